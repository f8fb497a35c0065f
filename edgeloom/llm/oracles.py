"""SQL for DuckDB of the conversation repair and the centroid clusters."""

from __future__ import annotations

_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: CRC-32 of an ASCII string, a bit at a time: each character is followed by seven steps that add nothing (polynomial 0xEDB88320).
_CRC32 = "xor(list_reduce(flatten(list_transform(string_split({}, ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])), lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384), 4294967295::BIGINT), 4294967295::BIGINT)"


def _more(x: str, cost: str, letter: str) -> str:
    """A state's cost in eight digits and audit after it, with an edit more; null stays null."""
    return f"lpad((substr({x}, 1, 8)::INT + {cost})::VARCHAR, 8, '0') || substr({x}, 9) || '{letter}'"


def _inserted(x: str) -> dict[int, str]:
    """States after insertions."""
    two = f"least({x}2, {_more(x + '0', '5', 'I')}, {_more(x + '1', '5', 'I')}, {_more(x + '3', '5', 'I')})"
    three = f"least({x}3, {_more(x + '2', '5', 'I')}, {_more(x + '0', '10', 'II')}, {_more(x + '1', '10', 'II')})"
    return {0: f"{x}0", 1: f"{x}1", 2: two, 3: three}


def _edited() -> dict[int, str]:
    """States after a turn: v0 to v3 with insertions made, role initial i, must_go and cut of the turn."""
    keep = lambda x, initial: f"CASE WHEN NOT must_go AND i = '{initial}' THEN {_more(x, 'cut', 'K')} END"
    rerole = lambda x: f"CASE WHEN NOT must_go THEN {_more(x, '1 + cut', 'R')} END"
    gone = {k: _more(f"w{k}", "2", "D") for k in range(4)}
    user = ", ".join(f"{keep(x, 'u')}, {rerole(x)}" for x in ("w0", "w1", "w3"))
    return {0: gone[0], 1: f"least({gone[1]}, {keep('w0', 's')})", 2: f"least({gone[2]}, {user})", 3: f"least({gone[3]}, {keep('w2', 'a')}, {rerole('w2')})"}


OP12_SQL = f"""
WITH RECURSIVE source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC32.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS lot FROM conversations
), hurt AS (
  SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role, CASE WHEN lot = 1 THEN '' WHEN lot = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN lot = 3 THEN [0, 1] ELSE [0] END) AS copy FROM source WHERE lot <> 0
), placed AS (
  SELECT *, coalesce(conv_id::VARCHAR, ' ') AS key, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || ':' || text)) AS k, left(role, 1) AS i FROM hurt
), looked AS (
  SELECT *, trim(text, {_SPACES}) = '' AS blank, row_number() OVER (PARTITION BY key, role, text ORDER BY k) > 1 AS again, right(rtrim(text, {_SPACES}), 1) IN ('.', '!', '?') AS closed, lag(i) OVER (PARTITION BY key ORDER BY k) AS before FROM placed
), coded AS (
  SELECT *, blank OR again AS must_go, CASE WHEN blank OR again OR closed THEN 0 ELSE 5 END AS cut FROM looked
), counts AS (
  SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
    count(*) FILTER (cut = 5) AS truncated, count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM coded GROUP BY key
), states AS (
  SELECT DISTINCT key, 0::BIGINT AS k, '00000000' AS v0, NULL::VARCHAR AS v1, NULL::VARCHAR AS v2, NULL::VARCHAR AS v3 FROM coded
  UNION ALL
  SELECT key, k, {", ".join(f"{x} AS v{j}" for j, x in _edited().items())}
  FROM (SELECT s.key, c.k, c.i, c.must_go, c.cut, {", ".join(f"{x} AS w{j}" for j, x in _inserted("s.v").items())} FROM states s JOIN coded c ON c.key = s.key AND c.k = s.k + 1)
), ended AS (
  SELECT key, least(v0, w3) AS whole FROM (SELECT key, {", ".join(f"{x} AS {'v0' if j == 0 else f'w{j}'}" for j, x in _inserted("v").items())} FROM states QUALIFY row_number() OVER (PARTITION BY key ORDER BY k DESC) = 1)
), audits AS (
  SELECT key, substr(whole, 1, 8)::BIGINT AS cost, substr(whole, 9) AS audit FROM ended
), letters AS (
  SELECT key, unnest(string_split(audit, '')) AS e, unnest(range(1, length(audit) + 1)) AS p FROM audits WHERE audit <> ''
), made AS (
  SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY key ORDER BY p) AS k, count(*) FILTER (e <> 'D') OVER (PARTITION BY key ORDER BY p) AS m, count(*) FILTER (e <> 'D') OVER (PARTITION BY key) % 2 AS system FROM letters
), repaired AS (
  SELECT m.key, sha256(coalesce(string_agg(CASE WHEN e = 'K' THEN c.role WHEN (m + system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE c.text END, chr(10) ORDER BY p) FILTER (e <> 'D'), '')) AS hash
  FROM made m LEFT JOIN coded c ON c.key = m.key AND c.k = m.k GROUP BY m.key
)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
  coalesce(audit, '') AS audit, coalesce(hash, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS key FROM conversations) d LEFT JOIN counts USING (key) LEFT JOIN audits USING (key) LEFT JOIN repaired USING (key)
"""


def _clusters(rounds: int = 5, k: int = 40) -> str:
    far = "list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [
        f"""WITH v AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS number, v FROM v QUALIFY number < {k})"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS (SELECT row, any_value(v.vec_id) AS vec_id, any_value(v.v) AS v, min({{'far': {far}, 'number': number}}) AS best FROM v, c{r} c GROUP BY row)""")
        if r < rounds:
            steps.append(f"""sum{r} AS (SELECT number, pos, sum(x) AS total, count(*) AS n FROM (SELECT best.number AS number, unnest(v) AS x, unnest(range(1, 65)) AS pos FROM near{r}) GROUP BY number, pos),
mean{r} AS (SELECT number, list(CAST(CASE WHEN total % n < 0 THEN total // n - 1 ELSE total // n END AS BIGINT) ORDER BY pos) AS v FROM sum{r} GROUP BY number),
c{r + 1} AS (SELECT c.number, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN mean{r} m USING (number))""")
    return ",\n".join(steps) + f"""
SELECT vec_id, CAST(best.number AS INT) AS cluster, CAST(best.far AS BIGINT) AS distance, CAST(sum(best.far) OVER (PARTITION BY best.number) AS BIGINT) AS cluster_inertia, CAST(sum(best.far) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM near{rounds} n JOIN c{rounds} c ON c.number = n.best.number"""


OP13_SQL = _clusters()
