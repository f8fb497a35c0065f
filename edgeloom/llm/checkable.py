"""Those columns of the numbered queries that SQL can express, each query run through its operator, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import avi, fingerprints, mixing, pii, secrets, warc
from .common import table

_KEYWORDS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN d[i]::INT WHEN d[i]::INT > 4 THEN 2 * d[i]::INT - 9 ELSE 2 * d[i]::INT END)) % 10 = 0"
#: kind -> (pattern, condition of a hit with its digits d), straight from the contracts.
_PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_bool_and(list_transform(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) < 4 AND ('0' || right(x, 3))::INT < 256))"),
    "card": (r"[0-9]([\x20-]?[0-9])+", f"length(d) BETWEEN 16 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 8 AND 15"),
}
_SECRETS = {
    "assign": (_ASSIGN, "length(regexp_extract(hit, '{}', 2)) >= 8".format(_ASSIGN.replace("'", "''"))),
    "access": ("AKIA[A-Z0-9]+", "length(hit) >= 16"),
    "hex": ("[0-9a-f]+", "length(hit) >= 32"),
}


def _spans_sql(kinds: dict[str, tuple[str, str]], order: str) -> str:
    """doc_id, n_<kind>..., base_sha256: hits and the pieces between them tile a text, so sums of their lengths are offsets."""
    parts = []
    for k, (kind, (pattern, keep)) in enumerate(kinds.items()):
        p = pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, {k} AS rank, '{kind}' AS kind, start, start + length(hit) AS stop FROM (
  SELECT doc_id, hits[k] AS hit, {_DIGITS.replace('hit', 'hits[k]')} AS d, list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) AS start FROM (
    SELECT doc_id, hits, regexp_split_to_array(text, '{p}') AS gaps, unnest(range(1, len(hits) + 1)) AS k FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{p}') AS hits FROM documents))) WHERE {keep}""")
    counts = ", ".join(f"count(*) FILTER (s.kind = '{kind}') AS n_{kind}" for kind in kinds)
    return "WITH s AS (" + "\nUNION ALL ".join(parts) + f""")
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(s.kind || ':' || s.start::BIGINT || ':' || s.stop::BIGINT, ',' ORDER BY {order}), '')) AS base_sha256 FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.digest(pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", *(f"n_{k}" for k in _PII), "base_sha256")


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", *(f"n_{k}" for k in _SECRETS), "base_sha256")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edits(table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "edited_sha256")


EDITED_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT *, length(text) AS n, length(text) // 3 AS cut, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS following FROM t)
SELECT doc_id, n AS n_chars, sha256(left(text, n - cut) || left(following, cut)) AS edited_sha256 FROM o
"""


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.digest(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


PAYLOAD_SQL = r"""
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), n AS (SELECT *, octet_length(b) AS n, greatest(1, (octet_length(b) + 63) // 64) * 64 AS m FROM b)
SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(b || repeat('\x00'::BLOB, m - n)) AS payload_sha256 FROM n
"""


def mixed_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id")
    sums = made.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("size").alias("size"), F.sum("taken").alias("taken"), F.max(F.col("taken") - 2 * F.col("size")).alias("over"))
    near = (F.abs(F.col("taken") - F.col("target")) <= 1) & (F.col("over") <= 0)
    return sums.select("source", "source_size", "size", F.round("target", 3).alias("target"), near.alias("met"))


#: The level at which min(2 * size, level * weight) sums up to 150 % of all sizes is that of the first source, by size per weight, which it leaves below its double.
MIXED_SQL = r"""
WITH w AS (SELECT source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM w GROUP BY source),
o AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS whole FROM s),
p AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source IS NULL, encode(source)) AS place FROM o),
l AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_, sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_ FROM p),
v AS (SELECT *, (SELECT arg_min((whole - full_) / open_, place) FROM l WHERE (whole - full_) / open_ * weight <= cap) AS level FROM l)
SELECT source, source_size, source_size AS size, round(CAST(least(cap, coalesce(level * weight, cap)) AS DOUBLE), 3) AS target, true AS met FROM v
"""


def warc_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived records, each with whether a response of its page is what it refers to."""
    made = warc.responses(table(spark, sf_dir, "pages"))
    known = made.select(F.col("page_id").alias("page"), F.regexp_extract(F.decode("warc", "utf-8"), r"WARC-Record-ID: (\S+)", 1).alias("refers_to"))
    found = warc.derive(made).select("page_id", "record_type", "target_uri", "refers_to", F.length("block").alias("n"))
    linked = found.join(known, (F.col("page") == F.col("page_id")) & (known["refers_to"] == found["refers_to"]), "left")
    return linked.select("page_id", "record_type", "target_uri", F.col("page").isNotNull().alias("linked"))


WARC_SQL = "SELECT page_id, kind AS record_type, coalesce(url, '') AS target_uri, true AS linked FROM pages, (VALUES ('metadata'), ('conversion')) t(kind)"

QUERIES = {
    "columns_of_op1_pii": pii_base,
    "columns_of_op3_fingerprints": edited_texts,
    "columns_of_op5_media_clips": payloads,
    "columns_of_op7_mixing": mixed_sums,
    "columns_of_op8_secrets": secrets_base,
    "columns_of_op9_warc": warc_links,
}
SQL = {
    "columns_of_op1_pii": _spans_sql(_PII, "s.rank, s.start"),
    "columns_of_op3_fingerprints": EDITED_SQL,
    "columns_of_op5_media_clips": PAYLOAD_SQL,
    "columns_of_op7_mixing": MIXED_SQL,
    "columns_of_op8_secrets": _spans_sql(_SECRETS, "s.start, s.rank"),
    "columns_of_op9_warc": WARC_SQL,
}
