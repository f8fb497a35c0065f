"""Secret scan over a trigram inverted index, in SQL expressions alone.

1. Each rule's regex yields a Boolean query over mandatory trigrams (:mod:`.trigrams`).
2. One window slides over each whole text and writes postings (trigram, document key) for the trigrams that any rule asks for.
3. Postings that meet all trigrams of one of a rule's sets are candidates of that rule; sets and terms are fixed by the rules.
4. Candidates alone are read again, and the regex verifies them over the whole text. A bitmap of candidate keys of bounded
   size (:func:`.common.marked`) is the only thing that every task receives; texts whose bit is not set go no further, so no
   text but a candidate's (and those that share its bit) can cross a shuffle.
5. Rules without mandatory trigrams scan every text in the map that also receives the spans of its document.

A document's key is a hash of doc_id and text: equal rows share postings, and an accidental collision only adds a candidate that
verification settles. A null text counts as empty; an empty table gives an empty result; repeated rows are answered one by one.
Of input columns, those named like results (found, n_<kind>) are replaced; all others pass.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trigrams
from .common import marked, text_of, written
from .spans import joined, labelled, locate


class Rule(NamedTuple):
    kind: str
    regex: str
    #: Keeps a match; receives its text.
    keep: object = None


#: Spans as they are sorted: by start, then by rule.
_FOUND = "array<struct<rank:int,start:bigint,end:bigint,kind:string>>"


def _value_length(hit: Column) -> Column:
    return F.length(F.regexp_extract(hit, r"""[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""", 1))


#: The first three are the base; possessive forms give the same matches in one pass over long runs.
RULES = [
    Rule("assign", r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++""", lambda hit: _value_length(hit) >= 8),
    Rule("access", r"AKIA[A-Z0-9]++", lambda hit: F.length(hit) >= 16),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}+"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}+"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN[A-Z\x20]{1,20}PRIVATE\x20KEY-----"),
]


def _keeps(rule: Rule) -> Callable[[Column], Column]:
    return lambda x: rule.keep(x["hit"])


def window(terms: list[str]) -> str:
    """A regex whose first group takes each occurrence of a trigram, overlapping ones as well; terms with one first letter share a branch."""
    heads: dict[str, list[str]] = {}
    for t in sorted(terms):
        heads.setdefault(t[0], []).append(t[1:])
    guard = "".join("[" + "".join(re.escape(c) for c in sorted({t[k] for t in terms})) + "]" for k in range(3))
    return f"(?={guard})(?=(" + "|".join(re.escape(h) + "(?:" + "|".join(map(re.escape, rest)) + ")" for h, rest in heads.items()) + "))"


def index(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Postings (term, __key) of the given trigrams; docs has __key and __text."""
    held = F.array_distinct(F.regexp_extract_all(F.lower("__text"), F.lit(window(terms)), F.lit(1)))
    return docs.select("__key", F.explode_outer(held).alias("term")).filter("term IS NOT NULL")  # explode would search twice, for its filter too


def candidates(postings: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(key, rules): documents whose postings meet one of a rule's sets, by counting the set's terms."""
    rows = [(kind, k, term, len(terms)) for kind, sets in queries.items() for k, terms in enumerate(sets) for term in sorted(terms)]
    quoted = ", ".join("('{}', {}, '{}', {})".format(a, b, c.replace("\\", "\\\\").replace("'", "\\'"), d) for a, b, c, d in rows)
    asked = postings.sparkSession.sql(f"SELECT * FROM VALUES {quoted} AS asked(kind, part, term, needed)")  # as long as the rules
    met = postings.join(F.broadcast(asked), "term").groupBy("__key", "kind", "part").agg(F.count_distinct("term").alias("met"), F.max("needed").alias("needed"))
    return met.filter("met = needed").groupBy("__key").agg(F.collect_set("kind").alias("__rules"))


def _spans(rules: list[tuple[int, Rule]]) -> Column:
    """(rank, start, end, kind) of the rules' columns; `rank` is the rule's place in the whole list."""
    return F.concat(*(labelled(f"__{r.kind}", r.kind, i) for i, r in rules))


def _kept(df: DataFrame, rules: list[Rule]) -> DataFrame:
    kept = {f"__{r.kind}": F.filter(f"__{r.kind}", _keeps(r)) for r in rules if r.keep}
    return df.withColumns(kept) if kept else df


def _count(kind: str) -> Column:
    return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")


def find_secrets(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """docs with `found`: an array of (start, rank, end, kind) in this order, rank being the rule's place; and n_<kind> of each rule."""
    rules = RULES if rules is None else rules
    queries = {r.kind: trigrams.query(r.regex) for r in rules}
    ranked = list(enumerate(rules))
    indexed, scanned = ([x for x in ranked if bool(queries[x[1].kind]) == asked] for asked in (True, False))
    docs = docs.drop("found", *(f"n_{r.kind}" for r in rules))
    keyed = docs.withColumn("__text", text_of(docs)).withColumn("__key", F.xxhash64("doc_id", "__text"))
    none = F.array().cast(_FOUND)
    found = keyed.withColumn("__scanned", none)
    if scanned:
        found = _kept(locate(keyed, "__text", {f"__{r.kind}": (r.regex, F.lit(True)) for _, r in scanned}), [r for _, r in scanned])
        found = found.withColumn("__scanned", _spans(scanned)).drop(*(f"__{r.kind}" for _, r in scanned))
    found = found.drop("__text")
    if indexed:
        slim = keyed.select("__key", "__text")
        terms = sorted({t for sets in queries.values() for s in sets for t in s})
        postings = written(index(slim, terms), "postings")
        chosen = written(candidates(postings, {r.kind: queries[r.kind] for _, r in indexed}), "candidates")
        read = locate(marked(slim, "__key", chosen).join(chosen, "__key"), "__text", {f"__{r.kind}": (r.regex, F.array_contains("__rules", r.kind)) for _, r in indexed})
        verified = _kept(read, [r for _, r in indexed]).select("__key", _spans(indexed).alias("__verified")).filter(F.size("__verified") > 0)
        verified = written(verified.groupBy("__key").agg(F.first("__verified").alias("__verified")), "verified")  # rows alike share a key and its spans
        found = found.join(verified, "__key", "left")
    else:
        found = found.withColumn("__verified", none)
    every = F.concat("__scanned", F.coalesce("__verified", none))
    by_start = F.array_sort(F.transform(every, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    found = found.withColumn("found", by_start).drop("__key", "__scanned", "__verified")
    return found.withColumns({f"n_{r.kind}": _count(r.kind) for r in rules})


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query: counts of the base kinds, the SHA-256 of their spans, all spans as text."""
    base = F.filter("found", lambda x: x["rank"] < 3)
    return found.select("doc_id", *(f"n_{r.kind}" for r in RULES[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
