"""Personal data by candidate gradient boosting, in SQL expressions alone.

1. Base matchers give the spans of fixed formats: emails, IPv4 addresses, cards that pass Luhn, phone numbers. They always stay.
2. High-recall generators propose further, overlapping spans of the same kinds.
3. Boosted trees, one set a kind, score each proposal by its shape and context, but not by what sets the base formats apart (a plus sign); they learn on
   the whole table. A proposal is positive if it holds a base span of its kind, or by evidence that the base formats do not
   ask for: a named top-level domain, octets in range, a check sum with the range and length of an issuer, the grouping of a telephone number or
   a word for telephones before it. All other proposals are negatives. Each document has a twin in which what the base formats find is broken (domains
   without their ends, octets beyond range, swapped digits), so look-alikes are among the negatives wherever a kind occurs. What names the evidence (domain,
   octets, issuer, grouping) is not a feature: trees must find it from counts, values and surroundings.
4. A hash of doc_id keeps a fifth of the documents from the trees; thresholds, one a kind, are calibrated on all of this fifth to a precision of PRECISION against these labels, over all proposals, base spans and twins included;
   a kind that cannot reach it, or has no positives or no negatives, adds nothing.

Proposals are folded into their distinct rows with counts, by one aggregate over the whole table, before any tree is grown. Trees and thresholds become one SQL
expression, so a corpus is scored in one map without any shuffle. A null text counts as empty;
rows of one doc_id are scored one by one. `find_pii` replaces input columns named like its results (RESULTS), all others pass; `redact`
passes every column but the text. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import text_of, written
from .spans import joined, labelled, locate

KINDS = ("email", "ip", "card", "phone")
#: The precision that a threshold must keep.
PRECISION = 0.98
_LOCAL = "[A-Za-z0-9._%+-]"
#: Possessive forms of the base formats: the same matches in one pass over long runs.
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![^\s@])[^\s@]++@[^\s@]++",
    "ip": r"(?<![0-9.])[0-9]{1,4}+(?:\.[0-9]{1,4}+){3,5}+(?::[0-9]{1,5}+)?+",
    "card": r"(?<![0-9])[0-9](?:[\x20._-]?+[0-9]){12,18}+(?![0-9])",
    "phone": r"(?<![0-9+])(?<![0-9][\x20.-])(?:\+|\()?+[0-9](?:[\x20()./-]{0,2}+[0-9]){6,14}+(?![0-9])",
}
#: lead: first digit; peak: largest number of a dotted one, in steps of 16; ends: dots within the part after the last @; last: letters after the last dot;
#: joined: digits go on before it, a space, dot or dash between.
FEATURES = ["length", "digits", "letters", "marks", "dots", "luhn", "lead", "peak", "ends", "last", "dated", "joined", "before", "after", "cue"]
#: Words shortly before a span that name its kind.
CUES = {
    "email": r"mail|contact|write|(?<!\p{L})(?:from|to|cc)(?!\p{L})",
    "ip": r"server|host|addr|(?<!\p{L})ip(?!\p{L})",
    "card": r"card|visa|master|amex|credit|debit|payment|(?<!\p{L})(?:cc|pan)(?!\p{L})",
    "phone": r"phone|mobile|contact|whatsapp|(?<!\p{L})(?:tel|call|fax|cell|sms|dial|ring)(?!\p{L})",
}
#: Digits of cards by the ranges and lengths that issuers use.
ISSUERS = r"^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|(?:5[1-5]|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12,14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|(?:6011|65[0-9]{2}|64[4-9][0-9])[0-9]{12,15}|35[0-9]{14}|62[0-9]{14,17})$"
#: Addresses with a top-level domain of letters, punctuation around them aside.
DOMAIN = r"^[^\p{L}\p{N}]*+[\p{L}\p{M}\p{N}._%+'-]+@(?:[\p{L}\p{N}][\p{L}\p{M}\p{N}-]*+\.)+\p{L}{2}[\p{L}\p{M}]*+[^\p{L}\p{N}]*+$"
#: Telephone numbers by grouping: an area code in brackets, three groups of 3, 3 and 4, or a trunk zero before groups.
GROUPED = r"^(?:(?:\+?[0-9]{1,3}[\x20./-]?)?\([0-9]{2,5}\)[\x20./-]{0,2}[0-9]{3,4}[\x20./-]?[0-9]{3,5}|(?:\+?[0-9]{1,3}([\x20./-]))?[2-9][0-9]{2}([\x20./-])[0-9]{3}\2[0-9]{4}|0[0-9]{1,4}(?:[\x20/-][0-9]{2,8}){1,4})$"
#: Dates, with or without a time, dotted quads and plain decimals.
DATED = r"^\(?(?:(?:19|20)[0-9]{2}[./-]?[01]?[0-9][./-]?[0-3]?[0-9](?![0-9])|[0-3]?[0-9][./-][0-3]?[0-9][./-](?:19|20)?[0-9]{2}(?![0-9])|[0-9]{1,4}(?:\.[0-9]{1,4}){3}$|[0-9]+\.[0-9]+$)"
_WINDOW = 24


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check sum of 1 to 30 digits is a multiple of ten."""
    from_right = F.reverse(digits)

    def step(total: Column, k: Column) -> Column:
        d = F.substring(from_right, k, F.lit(1)).cast("int") * (2 - k % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _octets(text: Column) -> Column:
    """Whether the dotted numbers are at most 255."""
    return text.rlike(r"^0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])?(?:\.0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])?){3}$")


def _valid(kind: str, hit: Column) -> Column:
    n = F.length(_digits(hit))
    # digits are counted first, so that long runs of digits cost no check sum
    card = F.when(n.between(16, 19), _luhn(F.when(n.between(16, 19), _digits(hit)).otherwise("0"))).otherwise(False)
    return {"email": F.lit(True), "ip": _octets(hit), "card": card, "phone": n.between(8, 15)}[kind]


def _keeps(kind: str) -> Callable[[Column], Column]:
    return lambda x: _valid(kind, x["hit"])


def _class(char: Column) -> Column:
    return F.when(char == "", 0).when(char.rlike(r"^\s"), 1).when(char.rlike("^[0-9]"), 2).when(char.rlike(r"^\p{L}"), 3).otherwise(4)


def _proposals(kind: str, labels: bool) -> Column:
    """Structs of features for the proposals of a kind; `known` tells whether one is a base span, with `labels` `label` tells whether it holds one or has other evidence."""
    known = F.col(f"__base_{kind}")

    def features(x: Column) -> Column:
        hit, digits = x["hit"], _digits(x["hit"])
        n = F.length(digits)
        head = F.substring(F.col("__text"), F.greatest(F.lit(1), (x["start"] - _WINDOW + 1).cast("int")), F.least(F.lit(_WINDOW), x["start"].cast("int")))
        tail = F.substring(F.col("__text"), (x["end"] + 1).cast("int"), F.lit(1))
        capped = lambda c, most: F.least(c, F.lit(most)).cast("int")
        # each kind computes what it can use only; a long address costs no further pattern
        asked = lambda found, *kinds: (found if kind in kinds else F.lit(0)).cast("int")
        luhn = F.when(n.between(13, 19), _luhn(F.when(n.between(13, 19), digits).otherwise("0"))).otherwise(False)
        domain = F.substring_index(hit, "@", -1)
        parts = F.transform(F.split(F.regexp_replace(hit, ":.*", ""), r"\."), lambda v: F.when(F.length(v) < 5, F.try_to_number(v, F.lit("9999")).cast("int")).otherwise(511))
        found = {
            "length": capped(F.length(hit), 40), "digits": capped(n, 24), "letters": capped(F.length(F.regexp_replace(hit, r"[^\p{L}]", "")), 24),
            "marks": capped(F.length(F.regexp_replace(hit, r"[\p{L}0-9\s]", "")), 12), "dots": asked(capped(F.length(F.regexp_replace(hit, r"[^.]", "")), 6), "ip", "card", "phone"),
            "luhn": asked(luhn, "card", "phone"), "lead": asked(F.coalesce(F.substring(digits, 1, 1).try_cast("int"), F.lit(10)), "card", "phone"),
            "peak": asked(F.floor(F.least(F.coalesce(F.array_max(parts), F.lit(511)), F.lit(511)) / 16), "ip"),
            "ends": asked(capped(F.regexp_count(domain, F.lit(r"\.[\p{L}\p{N}]")), 6), "email"),
            "last": asked(F.when(F.contains(domain, F.lit(".")), capped(F.length(F.regexp_replace(F.substring_index(domain, ".", -1), r"[^\p{L}]", "")), 8)).otherwise(0), "email"),
            "dated": asked(hit.rlike(DATED), "phone"), "joined": asked(head.rlike(r"[0-9][\x20.-]?$"), "card"), "before": _class(F.substring(head, -1, 1)), "after": _class(tail), "cue": F.lower(head).rlike(CUES[kind]).cast("int"),
        }
        columns = [x["start"].alias("start"), x["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind"), *(found[f].alias(f) for f in FEATURES)]
        columns.append(F.exists(known, lambda b: (b["start"] == x["start"]) & (b["end"] == x["end"])).alias("known"))
        if labels:
            issued = luhn & digits.rlike(ISSUERS)
            named = (F.length(hit) <= 320) & F.when(F.length(hit) <= 320, hit).otherwise("").rlike(DOMAIN)
            other = {
                "email": named, "ip": _octets(F.regexp_replace(hit, ":.*", "")), "card": issued,
                "phone": n.between(7, 15) & ~hit.rlike(DATED) & ~issued & (hit.rlike(GROUPED) | F.lower(head).rlike(CUES[kind])),
            }[kind]
            holds = F.exists(known, lambda b: (b["start"] >= x["start"]) & (b["end"] <= x["end"]))
            columns.append((holds | other).cast("int").alias("label"))
        return F.struct(*columns)

    return F.transform(f"__wide_{kind}", features)


def _broken(text: Column) -> Column:
    """A text whose emails have lost the ends of their domains, dotted numbers begin beyond 255, and numbers have swapped their last two digits and stand in fours."""
    text = F.regexp_replace(text, r"(@[A-Za-z0-9-]{1,64}+)(?:\.[A-Za-z0-9-]{1,64}+)++", "$1")
    text = F.regexp_replace(text, r"(?<![0-9.])([0-9]{1,2}+(?:\.[0-9]{1,3}+){3}+)(?![0-9.])", "40$1")
    text = F.regexp_replace(text, r"(?<![0-9.])[0-9]{3}+((?:\.[0-9]{1,3}+){3}+)(?![0-9.])", "412$1")
    text = F.regexp_replace(text, r"(?<=[0-9]{3})([0-9])([0-9])(?![0-9])", "$2$1")
    return F.regexp_replace(text, r"([0-9]{4})-?(?=[0-9]{4})", "$1 ")


def _candidates(docs: DataFrame, labels: bool = False) -> DataFrame:
    """docs (with __text) and, by kind, base spans `__base_` and proposals `__more_`."""
    digit = F.col("__text").rlike("[0-9]")
    when = {"email": F.contains("__text", F.lit("@")), "ip": digit, "card": digit, "phone": F.contains("__text", F.lit("+"))}
    docs = docs.withColumn("__digit", digit)
    when |= {"ip": F.col("__digit"), "card": F.col("__digit")}
    wide = when | {"phone": F.col("__digit")}
    found = locate(docs, "__text", {f"__base_{k}": (BASE[k], when[k]) for k in KINDS} | {f"__wide_{k}": (WIDE[k], wide[k]) for k in KINDS})
    found = found.withColumns({f"__base_{k}": F.filter(f"__base_{k}", _keeps(k)) for k in KINDS})
    found = found.withColumns({f"__more_{k}": _proposals(k, labels) for k in KINDS})
    return found.drop("__digit", *(f"__wide_{k}" for k in KINDS))


def train(docs: DataFrame, precision: float = PRECISION) -> tuple[dict[str, list[boosting.Split | float]], dict[str, float]]:
    """Trees and the threshold of each kind, from all documents."""
    whole = docs.select("doc_id", text_of(docs).alias("__text"))
    twins = whole.unionByName(whole.withColumn("__text", _broken(F.col("__text"))))
    every = _candidates(twins, labels=True).select("doc_id", F.explode(F.concat(*(f"__more_{k}" for k in KINDS))).alias("x")).select("doc_id", "x.*")
    held = (F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(5)) == 0).cast("int").alias("held")
    folded = written(every.groupBy("kind", *FEATURES, "label", held).agg(F.count("*").alias("n")), "candidates")
    fitted = boosting.fit(folded.filter("held = 0"), FEATURES, list(range(len(KINDS))))
    score = F.lit(0.0)
    for k in range(len(KINDS)):
        score = F.when(F.col("kind") == k, boosting.probability(fitted[k], F.col)).otherwise(score)
    bins = folded.filter("held = 1").groupBy("kind", F.floor(score * 100).alias("bin")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("good")).collect()  # 101 bins a kind at most
    trees, thresholds = {kind: fitted[k] for k, kind in enumerate(KINDS)}, {}
    for k, kind in enumerate(KINDS):
        if len(fitted[k]) == 1:  # a constant, for want of positives, of negatives or of a split
            continue
        n = good = 0
        for r in sorted((r for r in bins if r.kind == k), key=lambda r: -r.bin):
            n, good = n + r.n, good + r.good
            if good >= precision * n:
                thresholds[kind] = r.bin / 100
    return trees, thresholds


def find_pii(docs: DataFrame, precision: float = PRECISION, model: tuple[dict[str, list[boosting.Split | float]], dict[str, float]] | None = None) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone, `base` and `spans`: arrays of (rank, start, end, kind) by kind and start. A model of `train` may come from other documents."""
    docs = docs.drop(*RESULTS)
    trees, thresholds = train(docs, precision) if model is None else model
    found = _candidates(docs.withColumn("__text", text_of(docs)))

    def more(rank: int, kind: str) -> Column:
        chosen = F.filter(f"__more_{kind}", lambda x: ~x["known"] & (boosting.probability(trees[kind], lambda f: x[f]) >= thresholds[kind])) if kind in thresholds else F.array().cast("array<struct<start:bigint,end:bigint>>")
        return F.transform(chosen, lambda x: F.struct(F.lit(rank).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    found = found.withColumns({"base": F.concat(*(labelled(f"__base_{k}", k, i) for i, k in enumerate(KINDS))), "__added": F.concat(*(more(i, k) for i, k in enumerate(KINDS)))})
    counts = {f"n_{k}": F.size(f"__base_{k}").cast("long") for k in KINDS}
    return found.withColumns({**counts, "spans": F.array_sort(F.array_distinct(F.concat("base", "__added")))}).drop("__text", "__added", *(f"__{p}_{k}" for p in ("base", "more") for k in KINDS))


#: Columns that find_pii adds.
RESULTS = (*(f"n_{k}" for k in KINDS), "base", "spans")


def redact(docs: DataFrame) -> DataFrame:
    """docs with the characters of all spans as '*'; a null text stays null, all other columns pass whatever their names."""
    own = {c: f"__own_{c}" for c in docs.columns if c in RESULTS}  # names of results that the input has as well
    found = find_pii(docs.withColumnsRenamed(own)) if own else find_pii(docs)
    chars = F.split(text_of(found), "")
    # spans by kind overlap: joined by start into stretches, each is replaced once, so a text is copied once and not once a span
    spans = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))

    def step(acc: Column, x: Column) -> Column:
        begin = F.greatest(acc["at"], x["start"])
        more = x["end"] > begin
        kept = F.array_join(F.slice("__chars", (acc["at"] + 1).cast("int"), F.greatest(F.lit(0), begin - acc["at"]).cast("int")), "")
        stars = F.repeat(F.lit("*"), F.greatest(F.lit(0), x["end"] - begin).cast("int"))
        parts = F.when(more, F.concat(acc["out"], F.array(kept, stars))).otherwise(acc["out"])
        return F.struct(F.when(more, x["end"]).otherwise(acc["at"]).alias("at"), parts.alias("out"))

    def end(acc: Column) -> Column:
        rest = F.array_join(F.slice("__chars", (acc["at"] + 1).cast("int"), F.greatest(F.lit(0), F.size("__chars") - acc["at"]).cast("int")), "")
        return F.concat(F.array_join(acc["out"], ""), rest)

    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    hidden = F.when(F.size("spans") > 0, F.aggregate(spans, first, step, end)).otherwise(F.col("text"))
    found = found.withColumn("__chars", F.when(F.size("spans") > 0, chars).otherwise(F.array().cast("array<string>")))
    return found.withColumn("text", hidden).select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query: counts, the SHA-256 of the base spans, all spans as text."""
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
