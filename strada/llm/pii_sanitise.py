"""Operator 5, personal data: information-theoretic sanitisation, in DataFrame functions only.

Base spans are e-mail and IP addresses, card and phone numbers, found by patterns and
checked (parts, Luhn, digits). They are the protected entities: each kind is one, and each
value (an address in lower case, a number's digits).

Which terms reveal them is estimated from the corpus. A context is a line without its base
spans, a term a run of three letters or more, in lower case. With N lines, n(e) of them with
the entity e, n(t) with the term and n(t, e) with both,

    PMI(t; e) = log2(n(t, e) N / (n(t) n(e)))      IC(e) = log2(N / n(e))

and PMI / IC is the share of the entity's information that the term gives away, 1 if it
never stands without one. In lines with an entity, terms at or over `general` are
generalised to the entity's kind and at or over `gone` removed, if that is no accident. Every
term that stands beside an entity is scored. The line by which the pair was found is left out: of
the term's n = n(t) - 1 other lines k = n(t, e) - 1 have the entity, where n p are expected, p =
n(e) / N. Chernoff's bound of the chance of so many is 2^-b with

    b = k log2(k / (n p)) + (n - k) log2((n - k) / (n (1 - p)))

and b must be at least `bits`. This depends on rates only, so a corpus repeated gives the same
terms or more. Where term and entity have a single line in common b is 0, whatever the
corpus: so values that no second line has need not be paired. Counts are over all lines of all
texts, copies too.

Positions are code points: the pieces between matches and the matches are laid end to end
by a running sum. A match never holds a line break, so lines can be searched alone.

Patterns are written possessively and anchored at the runs' beginnings, where that
cannot change what is found, so that no text takes time beyond its length; after a match the
next may begin at once, hence the \\G.

Defined results: a null text counts as empty and has no spans (the digest of the empty
string); rows with equal keys each get a result; further columns are not read; an empty
table gives an empty table.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL, numbered, scratch, small

KINDS = ("email", "ip", "card", "phone", "term")
# The patterns of the four base kinds.
PATTERNS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?+[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
TERM = r"\p{L}{3,}+"
BITS, GENERAL, GONE = 10.0, 0.8, 0.95


def _valid(kind: int, match: Column) -> Column:
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        part = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(match, r"\.", -1), lambda x: (F.length(part(x)) <= 3) & (F.coalesce(part(x).try_cast("int"), F.lit(0)) <= 255))
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == 2:
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(8, 15)


def _pieces(rows: DataFrame, text: str, pattern: str, *keep: str) -> DataFrame:
    """(keep..., at, gap, match): each match, and the length of what lies between it and the one before."""
    found = rows.withColumn("found", F.regexp_extract_all(text, F.lit(pattern), 0)).where(F.size("found") > 0)
    both = F.posexplode(F.arrays_zip(F.split(text, pattern, -1).alias("part"), F.col("found").alias("match"))).alias("at", "both")
    return found.select(*keep, both).where("both.match is not null").select(*keep, "at", F.length("both.part").alias("gap"), F.col("both.match").alias("match"))


def _placed(pieces: DataFrame, *of: str) -> DataFrame:
    """With start and end of each match, from 0, end exclusive."""
    so_far = F.sum(F.col("gap") + F.length("match")).over(Window.partitionBy(*of).orderBy("at"))
    return pieces.withColumn("end", so_far).withColumn("start", F.col("end") - F.length("match"))


def _found_in(text: Column, kind: int) -> Column:
    """The matches of one kind, each with what lies between it and the one before."""
    pattern = F.lit(PATTERNS[kind])
    both = F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("part"), F.regexp_extract_all(text, pattern, 0).alias("match"))
    each = F.transform(both, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), F.length(x["part"]).alias("gap"), x["match"].alias("match")))
    return F.filter(each, lambda x: x["match"].isNotNull())


#: Of each kind, a pattern that any match holds and that is quick to look for.
_HINTS = ("@[A-Za-z0-9-]", r"[0-9]\.[0-9]", "[0-9][ -]?[0-9]", r"\+[0-9]")


def base_spans(rows: DataFrame) -> DataFrame:
    """(row, kind, start, end) of (row, text): one scan, each document's matches laid out by itself."""
    none = F.array().cast("array<struct<kind:int,at:int,gap:int,match:string>>")
    each = [F.when(F.col("text").rlike(hint), _found_in(F.col("text"), kind)).otherwise(none) for kind, hint in enumerate(_HINTS)]
    pieces = rows.select("row", F.explode(F.concat(*each)).alias("piece")).select("row", "piece.*")
    valid = F.lit(False)
    for kind in range(len(PATTERNS)):
        valid = F.when(F.col("kind") == kind, _valid(kind, F.col("match"))).otherwise(valid)
    return _placed(pieces, "row", "kind").where(valid).select("row", "kind", F.col("start").cast("long"), F.col("end").cast("long"))


def _kinds_in(line: Column) -> Column:
    """The base kinds that a line holds."""
    held = [F.when(F.exists(F.regexp_extract_all(line, F.lit(p), 0), partial(_valid, k)), F.lit(k)) for k, p in enumerate(PATTERNS)]
    return F.array_compact(F.array(*held))


def _value(kind: int, match: Column) -> Column:
    value = F.lower(match) if kind == 0 else match if kind == 1 else F.regexp_replace(match, "[^0-9]", "")
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"))


def _values_in(line: Column) -> Column:
    """The base spans that a line holds, as (kind, value)."""
    held = [F.transform(F.filter(F.regexp_extract_all(line, F.lit(p), 0), partial(_valid, k)), partial(_value, k)) for k, p in enumerate(PATTERNS)]
    return F.array_distinct(F.concat(*held))


def _masked(line: Column) -> Column:
    """The line with blanks for its base spans that hold letters, which are e-mail addresses; its length stays."""
    address = F.lit(PATTERNS[0])
    blank = F.zip_with(F.split(line, PATTERNS[0], -1), F.regexp_extract_all(line, address, 0), lambda part, match: F.concat(part, F.coalesce(F.repeat(F.lit(" "), F.length(match)), F.lit(""))))
    return F.when(line.contains("@"), F.array_join(blank, "")).otherwise(line)


def _lines(rows: DataFrame) -> DataFrame:
    return rows.select("row", F.posexplode(F.split("text", "\n", -1)).alias("number", "line"))


def _terms(line: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(line), F.lit(TERM), 0))


def protected_lines(rows: DataFrame) -> DataFrame:
    """(row, start, line, kinds, values) of the lines with base spans, masked."""
    some = rows.where(F.col("text").rlike("|".join(_HINTS)))
    kinds = F.when(F.col("line").rlike("[0-9@]"), _kinds_in(F.col("line")))
    each = _lines(some).withColumn("kinds", kinds)
    # Lines without a span go on as a length only.
    narrow = each.select("row", "number", F.length("line").alias("n"), F.when(F.size("kinds") > 0, F.col("line")).alias("line"), "kinds")
    before = F.coalesce(F.sum(F.col("n") + 1).over(Window.partitionBy("row").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return narrow.withColumn("start", before).where("line is not null").select("row", "start", _masked(F.col("line")).alias("line"), "kinds", _values_in(F.col("line")).alias("values"))


def _joint(lines: DataFrame) -> DataFrame:
    """(term, kind, n_e, n_te) for each kind and each value, from two common lines on."""
    n_kinds = lines.select(F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n_e"))
    by_kind = lines.select(F.explode("kinds").alias("kind"), _terms(F.col("line")).alias("terms")).select("kind", F.explode("terms").alias("term"))
    by_kind = by_kind.groupBy("kind", "term").agg(F.count(F.lit(1)).alias("n_te")).where("n_te > 1").join(small(n_kinds, len(PATTERNS)), "kind")
    values = lines.select(F.explode("values").alias("v"), "line").select("v.kind", "v.value", "line")
    again = scratch(values.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n_e")).where("n_e > 1"), "values")
    by_value = values.join(small(again, again.count()), ["kind", "value"]).select("kind", "value", "n_e", F.explode(_terms(F.col("line"))).alias("term"))
    by_value = by_value.groupBy("kind", "value", "n_e", "term").agg(F.count(F.lit(1)).alias("n_te")).where("n_te > 1")
    return by_kind.select("term", "kind", "n_e", "n_te").unionByName(by_value.select("term", "kind", "n_e", "n_te"))


def _bits(n: Column, k: Column, p: Column) -> Column:
    """-log2 of Chernoff's bound of the chance that k or more of n have what a share p has; 0 if no more than expected."""
    part = lambda x, share: F.when(x > 0, x * F.log2(x / (n * share))).otherwise(0.0)
    return F.when(k > n * p, part(k, p) + part(n - k, 1 - p)).otherwise(0.0)


def disclosing(rows: DataFrame, lines: DataFrame, bits: float = BITS, general: float = GENERAL) -> DataFrame:
    """(term, kind, share): the terms that give an entity away, with the kind of the one they give away most."""
    joint = scratch(_joint(lines), "joint")
    named = joint.select("term").distinct()
    n_lines = rows.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    words = _lines(rows).select(F.explode(_terms(_masked(F.col("line")))).alias("term"))
    # Too many terms to broadcast: all are counted, on the map side first, and the counts are joined by a shuffle.
    few = named.count() <= SMALL
    n_terms = (words.join(F.broadcast(named), "term") if few else words).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    n, n_te, n_t, n_e = F.lit(float(n_lines)), F.col("n_te"), F.col("n_t"), F.col("n_e")
    share = F.try_divide(F.log2(n_te * n / (n_t * n_e)), F.log2(n / n_e))
    both = joint.join(n_terms, "term").select("term", "kind", share.alias("share"), _bits(n_t - 1, n_te - 1, n_e / n).alias("bits"))
    both = both.where((F.col("share") >= general) & (F.col("bits") >= bits))
    return both.groupBy("term").agg(F.max(F.struct("share", (-F.col("kind")).alias("k"))).alias("m")).select("term", (-F.col("m.k")).alias("kind"), "m.share")


def spans(rows: DataFrame, bits: float = BITS, general: float = GENERAL, gone: float = GONE) -> DataFrame:
    """(row, kind, start, end, to) of (row, text): base spans and terms, with what stands for each."""
    rows = rows.select("row", "text")
    base = scratch(base_spans(rows), "spans")
    lines = scratch(protected_lines(rows), "lines")
    terms = scratch(disclosing(rows, lines, bits, general), "terms")
    here = _pieces(lines.select("row", F.col("start").alias("line_start"), "line"), "line", TERM, "row", "line_start")
    at = _placed(here, "row", "line_start").withColumn("term", F.lower("match")).join(small(terms, terms.count()), "term")
    label = F.array(*[F.lit(f"[{k}-related]") for k in KINDS[:4]])
    found = at.select("row", F.lit(4).alias("kind"), (F.col("line_start") + F.col("start")).alias("start"), (F.col("line_start") + F.col("end")).alias("end"), F.when(F.col("share") >= gone, F.lit("")).otherwise(label[F.col("kind")]).alias("to"))
    own = base.withColumn("to", F.concat(F.lit("["), F.array(*[F.lit(k) for k in KINDS])[F.col("kind")], F.lit("]")))
    return own.unionByName(found)


def _is_kind(kind: int, span: Column) -> Column:
    return span["kind"] == kind


def _joined(spans_: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda s: F.concat(names[s["kind"]], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """One row per document: key, counts by kind, base_sha256 and all spans."""
    rows, _ = numbered(docs, key)
    found = spans(rows, **options).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("spans"))
    each = rows.select("row", key).join(found, "row", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")))
    counts = [F.size(F.filter("spans", partial(_is_kind, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    base = F.filter("spans", lambda s: s["kind"] < 4)
    return each.select(key, *counts[:4], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), counts[4])


def base_counts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: key and the number of base spans of each kind."""
    rows, _ = numbered(docs, key)
    each = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    found = base_spans(rows).groupBy("row").agg(*each)
    return rows.select("row", key).join(found, "row", "left").select(key, *[F.coalesce(f"n_{name}", F.lit(0).cast("long")).alias(f"n_{name}") for name in KINDS[:4]])


def sanitise(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """(key, text) with base spans replaced by their kind, and disclosing terms generalised or removed."""
    rows, _ = numbered(docs, key)
    # Overlapping base spans of two kinds: the earlier, then longer one stands.
    found = spans(rows, **options).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("back"), "to"))).alias("spans"))
    step = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct((-s["back"]).alias("at"), F.concat(a["out"], F.array(F.substring(F.col("text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), s["to"])).alias("out"))),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.lit(2**31 - 1))),
    )
    return rows.join(found, "row", "left").select(key, F.when(F.col("spans").isNull(), F.col("text")).otherwise(step).alias("text"))
