"""Personal-data spans (O30): candidates by pattern, checks of their digits, one sweep over overlaps, redaction.

Everything happens inside the row and in the JVM: no shuffle, no Python.  A pattern takes whole runs (all the digits of a
number, all the parts of a dotted one), so a candidate never stands inside a longer run; what a pattern cannot say is checked on the
candidate: the Luhn sum and length of a card number, four octets of at most 255 of an address, four last digits of a
telephone number, no empty label in a mail domain.  Spans that overlap become one region, named after its longest span.

Positions are 0-based and count characters; ``stop`` is the position behind the last one.  Null and empty texts have no
spans; a null text is redacted to null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: categories in their order, with the patterns of their candidates ----
CANDIDATES = [
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("CARD", r"[0-9]{4}(?:[ -][0-9]{4}){3}[0-9]*|[0-9]+"),
    ("PHONE", r"\+[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]+"),
    ("IP", r"[0-9]+(?:\.[0-9]+)*"),
    ("SECRET", r"(?i)(?:token|secret|password|api_key|apikey) *[=:] *\"?[A-Za-z0-9_-]{16,}"),
]
CARD_LENGTHS = (13, 19)
OCTET = 255
# ------------------------------------------------------------------------------

_SPANS = "array<struct<start:int,stop:int,cat:string>>"
_REGIONS = "array<struct<start:int,stop:int,cat:string,longest:int,n:int>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check: from the right, every second digit doubled, nines cast out."""
    n = F.length(digits)
    weighed = F.transform(F.split(digits, ""), lambda c, i: F.when(
        (n - i) % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(weighed, F.lit(0), lambda a, d: a + d) % 10 == 0


def _checked(cat: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if cat == "CARD":
        grouped = ~found.rlike("^[0-9]+$")
        size = F.length(digits)
        return F.when(grouped, size == 16).otherwise(size.between(*CARD_LENGTHS)) & luhn(digits)
    if cat == "IP":
        parts = F.split(found, r"\.")
        return (F.size(parts) == 4) & F.forall(parts, lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, p).cast("int") <= OCTET))
    if cat == "PHONE":
        return F.length(F.regexp_extract(found, "-([0-9]+)$", 1)) == 4
    if cat == "EMAIL":
        return ~F.regexp_extract(found, "@(.*)$", 1).rlike(r"\.\.|^[.]")
    return F.lit(True)


def candidates(text: Column, cat: str, pattern: str) -> Column:
    """Spans of one category: what stands between two candidates tells where each of them starts."""
    between = F.transform(F.split(text, pattern, -1), F.length)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def span(m: Column, j: Column) -> Column:
        start = total(F.slice(between, 1, j + 1)) + total(F.transform(F.slice(found, 1, j), F.length))
        own = F.length(F.regexp_extract(m, "[A-Za-z0-9_-]+$", 0)) if cat == "SECRET" else F.length(m)       # of a secret, its value
        stop = start + F.length(m)
        return F.struct((stop - own).alias("start"), stop.alias("stop"), F.lit(cat).alias("cat"), _checked(cat, m).alias("ok"))

    ok = F.filter(F.transform(found, span), lambda s: s["ok"])
    return F.transform(ok, lambda s: F.struct(s["start"], s["stop"], s["cat"]))


def spans(text: Column) -> Column:
    """All checked spans of a text in order of (start, longest first, category)."""
    every = F.flatten(F.array(*[candidates(text, cat, p) for cat, p in CANDIDATES])).cast(_SPANS)
    order = F.transform(every, lambda s: F.struct(s["start"], (-s["stop"]).alias("last"), F.array_position(
        F.array(*[F.lit(c) for c, _ in CANDIDATES]), s["cat"]).alias("no"), s["stop"].alias("stop"), s["cat"].alias("cat")))
    return F.coalesce(F.transform(F.array_sort(order), lambda s: F.struct(s["start"], s["stop"], s["cat"])), F.array().cast(_SPANS))


def regions(ordered: Column) -> Column:
    """One sweep: spans that share characters become a region, named after its longest span (the first of equally long ones)."""
    def step(done: Column, s: Column) -> Column:
        last, size = F.element_at(done, -1), s["stop"] - s["start"]
        longer = size > last["longest"]
        joined = F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"),
                          F.when(longer, s["cat"]).otherwise(last["cat"]).alias("cat"), F.greatest(last["longest"], size).alias("longest"),
                          (last["n"] + 1).alias("n"))
        own = F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["cat"].alias("cat"), size.alias("longest"), F.lit(1).alias("n"))
        meets = (F.size(done) > 0) & (s["start"] < F.when(F.size(done) > 0, last["stop"]))
        return F.when(meets, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(own))).cast(_REGIONS)

    return F.aggregate(ordered, F.array().cast(_REGIONS), step)


def redacted(text: Column, found: Column) -> Column:
    """The text with every region replaced by its category in brackets."""
    def piece(r: Column, j: Column) -> Column:
        before = F.when(j > 0, F.get(found, j - 1)["stop"]).otherwise(0)
        return F.concat(F.substring(text, before + 1, r["start"] - before), F.lit("["), r["cat"], F.lit("]"))

    end = F.coalesce(F.get(found, F.size(found) - 1)["stop"], F.lit(0))
    return F.concat(F.array_join(F.transform(found, piece), ""), F.substring(text, end + 1, F.length(text)))


def pii_spans(df: DataFrame, text_col: str, key: str) -> DataFrame:
    """``key``, ``start``, ``stop``, ``category``, ``n_spans``: a row per region."""
    rows = df.select(key, spans(F.col(text_col)).alias("_s")).select(key, F.explode_outer(regions(F.col("_s"))).alias("_r"))
    return (rows.where(F.col("_r").isNotNull())
            .select(key, "_r.start", "_r.stop", F.col("_r.cat").alias("category"), F.col("_r.n").alias("n_spans")))


def redact(df: DataFrame, text_col: str, out: str = "redacted") -> DataFrame:
    """``df`` with ``out``, the redacted text, and ``n_regions``."""
    found = df.withColumn("_s", spans(F.col(text_col))).withColumn("_f", regions(F.col("_s")))
    return found.withColumn(out, redacted(F.col(text_col), F.col("_f"))).withColumn("n_regions", F.size("_f")).drop("_s", "_f")
