"""Secret scans: patterns of known forms, and a battery of randomness tests for what they hold and for tokens of unknown form.

Base kinds are assignments to secret names, access keys and long hex strings; all their matches are reported. Other candidates are
tokens of 24 or more characters of a base-64 alphabet that mix letters and digits and overlap no base span; they are reported as
``random`` where the battery finds them so. It looks at every candidate, base or other (of an assignment, at the value), and says
for each whether it is random.

The encoding of a candidate is inferred (hex, base 32, alphanumeric, base 64). What a finding must reject is that the string has
structure, in each of three ways: its alphabet is used as unevenly as in text (chi-squared, whose expected excess over even use
grows with the length by ``UNEVEN``, against its normal approximation); its runs above and below the middle of the alphabet stray
from their expected number by ``STRAY`` root n standard errors; its characters follow from the ones before with a serial
correlation of ``SERIAL``. Each gives a one-sided p-value against the least structure of that kind, and a string is random only
if all three are rejected, so the largest of them is its p-value. Short strings have little power against structure and large
p-values. In each class of lengths, Benjamini-Hochberg at ``FDR`` bounds the share of structured strings among those found.
For that, p-values are counted by length class and bin (rounded up; at most LENGTHS x BINS counts reach the driver).

All of it is DataFrame expressions; texts are read once and never shuffled; what is written between is spans.

Defined results: null texts count as empty; empty texts have no spans; each of repeated rows is answered and counts once
among the p-values; offsets are code points, ends exclusive; an empty table gives no rows; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import let, running_sum
from .scratch import Scratch

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
NAMES = "(?i:password|passwd|secret|token|api_?key)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "(?<![0-9a-f])[0-9a-f]{32,}"
TOKEN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}"
FDR = 0.05
#: Structure that counts: excess of chi-squared for a character (what text makes it in such an alphabet: k times the sum of squared
#: frequencies, less one, for words with capitals and digits between; for hex, that of decimal digits), departure of runs, and serial correlation.
UNEVEN = {"hex": 0.5, "base32": 0.8, "alnum": 1.0, "base64": 1.0}
STRAY, SERIAL = 0.6, 0.6
LENGTHS = (32, 48, 64, 128)
BINS, PER_DECADE = 400, 20
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def matches(text: Column, pattern: str, kind: int, found: Column, values: Column | None = None, least: int = 0) -> Column:
    """Array of (start, kind, end, value) of the matches ``found`` of a pattern whose values (the matches themselves, if not told)
    have ``least`` characters."""
    told = found if values is None else values

    def build(gaps: Column) -> Column:
        sizes = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(gaps, i)))
        return let(running_sum(sizes), lambda e: F.transform(found, lambda m, i: F.struct((F.get(e, i) - F.length(m)).cast("long").alias("start"), F.lit(kind).alias("kind"), F.get(e, i).cast("long").alias("end"), F.get(told, i).alias("value"))))

    spans = let(F.split(text, pattern, -1), build)
    return F.when(F.size(found) > 0, F.filter(spans, lambda s: F.length(s["value"]) >= least)).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def below(z: Column) -> Column:
    """Chance of a normal deviate below z (Abramowitz and Stegun 26.2.17)."""
    x = F.least(F.abs(z), F.lit(37.0))
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    rest = poly * F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    return F.when(z < 0, rest).otherwise(1 - rest)


def encoding(token: Column) -> Column:
    return (
        F.when(token.rlike("^[0-9a-f]+=*$") | token.rlike("^[0-9A-F]+=*$"), "hex").when(token.rlike("^[A-Z2-7]+=*$"), "base32").when(token.rlike("^[A-Za-z0-9]+=*$"), "alnum").otherwise("base64")
    )


def battery(token: Column) -> Column:
    """(n, encoding, chi, runs, serial, p) of a token: the chance of at most so little structure in a string that has some."""

    def over(enc: Column) -> Column:
        body = F.regexp_replace(F.translate(token, "-_", "+/"), "=+$", "")
        body = F.when(enc == "hex", F.lower(body)).otherwise(body)
        letters = F.lit(None).cast("string")
        for name, a in ALPHABETS.items():
            letters = F.when(enc == name, F.lit(a)).otherwise(letters)
        return let(F.struct(body.alias("body"), letters.alias("abc")), lambda s: let(F.transform(F.filter(F.split(s["body"], ""), lambda c: c != ""), lambda c: F.instr(s["abc"], c) - 1), lambda x: stats(x, s["body"], F.length(s["abc"]).cast("double"), enc, s["abc"])))

    def stats(x: Column, body: Column, k: Column, enc: Column, abc: Column) -> Column:
        n = F.size(x).cast("double")
        squares = F.aggregate(F.filter(F.split(abc, ""), lambda c: c != ""), F.lit(0.0), lambda a, c: a + F.pow((F.length(body) - F.length(F.replace(body, c, F.lit("")))).cast("double"), F.lit(2.0)))
        excess = F.element_at(F.create_map(*(F.lit(v) for x in UNEVEN.items() for v in x)), enc) * n
        chi = (k / n * squares - n - (k - 1) - excess) / F.sqrt(2 * (k - 1) + 4 * excess)
        high = F.transform(x, lambda v: (v >= k / 2).cast("int"))

        def runs(b: Column) -> Column:
            up = F.aggregate(b, F.lit(0), lambda a, v: a + v).cast("double")
            r = 1 + F.size(F.filter(b, lambda v, i: (i > 0) & (v != F.get(b, i - 1)))).cast("double")
            mean = 1 + 2 * up * (n - up) / n
            var = (mean - 1) * (mean - 2) / (n - 1)
            return F.when(var <= 0, F.lit(9.0)).otherwise(F.abs(r - mean) / F.sqrt(F.greatest(var, F.lit(1e-9))) - STRAY * F.sqrt(n))

        m = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n

        def serial(m: Column) -> Column:
            top = F.aggregate(F.transform(x, lambda v, i: F.when(i > 0, (v - m) * (F.get(x, i - 1) - m)).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, v: a + v)
            under = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m))
            return F.when(under <= 0, F.lit(9.0)).otherwise((F.abs(top / F.greatest(under, F.lit(1e-9)) + 1 / n) - SERIAL) * F.sqrt(n))

        some = lambda z: F.when(n < 2, F.lit(1.0)).otherwise(z)  # noqa: E731  too short for any
        return let(
            F.struct(some(below(chi)).alias("chi"), some(below(let(high, runs))).alias("runs"), some(below(let(m, serial))).alias("serial")),
            lambda p: F.struct(n.cast("int").alias("n"), enc.alias("encoding"), p["chi"].alias("chi"), p["runs"].alias("runs"), p["serial"].alias("serial"), F.greatest(p["chi"], p["runs"], p["serial"]).alias("p")),
        )

    return let(encoding(token), over)


def length_class(n: Column) -> Column:
    return sum(((n >= x).cast("int") for x in LENGTHS), F.lit(0))


def p_bin(p: Column) -> Column:
    """The higher, the smaller p; the p-value at the bin's lower end is never less than p."""
    return F.greatest(F.lit(0), F.least(F.lit(BINS), F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) * PER_DECADE))).cast("int")


def rejections(counts: list[tuple[int, int, int]], fdr: float = FDR) -> dict[int, int]:
    """The least bin that Benjamini-Hochberg rejects in each length class. counts: (class, bin, tokens)."""
    out = {}
    for k in {c for c, _, _ in counts}:
        own = sorted(((b, n) for c, b, n in counts if c == k), reverse=True)
        total, so_far = sum(n for _, n in own), 0
        for b, n in own:
            so_far += n
            if 10 ** (-b / PER_DECADE) <= fdr * so_far / total:
                out[k] = b
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``spans``: (start, kind, end, value, p, random), by start and then by kind; p is null for an empty value."""
    work = Scratch(docs.sparkSession, "secrets")
    text = F.col("text")
    t = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    t = t.select(
        "id",
        "text",
        F.when(text.rlike(NAMES), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0))).otherwise(none).alias("assign"),
        F.when(text.contains("AKIA"), F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0))).otherwise(none).alias("access"),
        F.regexp_extract_all(text, F.lit(HEX), F.lit(0)).alias("hex"),
        F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("token"),
    )
    value = F.when(F.size("assign") > 0, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))).otherwise(none)
    t = t.select(
        "id",
        F.concat(matches(text, ASSIGN, 0, F.col("assign"), value, 8), matches(text, ACCESS, 1, F.col("access"), least=16), matches(text, HEX, 2, F.col("hex"))).alias("base"),
        F.filter(matches(text, TOKEN, 3, F.col("token")), lambda s: s["value"].rlike("[A-Za-z]") & s["value"].rlike("[0-9]")).alias("more"),
    )
    t = t.select("id", F.array_sort("base").alias("base"), F.filter("more", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))).alias("more"))
    t = work.save(t.select("id", F.array_sort(F.concat("base", "more")).alias("spans")), "spans")
    t = work.save(t.select("id", F.transform("spans", lambda s: F.struct(s.alias("span"), battery(s["value"]).alias("test"))).alias("spans")), "tested")
    counts = t.select(F.explode("spans").alias("m")).groupBy(length_class(F.col("m.test.n")).alias("c"), p_bin(F.col("m.test.p")).alias("b")).count().collect()
    least = rejections([(r["c"], r["b"], r["count"]) for r in counts])
    limit = lambda n: F.coalesce(*(F.when(length_class(n) == k, F.lit(b)) for k, b in sorted(least.items())), F.lit(BINS + 1))
    told = F.transform("spans", lambda m: F.struct(*(m["span"][c].alias(c) for c in ("start", "kind", "end", "value")), m["test"]["p"].alias("p"), (p_bin(m["test"]["p"]) >= limit(m["test"]["n"])).alias("random")))
    return t.select(F.col("id").alias(id_col), F.filter(told, lambda s: (s["kind"] < 3) | s["random"]).alias("spans"))
