"""Line dedup by site-relative frequency.

For every host, the pages that contain a line (stripped; blank lines don't count) are divided by the host's pages, and a line above
``ratio`` is boilerplate there and is dropped from all its pages. Pages of equal text are one page in both counts, so that
copies are no template. The ratio is smoothed as if each host had ``smooth`` more pages, without the line: a line of one page is
never boilerplate by that alone (1 / (1 + 20) < 0.05), two of a host's two or three pages are, and large hosts are hardly touched.
The rule is one and the same for hosts of any size.

Counting shuffles a host, a 64-bit line hash and a 64-bit text hash; counts are partial before the second shuffle, so that a
hot host or line meets as one row for each task. Since a boilerplate line is on more than ratio x pages of its host, a host has
less than (lines per page) / ratio of them: they are joined to the pages as one array for each host, by a broadcast where their
measured size is below ``broadcast_bytes``, else by a join that splits skewed hosts. Pages are never shuffled in the first case.

Defined results: null text stays null and is a page without lines; a text whose lines all go becomes empty; rows of a null host are
a host of their own; repeated rows are one page and get the same result; blank lines stay; an empty table stays empty; other
columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import let
from .scratch import Scratch

RATIO = 0.05
#: Pages without the line that each host is given besides its own.
SMOOTH = 20
BROADCAST_BYTES = 32 << 20


def line_keys(text: Column) -> Column:
    """Distinct hashes of the lines of a page that aren't blank."""
    return F.array_distinct(F.transform(F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.xxhash64(x)))


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, smooth: float = SMOOTH) -> DataFrame:
    """(host, line, pages, host_pages) of the lines above the ratio."""
    base = pages.select(host.alias("host"), F.xxhash64(F.coalesce(text, F.lit("")), text.isNull()).alias("page"), text.alias("text"))
    totals = base.groupBy(F.col("host").alias("h")).agg(F.count_distinct("page").alias("host_pages"))
    lines = base.select("host", "page", F.explode(line_keys(F.col("text"))).alias("line")).groupBy("host", "line").agg(F.count_distinct("page").alias("pages"))
    return lines.join(totals, F.col("host").eqNullSafe(F.col("h"))).where(F.col("pages") > ratio * (F.col("host_pages") + smooth)).select("host", "line", "pages", "host_pages")


def drop_lines(pages: DataFrame, host: Column, text_col: str = "text", ratio: float = RATIO, smooth: float = SMOOTH, broadcast_bytes: int = BROADCAST_BYTES, counts: bool = False) -> DataFrame:
    """The pages without their boilerplate lines (with ``n_lines`` and ``n_dropped``, if asked)."""
    work = Scratch(pages.sparkSession, "lines")
    found = work.save(boilerplate(pages, host, F.col(f"`{text_col}`"), ratio, smooth).groupBy("host").agg(F.collect_list("line").alias("listed")), "found", thin=True)
    size = found.agg(F.coalesce(F.sum(8 * F.size("listed") + F.coalesce(F.length("host"), F.lit(0))), F.lit(0))).first()[0]
    side = (F.broadcast(found) if size <= broadcast_bytes else found).withColumnRenamed("host", "h")
    text = F.col("page").getField(text_col)
    joined = pages.select(host.alias("host"), F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("page")).join(side, F.col("host").eqNullSafe(F.col("h")), "left")
    lines = F.split(text, "\n", -1)

    def without(hits: Column) -> Column:
        listed = lambda x: F.array_contains(hits, F.xxhash64(F.trim(x))) & (F.trim(x) != "")
        return F.struct(F.array_join(F.filter(lines, lambda x: ~listed(x)), "\n").alias("text"), F.size(F.filter(lines, listed)).cast("long").alias("dropped"))

    as_is = F.struct(text.alias("text"), F.lit(0).cast("long").alias("dropped"))
    # a host's list may be long; a page has few lines of it
    kept = F.when(F.col("listed").isNull() | text.isNull(), as_is).otherwise(let(F.array_intersect(line_keys(text), F.col("listed")), lambda hits: F.when(F.size(hits) == 0, as_is).otherwise(without(hits))))
    out = joined.select("page", kept.alias("kept"))
    more = [F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.col("kept.dropped").alias("n_dropped")] if counts else []
    return out.select(*(F.col("kept.text").alias(c) if c == text_col else F.col("page").getField(c).alias(c) for c in pages.columns), *more)
