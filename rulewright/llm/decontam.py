"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are all runs of ``width`` words of the benchmark items (an item of fewer words is one pattern). Words are the
alphabet and two adjacent words a block: a shift table of fixed size says for the block under the cursor how far the cursor
can move without passing the end of any pattern; where it says nought, the block's bucket gives the patterns that end so,
and comparing all their words, one by one, confirms an occurrence (words are 64-bit hashes of their bytes throughout; two of
1e7 different words share one with a chance below 1e-5). Texts are cut into lanes of equal length that overlap by a pattern
less a word, and the cursors of all lanes of a batch move together, so that a step is one NumPy operation and a very long
text is many lanes.

The benchmark is the stated query set: it is read in blocks of at most ``block_words`` words, each block's tables go to the
executors as one broadcast of bounded size, and the documents are scanned against each block, up to ``BLOCKS_AT_ONCE`` of them in
a pass. A larger benchmark takes more passes; what each has found is stored by the document's place in the table (a row number that
is given once, when the texts are written for it), and put together at the end, so that no text is written again. In one pass,
nothing is shuffled.

Defined results: null or empty texts have no words and no hits; items without words match nothing; repeated items each count;
repeated documents each get a row; an empty benchmark leaves every document clean; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as X
from .scratch import Scratch

WIDTH = 10
#: Entries of the shift table.
TABLE = 1 << 18
#: Words of the benchmark that one block of tables holds at most (about 100 bytes each).
BLOCK_WORDS = 200_000
#: Blocks whose tables are on the executors at a time; each lot of so many is a pass over the documents.
BLOCKS_AT_ONCE = 8
LANE = 256
FOUND = ("n_words", "n_hit", "hits", "items")
U = np.uint64


class WuManber:
    """Tables for patterns of one length m over 64-bit symbols."""

    def __init__(self, patterns: np.ndarray, owners: list[list[int]]):
        self.m = m = patterns.shape[1]
        self.block = b = min(2, m)
        self.shift = np.full(TABLE, m - b + 1, np.uint8 if m < 200 else np.int32)
        for end in range(b, m + 1):  # blocks that end at this place of a pattern
            np.minimum.at(self.shift, self.slot(patterns, end), m - end)
        tail = self.tail(patterns, m)
        order = np.argsort(tail, kind="stable")
        self.patterns, self.tails, self.owners = patterns[order], tail[order], [owners[i] for i in order]

    def tail(self, rows: np.ndarray, end: int) -> np.ndarray:
        x = rows[:, end - 1]
        return X.mix(x * U(3) + (rows[:, end - 2] if self.block == 2 else U(0)))

    def slot(self, rows: np.ndarray, end: int) -> np.ndarray:
        return (self.tail(rows, end) >> U(64 - 18)).astype(np.int64)

    def search(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and pattern of every occurrence in rows h[at[i]:at[i+1]]."""
        m, none = self.m, np.zeros(0, np.int64)
        lanes = [(np.arange(a + m - 1, e, LANE)) for a, e in zip(at[:-1], at[1:], strict=True) if e - a >= m]
        if not lanes:
            return none, none
        cur = np.concatenate(lanes)
        ends = np.concatenate([np.minimum(x + LANE, e) for x, (a, e) in zip(lanes, ((a, e) for a, e in zip(at[:-1], at[1:], strict=True) if e - a >= m), strict=True)])
        found_at, found = [], []
        while len(cur):
            t = X.mix(h[cur] * U(3) + (h[cur - 1] if self.block == 2 else U(0)))
            s = self.shift[(t >> U(64 - 18)).astype(np.int64)]
            hit = np.flatnonzero(s == 0)
            if len(hit):
                c, lo = cur[hit], np.searchsorted(self.tails, t[hit], "left")
                hi = np.searchsorted(self.tails, t[hit], "right")
                while len(c := c[(go := lo < hi)]):
                    lo, hi = lo[go], hi[go]
                    same = (self.patterns[lo] == h[c[:, None] + np.arange(1 - m, 1)]).all(1)
                    found_at.append(c[same] - m + 1)
                    found.append(lo[same])
                    lo = lo + 1
            cur = cur + np.maximum(s, 1)
            go = cur < ends
            cur, ends = cur[go], ends[go]
        return (np.concatenate(found_at), np.concatenate(found)) if found else (none, none)


def build(items: list[tuple[object, str | None]], width: int = WIDTH) -> list[tuple[WuManber, None]]:
    """Tables by pattern length; owners are places in ``items``."""
    by: dict[int, dict[tuple, set[int]]] = {}
    data, offs = X.utf8(pa.array([t for _, t in items], pa.string()))
    h, _, at = X.words(data, offs, X.ALNUM)
    for i in range(len(items)):
        w = h[at[i] : at[i + 1]]
        m = min(width, len(w))
        for s in range(len(w) - m + 1 if m else 0):
            by.setdefault(m, {}).setdefault(tuple(w[s : s + m].tolist()), set()).add(i)
    return [WuManber(np.array(list(p), U), [sorted(x) for x in p.values()]) for m, p in sorted(by.items())]


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[object, str | None]]]:
    """The benchmark in blocks of bounded size; one block at a time is on the driver."""
    some, size = [], 0
    for r in benchmark.select(item_col, text_col).orderBy(item_col, text_col).toLocalIterator():
        n = len((r[1] or "").split()) + 1
        if some and size + n > block_words:
            yield some
            some, size = [], 0
        some.append((r[0], r[1]))
        size += n
    yield some


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, keep: list[str] | None = None, block_words: int = BLOCK_WORDS, blocks_at_once: int = BLOCKS_AT_ONCE) -> DataFrame:
    """The kept columns (the id if none are named) of each document with ``n_words``, ``hits`` (array of first and last
    word of each maximal hit run) and ``items`` (items with occurring windows, as strings, sorted)."""
    keep = keep or [id_col]
    run_t = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hits", run_t), T.StructField("items", T.ArrayType(T.StringType()))])

    def over(tables: list, columns: list[str], only_hits: bool = False):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                data, offs = X.utf8(b.column(b.num_columns - 1))
                for i, j in X.pieces(offs, 1 << 18):
                    out = scan(b.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], tables, columns)
                    yield out.filter(pa.array(out.column("n_hit").to_numpy() > 0)) if only_hits else out
            X.release()

        return run

    def scan(b: pa.RecordBatch, data: np.ndarray, offs: np.ndarray, tables: list, columns: list[str]) -> pa.RecordBatch:
        h, row, at = X.words(data, offs, X.ALNUM)
        mark = np.zeros(len(h) + 1, np.int64)
        items: dict[int, set[str]] = {}
        for t in tables:
            built, names = t.value
            for wm in built:
                first, which = wm.search(h, at)
                np.add.at(mark, first, 1)
                np.add.at(mark, first + wm.m, -1)
                for r, k in set(zip(row[first].tolist(), which.tolist(), strict=True)):
                    items.setdefault(r, set()).update(names[o] for o in wm.owners[k])
        hit = np.cumsum(mark[:-1]) > 0
        n = len(offs) - 1
        before = np.concatenate([[0], np.cumsum(hit)])
        n_hit = before[at[1:]] - before[at[:-1]]
        runs: list[list[dict]] = [[] for _ in range(n)]
        for r in np.flatnonzero(n_hit):
            x = np.concatenate([[False], hit[at[r] : at[r + 1]], [False]])
            e = np.flatnonzero(x[1:] != x[:-1]).reshape(-1, 2)
            runs[r] = [{"first": int(a), "last": int(z) - 1} for a, z in e]
        more = [pa.array(np.diff(at), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(runs, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), pa.array([sorted(items.get(r, ())) for r in range(n)], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(columns))), *more], names=[*columns, *FOUND])

    df = docs.select(*keep, F.col(text_col).alias("__text"))
    sc = docs.sparkSession.sparkContext
    lots = at_once(blocks(benchmark, item_col, item_text, block_words), blocks_at_once)
    lot, after = next(lots), next(lots, None)
    if after is None:
        return df.mapInArrow(over(broadcasts(sc, lot, width), keep), schema)
    work = Scratch(docs.sparkSession, "decontam")
    df = work.save(df.select(F.monotonically_increasing_id().alias("__no"), *keep, "__text"), "numbered")
    narrow = T.StructType([T.StructField("__no", T.LongType()), *schema.fields[len(keep) :]])
    passes = []
    while lot is not None:
        held = broadcasts(sc, lot, width)
        passes.append(work.save(df.select("__no", "__text").mapInArrow(over(held, ["__no"], bool(passes)), narrow), "found"))
        for x in held:
            x.destroy()
        lot, after = after, next(lots, None)
    told = reduce(lambda x, y: x.union(y), passes).groupBy("__no").agg(F.max("n_words").alias("n_words"), merged_runs(F.array_sort(F.flatten(F.collect_list("hits")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    return df.drop("__text").join(told.withColumn("n_hit", n_hit), "__no").select(schema.names)


def merged_runs(runs: Column) -> Column:
    """Ascending runs (first, last) with those that overlap or adjoin put together."""
    last = lambda a: F.try_element_at(a, F.lit(-1))
    both = lambda a, x: F.struct(last(a)["first"].alias("first"), F.greatest(last(a)["last"], x["last"]).alias("last"))
    return F.aggregate(
        runs, F.array().cast("array<struct<first:bigint,last:bigint>>"), lambda a, x: F.when((F.size(a) == 0) | (x["first"] > F.coalesce(F.try_element_at(a, F.lit(-1))["last"], F.lit(-9)) + 1), F.concat(a, F.array(x))).otherwise(F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(both(a, x))))
    )


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **more) -> DataFrame:
    """The documents without a benchmark passage, with their columns, whatever their names."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(f"`{text_col}`").alias("text"))
    found = find(packed, benchmark, id_col="doc", keep=["doc"], **more)
    return found.where(F.col("n_hit") == 0).select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))


def at_once(found: Iterator[list], n: int) -> Iterator[list[list]]:
    some: list[list] = []
    for x in found:
        if len(some) == n:
            yield some
            some = []
        some.append(x)
    yield some


def broadcasts(sc, lot: list[list[tuple[object, str | None]]], width: int) -> list:
    return [sc.broadcast((build(some, width), [str(i) for i, _ in some])) for some in lot]
