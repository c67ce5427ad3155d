"""Removal of repeated passages with longest-previous-factor arrays over a distributed, sparse suffix order.

A passage is a string of ``m`` bytes that starts in more than one place. Sorting all suffixes of a corpus in one order would
move every byte several times, so the order is built for those suffixes only that can matter, in buckets:

 1. Anchors. Of every ``m``-byte window, the k-byte gram with the least hash is its anchor: equal windows have equal anchors
    at equal places, and a text has one anchor for about 60 bytes. An anchor's block is the run of windows it anchors.
    Only (anchor hash, block hash, place) is shuffled; partitions are sorted and streamed, so that an anchor that is in any
    number of documents takes no more memory than a batch. Windows of equal blocks are repeated and are done; a block that is
    alone with its anchor has no repeated window and is dropped; blocks that share an anchor but differ go on.
 2. Suffix order. The bytes of those blocks (and of one block of each kind met in 1) are gathered by anchor. In each
    bounded bucket the suffixes at their windows' starts are sorted by prefix doubling up to m bytes, LCPs follow from the
    ranks, and previous and next smaller positions in suffix order give each start its longest previous factor and, the same
    way, its longest next factor: m or more means the window starts earlier, or later, too.
 3. A bucket's hot anchors (more than ``HOT`` differing blocks) take another exact way: their windows' hashes are shuffled and
    streamed like the blocks in 1.

``keep="none"`` removes every byte of every repeated window; ``keep="first"`` spares the copy that comes first by (id, place),
so that only later copies go. All windows are judged on the input; matches never cross texts. Blocks and hot windows are
compared by 64-bit hashes (of 1e12 blocks, two different ones that share an anchor's 64 bits collide with a chance below 1e-6).

Defined results: null texts count as empty and have nothing removed; texts shorter than m neither; rows without an id take
no part and come back whole; ids must be unique (rows of one id count as copies of each other, and get the same result);
removal may cut a character, which only the bytes kept show; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .scratch import Scratch, has_bit, id_bit, id_bitmap

U = np.uint64
M, GRAM = 200, 80
CHUNK = 1 << 20
BUCKET = 1 << 20  # bytes sorted at a time
HOT = 2000


def minima(x: np.ndarray, w: int) -> np.ndarray:
    """Place of the least of every w values in a row, the first of equal ones."""
    n = len(x)
    pad = -n % w
    key = (x & ~U(0xFFFFFF)) | np.arange(n, dtype=U)  # ties by place; n < 2**24
    full = np.concatenate([key, np.full(pad, ~U(0))]).reshape(-1, w)
    left = np.minimum.accumulate(full, 1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(right[: n - w + 1], left[w - 1 : n])
    return (least & U(0xFFFFFF)).astype(np.int64)


def anchors(data: np.ndarray, offs: np.ndarray, m: int = M, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, anchor hash, block hash, first window, last window) of all blocks; windows count from the row's start."""
    none = np.zeros(0, np.int64)
    out = []
    for lo in range(0, max(1, len(data)), 1 << 23):  # a very long text in parts that overlap by a window less a byte
        hi = min(len(data), lo + (1 << 23) + m - 1)
        part = data[lo:hi]
        if len(part) < m:
            continue
        c = X.prefix_hash(part)
        inv = X.powers(len(c))[1]
        g = X.mix((c[gram:] - c[:-gram]) * inv[: len(part) - gram + 1] + U(gram))
        best = minima(g, m - gram + 1)  # for each window of the part
        start = np.arange(len(best)) + lo
        row = np.searchsorted(offs, start, "right") - 1
        fits = start + m <= offs[row + 1]
        new = np.ones(len(best), bool)
        new[1:] = (best[1:] != best[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new & fits)
        stop = np.flatnonzero(np.append(new[1:], True) | np.append(~fits[1:], True))
        last = stop[np.searchsorted(stop, first)]
        a = best[first]
        block = X.range_hash(c, first, last + m)
        block = X.mix(block + (a - first).astype(U) * U(0x9E3779B97F4A7C15))
        base = lo - offs[row[first]]
        out.append((row[first], g[a], block, first + base, last + base))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (none, none.astype(U), none.astype(U), none, none)


def suffix_ranks(t: np.ndarray, cap: int) -> list[tuple[int, np.ndarray]]:
    """Ranks of all suffixes by their first 8, 16, ... and at last cap bytes (bytes beyond the end are nought)."""
    wide = np.concatenate([t, np.zeros(8, np.uint8)]).astype(U)
    word = np.zeros(len(t), U)
    for k in range(8):
        word = (word << U(8)) | wide[k : len(t) + k]
    rank = np.unique(word, return_inverse=True)[1].astype(np.int64) + 1
    out = [(8, rank)]
    size = 8
    while size < cap:
        step = min(size, cap - size)
        after = np.concatenate([rank[step:], np.zeros(step, np.int64)])
        rank = np.unique((rank.astype(U) << U(32)) | after.astype(U), return_inverse=True)[1].astype(np.int64) + 1
        size += step
        out.append((size, rank))
    return out


def common_prefix(ranks: list[tuple[int, np.ndarray]], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length in common of the suffixes at i and j, in steps of the ranks' sizes and no more than the largest."""
    top, last = ranks[-1]
    n = np.where(last[i] == last[j], top, 0)
    open_ = n == 0
    for size, rank in ranks[-2::-1]:
        a, b = np.minimum(i + n, len(rank) - 1), np.minimum(j + n, len(rank) - 1)
        n = np.where(open_ & (rank[a] == rank[b]), n + size, n)
    return np.minimum(n, top)


def smaller_neighbours(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a suffix order, the nearest place before and after it that holds an earlier position; -1: none."""
    prev, after, stack = [-1] * len(order), [-1] * len(order), []
    for k, p in enumerate(order.tolist()):
        while stack and stack[-1][1] > p:
            after[stack.pop()[0]] = k
        prev[k] = stack[-1][0] if stack else -1
        stack.append((k, p))
    return np.array(prev, np.int64), np.array(after, np.int64)


def previous_factors(t: np.ndarray, starts: np.ndarray, cap: int = M) -> np.ndarray:
    """LPF: for each start (ascending), the longest match, up to cap bytes, with a start before it."""
    ranks = suffix_ranks(t, cap)
    return factors(ranks, starts)


def factors(ranks: list[tuple[int, np.ndarray]], starts: np.ndarray, later: bool = False) -> np.ndarray:
    last = ranks[-1][1]
    sign = -1 if later else 1  # the same, with positions turned round
    order = np.lexsort((sign * starts, last[starts]))
    prev, after = smaller_neighbours(sign * starts[order])
    best = np.zeros(len(starts), np.int64)
    for near in (prev, after):
        k = np.flatnonzero(near >= 0)
        n = common_prefix(ranks, starts[order[k]], starts[order[near[k]]])
        best[order[k]] = np.maximum(best[order[k]], n)
    return best


def without_own_copies(row: np.ndarray, a: np.ndarray, k: np.ndarray, s: np.ndarray, e: np.ndarray, m: int, first: bool) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Which blocks are left if a text's equal blocks (of a period, say) are one, and the (row, start, end) byte ranges that
    those settle, merged."""
    order = np.lexsort((s, k, a, row))
    r, x, y = row[order], a[order], k[order]
    again = np.zeros(len(order), bool)
    again[1:] = (r[1:] == r[:-1]) & (x[1:] == x[:-1]) & (y[1:] == y[:-1])
    twice = again.copy()
    twice[:-1] |= again[1:]
    left, gone = np.ones(len(order), bool), np.zeros(len(order), bool)
    left[order], gone[order] = ~again, again if first else twice
    r, lo, hi = row[gone], s[gone], e[gone] + m
    order = np.lexsort((lo, r))
    r, lo, hi = r[order], lo[order], hi[order]
    if not len(r):
        return left, (r, lo, hi)
    step = np.int64(hi.max() + m + 1)  # rows laid out one after the other, so that ranges of two never meet
    top = np.maximum.accumulate(hi + r * step)
    new = np.ones(len(r), bool)
    new[1:] = (lo + r * step)[1:] > top[:-1]
    f = np.flatnonzero(new)
    return left, (r[f], lo[f], (top - r * step)[np.append(f[1:] - 1, len(r) - 1)])


def blocks(docs: DataFrame, m: int, gram: int, first: bool) -> DataFrame:
    """(id, anchor, block, s, e, own): the blocks of all texts, and with ``own`` the byte ranges that a text settles alone,
    under anchors that scatter them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = X.utf8(b.column(1))
            for i, j in X.pieces(offs, CHUNK):
                row, a, k, s, e = anchors(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], m, gram)
                if len(row):
                    left, (r, lo, hi) = without_own_copies(row, a, k, s, e, m, first)
                    scatter = X.mix(X.mix(r.astype(U)) + lo.astype(U) + a[:1])
                    a, k = np.append(a[left], scatter), np.append(k[left], scatter)
                    own = np.append(np.zeros(int(left.sum()), bool), np.ones(len(r), bool))
                    row, s, e = np.append(row[left], r), np.append(s[left], lo), np.append(e[left], hi - m)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(row + i)), pa.array(a.view(np.int64)), pa.array(k.view(np.int64)), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(own)], names=["id", "anchor", "block", "s", "e", "own"]
                    )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, anchor long, block long, s long, e long, own boolean")


ALONE, EQUAL, MODEL, FIRST, OWN = 1, 2, 4, 8, 16


def sorted_runs(rows: DataFrame, kind: str) -> DataFrame:
    """rows: anchor, block, id, s, e, own. Adds ``flag``: ALONE (no equal block, but others of its anchor), EQUAL (its block is met
    again), OWN (a range that its text has settled), MODEL (an EQUAL one that stands for its kind where others differ), FIRST (of equal blocks, the first by id and
    place). Blocks without company are left out. Sorted partitions are streamed: a row is known by its neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row, not yet told
        before: tuple[int, int] | None = None  # anchor and block of the row before it

        def tell(b: pa.RecordBatch, after: tuple[int, int] | None) -> pa.RecordBatch:
            a, k = b.column(0).to_numpy(), b.column(1).to_numpy()
            n = len(a)
            pa_, pk, na, nk = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
            pa_[1:], pk[1:], na[:-1], nk[:-1] = a[:-1], k[:-1], a[1:], k[1:]
            same_p, same_n = np.zeros(n, bool), np.zeros(n, bool)
            pa_[0], pk[0] = before or (0, 0)
            na[-1], nk[-1] = after or (0, 0)
            same_p[:], same_n[:] = pa_ == a, na == a
            same_p[0] &= before is not None
            same_n[-1] &= after is not None
            eq_p, eq_n = same_p & (pk == k), same_n & (nk == k)
            equal = eq_p | eq_n
            model = equal & ((same_p & ~eq_p) | (same_n & ~eq_n))
            alone = ~equal & (same_p | same_n)
            flag = ALONE * alone + EQUAL * equal + MODEL * model + FIRST * (equal & ~eq_p) + OWN * b.column(5).to_numpy(zero_copy_only=False)
            out = flag > 0
            cols = [b.column(i) for i in range(5)] + [pa.array(flag.astype(np.int32))]
            return pa.RecordBatch.from_arrays(cols, names=["anchor", "block", "id", "s", "e", "flag"]).filter(pa.array(out))

        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.Table.from_batches([held, b.cast(held.schema)]).combine_chunks().to_batches()[0]
            if b.num_rows == 1:
                held = b
                continue
            last = (b.column(0)[-1].as_py(), b.column(1)[-1].as_py())
            done = tell(b.slice(0, b.num_rows - 1), last)
            before = (b.column(0)[-2].as_py(), b.column(1)[-2].as_py())
            held = b.slice(b.num_rows - 1)
            if done.num_rows:
                yield done
        if held is not None:
            done = tell(held, None)
            if done.num_rows:
                yield done

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("anchor", "block", "id", "s", "e", "own")
    return rows.repartition(n, "anchor").sortWithinPartitions("anchor", "block", "id", "s").mapInArrow(run, f"anchor long, block long, id {kind}, s long, e long, flag int")


def with_texts(docs: DataFrame, lists: DataFrame, ids: DataFrame) -> DataFrame:
    """docs (id, text) joined with lists (id, ...); documents that can't be listed are thinned out before the shuffle."""
    bitmap = docs.sparkSession.sparkContext.broadcast(id_bitmap(ids, "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(has_bit(bitmap.value, b.column(2).to_numpy())))
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["id", "text"])

    kind = docs.schema["id"].dataType.simpleString()
    some = docs.select("id", F.coalesce("text", F.lit("")).alias("text"), id_bit("id").alias("bit")).mapInArrow(run, f"id {kind}, text string")
    return some.join(lists, "id")


def differing(docs: DataFrame, rows: DataFrame, m: int) -> DataFrame:
    """(anchor, id, s, hot, raw) with the bytes of the blocks in ``rows`` (anchor, id, s, e, hot)."""
    lists = rows.groupBy("id").agg(F.collect_list(F.struct("anchor", "s", "e", "hot")).alias("blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                raw = b.column(1)[i].as_py().encode()
                anchor, s, e, hot = b.column(2)[i].values.flatten()
                cuts = [raw[x : y + m] for x, y in zip(s.to_pylist(), e.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([anchor, b.column(0).take(pa.array(np.full(len(s), i))), s, hot, pa.array(cuts, pa.binary())], names=["anchor", "id", "s", "hot", "raw"])

    kind = docs.schema["id"].dataType.simpleString()
    return with_texts(docs, lists, rows.select("id")).select("id", "text", "blocks").mapInArrow(run, f"anchor long, id {kind}, s long, hot boolean, raw binary")


def repeated_windows(rows: DataFrame, kind: str, m: int, first: bool) -> DataFrame:
    """(id, s, e): byte ranges covered by repeated windows among blocks (anchor, id, s, raw) of the same anchor."""

    def solve(some: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, int]]:
        # windows that are equal have one anchor, so that the anchors of a bucket can share a suffix order
        parts, starts, where = [], [], []
        at = 0
        for x, s, raw in some:
            n = len(raw) - m + 1
            parts.append(np.frombuffer(raw, np.uint8))
            starts.append(np.arange(at, at + n))
            where.append((x, s, n))
            at += len(raw)
        t, st = np.concatenate(parts), np.concatenate(starts)
        ranks = suffix_ranks(t, m)
        hit = factors(ranks, st) >= m
        if not first:
            hit |= factors(ranks, st, later=True) >= m
        lo = 0
        for x, s, n in where:
            k = np.flatnonzero(hit[lo : lo + n])
            lo += n
            if len(k):
                cut = np.flatnonzero(np.diff(k) > m)
                for a, z in zip(k[np.append(0, cut + 1)].tolist(), k[np.append(cut, len(k) - 1)].tolist(), strict=True):
                    yield x, s + a, s + z + m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, group, anchor, size = [], [], None, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ready, size
            out = list(solve(ready)) if ready else []
            ready, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _, _ in out], id_type), pa.array([s for _, s, _ in out], pa.int64()), pa.array([e for *_, e in out], pa.int64())], names=["id", "s", "e"])

        id_type = None
        for b in batches:
            id_type = b.column(1).type
            for a, x, s, raw in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if a != anchor:
                    if len(group) > 1:
                        ready.extend(group)
                    group, anchor = [], a
                    if size >= BUCKET:
                        yield from flush()
                group.append((x, s, raw))
                size += len(raw)
        if len(group) > 1:
            ready.extend(group)
        yield from flush()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("anchor", "id", "s", "raw").repartition(n, "anchor").sortWithinPartitions("anchor", "id", "s").mapInArrow(run, f"id {kind}, s long, e long")


def hot_windows(rows: DataFrame, kind: str, m: int) -> DataFrame:
    """Windows of blocks (id, s, raw) as rows for ``sorted_runs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, raw in enumerate(b.column(2)):
                t = np.frombuffer(raw.as_py(), np.uint8)
                at = np.arange(len(t) - m + 1)
                h = X.range_hash(X.prefix_hash(t), at, at + m).view(np.int64)
                s = at + b.column(1)[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(h), b.column(0).take(pa.array(np.full(len(at), i))), pa.array(s, pa.int64()), pa.array(s, pa.int64()), pa.array(np.zeros(len(s), bool))], names=["anchor", "block", "id", "s", "e", "own"])

    return rows.select("id", "s", "raw").mapInArrow(run, f"anchor long, block long, id {kind}, s long, e long, own boolean")


def removed_ranges(docs: DataFrame, work: Scratch, m: int = M, gram: int = GRAM, keep: str = "none") -> DataFrame:
    """(id, s, e): byte ranges to remove from docs (id, text); ranges may overlap."""
    kind = docs.schema["id"].dataType.simpleString()
    first = keep == "first"
    told = work.save(sorted_runs(blocks(docs, m, gram, first), kind), "runs")
    equal = told.where((F.col("flag").bitwiseAND(EQUAL) > 0) & ((F.col("flag").bitwiseAND(FIRST) == 0) if first else F.lit(True)))
    ranges = equal.union(told.where(F.col("flag").bitwiseAND(OWN) > 0)).select("id", "s", (F.col("e") + m).alias("e"))
    # where the first is spared, it and those alone may still have earlier copies in other blocks
    odd = told.where(F.col("flag").bitwiseAND(ALONE + MODEL + (FIRST if first else 0)) > 0)
    hot = work.save(odd.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor", F.lit(True).alias("hot")), "hot")
    raw = work.save(differing(docs, odd.join(hot, "anchor", "left").select("anchor", "id", "s", "e", F.coalesce("hot", F.lit(False)).alias("hot")), m), "blocks")
    ranges = ranges.union(work.save(repeated_windows(raw.where(~F.col("hot")), kind, m, first), "windows"))
    if not hot.isEmpty():
        rows = sorted_runs(hot_windows(raw.where("hot"), kind, m), kind)
        rows = rows.where((F.col("flag").bitwiseAND(EQUAL) > 0) & ((F.col("flag").bitwiseAND(FIRST) == 0) if first else F.lit(True)))
        ranges = ranges.union(work.save(rows.select("id", "s", (F.col("e") + m).alias("e")), "windows"))
    work.drop(raw)
    return ranges


def cut(raw: bytes, s: np.ndarray, e: np.ndarray) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed runs, and the bytes left."""
    if not len(s):
        return [], raw
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    k = np.flatnonzero(new)
    runs = list(zip(s[k].tolist(), e[np.append(k[1:] - 1, len(s) - 1)].tolist(), strict=True))
    kept, at = [], 0
    for a, z in runs:
        kept.append(raw[at:a])
        at = z
    kept.append(raw[at:])
    return runs, b"".join(kept)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", m: int = M, gram: int = GRAM, keep: str = "none", with_kept: bool = True) -> DataFrame:
    """The id, n_bytes, n_removed, ``spans`` (array of (start, end) in bytes), kept_sha256 and, if asked, ``kept`` (binary)."""
    if keep not in ("none", "first"):
        raise ValueError(f"keep must be 'none' or 'first', not {keep!r}")
    work = Scratch(docs.sparkSession, "suffix")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = base.where(F.col("id").isNotNull())
    ranges = removed_ranges(known, work, m, gram, keep)
    lists = work.save(ranges.groupBy("id").agg(F.collect_set(F.struct("s", "e")).alias("cuts")), "cuts")
    kind = base.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string" + ", kept binary" * with_kept
    span_t = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for i, text in enumerate(b.column(1)):
                raw = (text.as_py() or "").encode()
                s, e = (c.to_numpy() for c in b.column(2)[i].values.flatten()) if b.num_columns > 2 else (np.zeros(0, np.int64),) * 2
                runs, kept = cut(raw, s, e)
                for c, v in zip(out, (len(raw), len(raw) - len(kept), [{"start": a, "end": z} for a, z in runs], hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    c.append(v)
            cols = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), span_t, pa.string(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols[: 4 + with_kept]], names=["id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"][: 5 + with_kept])

    bitmap = id_bitmap(lists, "id")
    told = docs.sparkSession.sparkContext.broadcast(bitmap)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = b.filter(pa.array(~has_bit(told.value, b.column(2).to_numpy())))
            yield from finish([pa.RecordBatch.from_arrays([some.column(0), some.column(1)], names=["id", "text"])])

    clean = known.select("id", "text", id_bit("id").alias("bit")).mapInArrow(whole, schema).union(base.where(F.col("id").isNull()).mapInArrow(finish, schema))
    maybe = known.select("id", "text", id_bit("id").alias("bit")).mapInArrow(thin(told), f"id {kind}, text string")
    cut_ = maybe.join(lists, "id", "left").select("id", "text", F.coalesce("cuts", F.array().cast("array<struct<s:bigint,e:bigint>>")).alias("cuts")).mapInArrow(finish, schema)
    return clean.union(cut_).withColumnRenamed("id", id_col)


def thin(bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(has_bit(bitmap.value, b.column(2).to_numpy())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["id", "text"])

    return run
