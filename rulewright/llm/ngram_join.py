"""Similarity join of documents by the Jaccard similarity of their word shingles, with PartEnum signatures.

Sets with J >= 0.8 differ in d <= min((a + b) / 9, a / 4, b / 4) shingles. Sizes are divided into bands; a set signs for its
own band and for the next one where a partner may lie there. In a band the domain of shingle hashes is partitioned into
pieces and each piece into ``n2`` parts. A set signs a piece with the contents that are left of it when any ``k2`` parts are
taken away (one signature for each subset, those left empty aside), so that the piece still matches where up to k2 of its
parts differ. To spoil all signatures of a piece, min(k2 + 1, its parts that aren't empty) differences are needed: that is
the piece's credit. A set signs its pieces in order until their credits exceed the most d that its band allows. Of two
similar sets, the one that stops first has a piece that isn't spoiled, and the other has signed it too. Sets whose pieces
have not credit enough (very small ones, or by chance) also sign their first d + 1 shingles one by one, which two such
sets have one of in common. So similar sets share a signature, whatever the data.

Members of a signature are never paired with each other blindly:
 1. each set is compared with one member: of the least members of its signatures (the smallest set, then the least key), the
    one that it shares most with. Before any set is moved, sizes and counts of shingles in 256 to 1024 buckets are compared:
    how far these counts differ bounds from below how far the sets do, and rules out nearly all pairs that are not similar.
    The links found are joined to components;
 2. a signature whose members lie in one component is settled. Of the others, those of two members are such pairs, too; in
    larger ones, sketches of members of different components
    are compared in memory, group by group; only sets that may have a partner there are brought whole to the group, compared
    exactly, and leave no more links than connect them. The largest component of a group is streamed, the others are held;
 3. a signature with more than ``PAIRS`` pairs across components, or more than ``HELD`` shingles to hold, is hot (a passage that
    very many dissimilar sets share) and is skipped: a piece with hot signatures loses its credit (or all but one), and a set
    that has too little left signs more pieces, in the same order, and at last all and its single shingles, too; so on until no
    set lacks some for that. Where either of two similar sets has credit enough without hot signatures, they share one that is not
    hot;
 4. sets that lack credit for good meet in signatures of a second level (larger pieces of which more parts may differ). There,
    none is skipped: the members of a hot one are dealt to blocks, and every two blocks are compared as a group of their own.
Every comparison is exact, on whole sets of 64-bit shingle hashes. Equal sets (by a 64-bit hash; two of 1e9 different sets
collide with a chance of 3 %) are one node, so copies cost one row each.

Defined results: null and empty texts, and texts of spaces, have no shingles, link with nothing and are their own
component; with fewer words than a shingle the whole sequence is one; repeated ids are one document; rows without an id take
no part and are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as X
from .graphs import Components
from .scratch import BITMAP_BITS, Scratch, bitmap_of, has_bit, id_bit, id_bitmap, small

U = np.uint64
K = 5
SIMILAR = 80  # per cent
#: Pairs of members of different components that a signature may have (about a second's work), and shingles of all members
#: but those of its largest component (64 MB); more make it hot.
PAIRS, HELD = 1 << 23, 1 << 23
#: So many of a set's least open signatures go along with it: a pair that has one of them in common is told once, under the least.
LEAST = 6
#: Members of the largest component that are compared at a time; members up to which groups are worked on many at a time, and rows
#: of such a lot.
STREAM, FEW, LOT = 2048, 64, 4096
#: Rows of one signature that are put in order at once.
AT_ONCE = 1 << 18
BYTES = 1 << 18
#: Buckets of a sketch, by the size of the set up to which it is used.
SKETCH = ((512, 256), (2000, 512), (1 << 60, 1024))
#: Buckets to which sketches are folded for the first comparison.
COARSE = 64
#: (k2, n2) of the levels: of n2 parts of a piece, any k2 may differ.
LEVELS = ((1, 3), (2, 6))


def band_ends(most: int = 1 << 40) -> np.ndarray:
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * 1.6)))
    return np.array(out, np.int64)


ENDS = band_ends()


def pieces_of(end: np.ndarray, level: int) -> np.ndarray:
    """Pieces of the band that ends there: 4 to 7 shingles each in its largest sets, 9 at the second level."""
    return np.maximum(1, end // 9 if level else end // np.select([end <= 24, end <= 64, end <= 400], [4, 5, 6], 7))


@dataclass(frozen=True)
class Pieces:
    """The pieces of some rows' sets that aren't empty, in order."""

    row: np.ndarray
    sig: np.ndarray  # a column for each subset of parts
    some: np.ndarray  # whether anything is left of the piece then
    credit: np.ndarray
    before: np.ndarray  # credits of the row's pieces ahead
    need: np.ndarray  # by row of all: what credits must come to
    reached: np.ndarray  # by row of all: whether they do
    single_row: np.ndarray
    single: np.ndarray  # signatures of the first shingles


def pieces(s: np.ndarray, at: np.ndarray, rows: np.ndarray, band: np.ndarray, own: bool, level: int) -> Pieces:
    """Of the rows s[at[i]:at[i+1]] (ascending shingles) with i in rows, for the band band[i], own or the next one."""
    k2, n2 = LEVELS[level]
    n, total = np.diff(at), len(at) - 1
    size = n[rows]
    row = np.repeat(rows, size)
    take = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at[rows], size)
    x = s[take]
    m = X.mix(x)
    need = n // 4
    if own:
        need = np.minimum(need, (n + ENDS[band]) // 9)
    need = need + 1
    place = (x >> U(32)) * pieces_of(ENDS[band], level).astype(U)[row]
    piece, part = place >> U(32), ((place & U(0xFFFFFFFF)) * U(n2)) >> U(32)
    new = np.ones(len(x), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])
    at_part = np.ones(len(x), bool)
    at_part[1:] = new[1:] | (part[1:] != part[:-1])
    g, f = np.flatnonzero(new), np.flatnonzero(at_part)
    p_row = row[g]
    sums = np.zeros((len(g), n2), U)
    there = np.zeros((len(g), n2), bool)
    if len(f):
        k, p = np.cumsum(new)[f] - 1, part[f].astype(np.int64)
        sums[k, p] = np.add.reduceat(m, f)
        there[k, p] = True
    salt = X.mix(X.mix(band[p_row].astype(U) * U(8) + U(level)) + piece[g])
    gone = list(combinations(range(n2), k2))
    sig, some = np.empty((len(g), len(gone)), U), np.empty((len(g), len(gone)), bool)
    for c, out in enumerate(gone):
        left = [i for i in range(n2) if i not in out]
        sig[:, c] = X.mix(X.mix(sums[:, left].sum(1, dtype=U) ^ salt) + U(c + 1))
        some[:, c] = there[:, left].any(1)
    credit = np.minimum(k2 + 1, there.sum(1))
    before = np.cumsum(credit) - credit
    first = np.ones(len(g), bool)
    first[1:] = p_row[1:] != p_row[:-1]
    before = before - np.maximum.accumulate(np.where(first, before, 0)) if len(g) else before
    reached = np.bincount(p_row, credit, minlength=total) >= need
    at_single = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) < need[row]
    r1 = row[at_single]
    single = X.mix(m[at_single] ^ X.mix(band[r1].astype(U) * U(8) + U(7 - level)))
    return Pieces(p_row, sig, some, credit, before, need, reached, r1, single)


def bands_of(n: np.ndarray) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """(own, rows, band of every row): for their own bands, and for the next ones where a partner may be."""
    home = np.searchsorted(ENDS, n)
    yield True, np.flatnonzero(n > 0), home
    yield False, np.flatnonzero((n > 0) & (n * 100 // SIMILAR > ENDS[home])), home + 1


def signatures(s: np.ndarray, at: np.ndarray, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) for rows of ascending shingles s[at[i]:at[i+1]]: what sets sign first."""
    rows, sigs = [], []
    for own, use, band in bands_of(np.diff(at)):
        p = pieces(s, at, use, band, own, level)
        keep = p.some & (p.before < p.need[p.row])[:, None]
        rows.append(np.broadcast_to(p.row[:, None], keep.shape)[keep])
        sigs.append(p.sig[keep])
        keep = ~p.reached[p.single_row]
        rows.append(p.single_row[keep])
        sigs.append(p.single[keep])
    return np.concatenate(rows), np.concatenate(sigs)


#: How far a set signs, as times the credit that is enough without hot signatures; at last all pieces, and the single shingles of
#: a set that lacks credit even so.
STEPS = (1.0, 1.2, 1.5, 2.0, 1e9)
LACKING = len(STEPS)


def signed_further(s: np.ndarray, hot: np.ndarray, step: int) -> tuple[int, np.ndarray]:
    """The step up to which a set has to sign for credit enough without hot signatures, and the signatures that it adds to
    those up to the step given."""
    at, found = np.array([0, len(s)]), []
    for own, use, band in bands_of(np.diff(at)):
        if len(use):
            p = pieces(s, at, use, band, own, 0)
            warm = np.isin(p.sig, hot) & p.some
            found.append((p, np.where(~warm.any(1), p.credit, (p.some & ~warm).any(1)), np.isin(p.single, hot).any()))
    need = step
    for p, credit, single in found:
        if not p.reached[0]:  # has signed all and its single shingles
            need = max(need, LACKING) if single else need
            continue
        ok = [credit[p.before < x * p.need[0]].sum() >= p.need[0] for x in STEPS]
        need = max(need, ok.index(True) if True in ok else LACKING)
    if need == LACKING and step < LACKING - 1:
        need = LACKING - 1  # first all pieces: more of them may turn out to be hot or not
    new = [np.zeros(0, U)]
    for p, _, _ in found:
        if need < LACKING:
            keep = (p.before >= STEPS[step] * p.need[0]) & (p.before < STEPS[need] * p.need[0]) if step < LACKING else np.zeros(len(p.row), bool)
            new.append(p.sig[keep][p.some[keep]])
        elif step < LACKING:
            new.append(p.single)
    return need, np.concatenate(new)


def set_keys(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    c, d = np.zeros(len(s) + 1, U), np.zeros(len(s) + 1, U)
    m = X.mix(s)
    np.cumsum(m, out=c[1:])
    np.cumsum(X.mix(m + U(1)), out=d[1:])
    a, b = c[at[1:]] - c[at[:-1]], d[at[1:]] - d[at[:-1]]
    return X.mix(X.mix(a) + (b ^ np.diff(at).astype(U)))


def shingled(b: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offs = X.utf8(b)
    for i, j in X.pieces(offs, BYTES):
        h, row, at = X.words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], X.NOT_SPACE)
        yield i, j, *X.distinct_shingles(h, row, at, K)


def sketch(s: np.ndarray) -> bytes:
    """How many shingles are in each bucket: 15 at most in half a byte, 255 at most in a byte where there are 1024."""
    k = next(k for top, k in SKETCH if len(s) <= top)
    x = np.bincount((s & U(k - 1)).astype(np.int64), minlength=k)
    if k == SKETCH[-1][1]:
        return np.minimum(x, 255).astype(np.uint8).tobytes()
    x = np.minimum(x, 15).astype(np.uint8)
    return (x[::2] | x[1::2] << 4).tobytes()


def counts(brief: bytes) -> tuple[np.ndarray, bool]:
    """The counts of a sketch, and whether one may be too low."""
    x = np.frombuffer(brief, np.uint8)
    if len(x) == SKETCH[-1][1]:
        return x.astype(np.int32), bool((x == 255).any())
    out = np.empty(2 * len(x), np.int32)
    out[::2], out[1::2] = x & 15, x >> 4
    return out, bool((out == 15).any())


def apart(x: np.ndarray, y: np.ndarray) -> int:
    k = min(len(x), len(y))
    return int(np.abs(x.reshape(-1, k).sum(0) - y.reshape(-1, k).sum(0)).sum())


def may_be_similar(a: pa.Array, b: pa.Array, n: np.ndarray) -> np.ndarray:
    """False where the sketches show that sets of n elements together differ in more than a ninth of n."""
    size_a, size_b = (pa.compute.binary_length(x).to_numpy() for x in (a, b))
    out = np.ones(len(n), bool)
    for k in np.unique(size_a[size_a == size_b]):  # sketches of one kind at once
        every = np.flatnonzero((size_a == k) & (size_b == k))
        for at in (every[i : i + 1024] for i in range(0, len(every), 1024)):
            (u, u_low), (v, v_low) = ((alike(X.binary_rows(x.take(pa.array(at)), int(k)))) for x in (a, b))
            out[at] = u_low | v_low | (9 * np.abs(u - v).sum(1, dtype=np.int64) <= n[at])
    for i in np.flatnonzero(size_a != size_b):
        (u, u_low), (v, v_low) = counts(a[i].as_py()), counts(b[i].as_py())
        out[i] = u_low or v_low or 9 * apart(u, v) <= n[i]
    return out


def alike(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of sketches of one length, a row each, and where one of them may be too low."""
    if raw.shape[1] == SKETCH[-1][1]:
        return raw.astype(np.int16), (raw == 255).any(1)
    out = np.empty((len(raw), 2 * raw.shape[1]), np.int16)
    out[:, ::2], out[:, 1::2] = raw & 15, raw >> 4
    return out, (out == 15).any(1)


def fresh_rows(n: np.ndarray, key: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which sets a task has not met yet (nor in earlier rows); empty ones never count."""
    fresh = np.zeros(len(n), bool)
    for k, v in enumerate(key.tolist()):
        if n[k] and v not in seen:
            seen.add(v)
            fresh[k] = True
    return fresh


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, key, sketch); a task lists the sketch of equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for i, j, s, at in shingled(b.column(1)):
                n, key = np.diff(at), set_keys(s, at)
                fresh = fresh_rows(n, key, seen)
                brief = pa.array([sketch(s[at[k] : at[k + 1]]) if fresh[k] else None for k in range(len(n))], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(key.view(np.int64)), brief], names=["id", "n", "key", "sketch"])
        X.release()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.where(F.col(id_col).isNotNull()).select(id_col, text_col).mapInArrow(run, f"id {kind}, n long, key long, sketch binary")


def signed(docs: DataFrame, id_col: str, text_col: str, among: DataFrame | None = None) -> DataFrame:
    """(sig, node, n) of what all sets sign first, a task's equal sets once; as far as they may be among some signatures, if told (no
    wanted one is missing). They are worked out from the texts each time: they are more than the texts."""
    bit = F.col("sig").bitwiseAND(BITMAP_BITS - 1)
    bitmap = None if among is None else docs.sparkSession.sparkContext.broadcast(bitmap_of(among.select(bit.alias("bit"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for _, _, s, at in shingled(b.column(0)):
                n, key = np.diff(at), set_keys(s, at)
                fresh = fresh_rows(n, key, seen)
                row, sig = signatures(s, at)
                keep = fresh[row]
                if bitmap is not None:
                    keep &= has_bit(bitmap.value, sig.view(np.int64) & (BITMAP_BITS - 1))
                yield told(sig[keep], key.view(np.int64)[row[keep]], n[row[keep]])
        X.release()

    return docs.where(F.col(id_col).isNotNull()).select(text_col).mapInArrow(run, "sig long, node long, n int")


def shared(rows: DataFrame) -> DataFrame:
    """(sig, node, n, pivot, pivot_n) of the signatures with two nodes or more; pivot is the smallest set among them (among the first
    ``AT_ONCE`` rows of a larger group), the least of equal ones. rows: sig, node, n. A partition is sorted by signature alone, which
    Spark does by radix, and streamed; groups of up to AT_ONCE rows are put in order here, and equal rows of theirs are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        before: tuple[int, int, int] | None = None  # a group that goes on: its signature, its pivot and that one's size

        def flush(sig: np.ndarray, node: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal before
            some = np.zeros(len(sig), bool)  # in company
            some[1:] = sig[1:] == sig[:-1]
            some[:-1] |= some[1:]
            if before:
                some |= sig == before[0]
            sig, node, n = sig[some], node[some], n[some]
            order = np.lexsort((node, n, sig))
            sig, node, n = sig[order], node[order], n[order]
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
            sig, node, n = sig[new], node[new], n[new]
            if not len(sig):
                return
            start = np.ones(len(sig), bool)
            start[1:] = sig[1:] != sig[:-1]
            first = np.flatnonzero(start)
            size = np.diff(np.append(first, len(sig)))
            pivot, pivot_n = np.repeat(node[first], size), np.repeat(n[first], size)
            out = np.repeat(size, size) > 1
            if before:
                go_on = sig == before[0]
                out |= go_on
                pivot, pivot_n = np.where(go_on, before[1], pivot), np.where(go_on, before[2], pivot_n)
            before = int(sig[-1]), int(pivot[-1]), int(pivot_n[-1])
            cols = (c[out] for c in (sig, node, n, pivot, pivot_n))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True)], names=["sig", "node", "n", "pivot", "pivot_n"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(tuple(b.column(i).to_numpy() for i in range(3)))
            sig, node, n = held[0] if len(held) == 1 else (np.concatenate(c) for c in zip(*held, strict=True))
            cut = len(sig) if len(sig) > AT_ONCE else int(np.searchsorted(sig, sig[-1]))  # the last group may go on
            yield from flush(sig[:cut], node[:cut], n[:cut])
            held[:] = [(sig[cut:], node[cut:], n[cut:])] if cut < len(sig) else []
        for rest in held:
            yield from flush(*rest)
        X.release()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "sig").sortWithinPartitions("sig").mapInArrow(run, "sig long, node long, n int, pivot long, pivot_n int")


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, n, shingles) of the documents (node, id) wanted."""
    bitmap = docs.sparkSession.sparkContext.broadcast(id_bitmap(wanted, "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(has_bit(bitmap.value, b.column(2).to_numpy())))
            for i, j, s, at in shingled(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(at.astype(np.int32), pa.array(s.view(np.int64)))], names=["id", "shingles"])
        X.release()

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text_col, id_bit(id_col).alias("bit")).mapInArrow(run, f"id {kind}, shingles array<long>")
    return found.join(wanted, "id").select("node", F.size("shingles").cast("long").alias("n"), "shingles")


def promising(pairs: DataFrame, brief: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and sketches (node, n, sketch) leave possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = may_be_similar(x.column(2), x.column(3), x.column(4).to_numpy())
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], names=["a", "b"]).filter(pa.array(ok))

    a = brief.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"))
    b = brief.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
    fits = (100 * F.col("na") >= SIMILAR * F.col("nb")) & (100 * F.col("nb") >= SIMILAR * F.col("na"))
    told = pairs.join(a, "a").join(b, "b").where(fits).select("a", "b", "ka", "kb", (F.col("na") + F.col("nb")).alias("n"))
    return told.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    a = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return pairs.join(a, "a").join(b, "b").withColumn("common", common).where(100 * F.col("common") >= SIMILAR * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


class Sets:
    """Sketches, and on demand whole sets, of the nodes."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, table: DataFrame, first: DataFrame, work: Scratch):
        self.docs, self.names, self.table, self.first, self.work = docs, (id_col, text_col), table, first, work
        self.brief: DataFrame | None = None

    def know(self, nodes: DataFrame) -> None:
        """Brings the sketches of more nodes to ``brief`` (node, n, sketch)."""
        old = self.brief
        if old is not None:
            nodes = nodes.join(old, "node", "left_anti")
        found = self.table.where("sketch is not null").withColumnRenamed("key", "node").join(nodes.distinct(), "node", "left_semi").dropDuplicates(["node"]).select("node", "n", "sketch")
        new = self.work.save(found, "brief")
        self.brief = new if old is None else old.union(new)

    def of(self, nodes: DataFrame) -> DataFrame:
        wanted = self.work.save(self.first.join(nodes, self.first["key"] == nodes["node"], "left_semi").select(F.col("key").alias("node"), F.col("first").alias("id")), "wanted")
        return self.work.save(shingle_sets(self.docs, wanted, *self.names), "sets")

    def links(self, pairs: DataFrame, told: bool = False) -> DataFrame:
        """A stored table of the pairs that are similar enough; told: sketches have been compared."""
        some = pairs if told else self.work.save(promising(pairs, self.brief), "promising")
        sets = self.of(some.select(F.col("a").alias("node")).union(some.select("b")).distinct())
        out = self.work.save(verified(some, sets), "edges", thin=True)
        self.work.drop(sets, some)
        self.work.sweep()
        return out


def resigned(sets: DataFrame, level: int) -> DataFrame:
    """(sig, node, n) of a higher level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, lists = b.column(0).to_numpy(), b.column(1)
            for k in range(0, len(node), 256):
                part = lists.slice(k, 256)
                at = part.offsets.to_numpy().astype(np.int64)
                s = part.values.to_numpy().view(U)[at[0] : at[-1]]
                row, sig = signatures(s, at - at[0], level)
                yield told(sig, node[k : k + 256][row], np.diff(at)[row])

    return sets.select("node", "shingles").mapInArrow(run, "sig long, node long, n int")


def told(sig: np.ndarray, node: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(node), pa.array(n.astype(np.int32))], names=["sig", "node", "n"])


@dataclass
class Members:
    """Some members of a signature, by size."""

    node: np.ndarray
    comp: np.ndarray
    n: np.ndarray
    what: list  # sketches or sets
    least: np.ndarray
    fine: np.ndarray
    coarse: np.ndarray
    low: np.ndarray

    @classmethod
    def of(cls, t: pa.Table, whole: bool) -> Members:
        t = t.take(pa.array(np.argsort(t["n"].to_numpy(), kind="stable")))
        k1 = SKETCH[0][1]
        if whole:
            what = [x.values.to_numpy().view(U) for x in t["what"]]
            fine = np.array([np.bincount((x & U(k1 - 1)).astype(np.int64), minlength=k1) for x in what], np.int16)
            low = np.zeros(len(what), bool)
        else:
            what = [counts(x.as_py()) for x in t["what"]]
            fine = np.array([x.reshape(-1, k1).sum(0) for x, _ in what], np.int16)
            low = np.array([x for _, x in what])
        least = np.full((len(what), LEAST), NONE)
        for i, x in enumerate([] if whole else t["least"].to_pylist()):
            least[i, : len(x)] = x
        return cls(t["node"].to_numpy(), t["comp"].to_numpy(), t["n"].to_numpy().astype(np.int64), what, least, fine, fine.reshape(len(fine), -1, COARSE).sum(1, dtype=np.int16), low)

    def partners(self, i: int, other: Members, sig: int) -> np.ndarray:
        """Members of other that may be similar to one of these: of another component, near enough by size and by sketches. Those
        that have the same least signature, but not this one, are met under that."""
        n = self.n[i]
        j = np.arange(np.searchsorted(other.n, -(-n * SIMILAR // 100)), np.searchsorted(other.n, n * 100 // SIMILAR, "right"))
        if other is self:
            j = j[j > i]
        j = j[other.comp[j] != self.comp[i]]
        if (first := self.least[i, 0]) != sig and first != NONE:
            j = j[other.least[j, 0] != first]
        for x, y in ((self.coarse, other.coarse), (self.fine, other.fine)):
            if len(j):
                j = j[(9 * np.abs(y[j] - x[i]).sum(1, dtype=np.int64) <= other.n[j] + n) | other.low[j] | self.low[i]]
        return j


NONE = np.iinfo(np.int64).max


def groups(batches: Iterator[pa.RecordBatch], whole: bool, meet: Callable[[int, Members, Members], Iterator[pa.RecordBatch]], close: Callable[[], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Streams rows (sig, top, node, comp, n, what, least), sorted by sig and top, and hands over members that are to be compared:
    those that aren't of a signature's top component with each other, and with those that are."""
    sig, small, held = None, [], None

    def hold() -> Iterator[pa.RecordBatch]:
        nonlocal held, small
        if held is None and small:
            held, small = Members.of(pa.concat_tables(small), whole), []
            yield from meet(sig, held, held)

    for b in batches:
        t = pa.Table.from_batches([b])
        s, top = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero((s[1:] != s[:-1]) | (top[1:] != top[:-1])) + 1
        for lo, hi in zip(np.append(0, cut).tolist(), np.append(cut, len(s)).tolist(), strict=True):
            if lo == hi:
                continue
            if s[lo] != sig:
                yield from hold()
                yield from close()
                sig, small, held = s[lo], [], None
            if not top[lo]:
                small.append(t.slice(lo, hi - lo))
                continue
            yield from hold()
            for k in range(lo, hi if held else lo, STREAM):
                yield from meet(sig, held, Members.of(t.slice(k, min(STREAM, hi - k)), whole))
    yield from hold()
    yield from close()


def dealt(rows: DataFrame, *more: str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("sig", "top", "node", "comp", "n", "what", "least", *more).repartition(n, "sig").sortWithinPartitions("sig", "top")


def unfolded(col: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Sketches as counts in COARSE and in the fewest buckets, where these may be too low, by length the finer ones with the place
    of each, and all lengths."""
    size, k1 = pa.compute.binary_length(col).to_numpy(), SKETCH[0][1]
    fine, low, finer = np.zeros((len(size), k1), np.int16), np.zeros(len(size), bool), {}
    for k in np.unique(size).tolist():
        at = np.flatnonzero(size == k)
        x, low[at] = alike(X.binary_rows(col.take(pa.array(at)), k))
        fine[at] = x.reshape(len(at), -1, k1).sum(1)
        if x.shape[1] > k1:
            place = np.zeros(len(size), np.int64)
            place[at] = np.arange(len(at))
            finer[k] = x, place
    return fine.reshape(len(fine), -1, COARSE).sum(1, dtype=np.int16), fine, finer, low, size


def likely(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sig, a, b) of members of different components that may be similar, in whole groups of up to FEW."""
    sig, node, comp, n = (t[c].to_numpy() for c in ("sig", "node", "comp", "n"))
    coarse, fine, finer, low, size = unfolded(t["what"].combine_chunks())
    lists = t["least"].combine_chunks()
    least = np.full((len(sig), LEAST), NONE)
    at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    row = np.repeat(np.arange(len(sig)), np.diff(at))
    least[row, np.arange(len(row)) - at[row]] = lists.flatten().to_numpy()
    start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    stop = np.append(start[1:], len(sig))
    pairs = [x + s for s, e in zip(start.tolist(), stop.tolist(), strict=True) for x in [np.stack(np.triu_indices(e - s, 1))]]
    i, j = np.concatenate(pairs, 1)
    small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    same = (least[i, 0] == least[j, 0]) & (least[i, 0] != sig[i]) & (least[i, 0] != NONE)
    go = (comp[i] != comp[j]) & (100 * small.astype(np.int64) >= SIMILAR * large) & ~same
    i, j = i[go], j[go]
    found = []
    for lo in range(0, len(i), 2048):  # a few megabytes at a time
        a, b = i[lo : lo + 2048], j[lo : lo + 2048]
        for x in (coarse, fine):
            go = (9 * np.abs(x[a] - x[b]).sum(1, dtype=np.int64) <= n[a] + n[b]) | low[a] | low[b]
            a, b = a[go], b[go]
        for k, (x, place) in finer.items():
            both = (size[a] == k) & (size[b] == k) & ~low[a] & ~low[b]
            go = np.ones(len(a), bool)
            go[both] = 9 * np.abs(x[place[a[both]]] - x[place[b[both]]]).sum(1, dtype=np.int64) <= n[a[both]] + n[b[both]]
            a, b = a[go], b[go]
        both = (least[a][:, :, None] == least[b][:, None, :]).any(2) & (least[a] != NONE)
        under = np.where(both, least[a], NONE).min(1, initial=NONE)
        go = (under == sig[a]) | (under == NONE)
        found += [a[go], b[go]]
    a, b = (np.concatenate([np.zeros(0, np.int64), *found[k::2]]) for k in (0, 1))
    return sig[a], np.minimum(node[a], node[b]), np.maximum(node[a], node[b])


def hopeful(rows: DataFrame, work: Scratch) -> DataFrame:
    """(sig, node) of members that may be similar to one of another component, as far as sketches tell, each pair under one
    signature of theirs (in groups of up to FEW exactly so; in larger ones under its least, if that is known). rows: sig, top,
    node, comp, n, what (sketch), least, all (members of the signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]] = []
        lot: list[pa.Table] = []

        def meet(sig: int, a: Members, b: Members) -> Iterator[pa.RecordBatch]:
            found = []
            for i in range(len(a.node)):
                j = a.partners(i, b, sig)
                if len(j) and len(a.what[i][0]) > SKETCH[0][1]:
                    j = j[[b.low[k] or a.low[i] or 9 * apart(a.what[i][0], b.what[k][0]) <= b.n[k] + a.n[i] for k in j]]
                if len(j):
                    both = (b.least[j][:, :, None] == a.least[i][None, None, :]).any(2) & (b.least[j] != NONE)
                    under = np.where(both, b.least[j], NONE).min(1)
                    j = j[(under == sig) | (under == NONE)]
                if len(j):
                    found.append(np.append(b.node[j], a.node[i]))
            if found:
                node = np.unique(np.concatenate(found))
                ready.append((np.full(len(node), sig, np.int64), node, None))
            return iter(())

        def compare(end: bool) -> None:
            t = pa.concat_tables(lot).combine_chunks()
            sig = t["sig"].to_numpy()
            cut = len(sig) if end else int(np.searchsorted(sig, sig[-1]))  # the last group may go on
            lot[:] = [t.slice(cut)]
            if cut:
                ready.append(likely(t.slice(0, cut)))

        def large() -> Iterator[pa.RecordBatch]:
            for b in batches:
                few = pa.compute.less_equal(b.column("all"), FEW)
                if some := pa.Table.from_batches([b.filter(few)]):
                    lot.append(some)
                    if sum(map(len, lot)) > LOT:
                        compare(False)
                if (rest := b.filter(pa.compute.invert(few))).num_rows:
                    yield rest
            if lot:
                compare(True)

        for _ in groups(large(), False, meet, lambda: iter(())):
            pass
        X.release()
        for sig, a, b in ready:
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(a), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b)], names=["sig", "a", "b"])

    found = work.save(dealt(rows, "all").mapInArrow(run, "sig long, a long, b long"), "hopeful")
    pairs = found.where("b is not null").groupBy("a", "b").agg(F.min("sig").alias("sig"))
    return pairs.select("sig", F.explode(F.array("a", "b")).alias("node")).union(found.where("b is null").select("sig", "a")).distinct()


def connected(rows: DataFrame) -> DataFrame:
    """(a, b) of similar members of different components, no more than connect what is similar within each signature. rows: sig,
    top, node, comp, n, what (shingles), least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(c: int) -> int:
            while (d := up.get(c, c)) != c:
                up[c] = c = up.get(d, d)
            return c

        def meet(sig: int, a: Members, b: Members) -> Iterator[pa.RecordBatch]:
            found = []
            for i in range(len(a.node)):
                x, ca = a.what[i], int(a.comp[i])
                for j in a.partners(i, b, sig).tolist():
                    if (ra := root(ca)) != (rb := root(int(b.comp[j]))):
                        y = b.what[j]
                        k = np.searchsorted(y, x)
                        common = int((y[np.minimum(k, len(y) - 1)] == x).sum())
                        if 100 * common >= SIMILAR * (len(x) + len(y) - common):
                            up[ra] = rb
                            found.append((a.node[i], b.node[j]))
            if found:
                e = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(e.min(1)), pa.array(e.max(1))], names=["a", "b"])

        def close() -> Iterator[pa.RecordBatch]:
            up.clear()
            return iter(())

        yield from groups(batches, True, meet, close)
        X.release()

    return dealt(rows).mapInArrow(run, "a long, b long").distinct()


def settle(members: DataFrame, sets: Sets, graph: Components, work: Scratch, last: bool = False) -> DataFrame:
    """Adds edges to the graph that connect whatever members (as ``shared`` gives them) of signatures that aren't hot connect,
    and returns the members (sig, node) of hot signatures. The last time, none is hot."""
    near = members.where("node != pivot").groupBy("node", "pivot").agg(F.count("*").alias("times"), F.min("pivot_n").alias("pivot_n"))
    near = work.save(near, "near")
    best = near.groupBy("node").agg(F.max(F.struct("times", (-F.col("pivot_n")).alias("size"), F.col("pivot"))).alias("best"))
    graph.add(sets.links(work.save(best.select(F.col("best.pivot").alias("a"), F.col("node").alias("b")), "best")))
    work.drop(near)
    m = work.save(graph.of(members.select("sig", "node", "n")).select("sig", "node", "n", "comp"), "placed")
    size = m.groupBy("sig", "comp").agg(F.count("*").alias("c"), F.max("n").alias("n"), F.bit_xor(F.xxhash64("node")).alias("who"))
    open_ = size.groupBy("sig").agg(
        F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("same"), F.max(F.struct("c", "comp")).alias("top"), F.max("n").cast("long").alias("most"), F.count("*").alias("comps"), F.bit_xor("who").alias("who")
    ).where("comps > 1")
    pairs, held = (F.col("all") * F.col("all") - F.col("same")) / 2 / PAIRS, (F.col("all") - F.col("top.c")) * F.col("most") / HELD
    open_ = work.save(open_.select("sig", "all", "who", F.col("top.comp").alias("top_comp"), pairs.alias("pairs"), held.alias("held")).withColumn("hot", F.greatest("pairs", "held") > 1), "open")
    # signatures of the same members, told by number and hash, are one
    once = open_.where(F.lit(last) | ~F.col("hot")).groupBy("all", "who", F.when(F.col("all") > AT_ONCE, F.col("sig"))).agg(F.min(F.struct("sig", "top_comp", "pairs", "held", "hot")).alias("x")).select("all", "x.*")
    m_open = placed = work.save(m.join(once, "sig").select("sig", "node", "n", "comp", (F.col("comp") == F.col("top_comp")).alias("top"), "pairs", "held", "hot", "all"), "once")
    two = m_open.where("all = 2").groupBy("sig").agg(F.min("node").alias("a"), F.max("node").alias("b")).select("a", "b").distinct()
    graph.add(sets.links(work.save(two, "two", thin=True)))
    m_open = m_open.where("all > 2")
    hot = work.save(m.join(open_.where(F.col("hot") & F.lit(not last)).select("sig"), "sig").select("sig", "node"), "hot", thin=True)
    few = m_open.where(~F.col("hot")).select("sig", "top", "node", "comp", "n", "all")
    least = few.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("sig")), 1, LEAST).alias("least"))
    few = few.join(least, "node")
    if last:  # members of a hot signature in blocks, a group for every two of them
        blocks = F.ceil(2 * F.greatest(F.sqrt("pairs"), "held"))
        own = F.pmod(F.xxhash64("node", F.lit(7)), blocks)
        cells = m_open.where("hot").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        few = few.union(cells.select("node", F.xxhash64("sig", F.least("own", "other"), F.greatest("own", "other")).alias("sig"), "top", "comp", "n", F.lit(FEW + 1).cast("long").alias("all"), F.array().cast("array<bigint>").alias("least")).select(few.columns))
    few = work.save(few, "few")
    if not few.isEmpty():
        sketches = few.join(sets.brief.select("node", F.col("sketch").alias("what")), "node")
        some = work.save(hopeful(sketches, work), "some", thin=True)
        if not some.isEmpty():
            own = sets.of(some.select("node").distinct())
            edges = connected(few.join(some, ["sig", "node"]).join(own.select("node", F.col("shingles").alias("what")), "node"))
            edges = work.save(edges, "edges", thin=True)
            graph.add(edges)
            work.drop(own)
        work.drop(some)
    work.drop(m, open_, placed, few)
    work.sweep()
    return hot


def more_signatures(sets: DataFrame, hot: DataFrame) -> DataFrame:
    """(sig, node, n, step) of the further signatures of sets (node, shingles) that need some because of hot ones, hot: (node, sigs,
    step), and of each such set and of each that lacks credit for good a row without a signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, own, hot, step in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3).to_pylist(), strict=True):
                s = own.values.to_numpy().view(U)
                need, new = signed_further(s, hot.values.to_numpy().view(U), step)
                if need > step or need == LACKING:
                    sig = pa.array(np.append(new.view(np.int64), 0), mask=np.append(np.zeros(len(new), bool), True))
                    yield pa.RecordBatch.from_arrays([sig, *(pa.array(np.full(len(sig), x, k)) for x, k in ((node, np.int64), (len(s), np.int32), (need, np.int32)))], names=["sig", "node", "n", "step"])
        X.release()

    return sets.join(hot, "node").select("node", "shingles", "sigs", "step").mapInArrow(run, "sig long, node long, n int, step int")


def linked(members: DataFrame, sets: Sets, work: Scratch) -> Components:
    """The components of all similar sets."""
    graph = Components(work)
    hot = settle(members, sets, graph, work)
    if hot.isEmpty():
        return graph
    later: DataFrame | None = None  # signatures that sets have added, with their steps
    while True:
        own, steps = hot, hot.select("node", F.lit(0).alias("step"))
        if later is not None:
            own = own.union(later.where("sig is not null").join(hot.select("sig").distinct(), "sig", "left_semi").select("sig", "node"))
            steps = steps.union(later.select("node", "step"))
        by_node = own.groupBy("node").agg(F.collect_set("sig").alias("sigs")).join(steps.groupBy("node").agg(F.max("step").alias("step")), "node")
        by_node = work.save(by_node, "by_node")
        whole = sets.of(by_node.select("node"))
        more = work.save(more_signatures(whole, by_node), "more")
        work.drop(whole, by_node)
        left = more.where(F.col("sig").isNull() & (F.col("step") == LACKING)).select("node")
        fresh = more.where("sig is not null")
        if fresh.isEmpty():
            break
        rows = fresh.select("sig", "node", "n").union(signed(sets.docs, *sets.names, among=fresh))
        if later is not None:
            rows = rows.union(later.join(fresh.select("sig").distinct(), "sig", "left_semi").select("sig", "node", "n"))
        again = work.save(shared(rows.join(hot.select("sig").distinct(), "sig", "left_anti")), "members")
        later = more if later is None else later.union(more)
        if not again.isEmpty():
            sets.know(again.select("node"))
            hot = hot.union(settle(again, sets, graph, work))
        work.drop(again)
    left = work.save(left, "left", thin=True)
    if not left.isEmpty():
        sets.know(left)
        own = sets.of(left)
        again = work.save(shared(resigned(own, 1)), "members")
        work.drop(own)
        if not again.isEmpty():
            settle(again, sets, graph, work, last=True)
    return graph


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", work: Scratch | None = None) -> DataFrame:
    """(id, n_shingles, component_id) of each document; a component is named by its least id."""
    work = work or Scratch(docs.sparkSession, "ngram")
    members = work.save(shared(signed(docs, id_col, text_col)), "members")
    work.sweep()
    table = work.save(keyed(docs, id_col, text_col), "keyed")
    first = table.where("n > 0").groupBy("key").agg(F.min("id").alias("first"))
    names = first.withColumn("comp", F.col("key"))
    if not members.isEmpty():
        sets = Sets(docs, id_col, text_col, table, work.save(first, "first", thin=True), work)
        sets.know(members.select("node"))
        graph = linked(members, sets, work)
        names = graph.of(first.select(F.col("key").alias("node"), "first")).select(F.col("node").alias("key"), "first", "comp")
    work.drop(members)
    least = names.groupBy("comp").agg(F.min("first").alias("least"))
    named = names.join(least, "comp").select("key", "least")
    out = table.select("id", "n", F.when(F.col("n") > 0, F.col("key")).alias("key")).join(named, "key", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that have an earlier one in their component."""
    work, inner = Scratch(docs.sparkSession, "ngram"), Scratch(docs.sparkSession, "ngram")
    found = work.save(similar_components(docs, id_col, text_col, inner), "components")
    inner.clear()
    later = work.save(found.where(F.col("component_id") != F.col(id_col)).select(id_col).distinct(), "later", thin=True)
    kept = docs.join(small(later), id_col, "left_anti").select(docs.columns)
    if found.groupBy(id_col).count().where("count > 1").isEmpty():
        return kept
    return kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).union(kept.where(F.col(id_col).isNull()))
