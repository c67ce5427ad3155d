"""Cost-balanced packing of tokenised documents into training sequences.

A document is tokenised and cut into pieces of at most ``capacity`` tokens. Full pieces are sequences of their own. The
other pieces of a block of documents are taken in descending order, and each goes to the sequence of lowest cost
(linear plus quadratic attention cost) that has room for it; a piece that fits nowhere is cut to fill the cheapest gaps.
A block opens as many sequences as its tokens fill, and its last tokens go to sequences whose lengths are powers of two,
which need no padding. Blocks are bounded and never leave their input partition, so nothing is shuffled and no id is
moved after tokenising; a lost task packs its own rows again to the same result.

Defined results: null or empty text is the closing id alone; repeated rows are packed as often as they occur; ties go to
the sequence opened first; an empty table gives no pieces; columns besides the id and the text are ignored.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textops import release

CAPACITY = 4096
#: Tokens that one block holds at most (besides its last document).
BLOCK_TOKENS = 1 << 21
#: Cheapest sequences that are tried one by one; where none has room, all are searched at once.
TRIES = 8
#: Cached parts of words (about 200 bytes each); the cache starts anew beyond it.
CACHE_PARTS = 500_000
#: Ranges of code points for which a word's ids do not depend on its surroundings: all are in composed form, lower-cased by
#: character, and either letters, the digits 0-9 or neither to any version of Unicode.
RANGES = ((0x09, 0x0A), (0x0D, 0x0D), (0x20, 0x7E), (0xA1, 0xB1), (0xB4, 0xB8), (0xBA, 0xBB), (0xBF, 0x12F), (0x131, 0x24F))
_ALL = {chr(c) for a, z in RANGES for c in range(a, z + 1)}
#: Those of them whose lower-case form lies in these ranges, too (that of some capitals doesn't).
PLAIN = re.compile("[" + "".join(map(re.escape, sorted(c for c in _ALL if set(c.lower()) <= _ALL))) + "]*")
#: What the tokenizer splits a lower-cased text into, for such code points.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


class PartIds(dict):
    """Ids of the parts of words, as bytes; the model works out each once."""

    def __init__(self, tokenizer):
        from tokenizers.pre_tokenizers import ByteLevel

        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.model = tokenizer.model
        self.bytes = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in _ALL if not c.isascii()})

    def __missing__(self, part: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(part if part.isascii() else part.translate(self.bytes))]
        ids = struct.pack(f"<{len(ids)}I", *ids)
        if len(part) <= 64:
            if len(self) >= CACHE_PARTS:
                self.clear()
            self[part] = ids
        return ids


class Encoder:
    """ids of texts as the tokenizer gives them, plus the closing id."""

    def __init__(self, path: str, closing: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts, self.closing = PartIds(self.tokenizer), np.uint32(closing)

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        if PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            ids = np.frombuffer(b"".join(map(self.parts.__getitem__, PARTS.findall(text.lower()))), "<u4")
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.append(ids, self.closing)


@lru_cache(maxsize=2)
def encoder(path: str, closing: int) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(path, closing)


def cost(n, linear: float, quadratic: float):
    return linear * n + quadratic * n * n


def pack_block(lengths: list[int], capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1.0 / CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(document, start, length, sequence, offset) of each piece, and the number of sequences."""
    out: list[tuple[int, int, int, int, int]] = []
    rest: list[tuple[int, int, int]] = []
    n_seq = 0
    for d, n in enumerate(lengths):
        at = 0
        while n - at >= capacity:
            out.append((d, at, capacity, n_seq, 0))
            n_seq += 1
            at += capacity
        if n > at:
            rest.append((n - at, d, at))
    total = sum(n for n, _, _ in rest)
    sizes = [capacity] * (total // capacity)
    left = total % capacity
    while left:  # the last tokens: powers of two
        sizes.append(1 << (left.bit_length() - 1))
        left -= sizes[-1]
    room, used = list(sizes), [0] * len(sizes)
    rest.sort(key=lambda x: (-x[0], x[1], x[2]))
    heap = [(0.0, k) for k in range(len(sizes))]  # by cost, then the sequence opened first; entries of another cost than level's are stale
    level, space = np.zeros(len(sizes)), np.array(sizes, np.int64)
    late: list[tuple[int, int, int]] = []

    def put(n: int, d: int, at: int, k: int) -> None:
        out.append((d, at, n, n_seq + k, used[k]))
        used[k] += n
        room[k] -= n
        space[k] = room[k]
        level[k] += cost(n, linear, quadratic)
        if room[k]:
            heapq.heappush(heap, (float(level[k]), k))

    for n, d, at in rest:
        aside, found = [], -1
        while heap and len(aside) < TRIES:
            c, k = heapq.heappop(heap)
            if not room[k] or c != level[k]:
                continue
            if room[k] >= n:
                found = k
                break
            aside.append((c, k))
        for x in aside:
            heapq.heappush(heap, x)
        if found < 0 and len(fit := np.flatnonzero(space >= n)):
            found = int(fit[np.argmin(level[fit])])
        if found < 0:
            late.append((n, d, at))
        else:
            put(n, d, at, found)
    for n, d, at in late:  # cut to fill the cheapest gaps
        while n:
            c, k = heapq.heappop(heap)
            if not room[k] or c != level[k]:
                continue
            m = min(n, room[k])
            put(m, d, at, k)
            n, at = n - m, at + m
    return out, n_seq + len(sizes)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, closing: int = 2, linear: float = 1.0, quadratic: float = 1.0 / CAPACITY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: the id, ``start`` and ``length`` in the document's ids, ``ids`` (little-endian unsigned 32 bit),
    ``doc_tokens``, ``sequence_id`` and ``offset`` in the sequence."""
    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("start", "length")), T.StructField("ids", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("doc_tokens", "sequence_id", "offset"))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, closing)
        first = TaskContext.get().partitionId() << 40
        done, names, ids, size = 0, [], [], 0
        kind = None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal done, names, ids, size
            placed, n_seq = pack_block([len(x) for x in ids], capacity, linear, quadratic)
            placed.sort(key=lambda x: (x[3], x[4]))
            for i in range(0, len(placed), 8192):
                some = placed[i : i + 8192]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[d] for d, *_ in some], kind),
                        pa.array([s for _, s, *_ in some], pa.int64()),
                        pa.array([n for _, _, n, *_ in some], pa.int64()),
                        pa.array([ids[d][s : s + n].astype("<u4").tobytes() for d, s, n, *_ in some], pa.binary()),
                        pa.array([len(ids[d]) for d, *_ in some], pa.int64()),
                        pa.array([first + done + q for *_, q, _ in some], pa.int64()),
                        pa.array([o for *_, o in some], pa.int64()),
                    ],
                    names=schema.names,
                )
            done, names, ids, size = done + n_seq, [], [], 0

        for b in batches:
            kind = b.column(0).type
            for name, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = encode(text.as_py())
                names.append(name)
                ids.append(x)
                size += len(x)
                if size >= block_tokens:
                    yield from flush()
        if ids:
            yield from flush()
        release()

    return docs.select(id_col, text_col).mapInArrow(run, schema)
