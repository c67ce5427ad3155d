"""The similarity join against comparing all pairs that share a shingle."""

import random

import numpy as np
import pytest

from rulewright.llm import ngram_join as J

from . import brute


def corpus(seed: int, n: int = 60) -> list[str | None]:
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocab) for _ in range(40)]
    out: list[str | None] = [None, "", "  \n", "one two", "One\ttwo", "one two three four five", "x" * 5000, "a b c d"]
    for k in range(n):
        base = [r.choice(vocab) for _ in range(r.choice([4, 6, 9, 13, 30, 60, 90, 130, 300]))]
        if k % 3 == 0:
            base[len(base) // 2 : len(base) // 2] = passage
        out.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            copy = list(base)
            for _ in range(max(1, len(base) // r.choice([25, 60, 100, 200]))):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            if r.random() < 0.4:
                copy = copy[: -r.randint(1, max(1, len(copy) // 8))]
            out.append(" ".join(copy).upper() if r.random() < 0.3 else " ".join(copy))
    out += [out[10], out[20], out[20]]
    return out


@pytest.mark.parametrize("seed,pairs", [(1, J.PAIRS), (2, 1)])
def test_components(spark, monkeypatch, seed, pairs):
    monkeypatch.setattr(J, "PAIRS", pairs)
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n int").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.similar_components(df).collect()}
    assert got == brute.components(dict(enumerate(texts)))


@pytest.mark.parametrize("level", range(len(J.LEVELS)))
def test_similar_sets_share_a_signature(level):
    """Down to J = 0.8 exactly, for all sizes and at every level."""
    r = np.random.default_rng(level)
    for _ in range(400):
        common = int(r.integers(4, 400 if level == 0 else 150))
        extra = common // 4
        left = int(r.integers(0, extra + 1))
        pool = np.unique(r.integers(0, 1 << 63, common + extra, dtype=np.uint64) * np.uint64(2))
        if len(pool) < common + extra:
            continue
        r.shuffle(pool)
        a, b = np.sort(pool[: common + left]), np.sort(np.concatenate([pool[:common], pool[common + left :]]))
        s, at = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
        row, sig = J.signatures(s, at, level)
        assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist()), (common, left, extra)


def test_hot_passage(spark, monkeypatch):
    """Many sets that share a passage and little else, some of them with near copies."""
    monkeypatch.setattr(J, "PAIRS", 12)
    r = random.Random(11)
    say = lambda n: [f"v{r.randrange(5000)}" for _ in range(n)]
    passage, texts = say(60), []
    for k in range(120):
        base = say(r.choice([8, 20, 60, 140, 200]))
        cut = r.randrange(len(base))
        base[cut:cut] = passage
        texts.append(" ".join(base))
        if k % 5 == 0:
            for _ in range(2):
                copy = list(base)
                for _ in range(max(1, len(base) // 80)):
                    copy[r.randrange(len(copy))] = "z"
                texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in J.similar_components(df).collect()}
    assert got == brute.components(dict(enumerate(texts)))


def test_empty_and_odd_ids(spark):
    assert J.similar_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, "A b c d e f g"), (3, None)], "doc_id long, text string")
    kept = sorted(r["doc_id"] or -1 for r in J.keep_first(df).collect())
    assert kept == [-1, 1, 3]


def test_signature_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(s, n, 50 - n) for s in range(5) for n in range(s * 9) for _ in range(2)] + [(99, 1, 3)] + [(s, n, 7) for s in range(200, 230) for n in (1, 2)]
        found = J.shared(spark.createDataFrame(rows, "sig long, node long, n int")).collect()
        got = sorted((r["sig"], r["node"], r["pivot"], r["pivot_n"]) for r in found)
        assert got == sorted([(s, n, s * 9 - 1, 51 - s * 9) for s in range(1, 5) for n in range(s * 9)] + [(s, n, 1, 7) for s in range(200, 230) for n in (1, 2)])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_credit_counts_what_spoils_a_piece():
    """No fewer differences than a piece's credit take away all its signatures (every set of changed shingles is tried)."""
    from itertools import combinations

    r = np.random.default_rng(3)
    for level in range(len(J.LEVELS)):
        s = np.sort(r.integers(0, 1 << 63, 30, dtype=np.uint64) * np.uint64(2))
        at, use, band = np.array([0, len(s)]), np.array([0]), np.array([int(np.searchsorted(J.ENDS, len(s)))])
        p = J.pieces(s, at, use, band, True, level)
        for gone in combinations(range(len(s)), 2):
            t = np.delete(s, gone)
            q = J.pieces(t, np.array([0, len(t)]), use, band, True, level)
            kept = set(q.sig[q.some].tolist())
            spoiled = [i for i in range(len(p.row)) if not kept & set(p.sig[i][p.some[i]].tolist())]
            assert p.credit[spoiled].sum() <= len(gone)


def near_threshold(n, changed, words=200, seed=1):
    r = random.Random(seed)
    base = [f"v{r.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(changed):
            copy[r.randrange(words)] = f"z{r.randrange(100_000)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("changed", [1, 3])
def test_pairs_follow_the_members(spark, monkeypatch, changed):
    """Near copies whose likeness lies about the threshold: the pairs that leave a task stay in proportion to the members."""
    given = []
    links = J.Sets.links
    monkeypatch.setattr(J.Sets, "links", lambda self, pairs, *a: (given.append(pairs.count()), links(self, pairs, *a))[1])
    texts = near_threshold(200, changed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in J.similar_components(df).collect()}
    assert got == brute.components(dict(enumerate(texts)))
    assert sum(given) <= 2 * len(texts)


def test_bare_passage(spark, monkeypatch):
    """Pieces that were hot before a set signed them count as well: a passage and the passage with a fifth of own words."""
    monkeypatch.setattr(J, "HELD", 400)
    r = random.Random(5)
    say = lambda n: [f"v{r.randrange(100_000)}" for _ in range(n)]
    texts = []
    for _ in range(12):
        passage = say(36)
        texts += [" ".join(passage + say(n)) for n in range(10, 25) for _ in range(3)]
        texts += [" ".join(passage), *(" ".join(passage + say(n)) for n in (5, 6, 7))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in J.similar_components(df).collect()}
    assert got == brute.components(dict(enumerate(texts)))
