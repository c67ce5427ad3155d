"""Repeated passages against counting all windows, and LPF arrays against their definition."""

import random

import numpy as np
import pytest

from rulewright.llm import suffix_dedup as S

from . import brute


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    passage = " ".join(word() for _ in range(80))
    line = " ".join(word() for _ in range(45))
    out = [None, "", "short", "x" * 199, "x" * 200, "x" * 201, "x" * 700, "ab" * 300, "heesble, " * 90, "a" * 400]
    for k in range(40):
        t = " ".join(word() for _ in range(r.randint(20, 160)))
        if k % 3 == 0:
            t = t[: len(t) // 2] + passage + t[len(t) // 2 :]
        if k % 4 == 0:
            t = line + t + line
        out.append(t)
        for _ in range(r.choice([0, 0, 1, 3])):
            u = list(t)
            for _ in range(r.randint(0, 4)):
                u[r.randrange(len(u))] = "z"
            out.append("".join(u))
    return out


@pytest.mark.parametrize("seed,hot", [(1, 2000), (2, 3)])
def test_removed_bytes(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(S, "HOT", hot)
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, cuts string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in S.dedup(df).collect()}
    assert got == brute.repeated_bytes(dict(enumerate(texts)))


@pytest.mark.parametrize("hot", [2000, 3])
def test_first_copies_stay(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    texts = corpus(5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: bytes(r["kept"]) for r in S.dedup(df, keep="first").collect()}
    seen, want = set(), {}
    for d, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - S.M + 1):
            if b[i : i + S.M] in seen:
                gone[i : i + S.M] = b"\1" * S.M
            seen.add(b[i : i + S.M])
        want[d] = bytes(c for c, g in zip(b, gone) if not g)
    assert got == want


def test_previous_factors():
    r = random.Random(9)
    for _ in range(30):
        t = np.frombuffer("".join(r.choice("ab") for _ in range(60)).encode(), np.uint8)
        got = S.previous_factors(t, np.arange(60), 16)
        for i in range(60):
            best = max((next((k for k in range(16) if i + k >= 60 or t[i + k] != t[j + k]), 16) for j in range(i)), default=0)
            assert got[i] <= best and (got[i] == 16) == (best == 16)
            assert got[i] >= best - best % 8


def test_odd_tables(spark):
    assert S.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "q" * 300), (1, "r" * 100), (None, None)], "doc_id long, text string")
    assert sorted((r["n_bytes"], r["n_removed"]) for r in S.dedup(df).collect()) == [(0, 0), (100, 0), (300, 0)]
    with pytest.raises(ValueError, match="keep must be"):
        S.dedup(df, keep="last")
