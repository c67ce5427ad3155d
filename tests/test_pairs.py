"""Rules that join match parts to pairs: the joined rows are not shuffled, cut keys lose and repeat nothing."""

import random

import pytest

from rulewright import queries as Q
from rulewright.functions import terms as T
from rulewright.plans import compiler as C
from rulewright.sources.store import FrameDataset

P = Q.P


def quads(spark, graph, rows):
    return spark.createDataFrame([(P + graph, s, p, o) for s, p, o in sorted(rows)], "g string, s string, p string, o string")


def at(kind, places):
    return {(T.iri(f"{P}{kind}/{k}"), T.iri(P + "at"), T.iri(f"{P}place/{n}")) for k, n in places}


def near(construct="?c near ?s"):
    return Q.rule([Q.part("?c at ?n", "L1", P + "left"), Q.part("?s at ?n", "L2", P + "right")], construct)


def test_pairs_are_not_shuffled(spark):
    data = FrameDataset(quads(spark, "left", at("c", [(1, 1)])), quads(spark, "right", at("s", [(2, 1)])))
    plan = C.compile_rule(near(), data, [P + "left", P + "right"])._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Join ")]
    assert "Exchange" not in above and "Aggregate" not in above


@pytest.mark.parametrize("most", [3, C.PAIRS])
@pytest.mark.parametrize("construct", ["?c near ?s", "?s near ?c", "?c by ?n", "?n near ?s", "?c near ?c"])
def test_each_pair_once(spark, monkeypatch, most, construct):
    """Ones with one place, with several, with none in common; a place that most share."""
    monkeypatch.setattr(C, "PAIRS", most)
    rnd = random.Random(7)
    left = at("c", {(k, rnd.randrange(6)) for k in range(30) for _ in range(rnd.choice((1, 1, 3)))} | {(k, 9) for k in range(12)})
    right = at("s", {(k, rnd.randrange(4, 10)) for k in range(20) for _ in range(rnd.choice((1, 1, 4)))} | {(99, 77)})
    a, p, b = construct.split()
    want = {tuple({"?c": c, "?s": s, "?n": n}[x] for x in (a, b)) for c, _, n in left for s, _, m in right if n == m}
    got = C.compile_rule(near(construct), FrameDataset(quads(spark, "left", left), quads(spark, "right", right)), [P + "left", P + "right"]).collect()
    assert len(got) == len(want) and {(r["s"], r["o"]) for r in got} == want and {r["p"] for r in got} == {T.iri(P + p)}


def test_terms_as_shown(spark):
    """Two triples that look alike stay two; a literal is no subject."""
    alike = {(T.iri(P + "x"), T.iri(P + "at"), T.iri(P + "place/1")), (T.iri(P + "y"), T.iri(P + "at"), T.iri(P + "place/1"))}
    named = {(T.iri(P + "place/1"), T.iri(P + "name"), o) for o in (T.literal("x"), T.iri(P + "x"), T.iri("http://x/a"), "_:b")}
    data = FrameDataset(quads(spark, "left", alike), quads(spark, "right", named))
    parts = [Q.part("?c at ?n", "L1", P + "left"), Q.part("?n name ?m", "L2", P + "right")]
    rows = lambda c: sorted(map(tuple, C.compile_rule(Q.rule(parts, c), data, [P + "left", P + "right"], Q.bare).select("s", "o").collect()))
    assert rows("?c named ?m") == sorted((c, m) for c in "xy" for m in ("x", "x", "http://x/a", "_:b"))
    assert rows("?m names ?c") == sorted((m, c) for c in "xy" for m in ("x", "http://x/a", "_:b"))
