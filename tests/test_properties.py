"""Random graphs: full rounds, rounds over new triples and a plain closure agree; undo takes back exactly what was done."""

import random
import uuid

import pytest

from rulewright.operators.engine import Engine
from rulewright.plans.spec import ASSERT, REWRITE, Part, RuleSpec, triple
from rulewright.sources.store import QuadStore

X = "http://x/"


def n(k):
    return f"<{X}{k}>"


def spec(mode, match, construct):
    full = lambda x: x if x[0] == "?" else n(x)
    pats = lambda ts: tuple(triple(*map(full, t)) for t in ts)
    return RuleSpec(X + "r", mode, (Part("L", pats(match)),), pats(construct))


@pytest.mark.parametrize("seed", range(2))
def test_closures_agree(spark, tmp_path, seed):
    r = random.Random(seed)
    edges = {(r.randrange(12), r.randrange(12)) for _ in range(14)}
    want = set(edges)
    while more := {(a, d) for a, b in want for c, d in want if b == c} - want:
        want |= more
    rule = spec(ASSERT, [("?a", "e", "?b"), ("?b", "e", "?c")], [("?a", "e", "?c")])
    counts = []
    for semi in (True, False):
        e = Engine(QuadStore(spark, f"file://{tmp_path}/{uuid.uuid4().hex}"))
        e.store.put_graph(spark.createDataFrame([(n(a), n("e"), n(b)) for a, b in edges], "s string, p string, o string"), X + "g")
        fired = e.run_rule(rule, [X + "g"], semi_naive=semi)
        counts.append([f.count for f in fired])
        got = e.store.merged([X + "g", *(f.graph for f in fired)]).collect()
        assert len(got) == len(want) and {(t["s"], t["o"]) for t in got} == {(n(a), n(b)) for a, b in want}
        for f in r.sample(fired, len(fired)):
            e.undo_firing(f.graph)
        assert {(t["s"], t["o"]) for t in e.store.scan(list(e.store.graphs)).collect()} == {(n(a), n(b)) for a, b in edges}
    assert counts[0] == counts[1]


@pytest.mark.parametrize("seed", range(2))
def test_rewrites_undo(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = {(n(r.randrange(6)), n(r.choice("pqr")), n(r.randrange(6))) for _ in range(25)}
    e = Engine(QuadStore(spark, f"file://{tmp_path}/{uuid.uuid4().hex}"))
    e.store.put_graph(spark.createDataFrame(sorted(rows), "s string, p string, o string"), X + "g")
    rule = spec(REWRITE, [("?a", "p", "?b"), ("?b", "q", "?c")], [("?a", "p", "?b"), ("?a", "r", "?c")])
    hits = [(a, c, (b2, n("q"), c)) for a, p, b in rows if p == n("p") for b2, q, c in rows if q == n("q") and b2 == b]
    gone, new = {h[2] for h in hits}, {(a, n("r"), c) for a, c, _ in hits}
    fired = e.run_rule(rule, [X + "g"])
    assert {tuple(t) for t in e.store.merged([X + "g"]).collect()} == (rows - gone) | new
    if fired:
        assert (fired[0].removed, fired[0].count) == (len(gone), len(new - rows))
        e.undo_firing(fired[0].graph)
    assert {tuple(t) for t in e.store.merged([X + "g"]).collect()} == rows
