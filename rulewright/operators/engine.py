"""Applies rules to a quad store and keeps the ledger.

An application lands in a graph of its own, its firing, pruned to the triples that are new; it is recorded with actor, time and
order; what a Rewrite removes is kept in a tombstone graph. Firing, tombstone, destination and ledger row of an application
are one commit of the store, so that none is ever there without the others, and undoing one is a commit, too.

Each round of a fixpoint is written before the next one reads it, so that lineage never grows; where the rule's shape allows,
later rounds join against the last round's triples only (which derives the same triples).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import terms as T
from ..functions.terms import RuleError
from ..plans import compiler as C
from ..plans.checks import check, refuse, scoped_read
from ..plans.loader import RuleBook
from ..plans.spec import DEFAULT_BUDGET, ONCE, REWRITE, TO_FIXPOINT, RuleSet, RuleSpec, construct_only, dangling_risks, effective_strategy, match_only
from ..sources.store import QuadStore

FIRING, TOMBSTONE = "urn:rulewright:firing:", "urn:rulewright:tombstone:"
SPO = ["s", "p", "o"]
LEDGER = S.StructType(
    [
        S.StructField("graph", S.StringType()),
        S.StructField("rule", S.StringType()),
        S.StructField("mode", S.StringType()),
        S.StructField("rule_set", S.StringType()),
        S.StructField("actor", S.StringType()),
        S.StructField("started_at", S.TimestampType()),
        S.StructField("ended_at", S.TimestampType()),
        S.StructField("ordinal", S.LongType()),
        S.StructField("iteration", S.IntegerType()),
        S.StructField("triple_count", S.LongType()),
        S.StructField("removed_count", S.LongType()),
        S.StructField("target", S.StringType()),
        S.StructField("tombstone", S.StringType()),
        S.StructField("sources", S.ArrayType(S.StringType())),
    ]
)


@dataclass(frozen=True)
class Firing:
    graph: str
    rule: str
    mode: str
    iteration: int
    count: int
    sources: tuple[str, ...]
    ordinal: int
    target: str | None = None
    tombstone: str | None = None
    removed: int | None = None
    rule_set: str | None = None
    actor: str = "anonymous"


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


class Engine:
    def __init__(self, store: QuadStore):
        self.store, self.spark = store, store.spark
        self.warnings: list[str] = []

    # ---- what counts as new

    def known(self, spec: RuleSpec, source: list[str]) -> DataFrame:
        """New means new to the destination of a write-scoped rule, else to the working set."""
        return self.store.merged([spec.destination] if spec.destination else source or [""])

    def new_triples(self, spec: RuleSpec, source: list[str], delta: DataFrame | None = None) -> DataFrame:
        derived = C.semi_naive(spec, self.store, source, delta) if delta is not None else None
        if derived is None:
            derived = C.compile_rule(spec, self.store, source)
        return derived.join(self.known(spec, source), SPO, "left_anti")

    @property
    def next_ordinal(self) -> int:
        """The number that the next firing gets; those of firings undone since are not used again."""
        return self.store.ordinal + 1

    # ---- one application

    def entry(self, spec: RuleSpec, graph: str, source: list[str], iteration: int, count: int, began: str, actor: str, rule_set: str | None, **more) -> dict:
        return {
            "graph": graph, "rule": spec.iri, "mode": spec.mode, "rule_set": rule_set, "actor": actor, "started_at": began, "ended_at": now(), "ordinal": self.next_ordinal, "iteration": iteration,
            "triple_count": count, "removed_count": None, "target": None, "tombstone": None, "sources": sorted(source),
        } | more

    def record(self, graphs: dict, row: dict) -> Firing:
        self.store.commit(graphs, self.store.ledger + [row], row["ordinal"])
        return as_firing(row)

    def apply_rule(self, spec: RuleSpec, source: list[str], *, into: str | None = None, actor: str = "anonymous", iteration: int = 1, rule_set: str | None = None, delta: DataFrame | None = None) -> Firing | None:
        """One application of a Construct or Assert rule; None (and nothing written) if it has nothing new."""
        if spec.mode == REWRITE:
            refuse(spec, "a Rewrite is applied with apply_rewrite")
        began, graph = now(), into or FIRING + str(uuid.uuid4())
        if into and self.store.graphs.get(into) and self.store.graph_size(into):
            refuse(spec, f"the graph <{into}> is not empty; a firing needs a graph of its own")
        C.check_collisions(spec, self.store, source)
        path, n = self.store.stage(self.new_triples(spec, source, delta), graph)
        if not n:
            return None
        graphs: dict[str, list[str] | None] = {graph: [path]}
        if spec.destination:
            copy, _ = self.store.stage(self.store.read_staged(path), spec.destination)
            graphs[spec.destination] = [*self.store.graphs.get(spec.destination, []), copy]
        return self.record(graphs, self.entry(spec, graph, source, iteration, n, began, actor, rule_set, target=spec.destination))

    def halves(self, spec: RuleSpec, target: str, solved: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(added, removed) of a Rewrite with these solutions, both against the target as it is."""
        have = self.store.merged([target])
        added = C.instantiate(solved, construct_only(spec)).join(have, SPO, "left_anti")
        removed = C.instantiate(solved, match_only(spec)).join(have, SPO, "left_semi")
        return added, removed

    def apply_rewrite(self, spec: RuleSpec, source: list[str], *, actor: str = "anonymous", iteration: int = 1, rule_set: str | None = None) -> Firing | None:
        if spec.mode != REWRITE:
            refuse(spec, "only a Rewrite is applied with apply_rewrite")
        if len(source) != 1:
            refuse(spec, f"a Rewrite needs exactly one source graph, its target, not {len(source)}")
        for v in dangling_risks(spec):
            self.warnings.append(f"rule <{spec.iri}> deletes every matched triple of ?{v} and keeps none; other facts about it may be left dangling")
        C.check_collisions(spec, self.store, source)
        began, target = now(), source[0]
        graph, tomb = FIRING + str(uuid.uuid4()), TOMBSTONE + str(uuid.uuid4())
        check(spec)
        solved_path, solved = self.store.stage_solutions(C.solutions(spec, self.store, [target]))
        added, removed = self.halves(spec, target, solved)
        gone_path, gone = self.store.stage(removed, tomb)
        new_path, new = self.store.stage(added, graph)
        self.store.discard(solved_path)
        if not gone and not new:
            return None
        after = self.store.merged([target])
        if gone:
            after = after.join(self.store.read_staged(gone_path), SPO, "left_anti")
        if new:
            after = after.unionByName(self.store.read_staged(new_path)).distinct()
        path, left = self.store.stage(after, target)
        row = self.entry(spec, graph, source, iteration, new, began, actor, rule_set, target=target, tombstone=tomb, removed_count=gone)
        return self.record({graph: [new_path] * bool(new), tomb: [gone_path] * bool(gone), target: [path] * bool(left)}, row)

    # ---- previews

    def dry_run(self, spec: RuleSpec, source: list[str], limit: int = 25) -> tuple[int, list[tuple]]:
        """How many triples an application would add, and the first of them; nothing is written."""
        C.check_collisions(spec, self.store, source)
        new = self.new_triples(spec, source).persist()
        try:
            return new.count(), [tuple(r) for r in new.orderBy(*SPO).limit(limit).collect()]
        finally:
            new.unpersist()

    def dry_run_rewrite(self, spec: RuleSpec, source: list[str], limit: int = 25) -> tuple[int, list[tuple], int, list[tuple]]:
        if len(source) != 1:
            refuse(spec, f"a Rewrite needs exactly one source graph, its target, not {len(source)}")
        check(spec)
        solved = C.solutions(spec, self.store, source).persist()  # nothing is written
        try:
            added, removed = self.halves(spec, source[0], solved)
            sample = lambda df: [tuple(r) for r in df.orderBy(*SPO).limit(limit).collect()]
            return added.count(), sample(added), removed.count(), sample(removed)
        finally:
            solved.unpersist()

    # ---- strategies

    def check_runnable(self, spec: RuleSpec, source: list[str], strategy: str | None = None, budget: int | None = None) -> tuple[str, int]:
        check(spec)
        how = effective_strategy(spec, strategy)
        n = budget if budget is not None else spec.max_iterations or DEFAULT_BUDGET
        if n < 1:
            refuse(spec, f"the budget must be 1 or more, not {n}")
        if not source and scoped_read(spec):
            refuse(spec, "a scoped read needs source graphs")
        if how == TO_FIXPOINT:
            if spec.mode == REWRITE and budget is None and spec.max_iterations is None:
                refuse(spec, "a Rewrite to fixpoint may never end; give it maxIterations")
            if spec.mode != REWRITE and scoped_read(spec):
                refuse(spec, "a scoped read can't run to fixpoint: what it adds lands in graphs it does not read")
            if not source:
                refuse(spec, "a fixpoint needs source graphs")
            if spec.destination and spec.destination not in source:
                refuse(spec, f"it writes to <{spec.destination}>, which is not among its source graphs, so a fixpoint would never see its results")
        return how, n

    def run_rule(self, spec: RuleSpec, source: Iterable[str] = (), *, strategy: str | None = None, max_iterations: int | None = None, actor: str = "anonymous", rule_set: str | None = None, semi_naive: bool = True) -> list[Firing]:
        """The firings of a run, each with something new. A budget that runs out is an error; earlier firings stay."""
        source = list(dict.fromkeys(source))
        how, budget = self.check_runnable(spec, source, strategy, max_iterations)
        out: list[Firing] = []
        delta = None
        for i in range(1, budget + 1):
            if spec.mode == REWRITE:
                fired = self.apply_rewrite(spec, source, actor=actor, iteration=i, rule_set=rule_set)
            else:
                fired = self.apply_rule(spec, source, actor=actor, iteration=i, rule_set=rule_set, delta=delta)
            if fired is None:
                return out
            out.append(fired)
            if how == ONCE:
                return out
            if spec.mode != REWRITE:
                if not spec.destination:
                    source.append(fired.graph)
                delta = self.store.merged([fired.graph]) if semi_naive else None
        raise RuleError(f"rule <{spec.iri}> has not come to rest after {budget} iteration(s); its firings so far are kept")

    # ---- sets

    def check_sequence(self, rules: list[RuleSpec], source: list[str], strategy: str) -> None:
        if not rules:
            raise RuleError("a rule set without rules")
        if strategy not in (ONCE, TO_FIXPOINT):
            raise RuleError(f"unknown strategy {strategy!r}")
        if any(r.mode == REWRITE for r in rules):
            for r in rules:
                if r.mode != REWRITE and not r.destination:
                    refuse(r, "it shares a set with a Rewrite, so it must be write-scoped: a Rewrite has one source graph and would not see its firing")
        if strategy == TO_FIXPOINT and not source:
            raise RuleError("a set needs source graphs to run to fixpoint")
        for r in rules:
            self.check_runnable(r, source)

    def run_rules(self, rules: list[RuleSpec], source: Iterable[str] = (), *, strategy: str | None = None, max_iterations: int | None = None, actor: str = "anonymous", rule_set: str | None = None, ordered: bool = False) -> list[Firing]:
        """Each rule by its own strategy; the sequence Once, or until a pass brings nothing. A list without an order of its own
        runs by priority, then IRI."""
        source = list(dict.fromkeys(source))
        if not ordered:
            rules = sorted(rules, key=lambda r: (-r.priority, r.iri))
        how, budget = strategy or ONCE, max_iterations or DEFAULT_BUDGET
        if max_iterations is not None and max_iterations < 1:
            raise RuleError(f"the budget must be 1 or more, not {max_iterations}")
        self.check_sequence(rules, source, how)
        out: list[Firing] = []
        for _ in range(budget):
            changed = False
            for r in rules:
                for f in self.run_rule(r, source, actor=actor, rule_set=rule_set):
                    changed = True
                    out.append(f)
                    if r.mode != REWRITE and not r.destination:
                        source.append(f.graph)
            if how == ONCE or not changed:
                return out
        raise RuleError(f"the set has not come to rest after {budget} pass(es); its firings so far are kept")

    def run_rule_set(self, book: RuleBook, told: RuleSet | str, source: Iterable[str] = (), *, strategy: str | None = None, max_iterations: int | None = None, actor: str = "anonymous") -> list[Firing]:
        told = book.rule_set(told) if isinstance(told, str) else told
        rules = [book.rule(r) for r in told.rules]
        return self.run_rules(rules, source, strategy=strategy or told.strategy, max_iterations=max_iterations or told.max_iterations, actor=actor, rule_set=told.iri, ordered=True)

    def rerun_rule_set(self, book: RuleBook, told: RuleSet | str, source: Iterable[str] = (), **how) -> tuple[list[str], list[Firing]]:
        """Undoes the set's recorded firings, newest first, and runs it again; everything is checked before anything is
        undone. Firings of other rules that built on them stay."""
        told = book.rule_set(told) if isinstance(told, str) else told
        rules = [book.rule(r) for r in told.rules]
        source = list(dict.fromkeys(source))
        self.check_sequence(rules, source, how.get("strategy") or told.strategy or ONCE)
        own = [r["graph"] for r in sorted(self.store.ledger, key=lambda r: -r["ordinal"]) if r["rule_set"] == told.iri]
        for g in own:
            self.undo_firing(g)
        return own, self.run_rule_set(book, told, source, **how)

    # ---- undo and history

    def is_firing(self, graph: str) -> bool:
        return any(r["graph"] == graph for r in self.store.ledger)

    def undo_firing(self, graph: str, force: bool = False) -> None:
        """Takes back exactly what a firing holds (not what its rule would derive now), puts back what it removed, and forgets
        it. force: drops a graph that the ledger does not know."""
        row = next((r for r in self.store.ledger if r["graph"] == graph), None)
        if row is None:
            if not force:
                raise RuleError(f"<{graph}> is no recorded firing")
            self.store.commit({graph: None})
            return
        change: dict[str, list[str] | None] = {graph: None}
        if row["target"]:
            after = self.store.merged([row["target"]]).join(self.store.merged([graph]), SPO, "left_anti")
            if row["tombstone"]:
                after = after.unionByName(self.store.merged([row["tombstone"]])).distinct()
                change[row["tombstone"]] = None
            path, n = self.store.stage(after, row["target"])
            change[row["target"]] = [path] * bool(n)
        self.store.commit(change, [r for r in self.store.ledger if r["graph"] != graph])

    def ledger(self) -> DataFrame:
        """One row per recorded firing."""
        rows = [{**r, "started_at": stamp(r["started_at"]), "ended_at": stamp(r["ended_at"])} for r in self.store.ledger]
        return self.spark.createDataFrame(rows, LEDGER)

    def firings(self, rule: str | None = None, rule_set: str | None = None) -> DataFrame:
        """The log, newest first."""
        df = self.ledger()
        for c, v in (("rule", rule), ("rule_set", rule_set)):
            if v is not None:
                df = df.where(F.col(c) == T.check_iri(v))
        return df.orderBy(F.desc("started_at"), F.desc("ordinal"), F.desc("iteration"))

    def retractions(self, subject: str | None = None, predicate: str | None = None, object: str | None = None) -> DataFrame:  # noqa: A002
        """What once held: removed triples with the firing that removed them, newest first. Only IRIs can be asked for."""
        tombs = sorted(r["tombstone"] for r in self.store.ledger if r["tombstone"])
        quads = self.store.scan(tombs)
        for c, v in (("s", subject), ("p", predicate), ("o", object)):
            if v is not None:
                quads = quads.where(F.col(c) == T.iri(v))
        log = self.ledger().select(F.col("tombstone").alias("g"), F.col("graph").alias("firing"), "rule", "actor", "started_at", "ordinal")
        return quads.join(log, "g").drop("g").orderBy(F.desc("started_at"), F.desc("ordinal"), *SPO)


def stamp(text: str) -> datetime:
    return datetime.strptime(text, "%Y-%m-%dT%H:%M:%S.%fZ").replace(tzinfo=UTC)


def as_firing(r: dict) -> Firing:
    return Firing(r["graph"], r["rule"], r["mode"], r["iteration"], r["triple_count"], tuple(r["sources"]), r["ordinal"], r["target"], r["tombstone"], r["removed_count"], r["rule_set"], r["actor"])


def open_engine(spark: SparkSession, path: str) -> Engine:
    return Engine(QuadStore(spark, path))

