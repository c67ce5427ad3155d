"""Text in, text out: what an agent or a person at a terminal calls. Errors come back as text; a Rewrite, a rerun and an undo
change or remove facts and need ``confirm=True``."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from ..functions.terms import RuleError
from ..plans import compiler as C
from ..plans.checks import binding_order
from ..plans.loader import RuleBook
from ..plans.spec import REWRITE, DataSource, Var, dangling_risks, effective_strategy, interface
from .engine import Engine, Firing


def guarded(f: Callable[..., str]) -> Callable[..., str]:
    @wraps(f)
    def run(*args, **kw) -> str:
        try:
            return f(*args, **kw)
        except RuleError as e:
            return f"Refused: {e}"

    return run


def told(firings: list[Firing]) -> str:
    if not firings:
        return "Nothing new."
    lines = [f"{len(firings)} firing(s), {sum(f.count for f in firings)} triple(s) added" + (f", {sum(f.removed or 0 for f in firings)} removed" if any(f.removed is not None for f in firings) else "")]
    lines += [f"  #{f.ordinal} <{f.graph}> by <{f.rule}>, iteration {f.iteration}: +{f.count}" + (f" -{f.removed}" if f.removed is not None else "") + (f" in <{f.target}>" if f.target else "") for f in firings]
    return "\n".join(lines)


def scope_text(scope) -> str:
    if scope is None:
        return "the merged source graphs"
    if isinstance(scope, Var):
        return f"each source graph, as {scope}"
    return f"the table of <{scope.iri}>" if isinstance(scope, DataSource) else f"<{scope}>"


class Tools:
    def __init__(self, engine: Engine, book: RuleBook):
        self.engine, self.book = engine, book

    @guarded
    def list_rules(self) -> str:
        rows = self.book.catalogue()
        return "\n".join(f"<{r['rule']}> {r['mode']}, {r['negative_conditions']} negative condition(s)" + (f": {r['label']}" if r["label"] else "") for r in rows) or "No rules."

    @guarded
    def list_rule_sets(self) -> str:
        return "\n".join(f"<{r['rule_set']}> {r['members']} member(s)" + (f": {r['label']}" if r["label"] else "") for r in self.book.set_catalogue()) or "No rule sets."

    @guarded
    def explain_rule(self, rule: str, source: list[str] | None = None, limit: int = 10) -> str:
        """What a rule does and would do now; the plan shown is the plan a run executes."""
        spec, source = self.book.rule(rule), list(source or [])
        out = [f"<{spec.iri}> {spec.mode}, {effective_strategy(spec)}, budget {spec.max_iterations or 'default'}"]
        out += [f"matches {len(p.triples)} triple(s) of <{p.graph}> in {scope_text(p.scope)}" for p in spec.match]
        out += [f"unless <{n.graph}> holds in {scope_text(n.scope)}" for n in spec.nacs]
        out += [f"binds ?{b.variable} := {b.text}" for b in binding_order(spec)]
        out += [f"mints ?{m.variable} from {m.template}" for m in spec.mints]
        out += [f"takes ?{v} from {', '.join(x)}" for v, x in spec.enums]
        out += [f"keeps what meets {f}" for f in spec.filters]
        out.append(f"writes {len(spec.construct)} triple(s) per match to {'<' + spec.destination + '>' if spec.destination else 'a graph of its own'}")
        if spec.mode == REWRITE:
            out.append(f"keeps {len(interface(spec))} matched triple(s) as they are")
            out += [f"warning: ?{v} may be left dangling" for v in dangling_risks(spec)]
            n, some, gone, lost = self.engine.dry_run_rewrite(spec, source, limit)
            out += [f"would add {n}:", *("  " + " ".join(t) for t in some), f"would remove {gone}:", *("  " + " ".join(t) for t in lost)]
        else:
            n, some = self.engine.dry_run(spec, source, limit)
            out += [f"would add {n}:", *("  " + " ".join(t) for t in some)]
            for m in spec.mints:
                for r in C.fan_in(spec, self.engine.store, source, m).collect():
                    out.append(f"note: {r['minted']} is made from {r['n']} different matches")
            plan = C.compile_rule(spec, self.engine.store, source)
            out.append(plan._jdf.queryExecution().optimizedPlan().toString())
        return "\n".join(out)

    @guarded
    def run_rule(self, rule: str, source: list[str] | None = None, actor: str = "anonymous", confirm: bool = False, max_iterations: int | None = None) -> str:
        spec = self.book.rule(rule)
        if spec.mode == REWRITE and not confirm:
            return "Refused: a Rewrite removes facts; look at explain_rule and call again with confirm=True"
        return told(self.engine.run_rule(spec, source or [], actor=actor, max_iterations=max_iterations))

    @guarded
    def run_rules(self, rule_set: str, source: list[str] | None = None, actor: str = "anonymous", confirm: bool = False, replace: bool = False) -> str:
        s = self.book.rule_set(rule_set)
        if not confirm and (replace or any(self.book.rule(r).mode == REWRITE for r in s.rules)):
            return "Refused: this removes facts; call again with confirm=True"
        if replace:
            undone, fired = self.engine.rerun_rule_set(self.book, s, source or [], actor=actor)
            return f"{len(undone)} firing(s) undone. " + told(fired)
        return told(self.engine.run_rule_set(self.book, s, source or [], actor=actor))

    @guarded
    def undo_firing(self, graph: str, confirm: bool = False) -> str:
        if not confirm:
            return "Refused: undoing removes facts; call again with confirm=True"
        self.engine.undo_firing(graph)
        return f"Undone: <{graph}>"

    @guarded
    def list_firings(self, rule: str | None = None, rule_set: str | None = None) -> str:
        rows = self.engine.firings(rule, rule_set).collect()
        return "\n".join(f"#{r['ordinal']} {r['started_at']:%Y-%m-%d %H:%M:%S} {r['actor']} <{r['rule']}> iteration {r['iteration']} +{r['triple_count']}" + (f" -{r['removed_count']}" if r["removed_count"] is not None else "") + f" <{r['graph']}>" for r in rows) or "No firings."

    @guarded
    def retractions(self, subject: str | None = None, predicate: str | None = None, object: str | None = None) -> str:  # noqa: A002
        rows = self.engine.retractions(subject, predicate, object).collect()
        return "\n".join(f"{r['s']} {r['p']} {r['o']} until #{r['ordinal']} by {r['actor']}" for r in rows) or "Nothing was retracted."
