"""What makes a rule refused, before anything runs. Each check names the rule and what to change."""

from __future__ import annotations

from ..functions import expressions as E
from ..functions import templates as P
from ..functions import terms as T
from ..functions.terms import RuleError
from .spec import ASSERT, CONSTRUCT, REWRITE, Binding, DataSource, Part, RuleSpec, Var, match_triples


def refuse(spec: RuleSpec, what: str) -> None:
    raise RuleError(f"rule <{spec.iri}>: {what}")


def check_variables(spec: RuleSpec) -> None:
    names: dict[str, str] = {}
    for iri, name in spec.declared:
        if not T.is_variable_text("?" + name):
            refuse(spec, f"variable <{iri}> has the text {name!r}, which is no variable")
        if names.setdefault(name, iri) != iri:
            refuse(spec, f"variables <{names[name]}> and <{iri}> share the text ?{name}")


def check_positions(spec: RuleSpec) -> None:
    for where, triples in [("match", match_triples(spec)), ("construct", spec.construct), *(("negative", n.triples) for n in spec.nacs)]:
        for t in triples:
            for x in t.terms:
                if isinstance(x, str) and x.startswith("_:"):
                    refuse(spec, f"the {where} pattern has the blank node {x}; declare a variable for it instead, with a variableText of its own")
            if isinstance(t.s, str) and t.s.startswith('"'):
                refuse(spec, f"the {where} pattern has the literal subject {t.s}")
            if isinstance(t.p, str) and not t.p.startswith("<"):
                refuse(spec, f"the {where} pattern has the predicate {t.p}, which is no IRI")


def check_shape(spec: RuleSpec) -> None:
    if spec.mode not in (CONSTRUCT, ASSERT, REWRITE):
        refuse(spec, f"unknown mode {spec.mode!r}")
    for p in spec.match:
        if not p.triples and not spec.source_maps:
            refuse(spec, f"the match pattern <{p.graph}> is empty")
    if not spec.match and not spec.source_maps:
        refuse(spec, "the match pattern is empty")
    if not spec.construct:
        refuse(spec, "the construct pattern is empty")
    if len(spec.match) > 1:
        if spec.mode == REWRITE:
            refuse(spec, "a Rewrite takes one match pattern; several are supported for Construct and Assert")
        if spec.source_maps:
            refuse(spec, "source maps take one match pattern")
    if spec.mode == REWRITE and set(match_triples(spec)) == set(spec.construct):
        refuse(spec, "match and construct pattern are the same; the Rewrite would change nothing")


def check_scopes(spec: RuleSpec) -> None:
    scopes = [p.scope for p in (*spec.match, *spec.nacs)] + [spec.construct_scope]
    if spec.mode == REWRITE and any(s is not None for s in scopes):
        refuse(spec, "a Rewrite can't be scoped: it changes its one source graph")
    if isinstance(spec.construct_scope, DataSource):
        refuse(spec, "a construct pattern can't be written to a data source")
    if isinstance(spec.construct_scope, Var):
        refuse(spec, f"a construct pattern can't be written to the variable graph {spec.construct_scope}; name a graph")
    for s in scopes:
        if isinstance(s, str):
            T.check_iri(s)
    bound = {v for p in spec.match for v in p.variables}
    for n in spec.nacs:
        if isinstance(n.scope, Var) and n.scope.name not in bound:
            refuse(spec, f"a negative condition is scoped to {n.scope}, which the match pattern doesn't bind")
        if isinstance(n.scope, DataSource):
            refuse(spec, "a negative condition can't be scoped to a data source")


def check_enums(spec: RuleSpec) -> None:
    for v, members in spec.enums:
        if not members:
            refuse(spec, f"the enumeration of ?{v} is empty")
        if v in {m.variable for m in spec.mints}:
            refuse(spec, f"?{v} is both enumerated and minted")


def check_mints(spec: RuleSpec) -> None:
    source = spec.matched | {v for v, _ in spec.enums} | {b.variable for b in spec.bindings}
    minted = {m.variable for m in spec.mints}
    for m in spec.mints:
        parts = P.parse_template(m.template)
        slots = P.template_slots(m.template)
        if not slots:
            refuse(spec, f"the template {m.template!r} of ?{m.variable} has no slot; every match would make one IRI")
        if parts[0][0] != "text" or not T._SCHEME.match(parts[0][1]):
            refuse(spec, f"the template {m.template!r} of ?{m.variable} is relative; it must begin with a scheme")
        T.check_iri("".join(v if k == "text" else "x" for k, v in parts))
        told = dict(m.slots)
        if len(told) != len(m.slots):
            refuse(spec, f"?{m.variable} has two values for one slot")
        for s in slots:
            if s not in told:
                refuse(spec, f"slot {s!r} of ?{m.variable} has no value")
        for s, v in told.items():
            if s not in slots:
                refuse(spec, f"?{m.variable} has a value for slot {s!r}, which the template lacks")
            if v in minted:
                refuse(spec, f"slot {s!r} of ?{m.variable} takes the minted ?{v}; mint from what is matched")
            if v not in source:
                refuse(spec, f"slot {s!r} of ?{m.variable} takes ?{v}, which nothing binds")
        if "" in P.ambiguous_separators(m.template):
            refuse(spec, f"the template {m.template!r} of ?{m.variable} has two slots with nothing between; different values could make one IRI")
        if m.variable in spec.matched:
            refuse(spec, f"?{m.variable} is minted and matched")


def binding_order(spec: RuleSpec) -> list[Binding]:
    """Bindings such that each comes after those it reads; refuses circles."""
    left = sorted(spec.bindings, key=lambda b: b.variable)
    out: list[Binding] = []
    while left:
        waiting = {b.variable for b in left}
        ready = [b for b in left if not (E.check_text(b.text) & waiting)]
        if not ready:
            refuse(spec, "bindings read each other in a circle: " + ", ".join(f"?{b.variable}" for b in left))
        out += ready
        left = [b for b in left if b not in ready]
    return out


def check_bindings(spec: RuleSpec) -> None:
    seen: set[str] = set()
    minted, enums = {m.variable for m in spec.mints}, {v for v, _ in spec.enums}
    maps = {m.variable for m in spec.source_maps}
    targets = {b.variable for b in spec.bindings}
    for b in spec.bindings:
        reads = E.check_text(b.text)
        E.parse(b.text)
        if b.variable in seen:
            refuse(spec, f"two bindings set ?{b.variable}")
        seen.add(b.variable)
        if b.variable in spec.matched - maps:
            refuse(spec, f"a binding sets ?{b.variable}, which the match pattern binds")
        for others, how in ((enums, "enumerated"), (minted, "minted"), (maps, "mapped from a column")):
            if b.variable in others:
                refuse(spec, f"a binding sets ?{b.variable}, which is {how}")
        if b.variable in reads:
            refuse(spec, f"the binding of ?{b.variable} reads itself")
        if reads & minted:
            refuse(spec, f"the binding of ?{b.variable} reads the minted ?{sorted(reads & minted)[0]}; mints come after bindings")
        if missing := reads - spec.matched - enums - targets:
            refuse(spec, f"the binding of ?{b.variable} reads ?{sorted(missing)[0]}, which nothing binds")
    binding_order(spec)


def check_filters(spec: RuleSpec) -> None:
    for text in spec.filters:
        reads = E.check_text(text)
        E.parse(text)
        if missing := reads - spec.bound:
            refuse(spec, f"the filter {text!r} reads ?{sorted(missing)[0]}, which nothing binds")


def check_source_maps(spec: RuleSpec) -> None:
    if not spec.source_maps:
        return
    if not (len(spec.match) == 1 and isinstance(spec.match[0].scope, DataSource)):
        refuse(spec, "source maps need a match pattern in a tabular data source")
    seen: set[str] = set()
    authored = {v for p in spec.match for v in p.variables}
    for m in spec.source_maps:
        if not m.column:
            refuse(spec, f"the source map of ?{m.variable} has no column")
        if m.variable in seen:
            refuse(spec, f"two source maps set ?{m.variable}")
        seen.add(m.variable)
        if m.variable in authored:
            refuse(spec, f"?{m.variable} is mapped from a column and used in the match pattern")


def check_use(spec: RuleSpec) -> None:
    if missing := {v for t in spec.construct for v in t.variables} - spec.bound:
        refuse(spec, f"the construct pattern uses ?{sorted(missing)[0]}, which nothing binds")


def check(spec: RuleSpec) -> RuleSpec:
    for f in (check_shape, check_variables, check_positions, check_scopes, check_enums, check_source_maps, check_bindings, check_mints, check_filters, check_use):
        f(spec)
    return spec


def scoped_read(spec: RuleSpec) -> bool:
    return any(isinstance(p.scope, Var | str) for p in (*spec.match, *spec.nacs))


def unscoped(part: Part) -> bool:
    return part.scope is None
