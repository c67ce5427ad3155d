"""Rules as frozen records."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from ..functions.terms import RuleError, decode

CONSTRUCT, ASSERT, REWRITE = "Construct", "Assert", "Rewrite"
ONCE, TO_FIXPOINT = "Once", "ToFixpoint"
DEFAULT_BUDGET = 100


@dataclass(frozen=True, order=True)
class Var:
    name: str

    def __str__(self) -> str:
        return f"?{self.name}"


PatternTerm = Var | str


@dataclass(frozen=True)
class PatternTriple:
    s: PatternTerm
    p: PatternTerm
    o: PatternTerm

    @property
    def terms(self) -> tuple[PatternTerm, PatternTerm, PatternTerm]:
        return self.s, self.p, self.o

    @property
    def key(self) -> tuple[str, str, str]:
        return str(self.s), str(self.p), str(self.o)

    @property
    def variables(self) -> set[str]:
        return {t.name for t in self.terms if isinstance(t, Var)}


@dataclass(frozen=True)
class DataSource:
    iri: str
    options: tuple[tuple[str, str], ...]


Scope = None | str | Var | DataSource


@dataclass(frozen=True)
class Part:
    """Patterns that are matched together: a match part or a negative condition. ``scope`` None: the merged source graphs;
    an IRI: that graph; a variable: whichever source graph holds all of them; a data source: its table."""

    graph: str
    triples: tuple[PatternTriple, ...]
    scope: Scope = None

    @property
    def variables(self) -> set[str]:
        own = {v for t in self.triples for v in t.variables}
        return own | {self.scope.name} if isinstance(self.scope, Var) else own


@dataclass(frozen=True)
class Mint:
    variable: str
    template: str
    slots: tuple[tuple[str, str], ...]  # slot name, variable
    function: str | None = None


@dataclass(frozen=True)
class Binding:
    variable: str
    text: str
    iri: str = ""


@dataclass(frozen=True)
class SourceMap:
    variable: str
    column: str
    separator: str | None = None
    string_before: str | None = None
    pattern_match: str | None = None
    pattern_exclude: str | None = None
    iri: str = ""


@dataclass(frozen=True)
class RuleSpec:
    iri: str
    mode: str
    match: tuple[Part, ...]
    construct: tuple[PatternTriple, ...]
    construct_graph: str = ""
    construct_scope: Scope = None
    nacs: tuple[Part, ...] = ()
    filters: tuple[str, ...] = ()
    bindings: tuple[Binding, ...] = ()
    mints: tuple[Mint, ...] = ()
    enums: tuple[tuple[str, tuple[str, ...]], ...] = ()
    source_maps: tuple[SourceMap, ...] = ()
    strategy: str | None = None
    priority: int = 0
    max_iterations: int | None = None
    label: str | None = None
    definition: str | None = None
    declared: tuple[tuple[str, str], ...] = field(default=(), compare=False)  # variable IRI, name

    @property
    def matched(self) -> set[str]:
        """Variables that the patterns or the source maps bind."""
        return {v for p in self.match for v in p.variables} | {m.variable for m in self.source_maps}

    @property
    def bound(self) -> set[str]:
        return self.matched | {v for v, _ in self.enums} | {b.variable for b in self.bindings} | {m.variable for m in self.mints}

    @property
    def destination(self) -> str | None:
        return self.construct_scope if isinstance(self.construct_scope, str) else None

    def with_(self, **changes) -> RuleSpec:
        return replace(self, **changes)


@dataclass(frozen=True)
class RuleSet:
    iri: str
    rules: tuple[str, ...]
    label: str | None = None
    strategy: str | None = None
    max_iterations: int | None = None


def match_triples(spec: RuleSpec) -> list[PatternTriple]:
    return list(dict.fromkeys(t for p in spec.match for t in p.triples))


def interface(spec: RuleSpec) -> list[PatternTriple]:
    """Triples that the match and the construct pattern share: kept as they are."""
    own = set(spec.construct)
    return [t for t in match_triples(spec) if t in own]


def match_only(spec: RuleSpec) -> list[PatternTriple]:
    own = set(spec.construct)
    return [t for t in match_triples(spec) if t not in own]


def construct_only(spec: RuleSpec) -> list[PatternTriple]:
    own = set(match_triples(spec))
    return [t for t in dict.fromkeys(spec.construct) if t not in own]


def dangling_risks(spec: RuleSpec) -> list[str]:
    """Variables all of whose matched triples a Rewrite deletes and that the construct pattern never mentions: what they stand
    for may be left with facts that lead nowhere."""
    gone, kept = match_only(spec), {v for t in spec.construct for v in t.variables}
    held = {v for t in interface(spec) for v in t.variables}
    return sorted({v for t in gone for v in t.variables} - kept - held)


def pattern_term(text: str) -> PatternTerm:
    """``?x`` or ``$x`` as a variable, anything else as canonical text."""
    if text[:1] in "?$":
        from ..functions.terms import variable_name

        return Var(variable_name(text))
    decode(text)
    return text


def triple(s: str, p: str, o: str) -> PatternTriple:
    return PatternTriple(pattern_term(s), pattern_term(p), pattern_term(o))


def effective_mode(name: str) -> str:
    if name not in (CONSTRUCT, ASSERT, REWRITE):
        raise RuleError(f"unknown mode {name!r}")
    return name


def effective_strategy(spec: RuleSpec, asked: str | None = None) -> str:
    out = asked or spec.strategy or (TO_FIXPOINT if spec.mode == ASSERT else ONCE)
    if out not in (ONCE, TO_FIXPOINT):
        raise RuleError(f"unknown strategy {out!r}")
    return out
