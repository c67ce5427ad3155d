"""Rules from RDF: metadata in the default graph, patterns in named graphs.

Everything a declaration should have is looked up and then checked, so that an incomplete one is refused by name and never
silently ignored. The vocabulary's namespaces are parameters; its structure is fixed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

from ..functions import terms as T
from ..functions.terms import RuleError
from ..sources.rdf import Quad, parse, walk_list
from ..sources.store import DEFAULT, Dataset
from .checks import check
from .spec import ASSERT, CONSTRUCT, ONCE, REWRITE, TO_FIXPOINT, Binding, DataSource, Mint, Part, PatternTriple, RuleSet, RuleSpec, Scope, SourceMap, Var

TYPE = T.iri(T.RDF + "type")
SKOS = "http://www.w3.org/2004/02/skos/core#"


@dataclass(frozen=True)
class Vocabulary:
    """Namespaces of the terms; ``pattern``: variables, minting, sources; ``rule``: rules; ``member``: ordered sets;
    ``option``: options of data sources."""

    pattern: str = "https://rulewright.example/pattern/"
    rule: str = "https://rulewright.example/rule/"
    member: str = "https://rulewright.example/member/"
    option: str = "http://sparql.xyz/facade-x/ns/"

    def __getattr__(self, name: str) -> str:
        space, _, local = name.partition("_")
        if space in ("p", "r", "m") and local:
            return T.iri({"p": self.pattern, "r": self.rule, "m": self.member}[space] + local)
        raise AttributeError(name)


class RuleBook:
    """Rules and rule sets of a list of quads."""

    def __init__(self, quads: Iterable[Quad], vocabulary: Vocabulary | None = None):
        self.v = vocabulary or Vocabulary()
        self.quads = list(dict.fromkeys(quads))
        self.meta: dict[str, dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
        self.graphs: dict[str, list[tuple[str, str, str]]] = defaultdict(list)
        for g, s, p, o in self.quads:
            if g == DEFAULT:
                self.meta[s][p].append(o)
            else:
                self.graphs[g].append((s, p, o))
        self.variables: dict[str, str] = {}
        for s, po in self.meta.items():
            for text in po.get(self.v.p_variableText, []):
                t = T.decode(text)
                if t.kind != "literal" or not T.is_variable_text(t.value):
                    raise RuleError(f"variable {s} has the text {t.value!r}, which is no variable")
                if s in self.variables and self.variables[s] != T.variable_name(t.value):
                    raise RuleError(f"variable {s} has two texts")
                self.variables[s] = T.variable_name(t.value)

    @classmethod
    def parse(cls, text: str, vocabulary: Vocabulary | None = None) -> RuleBook:
        return cls(parse(text), vocabulary)

    @classmethod
    def of(cls, data: Dataset, vocabulary: Vocabulary | None = None) -> RuleBook:
        """From a store: the metadata of rules in the default graph (by predicate, so that data there stays where it is) and
        the graphs that it names as patterns."""
        from pyspark.sql import functions as F

        v = vocabulary or Vocabulary()
        p = F.col("p")
        told = p.startswith("<" + v.pattern) | p.startswith("<" + v.rule) | p.startswith("<" + v.member) | p.startswith("<" + v.option) | p.startswith("<" + SKOS) | p.isin(T.iri(T.RDF + "first"), T.iri(T.RDF + "rest"))
        kinds = (p == TYPE) & F.col("o").isin(v.r_RuleSet, v.p_TabularDataSource)
        meta = [tuple(r) for r in data.scan([DEFAULT]).where(told | kinds).collect()]
        named = {o[1:-1] for _, _, q, o in meta if q in (v.r_hasMatchPattern, v.r_hasConstructPattern, v.r_hasNegativeCondition) and o.startswith("<")}
        patterns = [tuple(r) for r in data.scan(sorted(named)).collect()] if named else []
        return cls(meta + patterns, v)

    # ---- single values

    def all(self, s: str, p: str) -> list[str]:
        return sorted(set(self.meta[s][p])) if s in self.meta else []

    def one(self, s: str, p: str, what: str, of: str) -> str:
        found = self.all(s, p)
        if len(found) != 1:
            raise RuleError(f"{of} needs exactly one {what}, not {len(found)}")
        return found[0]

    def maybe(self, s: str, p: str, what: str, of: str) -> str | None:
        found = self.all(s, p)
        if len(found) > 1:
            raise RuleError(f"{of} has {len(found)} of {what}; one at most")
        return found[0] if found else None

    def text(self, value: str, what: str, of: str) -> str:
        t = T.decode(value)
        if t.kind != "literal" or value in self.variables:
            raise RuleError(f"{of}: {what} must be a literal, not {value}")
        return t.value

    def integer(self, value: str, what: str, of: str) -> int:
        try:
            return int(self.text(value, what, of))
        except ValueError:
            raise RuleError(f"{of}: {what} must be an integer, not {value}") from None

    def name(self, value: str, what: str, of: str) -> str:
        if value not in self.variables:
            raise RuleError(f"{of}: {what} {value} is no declared variable with a variableText")
        return self.variables[value]

    # ---- patterns

    def pattern_term(self, text: str) -> Var | str:
        if text in self.variables:
            return Var(self.variables[text])
        if text.startswith('"'):
            t = T.decode(text)
            if t.datatype == self.v.p_var[1:-1]:
                return Var(T.variable_name(t.value))
        return text

    def triples(self, graph: str) -> tuple[PatternTriple, ...]:
        own = [PatternTriple(*(self.pattern_term(x) for x in t)) for t in self.graphs.get(graph[1:-1], [])]
        return tuple(sorted(dict.fromkeys(own), key=lambda t: t.key))

    def scope(self, graph: str) -> Scope:
        value = self.maybe(graph, self.v.r_inGraph, "inGraph", f"pattern {graph}")
        if value is None:
            return None
        if not value.startswith("<"):
            raise RuleError(f"pattern {graph}: inGraph must be an IRI, not {value}")
        if value in self.variables:
            return Var(self.variables[value])
        if self.v.p_TabularDataSource in self.all(value, TYPE):
            return self.data_source(value)
        return value[1:-1]

    def data_source(self, iri: str) -> DataSource:
        options = {}
        for p in self.meta[iri]:
            if p[1:].startswith(self.v.option):
                value = self.one(iri, p, f"value of {p}", f"data source {iri}")
                options[p[1 + len(self.v.option) : -1]] = self.text(value, p, f"data source {iri}")
        if not options.get("location"):
            raise RuleError(f"data source {iri} needs a location")
        return DataSource(iri[1:-1], tuple(sorted(options.items())))

    # ---- rules

    def rules(self) -> list[str]:
        return sorted(s for s, po in list(self.meta.items()) if po.get(self.v.r_hasMatchPattern) or po.get(self.v.r_hasConstructPattern))

    def mode(self, rule: str) -> str:
        value = self.one(rule, self.v.r_rewriteMode, "rewriteMode", f"rule {rule}")
        known = {getattr(self.v, f"r__RewriteMode_{m.lower()}"): m for m in (CONSTRUCT, ASSERT, REWRITE)}
        if value not in known:
            raise RuleError(f"rule {rule} has the unknown mode {value}")
        return known[value]

    def strategy(self, s: str, of: str) -> str | None:
        value = self.maybe(s, self.v.r_strategy, "strategy", of)
        known = {self.v.r_Once: ONCE, self.v.r_ToFixpoint: TO_FIXPOINT}
        if value is not None and value not in known:
            raise RuleError(f"{of} has the unknown strategy {value}")
        return known.get(value) if value else None

    def budget(self, s: str, of: str) -> int | None:
        value = self.maybe(s, self.v.r_maxIterations, "maxIterations", of)
        if value is None:
            return None
        n = self.integer(value, "maxIterations", of)
        if n < 1:
            raise RuleError(f"{of}: maxIterations must be 1 or more, not {n}")
        return n

    def rule(self, iri: str) -> RuleSpec:
        rule = iri if iri.startswith("<") else T.iri(iri)
        of = f"rule {rule}"
        v = self.v
        if rule not in self.meta or rule not in self.rules():
            raise RuleError(f"there is no {of}")
        construct = self.one(rule, v.r_hasConstructPattern, "construct pattern", of)
        graphs = self.all(rule, v.r_hasMatchPattern)
        if not graphs:
            raise RuleError(f"{of} needs a match pattern")
        parts = tuple(Part(g[1:-1], self.triples(g), self.scope(g)) for g in graphs)
        nacs = tuple(Part(g[1:-1], self.triples(g), self.scope(g)) for g in self.all(rule, v.r_hasNegativeCondition))
        filters = tuple(sorted({self.text(self.one(n, v.r_filterText, "filterText", f"{of}, filter {n}"), "filterText", of) for n in self.all(rule, v.r_hasFilterCondition)}))
        bindings = tuple(
            Binding(self.name(self.one(n, v.r_bindsVariable, "bindsVariable", f"{of}, binding {n}"), "bindsVariable", of), self.text(self.one(n, v.r_bindText, "bindText", f"{of}, binding {n}"), "bindText", of), n)
            for n in self.all(rule, v.r_hasBinding)
        )
        own = self.occurring([*parts, *nacs, Part(construct[1:-1], self.triples(construct), self.scope(construct))]) | {b.variable for b in bindings}
        mints, declared = [], {}
        for s, name in sorted(self.variables.items()):
            if name in own and (m := self.mint(s, name)):
                mints.append(m)
                own |= {x for _, x in m.slots}
        for s, name in self.variables.items():
            if name in own:
                declared[s[1:-1]] = name
        enums = tuple((name, self.enumeration(s)) for s, name in sorted(self.variables.items()) if name in own and self.all(s, v.p_oneOf))
        priority = self.maybe(rule, v.r_priority, "priority", of)
        return check(
            RuleSpec(
                iri=rule[1:-1], mode=self.mode(rule), match=parts, construct=self.triples(construct), construct_graph=construct[1:-1], construct_scope=self.scope(construct), nacs=nacs, filters=filters,
                bindings=bindings, mints=tuple(mints), enums=enums, source_maps=self.maps(parts), strategy=self.strategy(rule, of), priority=self.integer(priority, "priority", of) if priority else 0,
                max_iterations=self.budget(rule, of), label=self.label(rule), definition=self.label(rule, "definition"), declared=tuple(sorted(declared.items())),
            )
        )

    def label(self, s: str, name: str = "prefLabel") -> str | None:
        found = self.all(s, f"<{SKOS}{name}>")
        return T.decode(found[0]).value if found else None

    def occurring(self, parts: list[Part]) -> set[str]:
        return {x for p in parts for x in p.variables}

    def mint(self, s: str, name: str) -> Mint | None:
        v, of = self.v, f"variable {s}"
        template, function = self.maybe(s, v.p_iriTemplate, "iriTemplate", of), self.maybe(s, v.p_isMintedBy, "isMintedBy", of)
        if template and function:
            raise RuleError(f"{of} has an iriTemplate and a minting function; give one")
        if function:
            space = self.text(self.one(function, v.p_namespace, "namespace", f"minting function {function}"), "namespace", function)
            if "{" in space or "}" in space:
                raise RuleError(f"minting function {function}: the namespace {space!r} has a brace; slots belong in the local template")
            text = space + self.text(self.one(function, v.p_localTemplate, "localTemplate", f"minting function {function}"), "localTemplate", function)
        elif template:
            text = self.text(template, "iriTemplate", of)
        else:
            return None
        slots = []
        for n in self.all(s, v.p_hasSlot):
            slot = self.text(self.one(n, v.p_slotName, "slotName", f"{of}, slot {n}"), "slotName", of)
            slots.append((slot, self.name(self.one(n, v.p_slotValue, "slotValue", f"{of}, slot {slot!r}"), "slotValue", of)))
        return Mint(name, text, tuple(sorted(slots)), function[1:-1] if function else None)

    def enumeration(self, s: str) -> tuple[str, ...]:
        head = self.one(s, self.v.p_oneOf, "oneOf", f"variable {s}")
        members = sorted(set(walk_list([q for q in self.quads if q[0] == DEFAULT], head)))
        if not members:
            raise RuleError(f"the enumeration of variable {s} is empty")
        return tuple(members)

    def maps(self, parts: tuple[Part, ...]) -> tuple[SourceMap, ...]:
        """Source maps of the data sources that the parts read."""
        v, out = self.v, []
        unsupported = [n for n in ("mapFrom", "mapFirst", "mapEach", "concat")]
        for part in parts:
            if not isinstance(part.scope, DataSource):
                continue
            for m in self.all(T.iri(part.scope.iri), v.p_hasSourceMap):
                of = f"source map {m}"
                for bad in unsupported:
                    if self.all(m, getattr(v, f"p_{bad}")):
                        raise RuleError(f"{of} uses {bad}, which is not supported; map one column")
                get = lambda p: (lambda x: self.text(x, p, of) if x else None)(self.maybe(m, getattr(v, f"p_{p}"), p, of))  # noqa: B023,E731
                column = get("mapFromString")
                if not column:
                    raise RuleError(f"{of} has no column")
                out.append(SourceMap(self.name(self.one(m, v.p_mapTo, "mapTo", of), "mapTo", of), column, get("separator"), get("stringBefore"), get("valuePatternMatch"), get("valuePatternExclude"), m))
        return tuple(sorted(out, key=lambda m: m.variable))

    # ---- sets

    def rule_sets(self) -> list[str]:
        return sorted(s for s, po in list(self.meta.items()) if self.v.r_RuleSet in po.get(TYPE, []))

    def rule_set(self, iri: str) -> RuleSet:
        at = iri if iri.startswith("<") else T.iri(iri)
        v, of = self.v, f"rule set {at}"
        if at not in self.rule_sets():
            raise RuleError(f"{of} is not declared as a rule set")
        members = sorted(s for s, po in list(self.meta.items()) if at in po.get(v.m_isMemberOf, []))
        if not members:
            raise RuleError(f"{of} has no members")
        known, placed = set(self.rules()), []
        for m in members:
            rule = self.maybe(m, v.m_providesOrderFor, "providesOrderFor", f"{of}, member {m}")
            if rule is None:
                raise RuleError(f"{of}: member {m} names no rule")
            if rule not in known:
                raise RuleError(f"{of}: member {m} orders {rule}, which is no rule")
            number = self.maybe(m, v.m_sequence, "sequence", f"{of}, member {m}")
            if number is None:
                raise RuleError(f"{of}: member {m} has no sequence")
            p = self.maybe(rule, v.r_priority, "priority", f"rule {rule}")
            placed.append((self.integer(number, "sequence", f"{of}, member {m}"), -(self.integer(p, "priority", rule) if p else 0), rule, m))
        placed.sort()
        rules = [r for _, _, r, _ in placed]
        if len(set(rules)) != len(rules):
            raise RuleError(f"{of} has a rule twice (duplicate)")
        for m in members:
            if at in self.meta[m].get(v.m_isFirstMemberOf, []) and placed[0][0] != next(n for n, _, _, x in placed if x == m):
                raise RuleError(f"{of}: member {m} is declared the first, but its sequence is not the least")
        return RuleSet(at[1:-1], tuple(r[1:-1] for r in rules), self.label(at), self.strategy(at, of), self.budget(at, of))

    # ---- catalogue

    def catalogue(self) -> list[dict]:
        """Every rule with mode, label and number of its patterns; a malformed one is listed as Unrecognised."""
        out = []
        for r in self.rules():
            try:
                mode = self.mode(r)
            except RuleError:
                mode = "Unrecognised"
            out.append({"rule": r[1:-1], "mode": mode, "label": self.label(r), "definition": self.label(r, "definition"), "negative_conditions": len(self.all(r, self.v.r_hasNegativeCondition))})
        return out

    def set_catalogue(self) -> list[dict]:
        return [{"rule_set": s[1:-1], "label": self.label(s), "members": len({m for m, po in list(self.meta.items()) if s in po.get(self.v.m_isMemberOf, [])})} for s in self.rule_sets()]

    def shared_declarations(self) -> list[str]:
        """Variables with a template or an enumeration that several rules use: a change for one is a change for all."""
        used: dict[str, set[str]] = defaultdict(set)
        for r in self.rules():
            graphs = [g for p in (self.v.r_hasMatchPattern, self.v.r_hasConstructPattern, self.v.r_hasNegativeCondition) for g in self.all(r, p)]
            text = {x for g in graphs for t in self.graphs.get(g[1:-1], []) for x in t}
            for s in self.variables:
                if s in text and (self.all(s, self.v.p_oneOf) or self.all(s, self.v.p_iriTemplate) or self.all(s, self.v.p_isMintedBy)):
                    used[s].add(r)
        return sorted(f"{s} is shared by {', '.join(sorted(rs))}" for s, rs in used.items() if len(rs) > 1)


