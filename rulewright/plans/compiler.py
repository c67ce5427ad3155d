"""From a rule to one DataFrame plan.

``solutions`` is the only place where a rule's conditions are put together; runs, previews, collision checks and fan-in reports
all call it. The order is fixed by the rules' meaning: match parts, source maps, enumerations, bindings in order of what they
read, minted identifiers, negative conditions, filters. The plan is lazy; Catalyst pushes constants of patterns into the Parquet
scans, prunes columns and picks join strategies. Patterns are joined in a connected order, so that a product of unconnected
patterns appears only where the rule has one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions import templates as P
from ..functions import terms as T
from ..functions.terms import RuleError
from ..sources import tabular
from ..sources.store import Dataset
from .checks import binding_order, check, refuse
from .spec import DataSource, Mint, Part, PatternTriple, RuleSpec, Var, triple

#: Columns of solutions are named so, apart from any column a table may have.
PREFIX = "v_"

#: Joined rows of one key that a task makes at most, about, where parts are joined to a set of pairs.
PAIRS = 4_000_000


def col(name: str) -> Column:
    return F.col(PREFIX + name)


def columns(names: Iterable[str]) -> dict[str, Column]:
    return {n: col(n) for n in names}


def connected_order(triples: Iterable[PatternTriple]) -> list[PatternTriple]:
    """Sorted, but each as early as it shares a variable with those before it."""
    left = sorted(dict.fromkeys(triples), key=lambda t: t.key)
    out: list[PatternTriple] = []
    known: set[str] = set()
    while left:
        k = next((i for i, t in enumerate(left) if t.variables & known), None)
        if k is None:  # a new island: begin where most is constant
            k = min(range(len(left)), key=lambda i: (len(left[i].variables), left[i].key))
        out.append(left.pop(k))
        known |= out[-1].variables
    return out


def part_order(parts: Iterable[Part]) -> list[Part]:
    """The part that shares most variables first, then always the most connected one."""
    left = sorted(parts, key=lambda p: p.graph)
    shares = {p.graph: sum(len(p.variables & q.variables) for q in left if q is not p) for p in left}
    left.sort(key=lambda p: (-shares[p.graph], len(p.triples), p.graph))
    out: list[Part] = []
    while left:
        known = {v for p in out for v in p.variables}
        k = max(range(len(left)), key=lambda i: (len(left[i].variables & known), -i)) if out else 0
        out.append(left.pop(k))
    return out


def natural_join(a: DataFrame | None, b: DataFrame) -> DataFrame:
    if a is None:
        return b
    shared = [c for c in a.columns if c in b.columns]
    return a.join(b, shared) if shared else a.crossJoin(b)


def triple_scan(scan: DataFrame, t: PatternTriple, graph: Var | None) -> DataFrame:
    """scan: g (where a graph variable is), s, p, o."""
    where, out = [], {}
    fields = list(zip(("s", "p", "o"), t.terms, strict=True)) + ([("g", graph)] if graph else [])
    for name, term in fields:
        c = F.col(name)
        if isinstance(term, Var):
            c = T.col_iri(c) if name == "g" else c
            if term.name in out:
                where.append(out[term.name] == c)
            else:
                out[term.name] = c
        else:
            where.append(c == term)
    df = scan.where(reduce(lambda x, y: x & y, where)) if where else scan
    if not out:  # a pattern of constants holds or it does not
        return df.select(F.lit(True).alias("there")).limit(1).select()
    return df.select(*(c.alias(PREFIX + n) for n, c in out.items()))


def match_part(data: Dataset, part: Part, source: list[str], delta: tuple[int, DataFrame] | None = None, distinct: bool = True) -> DataFrame:
    """The solutions of one part. delta: the place of the pattern that reads new triples only, and those. distinct: a triple that is
    in several graphs of the merged source gives one solution; where what is made of the solutions is a set anyway, that needs
    no shuffle for each pattern."""
    scope = part.scope
    table = tabular.cells_as_triples(tabular.read_table(data.spark, dict(scope.options))) if isinstance(scope, DataSource) else None
    graphs = [scope] if isinstance(scope, str) else source or [""]
    out: DataFrame | None = None
    for k, t in enumerate(connected_order(part.triples)):
        if delta and delta[0] == k:
            from_ = delta[1]
        elif table is not None:
            from_ = table
        elif isinstance(scope, Var):
            from_ = data.scan(source, t.p if isinstance(t.p, str) else None)
        else:
            raw = data.scan(graphs, t.p if isinstance(t.p, str) else None)
            if distinct and len(set(graphs)) > 1:  # constants below the merge
                consts = [F.col(n) == x for n, x in zip(("s", "p", "o"), t.terms, strict=True) if isinstance(x, str)]
                raw = (raw.where(reduce(lambda x, y: x & y, consts)) if consts else raw).select("s", "p", "o").distinct()
            from_ = raw.select("s", "p", "o")
        out = natural_join(out, triple_scan(from_, t, scope if isinstance(scope, Var) else None))
    return out


def source_map_solutions(data: Dataset, spec: RuleSpec) -> DataFrame:
    """One solution for each row of the table (more where a cell is split); a row that lacks a mapped value vanishes."""
    part = spec.match[0]
    table = tabular.read_table(data.spark, dict(part.scope.options))
    out = table
    for m in sorted(spec.source_maps, key=lambda m: m.variable):
        if m.column not in table.columns:
            refuse(spec, f"the table has no column {m.column!r}; it has {', '.join(table.columns)}")
        v = F.col(f"`{m.column}`")
        name = PREFIX + m.variable
        if m.separator is not None:
            out = out.withColumn(name, F.explode(F.split(F.nullif(v, F.lit("")), P.regex_quote(m.separator))))
            v = F.col(name)
        if m.string_before is not None:
            v = F.substring_index(v, m.string_before, 1)
        out = out.withColumn(name, v).where(F.col(name).isNotNull())
        if m.pattern_match is not None:
            out = out.where(F.col(name).rlike(m.pattern_match))
        if m.pattern_exclude is not None:
            out = out.where(~F.col(name).rlike(m.pattern_exclude))
    out = out.select(*(T.col_plain(F.col(PREFIX + m.variable)).alias(PREFIX + m.variable) for m in spec.source_maps))
    if part.triples:
        raise RuleError(f"rule <{spec.iri}>: a match pattern with source maps is empty; map the columns it reads")
    return out


def with_enums(df: DataFrame, spec: RuleSpec) -> DataFrame:
    for v, members in sorted(spec.enums):
        name = PREFIX + v
        if name in df.columns:  # constrains
            df = df.where(F.col(name).isin(*members))
        else:  # generates: one solution for each member
            df = df.withColumn(name, F.explode(F.array(*map(F.lit, members))))
    return df


def with_bindings(df: DataFrame, spec: RuleSpec) -> DataFrame:
    for b in binding_order(spec):
        known = {c[len(PREFIX) :]: F.col(c) for c in df.columns}
        df = df.withColumn(PREFIX + b.variable, E.binding_column(b.text, known))
    return df


def mint_column(m: Mint) -> Column:
    told = dict(m.slots)
    parts = [F.lit(v) if kind == "text" else T.col_encode(T.col_lexical(col(told[v]))) for kind, v in P.parse_template(m.template)]
    return T.col_iri(F.concat(*parts))


def with_mints(df: DataFrame, mints: Iterable[Mint]) -> DataFrame:
    for m in sorted(mints, key=lambda m: m.variable):
        df = df.withColumn(PREFIX + m.variable, mint_column(m))
    return df


def without_nacs(df: DataFrame, spec: RuleSpec, data: Dataset, source: list[str]) -> DataFrame:
    """Rows for which no negative condition holds. A variable that may be unbound correlates only where it is bound: an anti-join
    on equality for the rows where all are bound, and one for each set of variables that may be unbound together, on the others
    alone."""
    sure = {PREFIX + v for v in spec.matched}
    for n in spec.nacs:
        if not n.triples:
            continue
        found = match_part(data, n, source, distinct=False)
        shared = [c for c in df.columns if c in found.columns]
        unsure = [c for c in shared if c not in sure]
        for k in range(len(unsure) + 1):
            for gone in combinations(unsure, k):
                keys = [c for c in shared if c not in gone]
                # the extra key is null for the rows that this join is not about; made of a column, so that it stays a key
                about = reduce(lambda a, b: a & b, (F.col(c).isNull() for c in gone), F.lit(True))
                there = found.select(*(F.col(c).alias("n_" + c) for c in keys), (F.length(gone[0]) * 0 if gone else F.lit(0)).alias("n_about"))
                there = there.distinct() if keys and len(keys) < len(found.columns) else there if keys else there.limit(1)
                on = [F.when(about, F.lit(0)) == F.col("n_about")] if gone or not keys else []
                df = df.join(there, reduce(lambda a, b: a & b, [*on, *(F.col(c) == F.col("n_" + c) for c in keys)]), "left_anti")
    return df


def solutions(spec: RuleSpec, data: Dataset, source: list[str], *, filters: bool = True, mints: Iterable[Mint] | None = None, deltas: tuple[int, DataFrame] | None = None) -> DataFrame:
    """The solutions of a rule's conditions; one may occur more than once where a triple is in several source graphs. All that is
    made of them is a set or counts different ones."""
    if spec.source_maps:
        df = source_map_solutions(data, spec)
    else:
        df = None
        for p in part_order(spec.match):
            df = natural_join(df, match_part(data, p, source, deltas, distinct=False))
    df = with_enums(df, spec)
    df = with_bindings(df, spec)
    df = with_mints(df, spec.mints if mints is None else mints)
    df = without_nacs(df, spec, data, source)
    if filters:
        for text in sorted(spec.filters):
            df = df.where(E.filter_column(text, {c[len(PREFIX) :]: F.col(c) for c in df.columns}))
    return df


def instantiate(solved: DataFrame, template: Iterable[PatternTriple]) -> DataFrame:
    """Each triple of the template for each solution, in one pass, as a set; triples with an unbound variable, a literal
    subject or a predicate that is no IRI are left out."""
    value = lambda t: col(t.name) if isinstance(t, Var) else F.lit(t)
    rows = [F.struct(value(t.s).alias("s"), value(t.p).alias("p"), value(t.o).alias("o")) for t in sorted(set(template), key=lambda t: t.key)]
    if not rows:
        return solved.sparkSession.createDataFrame([], "s string, p string, o string")
    return solved.select(F.inline(F.array(*rows))).where(fine()).distinct()


def fine() -> Column:
    """Of s, p, o: may they be a triple?"""
    return F.col("s").isNotNull() & F.col("o").isNotNull() & F.startswith("p", F.lit("<")) & ~F.startswith("s", F.lit('"'))


def shared_out(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with one more key, which deals out the joined rows of keys that have more than PAIRS of them: the side with more
    rows of such a key is cut, each row of the other goes to all cuts. Every pair of rows meets once, as it does without."""
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # told, as else small sides with many pairs are put together in one
    counts = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_a")).join(b.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_b")), keys)
    most = F.greatest("n_a", "n_b")
    cuts = F.least(F.ceil(F.col("n_a").cast("double") * F.col("n_b") / PAIRS), most, F.lit(1_000_000)).cast("int")
    heavy = counts.select(*keys, cuts.alias("cuts"), (F.col("n_a") >= F.col("n_b")).alias("cut_a")).where("cuts > 1")

    def dealt(df: DataFrame, own: Column) -> DataFrame:
        one = F.array(F.pmod(F.xxhash64(*df.columns), F.col("cuts")).cast("int"))
        places = F.when(F.col("cuts").isNull(), F.array(F.lit(0))).when(own, one).otherwise(F.sequence(F.lit(0), F.col("cuts") - 1))
        return df.join(heavy, keys, "left").withColumn("cut", F.explode(places)).drop("cuts", "cut_a").repartition(parts, *keys, "cut")

    return dealt(a, F.col("cut_a")), dealt(b, ~F.col("cut_a")), [*keys, "cut"]


def paired(spec: RuleSpec, data: Dataset, source: list[str], show: Callable[[Column], Column]) -> DataFrame | None:
    """The set of triples of a rule that only joins match parts and makes one triple of each solution, without a shuffle of the joined
    rows: their number may be the square of the input's. The sides of the last join are made sets first. Then a solution can repeat
    only if a variable of the join is left out of the triple, and both what comes from the left and what comes from the right have
    several values of it; those pairs alone are made distinct. None if the rule has another shape."""
    other = (spec.source_maps, spec.enums, spec.bindings, spec.mints, spec.nacs, spec.filters)
    if len(spec.match) < 2 or len(set(spec.construct)) != 1 or any(other) or any(isinstance(p.scope, DataSource) for p in spec.match):
        return None
    (made,) = set(spec.construct)
    *first, last = part_order(spec.match)
    vars_a, vars_b = {v for p in first for v in p.variables}, last.variables
    keys = sorted(PREFIX + v for v in vars_a & vars_b)
    head_a, head_b = (sorted(PREFIX + v for v in made.variables & x) for x in (vars_a, vars_b))
    if not keys or not head_a or not head_b or not made.variables <= vars_a | vars_b:
        return None
    left_out = not set(keys) <= {*head_a, *head_b}

    def side(parts: list[Part], head: list[str], flag: str) -> DataFrame:
        df = reduce(natural_join, (match_part(data, p, source, distinct=False) for p in parts))
        df = df.repartition(*head).select(*dict.fromkeys((*head, *keys))).distinct()
        return df.withColumn(flag, F.count(F.lit(1)).over(Window.partitionBy(*head)) == 1) if left_out else df

    def shown(df: DataFrame, names: Iterable[str]) -> DataFrame:
        return df.withColumns({"shown_" + c: show(F.col(c)) for c in names})

    value = lambda t: col(t.name) if isinstance(t, Var) else F.lit(t)
    triples = {n: value(t).alias(n) for n, t in zip(("s", "p", "o"), made.terms, strict=True)}
    after = {n: F.col(f"shown_{PREFIX}{t.name}") if isinstance(t, Var) else show(F.lit(t)) for n, t in zip(triples, made.terms, strict=True)}
    a, b = side(first, head_a, "one_a"), side([last], head_b, "one_b")
    near, far, on = shared_out(shown(a, head_a), shown(b, (c for c in head_b if c not in head_a)), keys)
    met = near.hint("merge").join(far, on)  # the rows of a side that goes to several cuts are more than Spark expects
    met = met.where("one_a or one_b") if left_out else met
    once = met.select(*triples.values(), *(c.alias("shown_" + n) for n, c in after.items())).where(fine()).select(*(F.col("shown_" + n).alias(n) for n in after))
    if not left_out:
        return once
    again = a.where("not one_a").join(b.where("not one_b"), keys).select(*triples.values()).where(fine()).distinct()
    return once.union(again.select(*(show(F.col(n)).alias(n) for n in triples)))


def compile_rule(spec: RuleSpec, data: Dataset, source: list[str] | None = None, show: Callable[[Column], Column] | None = None) -> DataFrame:
    """The triples (s, p, o) a Construct or Assert rule derives from the source graphs, lazily. show: each triple's terms are
    returned as this has them (as a set of triples before that); where parts are joined to pairs, it is worked out before the join."""
    check(spec)
    source = list(dict.fromkeys(source or []))
    check_source(spec, source)
    if (pairs := paired(spec, data, source, show or (lambda c: c))) is not None:
        return pairs
    made = instantiate(solutions(spec, data, source), spec.construct)
    return made.select(*(show(F.col(n)).alias(n) for n in made.columns)) if show else made


def semi_naive(spec: RuleSpec, data: Dataset, source: list[str], new: DataFrame) -> DataFrame | None:
    """What derives from at least one new triple: a union of as many plans as there are patterns, each with one pattern
    over the new triples alone. None if the rule has a shape for which that says less than a full round."""
    if len(spec.match) != 1 or spec.match[0].scope is not None or spec.nacs or spec.source_maps:
        return None
    n = len(connected_order(spec.match[0].triples))
    plans = [instantiate(solutions(spec, data, source, deltas=(k, new)), spec.construct) for k in range(n)]
    return reduce(lambda a, b: a.union(b), plans).distinct()


def check_source(spec: RuleSpec, source: list[str]) -> None:
    if not source and any(isinstance(p.scope, Var | str) for p in (*spec.match, *spec.nacs)):
        refuse(spec, "a scoped read needs source graphs")


def match_patterns(data: Dataset, patterns: list[tuple[str, str, str]], graphs: list[str]) -> DataFrame:
    """Solutions of triple patterns over merged graphs, with the variables' names as columns."""
    df = match_part(data, Part("", tuple(triple(*p) for p in patterns)), graphs)
    return df.toDF(*(c[len(PREFIX) :] for c in df.columns))


# ---- identity of minted nodes


def collisions(spec: RuleSpec, data: Dataset, source: list[str], mint: Mint) -> DataFrame:
    """(minted, n) of the IRIs that stand for more than one combination of slot values. Filters don't count here: the report
    may name too many, never too few."""
    df = solutions(spec, data, source, filters=False, mints=[mint])
    key = F.concat_ws(" ", *(T.col_encode(T.col_lexical(col(v))) for _, v in mint.slots))
    return df.groupBy(col(mint.variable).alias("minted")).agg(F.countDistinct(key).alias("n")).where("n > 1").orderBy("minted")


def check_collisions(spec: RuleSpec, data: Dataset, source: list[str]) -> None:
    """Refuses to mint where different slot values make one IRI; only templates whose separators can occur inside a value
    are looked at."""
    for m in spec.mints:
        if not P.ambiguous_separators(m.template):
            continue
        some = collisions(spec, data, source, m).limit(5).collect()
        if some:
            refuse(spec, f"?{m.variable} has an ambiguous identity: " + ", ".join(f"{r['minted']} stands for {r['n']} combinations" for r in some))


def fan_in(spec: RuleSpec, data: Dataset, source: list[str], mint: Mint, limit: int = 5) -> DataFrame:
    """(minted, n) of minted IRIs that several solutions share, by how many different ones."""
    df = solutions(spec, data, source, filters=False, mints=[mint])
    minted = {m.variable for m in spec.mints}
    others = sorted({v for t in spec.construct for v in t.variables} - minted)
    key = F.struct(*(col(v) for v in others)) if others else F.lit(1)
    return df.groupBy(col(mint.variable).alias("minted")).agg(F.countDistinct(key).alias("n")).where("n > 1").orderBy(F.desc("n"), "minted").limit(limit)
