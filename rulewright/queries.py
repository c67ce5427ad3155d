"""The query catalogue: every rule feature over the relational tables, seen as quads, with the SQL that gives the same rows.

Rows of a table become triples about ``urn:t:<table>/<key>``; results are told as ``subject``, ``predicate`` and ``object`` with that
prefix and the brackets taken off.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import terms as T
from .operators.engine import Engine
from .plans import compiler as C
from .plans.loader import RuleBook, Vocabulary
from .plans.spec import ASSERT, CONSTRUCT, REWRITE, Binding, DataSource, Mint, Part, RuleSet, RuleSpec, SourceMap, Var, triple
from .sources import rdf, tabular
from .sources.store import FrameDataset, QuadStore, union_all

P = "urn:t:"
TYPE = T.iri(T.RDF + "type")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def note(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return note


# ---- tables as quads


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ent(kind: str, c: str | Column) -> Column:
    return tabular.iri_of(f"{P}{kind}/", F.col(c) if isinstance(c, str) else c)


def kind(name: str) -> Column:
    return F.lit(T.iri(P + name))


def text(c: str | Column) -> Column:
    return T.col_plain(F.col(c) if isinstance(c, str) else c)


def number(c: str | Column) -> Column:
    return tabular.int_literal(F.col(c) if isinstance(c, str) else c)


def lens(df: DataFrame, graph: str, subject: Column, predicates: dict[str, Column]) -> tabular.Lens:
    return tabular.Lens(df, P + graph, subject, {T.iri(T.RDF + "type" if k == "a" else P + k): v for k, v in predicates.items()})


def nations(spark, sf):
    return lens(table(spark, sf, "nation"), "nations", ent("nation", "n_nationkey"), {"a": kind("Nation"), "name": text("n_name"), "inRegion": ent("region", "n_regionkey"), "next": ent("nation", (F.col("n_nationkey") + 1) % 25)})


def regions(spark, sf):
    return lens(table(spark, sf, "region"), "regions", ent("region", "r_regionkey"), {"a": kind("Region"), "name": text("r_name")})


def customers(spark, sf):
    c = table(spark, sf, "customer")
    rich = F.when(F.col("c_acctbal") > 9000, F.lit(T.literal("yes")))
    return lens(c, "customers", ent("customer", "c_custkey"), {"a": kind("Customer"), "name": text("c_name"), "segment": text("c_mktsegment"), "inNation": ent("nation", "c_nationkey"), "rich": rich})


def suppliers(spark, sf):
    s = table(spark, sf, "supplier")
    rich = F.when(F.col("s_acctbal") > 9000, F.lit(T.literal("yes")))
    return lens(s, "suppliers", ent("supplier", "s_suppkey"), {"a": kind("Supplier"), "name": text("s_name"), "inNation": ent("nation", "s_nationkey"), "rich": rich})


def parts(spark, sf):
    p = table(spark, sf, "part")
    tenth = T.col_typed(F.concat(F.col("p_size").cast("string"), F.lit(".0")), T.XSD + "decimal")
    return lens(p, "parts", ent("part", "p_partkey"), {"name": text("p_name"), "brand": text("p_brand"), "size": number("p_size"), "sizeDecimal": tenth, "rank": number(F.col("p_partkey") % 50)})


def orders(spark, sf):
    o = table(spark, sf, "orders")
    return lens(o, "orders", ent("order", "o_orderkey"), {"number": number("o_orderkey"), "status": text("o_orderstatus"), "by": ent("customer", "o_custkey"), "priority": text("o_orderpriority")})


def turns(spark, sf):
    t = table(spark, sf, "conversations")
    at = lambda k: F.concat_ws("-", F.col("conv_id"), F.col("turn") + k)
    return lens(t, "turns", ent("turn", at(0)), {"next": ent("turn", at(1))})


# ---- rules in short


def term(x: str) -> str:
    return x if x[:1] in '?"<_' else TYPE if x == "a" else T.iri(P + x)


def pats(lines: str) -> tuple:
    return tuple(triple(*map(term, line.split(None, 2))) for line in lines.strip().split(";"))


def part(lines: str, graph: str = "L", scope=None) -> Part:
    return Part(graph, pats(lines), scope)


def rule(match, construct: str, mode: str = CONSTRUCT, name: str = "rule", **kw) -> RuleSpec:
    parts_ = tuple(match) if isinstance(match, list | tuple) else (part(match),)
    return RuleSpec(P + name, mode, parts_, pats(construct), **kw)


def bare(x: Column) -> Column:
    begin = F.when(x.startswith(f"<{P}"), len(P) + 2).otherwise(2)
    return F.when(x.startswith("<"), F.substr(x, begin, F.length(x) - begin)).when(x.startswith('"'), T.col_lexical(x)).otherwise(x)


def strip(c: str) -> Column:
    return bare(F.col(c))


def told(triples: DataFrame, *names: str) -> DataFrame:
    full = {"subject": strip("s"), "predicate": strip("p"), "object": strip("o")}
    return triples.select(*(full[n].alias(n) for n in names or ("subject", "object")))


def run(spark, quads: list[DataFrame | tabular.Lens], spec: RuleSpec, graphs: list[str], show: Callable[[Column], Column] | None = None) -> DataFrame:
    return C.compile_rule(spec, FrameDataset(*quads), [P + g for g in graphs], show)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode, where it is unset, a new one."""
    if told := spark.conf.get("spark.checkpoint.dir", None):
        return told.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: executors would not see a folder of the driver's")
    return "file://" + tempfile.mkdtemp(prefix="rulewright-")


def engine(spark: SparkSession, *quads: DataFrame | tabular.Lens) -> Engine:
    e = Engine(QuadStore(spark, f"{shared_dir(spark)}/quads-{uuid.uuid4().hex}"))
    if quads:
        e.store.add(union_all([q.quads() if isinstance(q, tabular.Lens) else q for q in quads]))
    return e


class Rules(dict):
    """Rules by IRI, for sets that are put together here."""

    rule = dict.__getitem__

    @classmethod
    def of(cls, *rules: RuleSpec) -> Rules:
        return cls((r.iri, r) for r in rules)


# ---- matching


@query("SELECT 'nation/' || n_nationkey AS subject, r_name AS object FROM nation JOIN region ON n_regionkey = r_regionkey")
def q01_bgp_star(spark, sf):
    r = rule("?n a Nation; ?n name ?x; ?n inRegion ?r; ?r name ?y", "?n regionName ?y")
    return told(run(spark, [nations(spark, sf), regions(spark, sf)], r, ["nations", "regions"]))


@query("SELECT 'customer/' || c_custkey AS subject, r_name AS object FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def q02_bgp_path3(spark, sf):
    r = rule("?c inNation ?n; ?n inRegion ?r; ?r name ?y", "?c regionName ?y")
    return told(run(spark, [customers(spark, sf), nations(spark, sf), regions(spark, sf)], r, ["customers", "nations", "regions"]))


@query("""SELECT 'nation/' || c_nationkey AS subject, 'hasCustomer' AS predicate, 'customer/' || c_custkey AS object FROM customer
UNION SELECT 'customer/' || c_custkey, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'Resident' FROM customer""")
def q03_construct_template(spark, sf):
    r = rule("?c inNation ?n; ?c a Customer", "?n hasCustomer ?c; ?c a Resident")
    return told(run(spark, [customers(spark, sf)], r, ["customers"]), "subject", "predicate", "object")


@query("""SELECT 'customer/' || c_custkey AS subject, 'nation/' || c_nationkey AS object FROM customer
UNION SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey FROM supplier""")
def q04_default_merge(spark, sf):
    c = customers(spark, sf).quads()
    again = c.withColumn("g", F.lit(P + "copies"))  # the same triples in another graph: a merge counts them once
    return told(run(spark, [c, again, suppliers(spark, sf)], rule("?x inNation ?n", "?x locatedIn ?n"), ["customers", "copies", "suppliers"]))


@query("SELECT DISTINCT 'customer/' || c_custkey AS subject, 'supplier/' || s_suppkey AS object FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def q05_multi_part(spark, sf):
    r = rule([part("?c inNation ?n", "L1", P + "customers"), part("?s inNation ?n", "L2", P + "suppliers")], "?c near ?s")
    return run(spark, [customers(spark, sf), suppliers(spark, sf)], r, ["customers", "suppliers"], bare).select(F.col("s").alias("subject"), F.col("o").alias("object"))


@query("""SELECT DISTINCT 'nation/' || c_nationkey AS subject, 'customers' AS object FROM customer
UNION SELECT DISTINCT 'nation/' || s_nationkey, 'suppliers' FROM supplier""")
def q06_graph_variable(spark, sf):
    r = rule([part("?x inNation ?n; ?x a ?k", scope=Var("g"))], "?n mentionedIn ?g")
    return told(run(spark, [customers(spark, sf), suppliers(spark, sf)], r, ["customers", "suppliers"]))


@query("SELECT 'region/' || a.r_regionkey AS subject, 'region/' || b.r_regionkey AS object FROM region a JOIN region b ON a.r_name < b.r_name")
def q07_cross_theta(spark, sf):
    r = rule("?a name ?x; ?b name ?y", "?a before ?b", filters=("STR(?x) < STR(?y)",))
    return told(run(spark, [regions(spark, sf)], r, ["regions"]))


@query("SELECT 'part/' || p_partkey AS subject, CAST(p_size AS VARCHAR) AS object FROM part WHERE p_size <> 7 AND p_size > 3")
def q08_filter_value_equality(spark, sf):
    r = rule("?p size ?s; ?p sizeDecimal ?d", "?p sized ?s", filters=("?s = ?d && ?s != 7.00", "!(?d <= 3)"))
    return told(run(spark, [parts(spark, sf)], r, ["parts"]))


@query("SELECT 'part/' || p_partkey AS subject, p_name AS object FROM part WHERE contains(p_name, 'red') OR starts_with(p_name, 'blue')")
def q09_filter_contains(spark, sf):
    r = rule("?p name ?n", "?p coloured ?n", filters=('CONTAINS(?n, "red") || STRSTARTS(?n, "blue")',))
    return told(run(spark, [parts(spark, sf)], r, ["parts"]))


@query("""SELECT 'part/' || p_partkey AS subject,
upper(regexp_replace(CASE WHEN contains(p_name, ' ') THEN substr(p_name, strpos(p_name, ' ') + 1) || '_' || split_part(p_name, ' ', 1) ELSE p_name END, '[aeiou]', '*', 'g')) AS object FROM part""")
def q10_bind_chain(spark, sf):
    binds = (Binding("slug", 'UCASE(REPLACE(?turned, "[aeiou]", "*"))'), Binding("turned", 'IF(CONTAINS(?n, " "), CONCAT(STRAFTER(?n, " "), "_", STRBEFORE(?n, " ")), ?n)'))
    return told(run(spark, [parts(spark, sf)], rule("?p name ?n", "?p slug ?slug", bindings=binds), ["parts"]))


@query("SELECT 'part/' || p_partkey AS subject, md5(p_brand || '|' || p_size) AS object FROM part")
def q11_md5_key(spark, sf):
    binds = (Binding("k", 'MD5(CONCAT(?b, "|", STR(?s)))'),)
    return told(run(spark, [parts(spark, sf)], rule("?p brand ?b; ?p size ?s", "?p key ?k", bindings=binds), ["parts"]))


@query("SELECT DISTINCT 'priority/' || replace(o_orderpriority, ' ', '%20') || '/' || o_orderstatus AS subject, o_orderpriority AS object FROM orders")
def q12_mint_iri(spark, sf):
    m = (Mint("m", P + "priority/{p}/{s}", (("p", "x"), ("s", "y"))),)
    return told(run(spark, [orders(spark, sf)], rule("?o priority ?x; ?o status ?y", "?m label ?x", mints=m), ["orders"]))


@query("""SELECT DISTINCT 'place/' || n_name AS subject, 'nation/' || n_nationkey AS object FROM nation
UNION SELECT 'place/' || r_name, 'region/' || r_regionkey FROM (SELECT replace(r_name, ' ', '%20') AS r_name, r_regionkey FROM region)""")
def q13_mint_function(spark, sf):
    """Two rules share a minting function: equal names reach equal IRIs."""
    data = [nations(spark, sf), regions(spark, sf)]
    m = lambda v: (Mint("m", P + "place/{n}", (("n", v),), P + "placeFunction"),)
    a = run(spark, data, rule("?x a Nation; ?x name ?n", "?m of ?x", mints=m("n")), ["nations"])
    b = run(spark, data, rule("?y a Region; ?y name ?k", "?m of ?y", mints=m("k")), ["regions"])
    return told(a.union(b).distinct())


@query("SELECT 'region/' || r_regionkey AS subject, r_name AS object FROM region WHERE r_name IN ('ASIA', 'EUROPE')")
def q14_values_constrain(spark, sf):
    return told(run(spark, [regions(spark, sf)], rule("?r name ?n", "?r kept ?n", enums=(("n", (T.literal("ASIA"), T.literal("EUROPE"), T.literal("NOWHERE"))),)), ["regions"]))


@query("SELECT 'check/' || n_name || '/' || c AS subject, 'nation/' || n_nationkey AS object FROM nation CROSS JOIN (VALUES ('EU'), ('JP'), ('US')) v(c)")
def q15_values_generate(spark, sf):
    r = rule("?n a Nation; ?n name ?x", "?m of ?n", enums=(("c", tuple(map(T.literal, ("EU", "JP", "US")))),), mints=(Mint("m", P + "check/{n}/{c}", (("c", "c"), ("n", "x"))),))
    return told(run(spark, [nations(spark, sf)], r, ["nations"]))


@query("SELECT 'customer/' || c_custkey AS subject, c_name AS object FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def q16_negative_condition(spark, sf):
    r = rule("?c a Customer; ?c name ?n", "?c idle ?n", nacs=(part('?o by ?c; ?o status "F"', "N"),))
    return told(run(spark, [customers(spark, sf), orders(spark, sf)], r, ["customers", "orders"]))


@query("""WITH x AS (SELECT c_nationkey AS n, 'customers' AS g, c_acctbal AS b FROM customer UNION ALL SELECT s_nationkey, 'suppliers', s_acctbal FROM supplier)
SELECT DISTINCT 'nation/' || n AS subject, g AS object FROM x WHERE NOT EXISTS (SELECT 1 FROM x y WHERE y.n = x.n AND y.g = x.g AND y.b > 9000)""")
def q17_negative_condition_in_graph(spark, sf):
    r = rule([part("?x inNation ?n", scope=Var("g"))], "?n nobodyRichIn ?g", nacs=(part('?y inNation ?n; ?y rich "yes"', "N", Var("g")),))
    return told(run(spark, [customers(spark, sf), suppliers(spark, sf)], r, ["customers", "suppliers"]))


@query("SELECT 'review/' || o_orderkey AS subject, 'order/' || o_orderkey AS object FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 <> 0")
def q18_negative_condition_minted(spark, sf):
    o = table(spark, sf, "orders").where("o_orderkey % 3 = 0")
    tasks = lens(o, "tasks", ent("review", "o_orderkey"), {"a": kind("Task")})
    r = rule('?o status "F"; ?o number ?k', "?m about ?o", mints=(Mint("m", P + "review/{k}", (("k", "k"),)),), nacs=(part("?m a Task", "N"),))
    return told(run(spark, [orders(spark, sf), tasks], r, ["orders", "tasks"]))


@query("""SELECT 'customer/' || c_custkey AS subject, c_name AS object FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')
AND NOT c_acctbal > 9000""")
def q19_two_negative_conditions(spark, sf):
    r = rule("?c a Customer; ?c name ?n", "?c quiet ?n", nacs=(part('?o by ?c; ?o status "F"', "N1"), part('?c rich "yes"', "N2")))
    return told(run(spark, [customers(spark, sf), orders(spark, sf)], r, ["customers", "orders"]))


@query("SELECT DISTINCT 'nation/' || c_nationkey AS subject, 'yes' AS object FROM customer")
def q20_dedupe_set(spark, sf):
    return told(run(spark, [customers(spark, sf)], rule("?c inNation ?n", '?n populated "yes"'), ["customers"]))


@query("""SELECT 'customer/' || c_custkey AS subject, 'nation/' || c_nationkey AS object FROM customer
EXCEPT SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey FROM customer WHERE c_custkey % 4 = 0""")
def q21_prune_known(spark, sf):
    known = customers(spark, sf).quads().where(F.col("p") == term("inNation")).where(F.regexp_extract("s", r"/(\d+)>", 1).cast("long") % 4 == 0).select(F.lit(P + "known").alias("g"), "s", F.lit(term("livesIn")).alias("p"), "o")
    data = FrameDataset(customers(spark, sf), known)
    source = [P + "customers", P + "known"]
    new = C.compile_rule(rule("?c inNation ?n", "?c livesIn ?n"), data, source).join(data.merged(source), ["s", "p", "o"], "left_anti")
    return told(new)


@query("SELECT 'nation/' || n_nationkey AS subject, n_name AS object FROM nation WHERE n_nationkey >= 5")
def q22_prune_destination(spark, sf):
    """True in the source already, but new to the destination, which has a fifth of it."""
    e = engine(spark)
    names = nations(spark, sf).quads().where(F.col("p") == term("name"))
    e.store.add(names)
    e.store.put_graph(names.where(F.regexp_extract("s", r"/(\d+)>", 1).cast("long") < 5).select("s", "p", "o"), P + "dest")
    (f,) = e.run_rule(rule("?n name ?x", "?n name ?x", construct_scope=P + "dest"), [P + "nations"])
    return told(e.store.merged([f.graph]))


# ---- fixpoints


def closure(e: Engine, source: str, edge: str = "next", **kw) -> DataFrame:
    spec = rule(f"?a {edge} ?b; ?b {edge} ?c", f"?a {edge} ?c", ASSERT, **kw)
    return e.store.merged([source, *(f.graph for f in e.run_rule(spec, [source]) if not spec.destination)])


@query("""WITH RECURSIVE e AS (SELECT DISTINCT conv_id || '-' || turn AS a, conv_id || '-' || (turn + 1) AS b FROM conversations),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT 'turn/' || a AS subject, 'turn/' || b AS object FROM r""")
def q23_fixpoint_closure(spark, sf):
    e = engine(spark, turns(spark, sf))
    return told(closure(e, P + "turns"))


@query("SELECT 'nation/' || a.n_nationkey AS subject, 'nation/' || b.n_nationkey AS object FROM nation a CROSS JOIN nation b")
def q24_fixpoint_ring(spark, sf):
    e = engine(spark, nations(spark, sf).quads().where(F.col("p") == term("next")))
    return told(closure(e, P + "nations"))


@query("SELECT 'nation/' || a.n_nationkey AS subject, 'nation/' || b.n_nationkey AS object FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def q25_fixpoint_in_place(spark, sf):
    e = engine(spark, nations(spark, sf).quads().where((F.col("p") == term("next")) & ~F.col("o").endswith("/0>")))
    return told(closure(e, P + "nations", construct_scope=P + "nations"))


# ---- identity


@query("SELECT 'home/' || c_nationkey AS minted, count(DISTINCT c_custkey) AS n FROM customer GROUP BY c_nationkey HAVING count(DISTINCT c_custkey) > 1 ORDER BY n DESC, '<urn:t:home/' || c_nationkey || '>' LIMIT 5")
def q26_fan_in(spark, sf):
    m = Mint("m", P + "home/{n}", (("n", "k"),))
    keys = lens(table(spark, sf, "nation"), "nations", ent("nation", "n_nationkey"), {"key": number("n_nationkey")})
    r = rule("?c inNation ?n; ?n key ?k", "?m of ?c", mints=(m,))
    found = C.fan_in(r, FrameDataset(customers(spark, sf), keys), [P + "customers", P + "nations"], m)
    return found.select(strip("minted").alias("minted"), "n")


@query("""SELECT 'pair/' || k AS minted, n FROM (SELECT a || '-' || b AS k, count(DISTINCT a || ' ' || b) AS n FROM
(SELECT CAST(p_size AS VARCHAR) AS a, p_size || '-' || (p_partkey % 50) AS b FROM part UNION SELECT p_size || '-' || p_size, CAST(p_partkey % 50 AS VARCHAR) FROM part) GROUP BY a || '-' || b) WHERE n > 1""")
def q27_collisions(spark, sf):
    """a-b and c can be a and b-c: the same IRI for different keys."""
    p = table(spark, sf, "part")
    size, rank = F.col("p_size").cast("string"), (F.col("p_partkey") % 50).cast("string")
    dash = lambda x, y: F.concat_ws("-", x, y)
    one = lens(p, "keys", ent("k1", "p_partkey"), {"first": text(size), "second": text(dash(size, rank))})
    two = lens(p, "keys", ent("k2", "p_partkey"), {"first": text(dash(size, size)), "second": text(rank)})
    m = Mint("m", P + "pair/{a}-{b}", (("a", "x"), ("b", "y")))
    r = rule("?k first ?x; ?k second ?y", "?m of ?k", mints=(m,))
    return C.collisions(r, FrameDataset(one, two), [P + "keys"], m).select(strip("minted").alias("minted"), "n")


# ---- rewrites and the ledger

RENAME = rule("?n a Nation; ?n name ?x", "?n a Nation; ?n title ?x", REWRITE, "rename")


def renamed(spark, sf):
    e = engine(spark, nations(spark, sf))
    titled = nations(spark, sf).quads().where((F.col("p") == term("name")) & F.col("s").endswith("/7>")).select("g", "s", F.lit(term("title")).alias("p"), "o")
    e.store.add(titled)
    return e, e.run_rule(RENAME, [P + "nations"])


@query("SELECT 'nation/' || n_nationkey AS subject, 'name' AS predicate, n_name AS object FROM nation")
def q28_rewrite_removed(spark, sf):
    e, (f,) = renamed(spark, sf)
    return told(e.store.merged([f.tombstone]), "subject", "predicate", "object")


@query("SELECT 'nation/' || n_nationkey AS subject, 'title' AS predicate, n_name AS object FROM nation WHERE n_nationkey <> 7")
def q29_rewrite_added(spark, sf):
    e, (f,) = renamed(spark, sf)
    return told(e.store.merged([f.graph]), "subject", "predicate", "object")


@query("""SELECT 'nation/' || n_nationkey AS subject, 'title' AS predicate, n_name AS object FROM nation
UNION ALL SELECT 'nation/' || n_nationkey, 'inRegion', 'region/' || n_regionkey FROM nation
UNION ALL SELECT 'nation/' || n_nationkey, 'next', 'nation/' || ((n_nationkey + 1) % 25) FROM nation
UNION ALL SELECT 'nation/' || n_nationkey, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'Nation' FROM nation""")
def q30_rewrite_after(spark, sf):
    e, _ = renamed(spark, sf)
    return told(e.store.merged([P + "nations"]), "subject", "predicate", "object")


@query("""SELECT 'nation/' || n_nationkey AS subject, 'name' AS predicate, n_name AS object FROM nation
UNION ALL SELECT 'nation/7', 'title', n_name FROM nation WHERE n_nationkey = 7""")
def q31_undo(spark, sf):
    e, (f,) = renamed(spark, sf)
    e.undo_firing(f.graph)
    return told(e.store.merged([P + "nations"]).where(F.col("p").isin(term("name"), term("title"))), "subject", "predicate", "object")


@query("SELECT 'nation/' || n_nationkey AS subject, n_name AS object, 'rename' AS rule, 1 AS ordinal FROM nation WHERE n_nationkey = 3")
def q32_retractions(spark, sf):
    e, _ = renamed(spark, sf)
    gone = e.retractions(subject=P + "nation/3", predicate=P + "name")
    return gone.select(strip("s").alias("subject"), strip("o").alias("object"), F.regexp_replace("rule", f"^{P}", "").alias("rule"), F.col("ordinal").cast("int").alias("ordinal"))


@query("SELECT 1 AS ordinal, 1 AS iteration, 23 AS triple_count UNION ALL SELECT 2, 2, 22 + 21")
def q33_firings_log(spark, sf):
    """Two rounds over a chain of 25: the 23 edges of two steps, then those of three and four."""
    e = engine(spark, nations(spark, sf).quads().where((F.col("p") == term("next")) & ~F.col("o").endswith("/0>")))
    spec = rule("?a next ?b; ?b next ?c", "?a next ?c", ASSERT)
    one = e.run_rule(spec, [P + "nations"], strategy="Once")
    e.apply_rule(spec, [P + "nations", one[0].graph], iteration=2)
    return e.firings().select(F.col("ordinal").cast("int").alias("ordinal"), "iteration", F.col("triple_count").cast("int").alias("triple_count"))


# ---- sets

STEPS = [
    rule("?c inNation ?n; ?n inRegion ?r", "?c inRegion ?r", name="a_locate"),
    rule("?c inRegion ?r; ?r name ?x; ?c a Customer", "?r hasCustomer ?c", name="b_turn"),
]


@query("SELECT 'region/' || n_regionkey AS subject, 'customer/' || c_custkey AS object FROM customer JOIN nation ON c_nationkey = n_nationkey")
def q34_ruleset_cascade(spark, sf):
    e = engine(spark, customers(spark, sf), nations(spark, sf), regions(spark, sf))
    *_, last = e.run_rules(STEPS, [P + g for g in ("customers", "nations", "regions")], ordered=True, rule_set=P + "set")
    return told(e.store.merged([last.graph]))


@query("SELECT 'region/' || n_regionkey AS subject, 'customer/' || c_custkey AS object FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 1")
def q35_ruleset_rerun(spark, sf):
    """The input changes, the set's firings are undone and run again: nothing stale is left."""
    e = engine(spark, customers(spark, sf), nations(spark, sf), regions(spark, sf))
    source = [P + g for g in ("customers", "nations", "regions")]
    told_ = RuleSet(P + "set", tuple(r.iri for r in STEPS), "", None, None)
    e.run_rule_set(Rules.of(*STEPS), told_, source)
    half = customers(spark, sf).quads().where(F.regexp_extract("s", r"/(\d+)>", 1).cast("long") % 2 == 1).select("s", "p", "o")
    e.store.put_graph(half, P + "customers")
    _, (*_, last) = e.rerun_rule_set(Rules.of(*STEPS), told_, source)
    return told(e.store.merged([last.graph]))


ACCOUNT = Mint("a", P + "account/{name}", (("name", "x"),))
LEDGER_RULES = [
    rule("?c a Customer; ?c name ?x", "?a of ?c; ?a a Account", name="g1_account", mints=(ACCOUNT,), construct_scope=P + "accounts"),
    rule("?a of ?c; ?c segment ?s", "?a segment ?y", name="g2_segment", bindings=(Binding("y", "LCASE(?s)"),), construct_scope=P + "accounts"),
    rule("?a of ?c; ?c inNation ?n; ?n name ?x", "?a country ?x", name="g3_country", construct_scope=P + "accounts"),
    rule('?o status "F"; ?o number ?k', "?t closes ?o", name="g4_trade", mints=(Mint("t", P + "trade/{k}", (("k", "k"),)),), construct_scope=P + "trades"),
    rule("?t closes ?o; ?o by ?c; ?a of ?c", "?t account ?a", name="g5_trader", construct_scope=P + "trades"),
    rule("?t closes ?o; ?o priority ?p", '?t urgent "yes"', name="g6_urgent", filters=('STRSTARTS(?p, "1")',), construct_scope=P + "trades"),
    rule("?t account ?a; ?a country ?x", "?m trades ?t", name="g7_market", mints=(Mint("m", P + "market/{x}", (("x", "x"),)),), construct_scope=P + "report"),
    rule("?a a Account; ?a of ?c", "?a idle ?c", name="g8_idle", nacs=(part("?t account ?a", "N"),), construct_scope=P + "report"),
]
LEDGER_GRAPHS = ("accounts", "trades", "report")


def closed_books(spark: SparkSession, sf: str) -> tuple[Engine, list, list[str]]:
    """Eight rules in order, over three graphs into three others; each rule reads what the ones before it have made."""
    e = engine(spark, customers(spark, sf), nations(spark, sf), orders(spark, sf))
    source = [P + g for g in ("customers", "nations", "orders", *LEDGER_GRAPHS)]
    told_ = RuleSet(P + "books", tuple(r.iri for r in LEDGER_RULES), "", None, None)
    return e, e.run_rule_set(Rules.of(*LEDGER_RULES), told_, source), source


@query("""WITH c AS (SELECT 'account/' || replace(replace(c_name, '#', '%23'), ' ', '%20') AS a, * FROM customer JOIN nation ON c_nationkey = n_nationkey), o AS (SELECT 'trade/' || o_orderkey AS t, * FROM orders JOIN c ON o_custkey = c_custkey WHERE o_orderstatus = 'F')
SELECT 'accounts' AS graph, a AS subject, 'of' AS predicate, 'customer/' || c_custkey AS object FROM c UNION ALL SELECT 'accounts', a, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'Account' FROM c
UNION ALL SELECT 'accounts', a, 'segment', lower(c_mktsegment) FROM c UNION ALL SELECT 'accounts', a, 'country', n_name FROM c
UNION ALL SELECT 'trades', 'trade/' || o_orderkey, 'closes', 'order/' || o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'trades', t, 'account', a FROM o
UNION ALL SELECT 'trades', 'trade/' || o_orderkey, 'urgent', 'yes' FROM orders WHERE o_orderstatus = 'F' AND starts_with(o_orderpriority, '1')
UNION ALL SELECT 'report', 'market/' || replace(n_name, ' ', '%20'), 'trades', t FROM o
UNION ALL SELECT 'report', a, 'idle', 'customer/' || c_custkey FROM c WHERE a NOT IN (SELECT a FROM o)""")
def q51_eight_rules(spark, sf):
    e, _, _ = closed_books(spark, sf)
    made = e.store.scan([P + g for g in LEDGER_GRAPHS])
    return made.select(F.regexp_replace("g", f"^{P}", "").alias("graph"), strip("s").alias("subject"), strip("p").alias("predicate"), strip("o").alias("object"))


# ---- tables of files


def as_csv(spark: SparkSession, df: DataFrame) -> DataSource:
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    df.write.option("header", True).option("escape", '"').csv(path)
    return DataSource(P + "file", (("csv.headers", "true"), ("location", path)))


def from_file(spark, df: DataFrame, maps: tuple[SourceMap, ...], construct: str, **kw) -> DataFrame:
    return C.compile_rule(rule([Part("L", (), as_csv(spark, df))], construct, source_maps=maps, **kw), FrameDataset(rdf.frame(spark, [])), [])


@query("SELECT DISTINCT 'part/' || p_partkey AS subject, unnest(string_split(p_name, ' ')) AS object FROM part")
def q36_split_explode(spark, sf):
    maps = (SourceMap("k", "p_partkey"), SourceMap("w", "p_name", separator=" "))
    return told(from_file(spark, table(spark, sf, "part").select("p_partkey", "p_name"), maps, "?m word ?w", mints=(Mint("m", P + "part/{k}", (("k", "k"),)),)))


@query("SELECT 'page/' || page_id AS subject, split_part(url, '?', 1) AS object FROM pages")
def q37_string_before(spark, sf):
    maps = (SourceMap("k", "page_id"), SourceMap("u", "url", string_before="?"))
    return told(from_file(spark, table(spark, sf, "pages").select("page_id", "url"), maps, "?m address ?u", mints=(Mint("m", P + "page/{k}", (("k", "k"),)),)))


@query("SELECT 'page/' || page_id AS subject, url AS object FROM pages WHERE regexp_matches(url, '^https://') AND NOT regexp_matches(url, '#top$')")
def q38_pattern_filters(spark, sf):
    maps = (SourceMap("k", "page_id"), SourceMap("u", "url", pattern_match="^https://", pattern_exclude="#top$"))
    return told(from_file(spark, table(spark, sf, "pages").select("page_id", "url"), maps, "?m address ?u", mints=(Mint("m", P + "page/{k}", (("k", "k"),)),)))


# ---- reports


@query("SELECT subject, object FROM (SELECT 'customer/' || c_custkey AS subject, 'nation/' || c_nationkey AS object FROM customer ORDER BY '<urn:t:customer/' || c_custkey || '>' LIMIT 25)")
def q39_preview_sample(spark, sf):
    e = engine(spark, customers(spark, sf))
    _, sample = e.dry_run(rule("?c inNation ?n", "?c livesIn ?n"), [P + "customers"], 25)
    return told(spark.createDataFrame(sample, "s string, p string, o string"))


@query("SELECT 'region_' || r_regionkey AS rule, 'Construct' AS mode, r_regionkey % 3 AS negative_conditions FROM region")
def q40_count_by(spark, sf):
    """A rule for each region, declared as text, with none to two negative conditions: counted for each, also where there is none."""
    keys = [r[0] for r in table(spark, sf, "region").select("r_regionkey").collect()]
    v = Vocabulary()
    lines = [f"<{P}v> {v.p_variableText} \"?x\" ."]
    for k in keys:
        at = lambda g, k=k: f"<{P}region_{k}{g}>"
        lines += [f"{at('')} {v.r_hasMatchPattern} {at('/match')} ; {v.r_hasConstructPattern} {at('/made')} ; {v.r_rewriteMode} {v.r__RewriteMode_construct} .", f"{at('/match')} {{ <{P}v> <{P}p> <{P}region/{k}> . }}", f"{at('/made')} {{ <{P}v> <{P}q> <{P}region/{k}> . }}"]
        for i in range(k % 3):
            lines += [f"{at('')} {v.r_hasNegativeCondition} {at(f'/not{i}')} .", f"{at(f'/not{i}')} {{ <{P}v> <{P}r{i}> <{P}region/{k}> . }}"]
    rows = [(c["rule"].removeprefix(P), c["mode"], c["negative_conditions"]) for c in RuleBook.parse("\n".join(lines)).catalogue()]
    return spark.createDataFrame(rows, "rule string, mode string, negative_conditions int")


@query("SELECT 'genid:' || n_nationkey AS subject, 'genid:' || ((n_nationkey + 1) % 25) AS object FROM nation")
def q41_skolem(spark, sf):
    n = table(spark, sf, "nation")
    blank = lambda c: F.concat(F.lit("_:"), c.cast("string"))
    q = n.select(F.lit("g").alias("g"), blank(F.col("n_nationkey")).alias("s"), F.lit(term("next")).alias("p"), blank((F.col("n_nationkey") + 1) % 25).alias("o"))
    return told(rdf.skolemize(q, P + "genid:")[0])


@query("SELECT EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 9000) AS some, EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 1e12) AS none")
def q42_ask(spark, sf):
    data = FrameDataset(customers(spark, sf))
    ask = lambda p, o: not C.match_patterns(data, [("?c", term(p), o)], [P + "customers"]).isEmpty()
    return spark.range(1).select(F.lit(ask("rich", '"yes"')).alias("some"), F.lit(ask("rich", '"never"')).alias("none"))


@query("SELECT 1 AS next UNION ALL SELECT 4")
def q43_max_plus_one(spark, sf):
    """The number of the next firing: one where there is none, and above all that there have been, undone ones too."""
    e = engine(spark, nations(spark, sf))
    found = [e.next_ordinal]
    spec = rule("?n name ?x", "?n title ?x")
    for _ in range(3):
        (f,) = e.run_rule(spec, [P + "nations"])
        e.undo_firing(f.graph)
    return spark.createDataFrame([(x,) for x in [*found, e.next_ordinal]], "next int")


@query("SELECT 'document/' || doc_id AS subject, lang AS language, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#langString' AS datatype FROM documents WHERE lang IN ('fr', 'de')")
def q44_datatype_language(spark, sf):
    d = table(spark, sf, "documents")
    tagged = F.concat(text(F.col("source")), F.lit("@"), F.col("lang"))
    q = lens(d, "documents", ent("document", "doc_id"), {"source": tagged})
    r = rule("?d source ?x", "?d tagged ?y; ?d typed ?z", bindings=(Binding("y", "LANG(?x)"), Binding("z", "DATATYPE(?x)")), filters=('LANG(?x) IN ("fr", "de")',))
    t = run(spark, [q], r, ["documents"])
    y, z = (t.where(F.col("p") == term(p)).select("s", strip("o").alias(n)) for p, n in (("tagged", "language"), ("typed", "datatype")))
    return y.join(z, "s").select(strip("s").alias("subject"), "language", "datatype")


@query("""SELECT 'name' AS predicate, n_name AS object FROM nation WHERE n_nationkey = 4 UNION ALL SELECT 'inRegion', 'region/' || n_regionkey FROM nation WHERE n_nationkey = 4
UNION ALL SELECT 'next', 'nation/5' UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'Nation'""")
def q45_variable_predicate(spark, sf):
    q = nations(spark, sf)
    r = rule(f"<{P}nation/4> ?p ?o", "about4 ?p ?o")
    return told(run(spark, [q], r, ["nations"]), "predicate", "object")


# ---- expressions


def bound(spark, q, match: str, predicate: str, text_: str, **kw) -> DataFrame:
    """What a rule binds by one expression."""
    r = rule(match, f"?s {predicate} ?y", bindings=(Binding("y", text_),), **kw)
    return told(run(spark, [q], r, [q.graph.removeprefix(P)]))


@query("""SELECT 'order/' || o_orderkey AS subject, year(o_orderdate) || '-' || month(o_orderdate) || '-' || day(o_orderdate) || '/23/45/13.815/-05:00' AS object FROM orders""")
def q46_date_parts(spark, sf):
    """As the text has them, whatever the time zone of the session or of the text."""
    o = table(spark, sf, "orders")
    at = T.col_typed(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T23:45:13.815-05:00")), T.XSD + "dateTime")
    parts_ = ('STR(YEAR(?d))', '"-"', 'STR(MONTH(?d))', '"-"', 'STR(DAY(?d))', '"/"', 'STR(HOURS(?d))', '"/"', 'STR(MINUTES(?d))', '"/"', 'STR(SECONDS(?d))', '"/"', 'TZ(?d)')
    return bound(spark, lens(o, "orders", ent("order", "o_orderkey"), {"at": at}), "?s at ?d", "told", f"CONCAT({', '.join(parts_)})")


@query("""SELECT 'supplier/' || s_suppkey AS subject, CAST(CAST(trunc(s_acctbal) AS BIGINT) AS VARCHAR) || '/' || CAST(s_acctbal <> 0 AS VARCHAR) || '/none' AS object FROM supplier""")
def q47_casts(spark, sf):
    """Towards nought; a text that is no integer is an error, not a number."""
    s = table(spark, sf, "supplier")
    q = lens(s, "suppliers", ent("supplier", "s_suppkey"), {"balance": T.col_typed(F.col("s_acctbal").cast("decimal(18,2)").cast("string"), T.XSD + "decimal")})
    x = f'CONCAT(STR(<{T.XSD}integer>(?b)), "/", STR(<{T.XSD}boolean>(?b)), "/", COALESCE(STR(<{T.XSD}integer>(STR(?b))), "none"))'
    return bound(spark, q, "?s balance ?b", "told", x)


@query("""SELECT 'part/' || p_partkey AS subject, CAST(CAST((p_size * 2 + 1) / 4.0 AS DECIMAL(12, 2)) AS VARCHAR) || '/' || CAST(abs(p_size - 25) AS VARCHAR) || '/' || CAST(CAST(floor((p_size * 2 + 1) / 4.0 + 0.5) AS BIGINT) AS VARCHAR) AS object
FROM part WHERE p_size * 3 - 10 > p_size""")
def q48_arithmetic(spark, sf):
    r = 'CONCAT(STR((?z * 2 + 1) / 4), "/", STR(ABS(?z - 25)), "/", STR(ROUND((?z * 2 + 1) / 4)))'
    return bound(spark, parts(spark, sf), "?s size ?z", "told", r, filters=("?z * 3 - 10 > ?z", "?z * 1e24 > 1"))


@query("""SELECT 'document/' || doc_id AS subject, upper(source) || '@' || lang || '/' || substr(source, 2, 2) || '@' || lang AS object FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL""")
def q49_language_tags(spark, sf):
    """Functions of strings keep the tag."""
    d = table(spark, sf, "documents")
    q = lens(d, "documents", ent("document", "doc_id"), {"source": F.concat(text(F.col("source")), F.lit("@"), F.col("lang"))})
    x = 'CONCAT(STR(UCASE(?x)), "@", LANG(UCASE(?x)), "/", STR(SUBSTR(?x, 2, 2)), "@", LANG(SUBSTR(?x, 2, 2)))'
    return bound(spark, q, "?s source ?x", "told", x)


@query("SELECT 'nation/' || n_nationkey AS subject, 'yes' AS object FROM nation WHERE n_nationkey % 2 = 0")
def q50_repeated_variable(spark, sf):
    q = lens(table(spark, sf, "nation"), "nations", ent("nation", "n_nationkey"), {"likes": ent("nation", F.col("n_nationkey") - F.col("n_nationkey") % 2)})
    return told(run(spark, [q], rule("?n likes ?n", '?n proud "yes"'), ["nations"]))


@query("""SELECT 'order/' || o_orderkey AS subject, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE o_orderstatus END AS object FROM orders
WHERE CASE WHEN o_orderkey % 5 = 0 THEN false ELSE o_orderstatus <> 'F' END""")
def q52_negative_condition_unbound(spark, sf):
    """Where an expression has an error its variable is unbound: there, the negative condition holds with any value, and is met."""
    o = table(spark, sf, "orders")
    number_ = F.when(F.col("o_orderkey") % 5 == 0, T.col_plain(F.lit("none"))).otherwise(T.col_typed(F.lit("1"), T.XSD + "integer"))
    q = lens(o, "orders", ent("order", "o_orderkey"), {"status": text("o_orderstatus"), "weight": number_})
    bad = lens(table(spark, sf, "region").where("r_regionkey = 0"), "bad", ent("region", "r_regionkey"), {"bans": F.lit(T.literal("F1"))})
    r = rule("?s status ?x; ?s weight ?w", "?s fine ?x", bindings=(Binding("y", "CONCAT(?x, STR(?w * 1))"),), nacs=(part("?r bans ?y", "N"),))
    return told(run(spark, [q, bad], r, ["orders", "bad"]))


@query("SELECT 25 AS added, 25 AS removed, (SELECT count(*) FROM region) AS files")
def q53_preview_rewrite(spark, sf):
    """A preview of a Rewrite, and of how many files it leaves behind in the store: none but the regions that are put there."""
    e = engine(spark, nations(spark, sf))
    added, _, removed, _ = e.dry_run_rewrite(RENAME, [P + "nations"])
    for r in table(spark, sf, "region").select("r_regionkey").collect():
        e.store.put_graph(spark.createDataFrame([("<urn:s>", "<urn:p>", "<urn:o>")], "s string, p string, o string"), f"{P}r{r[0]}")
    made = e.store.vacuum(0)
    return spark.createDataFrame([(added, removed, sum(len(d) for d in e.store.graphs.values()) - 1 if made >= 0 else -1)], "added int, removed int, files int")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
