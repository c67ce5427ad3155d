"""The quad store: Parquet directories by graph, named by a manifest that is replaced as a whole.

Every write of a graph makes a new directory; a commit writes a manifest (graph to directories, the ledger, the last ordinal)
and renames it into place as the next version. So a commit of several graphs and a ledger row happens or does not, readers see
the version they opened, and a crash leaves only unnamed directories behind. A rename that finds its version taken means that
another writer was first, and is refused. The manifest holds one line per graph and firing, never data.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import RuleError, check_iri
from . import rdf, tabular

DEFAULT = ""
#: In the names of directories that hold several graphs.
ADDED = "-added"


class Dataset:
    """Anything rules can be matched against: ``scan`` gives g, s, p, o of the graphs asked for."""

    spark: SparkSession

    def scan(self, graphs: list[str], predicate: str | None = None) -> DataFrame:
        """predicate: all that is read of it are triples with that one (a hint; others may come, too)."""
        raise NotImplementedError

    def merged(self, graphs: list[str]) -> DataFrame:
        """The union of graphs as a set of triples."""
        t = self.scan(graphs).select("s", "p", "o")
        return t if len(set(graphs)) == 1 else t.distinct()


class FrameDataset(Dataset):
    """Quads of DataFrames and of tables seen as quads; each graph must be a set of triples. Of a table, a pattern with a constant
    predicate reads the columns that this one is made of."""

    def __init__(self, *sources: DataFrame | tabular.Lens):
        self.sources, self.spark = sources, sources[0].sparkSession

    def scan(self, graphs: list[str], predicate: str | None = None) -> DataFrame:
        out = []
        for x in self.sources:
            if not isinstance(x, tabular.Lens):
                out.append(x.select("g", "s", "p", "o").where(F.col("g").isin(*graphs)))
            elif x.graph in graphs and (predicate is None or predicate in x.predicates):
                out.append(x.quads(predicate))
        return union_all(out) if out else self.spark.createDataFrame([], rdf.SCHEMA)


class QuadStore(Dataset):
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._p(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._p(f"{self.path}/manifest"))
        self.version = 0
        self.graphs: dict[str, list[str]] = {}
        self.ledger: list[dict] = []
        self.ordinal = 0
        self.refresh()

    def _p(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def refresh(self) -> None:
        """Reads the newest version."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._p(f"{self.path}/manifest"))]
        versions = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not versions or max(versions) == self.version:
            return
        self.version = max(versions)
        f = self._fs.open(self._p(f"{self.path}/manifest/{self.version:012d}.json"))
        try:
            told = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8"))
        finally:
            f.close()
        self.graphs, self.ledger, self.ordinal = told["graphs"], told["ledger"], told["ordinal"]

    def commit(self, graphs: dict[str, list[str] | None], ledger: list[dict] | None = None, ordinal: int | None = None) -> None:
        """Points graphs to directories (None: drops one), all at once."""
        new = {g: d for g, d in {**self.graphs, **graphs}.items() if d}
        told = {"graphs": new, "ledger": self.ledger if ledger is None else ledger, "ordinal": self.ordinal if ordinal is None else ordinal}
        tmp, end = self._p(f"{self.path}/manifest/.{uuid.uuid4().hex}"), self._p(f"{self.path}/manifest/{self.version + 1:012d}.json")
        out = self._fs.create(tmp, False)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        if self._fs.exists(end) or not self._fs.rename(tmp, end):
            self._fs.delete(tmp, False)
            raise RuleError(f"another writer has committed version {self.version + 1}; refresh and run again")
        self.version += 1
        self.graphs, self.ledger, self.ordinal = told["graphs"], told["ledger"], told["ordinal"]

    # ---- reading

    def scan(self, graphs: list[str], predicate: str | None = None) -> DataFrame:
        """A directory of several graphs (``ADDED``) may hold some that have been replaced since: of each, only the graphs that
        still point to it are read. All other directories hold one graph, and are one scan, however many firings there are."""
        one: list[str] = []
        groups: dict[tuple[str, ...], list[str]] = {}
        by_dir: dict[str, list[str]] = {}
        for g in sorted(set(graphs)):
            for d in self.graphs.get(g, []):
                by_dir.setdefault(d, []).append(g)
        for d, gs in by_dir.items():
            if ADDED in d.rsplit("/", 1)[-1]:
                groups.setdefault(tuple(gs), []).append(d)
            else:
                one.append(d)
        if one:
            groups.setdefault(tuple(sorted({g for d in one for g in by_dir[d]})), []).extend(one)
        if not groups:
            return self.spark.createDataFrame([], rdf.SCHEMA)
        return union_all([self.spark.read.schema(rdf.SCHEMA).parquet(*sorted(dirs)).where(F.col("g").isin(*gs)) for gs, dirs in sorted(groups.items())])

    def graph_size(self, graph: str) -> int:
        return self.scan([graph]).count()

    def ask(self, df: DataFrame) -> bool:
        return not df.isEmpty()

    # ---- writing

    def stage(self, triples: DataFrame, graph: str) -> tuple[str, int]:
        """Writes triples as a directory of a graph (not yet named by the manifest), and counts them."""
        path = f"{self.path}/data/{uuid.uuid4().hex}"
        triples.select(F.lit(graph).alias("g"), "s", "p", "o").write.parquet(path)
        n = self.spark.read.schema(rdf.SCHEMA).parquet(path).count()  # from the files' footers
        if not n:
            self.discard(path)
        return path, n

    def discard(self, *paths: str) -> None:
        """Deletes directories that no manifest names."""
        for path in paths:
            self._fs.delete(self._p(path), True)

    def vacuum(self, older_than: float = 24 * 3600.0) -> int:
        """Deletes directories that the newest version doesn't name and that have not changed for so many seconds (readers and
        writers may still be at younger ones), and versions but the newest that are as old; returns how many it deleted."""
        self.refresh()
        named = {d.rsplit("/", 1)[-1] for dirs in self.graphs.values() for d in dirs}
        before, gone = (time.time() - older_than) * 1000, 0
        for folder, keep in (("data", named), ("manifest", {f"{self.version:012d}.json"})):
            if not self._fs.exists(self._p(f"{self.path}/{folder}")):
                continue
            for s in self._fs.listStatus(self._p(f"{self.path}/{folder}")):
                if s.getPath().getName() not in keep and s.getModificationTime() <= before:
                    gone += bool(self._fs.delete(s.getPath(), True))
        return gone

    def read_staged(self, path: str) -> DataFrame:
        return self.spark.read.schema(rdf.SCHEMA).parquet(path).select("s", "p", "o")

    def stage_solutions(self, solved: DataFrame) -> tuple[str, DataFrame]:
        """Solutions of a rule, written once and read by all that builds on them; discard the path after that."""
        path = f"{self.path}/data/{uuid.uuid4().hex}"
        if not solved.columns:
            solved = solved.withColumn("v__", F.lit(True))
        solved.write.parquet(path)
        return path, self.spark.read.schema(solved.schema).parquet(path)

    def put_graph(self, triples: DataFrame, graph: str) -> int:
        """Replaces one graph."""
        path, n = self.stage(triples.select("s", "p", "o").distinct(), graph)
        self.commit({graph: [path] * bool(n)})
        return n

    def add(self, quads: DataFrame) -> None:
        """Adds quads to the graphs they name; what a graph has already is not added again."""
        quads = quads.select("g", "s", "p", "o").distinct()
        names = [r["g"] for r in quads.select("g").distinct().collect()]
        fresh = quads.join(self.scan(names), ["g", "s", "p", "o"], "left_anti") if any(n in self.graphs for n in names) else quads
        path = f"{self.path}/data/{uuid.uuid4().hex}{ADDED}"
        fresh.sortWithinPartitions("g", "p", "s").write.parquet(path)
        self.commit({n: [*self.graphs.get(n, []), path] for n in names})

    def drop_graph(self, graph: str) -> None:
        self.commit({graph: None})

    def compact(self, graph: str) -> None:
        """One directory for a graph that has been added to many times."""
        self.put_graph(self.scan([graph]), graph)

    def load_graph(self, content: str, graph: str, skolem: str | None = None) -> int:
        """Replaces a graph by a Turtle document (its blank nodes as IRIs under ``skolem``, if given)."""
        check_iri(graph)
        df = rdf.frame(self.spark, rdf.parse(content))
        return self.put_graph(rdf.skolemize(df, skolem)[0] if skolem else df, graph)

    def load_dataset(self, content: str) -> None:
        """Adds a TriG document, which places its own graphs."""
        self.add(rdf.frame(self.spark, rdf.parse(content)))

    def load_file(self, path: str) -> None:
        self.add(rdf.load_file(self.spark, path))

    def skolemize(self, graphs: list[str] | None = None, base: str | None = None) -> int:
        """Blank nodes of the graphs (all, if none are named) become IRIs under a base that is new for each call."""
        names = sorted(self.graphs) if graphs is None else graphs
        base = base or f"urn:rulewright:genid:{uuid.uuid4()}:"
        total, change = 0, {}
        for g in names:
            done, n = rdf.skolemize(self.scan([g]), base)
            if n:
                total += n
                change[g] = [self.stage(done.distinct(), g)[0]]
        if change:
            self.commit(change)
        return total

    def sparql_like(self, patterns: list[tuple[str, str, str]], graphs: list[str]) -> DataFrame:
        """Solutions of triple patterns over the merged graphs; strings with ``?`` are variables."""
        from ..plans.compiler import match_patterns

        return match_patterns(self, patterns, graphs)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
