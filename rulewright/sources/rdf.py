"""Readers and writers of RDF documents.

N-Triples and N-Quads are line formats: they are read with ``spark.read.text`` and taken apart by one regular expression, on
as many executors as there are splits. Turtle and TriG nest: a file is parsed as a whole, by one task; documents given as text, such
as rules, by the driver.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.terms import RuleError
from ..ship import ship

SCHEMA = "g string, s string, p string, o string"
Quad = tuple[str, str, str, str]

_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)|(?P<long>\"{3}(?:(?:\"|\"\")?(?:[^\"\\]|\\.))*\"{3}|'{3}(?:(?:'|'')?(?:[^'\\]|\\.))*'{3})|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<iri><[^<>"{}|^`\s]*>)|(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<dt>\^\^)|(?P<bnode>_:[\w][\w.-]*(?<!\.))|(?P<num>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)"""
    r"""|(?P<pname>(?:[A-Za-z_][\w.-]*)?:(?:[\w:%-](?:[\w.:%-]*[\w:%-])?)?)|(?P<word>[A-Za-z]+)|(?P<punct>[{}()\[\];,.])""",
    re.S,
)


class Parser:
    """Turtle and TriG to quads of canonical text; labels of blank nodes are made unique for each document."""

    def __init__(self, text: str, salt: str | None = None):
        self.toks, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise RuleError(f"can't read the document at line {text.count(chr(10), 0, at) + 1}: {text[at : at + 30]!r}")
            if m.lastgroup != "skip":
                self.toks.append((m.lastgroup, m[0], at))
            at = m.end()
        self.text, self.at = text, 0
        self.prefixes: dict[str, str] = {}
        self.base = ""
        self.salt, self.fresh = salt or uuid.uuid4().hex[:12], 0
        self.graph, self.out = "", []

    def peek(self) -> tuple[str, str]:
        return self.toks[self.at][:2] if self.at < len(self.toks) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        t = self.peek()
        if t[0] == "end" or (value is not None and t[1] != value):
            where = self.text.count("\n", 0, self.toks[self.at][2]) + 1 if self.at < len(self.toks) else "the end"
            raise RuleError(f"line {where}: expected {value or 'a term'}, found {t[1]!r}")
        self.at += 1
        return t

    def blank(self) -> str:
        self.fresh += 1
        return f"_:b{self.salt}n{self.fresh}"

    def resolve(self, token: str) -> str:
        raw = T.unescape_literal(token[1:-1])
        return T.iri(raw if ":" in raw or not self.base else self.base + raw)

    def document(self) -> list[Quad]:
        while self.peek()[0] != "end":
            kind, v = self.peek()
            if v.lower() in ("@prefix", "prefix"):
                self.take()
                name = self.take()[1]
                self.prefixes[name[:-1]] = self.resolve(self.take()[1])[1:-1]
                if v.startswith("@"):
                    self.take(".")
            elif v.lower() in ("@base", "base"):
                self.take()
                self.base = self.resolve(self.take()[1])[1:-1]
                if v.startswith("@"):
                    self.take(".")
            elif v == "{":
                self.block("")
            elif v.upper() == "GRAPH":
                self.take()
                self.block(self.term())
            else:
                if kind != "punct" and self.at + 1 < len(self.toks) and self.toks[self.at + 1][1] == "{":
                    self.block(self.term())
                else:
                    self.triples()
                    self.take(".")
        return self.out

    def block(self, graph: str) -> None:
        self.take("{")
        self.graph = graph[1:-1] if graph.startswith("<") else graph
        while self.peek()[1] != "}":
            self.triples()
            if self.peek()[1] == ".":
                self.take()
        self.take("}")
        self.graph = ""

    def triples(self) -> None:
        lone = self.peek()[1] == "["
        s = self.term()
        if lone and self.peek()[1] in (".", "}"):
            return
        self.predicates(s)

    def predicates(self, s: str) -> None:
        while True:
            kind, v = self.peek()
            p = T.iri(T.RDF + "type") if (kind, v) == ("word", "a") else None
            if p:
                self.take()
            else:
                p = self.term()
            while True:
                self.out.append((self.graph, s, p, self.term()))
                if self.peek()[1] != ",":
                    break
                self.take()
            while self.peek()[1] == ";":
                self.take()
            if self.peek()[1] in (".", "]", "}") or self.peek()[0] == "end":
                return
            if self.toks[self.at - 1][1] != ";":
                self.take(";")

    def term(self) -> str:
        kind, v = self.take()
        if kind == "iri":
            return self.resolve(v)
        if kind == "pname":
            prefix, local = v.split(":", 1)
            if prefix not in self.prefixes:
                raise RuleError(f"prefix {prefix!r} is not declared")
            return T.iri(self.prefixes[prefix] + local)
        if kind == "bnode":
            return f"_:b{self.salt}x{v[2:]}"
        if kind in ("str", "long"):
            cut = 3 if kind == "long" else 1
            body = T.unescape_literal(v[cut:-cut])
            if self.peek()[0] == "at":
                return T.literal(body, language=self.take()[1][1:])
            if self.peek()[0] == "dt":
                self.take()
                return T.literal(body, T.decode(self.term()).value)
            return T.literal(body)
        if kind == "num":
            return T.literal(v, T.XSD + ("double" if "e" in v.lower() else "decimal" if "." in v else "integer"))
        if kind == "word" and v in ("true", "false"):
            return T.literal(v, T.XSD + "boolean")
        if v == "[":
            node = self.blank()
            if self.peek()[1] != "]":
                self.predicates(node)
            self.take("]")
            return node
        if v == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.term())
            self.take(")")
            head = T.iri(T.RDF + "nil")
            for x in reversed(items):
                node = self.blank()
                self.out += [(self.graph, node, T.iri(T.RDF + "first"), x), (self.graph, node, T.iri(T.RDF + "rest"), head)]
                head = node
            return head
        raise RuleError(f"unexpected {v!r}")


def parse(text: str, salt: str | None = None) -> list[Quad]:
    """Quads of a Turtle or TriG document, without repetitions. salt: what tells its blank nodes from those of others."""
    return list(dict.fromkeys(Parser(text, salt).document()))


_LINE = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*(<[^>]*>|_:\S+)?\s*\.\s*(?:#.*)?$'


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Quads of N-Triples or N-Quads files; a line that is neither blank, a comment nor a statement fails the read."""
    salt = uuid.uuid4().hex[:12]
    line = F.col("value")
    rows = spark.read.text(path).where(~line.rlike(r"^\s*(#.*)?$"))
    part = lambda k: F.regexp_extract(line, _LINE, k)
    node = lambda c: F.when(c.startswith("_:"), F.concat(F.lit(f"_:b{salt}x"), F.substr(c, F.lit(3)))).otherwise(c)
    plain = F.lit(f"^^<{T.XSD}string>")
    o = F.when(part(3).endswith(f"^^<{T.XSD}string>"), F.substr(part(3), F.lit(1), F.length(part(3)) - F.length(plain))).otherwise(part(3))
    checked = F.when(line.rlike(_LINE), F.regexp_replace(part(4), "^<|>$", "")).otherwise(F.raise_error(F.concat(F.lit("not a statement: "), line)))
    return rows.select(checked.alias("g"), node(part(1)).alias("s"), part(2).alias("p"), node(o).alias("o")).distinct()


def frame(spark: SparkSession, quads: list[Quad]) -> DataFrame:
    return spark.createDataFrame(quads, SCHEMA)


def load_file(spark: SparkSession, path: str) -> DataFrame:
    """By extension: .nt and .nq line by line, .trig and all others as TriG (which Turtle is part of). A Turtle or TriG file is
    parsed as a whole, by one task; several files are parsed side by side, and blank nodes are told apart by file."""
    if path.endswith((".nt", ".nq")):
        return read_lines(spark, path)
    ship(spark)
    own = uuid.uuid4().hex[:12]  # from here, so that a task that runs again gives the same labels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, name in zip(b.column(0), b.column(1), strict=True):
                quads = parse(text.as_py(), own + hashlib.md5(name.as_py().encode()).hexdigest()[:12])
                for k in range(0, len(quads), 8192):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*quads[k : k + 8192], strict=True)], names=["g", "s", "p", "o"])

    texts = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("path"))
    return texts.mapInArrow(run, SCHEMA).distinct()


def to_lines(triples: DataFrame) -> DataFrame:
    """N-Triples, or N-Quads where there is a graph column, for ``df.write.text``."""
    cols = ["s", "p", "o"]
    if "g" in triples.columns:
        g = F.when(F.col("g") == "", F.lit("")).otherwise(F.concat(F.lit("<"), F.col("g"), F.lit("> ")))
        return triples.select(F.concat(F.concat_ws(" ", *cols), F.lit(" "), g, F.lit(".")).alias("value"))
    return triples.select(F.concat(F.concat_ws(" ", *cols), F.lit(" .")).alias("value"))


def skolemize(quads: DataFrame, base: str) -> tuple[DataFrame, int]:
    """Blank nodes replaced by IRIs under ``base``, and how many quads had one. Equal labels get equal IRIs, so links stay."""
    T.check_iri(base)
    named = lambda c: F.when(T.col_is_blank(F.col(c)), T.col_iri(F.concat(F.lit(base), T.col_encode(F.substr(F.col(c), F.lit(3)))))).otherwise(F.col(c))
    n = quads.where(T.col_is_blank(F.col("s")) | T.col_is_blank(F.col("o"))).count()
    return quads.withColumns({"s": named("s"), "o": named("o")}), n


def walk_list(quads: list[Quad], head: str) -> Iterator[str]:
    """The members of an rdf:List."""
    first = {s: o for _, s, p, o in quads if p == T.iri(T.RDF + "first")}
    rest = {s: o for _, s, p, o in quads if p == T.iri(T.RDF + "rest")}
    seen = set()
    while head in first and head not in seen:
        seen.add(head)
        yield first[head]
        head = rest.get(head, "")
