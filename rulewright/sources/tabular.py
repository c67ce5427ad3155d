"""Tables as sources: CSV files behind a data source's options, and tables as quads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.terms import RuleError

COLUMN = "http://sparql.xyz/facade-x/data/"
#: Option of a data source: option of Spark's CSV reader.
OPTIONS = {"csv.headers": "header", "csv.delimiter": "sep", "csv.quote-char": "quote", "null-string": "nullValue", "charset": "encoding"}
_ESCAPED = set('<>"{}|^`\\#()')


def column_predicate(column: str) -> str:
    """The predicate IRI that stands for a column's header."""
    return T.iri(COLUMN + "".join(T.encode_for_uri(c) if c in _ESCAPED or c <= " " else c for c in column))


def read_table(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """The file a data source names; every column is a string, empty cells are null if the options say so."""
    options = dict(options)
    location = options.pop("location", None)
    if not location:
        raise RuleError("a tabular data source needs a location")
    reader = spark.read.option("header", "true").option("nullValue", "").option("escape", '"').option("multiLine", "true")
    for k, v in sorted(options.items()):
        if k not in OPTIONS:
            raise RuleError(f"unknown option {k!r} of a tabular data source; known: {', '.join(sorted(OPTIONS))}")
        reader = reader.option(OPTIONS[k], v)
    return reader.csv(location)


@dataclass(frozen=True)
class Lens:
    """A table seen as quads: one for each predicate of each row whose subject and object aren't null. predicates: predicate (as
    canonical text) to the object's."""

    table: DataFrame
    graph: str
    subject: Column
    predicates: dict[str, Column]

    @property
    def sparkSession(self) -> SparkSession:  # noqa: N802  as a DataFrame has it
        return self.table.sparkSession

    def quads(self, predicate: str | None = None) -> DataFrame:
        """All in one pass over the table; of one predicate, from its columns alone."""
        if predicate is None:
            cells = F.array(*(F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in self.predicates.items()))
            df = self.table.select(self.subject.alias("s"), F.inline(cells))
        else:
            df = self.table.select(self.subject.alias("s"), F.lit(predicate).alias("p"), self.predicates[predicate].alias("o"))
        return df.where("s is not null and o is not null").select(F.lit(self.graph).alias("g"), "s", "p", "o")


def table_quads(df: DataFrame, graph: str, subject: Column, predicates: dict[str, Column]) -> DataFrame:
    """A table as quads: one row for each column of each row that isn't null. predicates: predicate IRI to the object's
    canonical text; one pass over the table."""
    return Lens(df, graph, subject, {T.iri(p): o for p, o in predicates.items()}).quads()


def cells_as_triples(df: DataFrame) -> DataFrame:
    """Hand-written column predicates read a table as triples with a blank node for each row."""
    row = F.concat(F.lit("_:row"), F.monotonically_increasing_id().cast("string"))
    cells = F.array(*(F.struct(F.lit(column_predicate(c)).alias("p"), T.col_plain(F.col(f"`{c}`").cast("string")).alias("o")) for c in df.columns))
    return df.select(row.alias("s"), F.inline(cells)).where("o is not null").select("s", "p", "o")


def int_literal(c: Column) -> Column:
    return T.col_typed(c.cast("string"), T.XSD + "integer")


def text_literal(c: Column) -> Column:
    return T.col_plain(c)


def iri_of(prefix: str, c: Column) -> Column:
    return F.when(c.isNotNull(), T.col_iri(F.concat(F.lit(prefix), T.col_encode(c.cast("string")))))
