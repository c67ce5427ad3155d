"""Tables that cut lineage, kept in the folder the cluster shares."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode (as in tests), where it is unset, one of our own."""
    if told := spark.conf.get("spark.checkpoint.dir", None):
        return told.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: executors would not see a folder of the driver's")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="rulewright-"))
    return _OWN[0]


#: Bytes of an Arrow batch sent to a Python worker, where the session doesn't say; texts are long, and a worker holds several.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, str(BATCH_BYTES))


class Scratch:
    """Writes intermediate tables as Parquet, reads them again, and drops those no longer needed."""

    #: All made so far, for those who know when a result has been written and what it was made from can go.
    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bound_batches(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        Scratch.made.append(self)

    def save(self, df: DataFrame, name: str = "t", thin: bool = False) -> DataFrame:
        """Writes and rereads. thin: rows are so much smaller than those of the corpus (ids, links) that an eighth of the
        partitions will do."""
        if thin:
            df = df.coalesce(max(8, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8))
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def sweep(self) -> None:
        """Lets Spark delete the shuffle files of plans that nothing refers to any more; it does so only once the driver's
        garbage is collected, which an idle driver may put off for half an hour."""
        gc.collect()
        self.spark._jvm.System.gc()

    def clear(self) -> None:
        """Deletes all tables."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        if self in Scratch.made:
            Scratch.made.remove(self)

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            if path := getattr(t, "_scratch_path", None):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)


#: Rows of a stored table of a few ids each up to which it is broadcast (about 32 MB in memory); beyond, joins shuffle both sides.
SMALL_ROWS = 500_000


def small(ids: DataFrame) -> DataFrame:
    """A stored table of ids, marked for a broadcast if its counted rows are few enough."""
    return F.broadcast(ids) if ids.count() <= SMALL_ROWS else ids


#: Bits of the filter below; its size is fixed, whatever the input.
BITMAP_BITS = 1 << 24


def id_bit(col: str) -> Column:
    return F.pmod(F.xxhash64(F.col(col)), F.lit(BITMAP_BITS))


def id_bitmap(ids: DataFrame, col: str) -> np.ndarray:
    """A bitmap (2 MB at any size of the input) of the bits of ids. It only thins out rows ahead of an exact join, which
    removes its false positives; there are no false negatives. At most BITMAP_BITS / 64 rows reach the driver."""
    return bitmap_of(ids.select(id_bit(col).alias("bit")))


def bitmap_of(bits: DataFrame) -> np.ndarray:
    words = bits.groupBy((F.col("bit") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("b"))
    out = np.zeros(BITMAP_BITS // 64, np.int64)
    for w, b in words.collect():
        out[w] = b
    return out


def has_bit(bitmap: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (bitmap[bits >> 6] >> (bits & 63)) & 1 == 1
