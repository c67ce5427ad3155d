"""Additive rules over streams of quads.

A rule that matches each triple on its own (one pattern, no negative condition, no table) derives the same from a stream,
batch by batch, as from the whole. Its new triples are added to the store per micro-batch; the store's commit and the anti-join
against what is known make a batch that is delivered twice harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans import compiler as C
from ..plans.checks import check, refuse
from ..plans.spec import REWRITE, RuleSpec
from ..sources.store import FrameDataset, QuadStore


def run_streaming(spec: RuleSpec, quads: DataFrame, store: QuadStore, target: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that adds what the rule derives from each batch of streamed quads (g, s, p, o) to the target graph."""
    from pyspark.sql import functions as F

    check(spec)
    if spec.mode == REWRITE or spec.nacs or spec.source_maps or len(spec.match) != 1 or len(spec.match[0].triples) != 1 or spec.match[0].scope is not None:
        refuse(spec, "only an additive rule with one unscoped pattern and no negative condition can run over a stream")

    def batch(df: DataFrame, _: int) -> None:
        data = FrameDataset(df)
        derived = C.instantiate(C.solutions(spec, data, [r["g"] for r in df.select("g").distinct().collect()]), spec.construct)
        store.refresh()
        store.add(derived.withColumn("g", F.lit(target)))

    return quads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
