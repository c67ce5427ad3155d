"""The queries of this subpackage, by name, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from . import chat, decontam, line_dedup, ngram_join, packing, pii, quality, secrets, suffix_dedup, toxicity
from .scratch import bound_batches

CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digest(text):
    return F.sha2(text, 256)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2, numPartitions=1).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(CONTROL_TEXT))
    done = chat.format_conversations(rows.union(probe))
    done = done.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    return done.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        digest(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        digest(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "rank",
        F.col("path_score").alias("mean_words"),
    )


OP1_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(24 + length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;'))
                   + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|'))) AS BIGINT) AS formatted_chars,
       CAST(1 AS BIGINT) AS rank, avg(CAST(len(regexp_extract_all(text, '[^\\s]+')) AS DOUBLE)) AS mean_words
FROM t GROUP BY conv_id"""


def joined_spans(spans, keep=None):
    some = F.filter(spans, keep) if keep else spans
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(field: str, value):
    return F.size(F.filter("spans", lambda s: s[field] == value)).cast("long")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = pii.KINDS[: pii.BASE]
    return found.select(
        "doc_id",
        *(count_of("kind", k).alias(f"n_{k}") for k in base),
        digest(joined_spans(F.col("spans"), lambda s: s["kind"].isin(*base))).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, secrets.KINDS))
    named = F.transform("spans", lambda s: F.struct(s["kind"].alias("no"), F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["random"].alias("random")))
    found = found.select("doc_id", named.alias("spans"))
    return found.select(
        "doc_id",
        *(count_of("no", i).alias(f"n_{secrets.KINDS[i]}") for i in range(3)),
        digest(joined_spans(F.col("spans"), lambda s: s["no"] < 3)).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
        count_of("random", True).alias("n_random"),
        joined_spans(F.col("spans"), lambda s: s["random"]).alias("random_spans"),
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.dedup(table(spark, sf_dir, "documents"), with_kept=False)
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality.assess(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior", *(f"vote_{n}" for n in quality.RULES))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "hits"
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.label_categories())
    return toxicity.score(docs, chain).withColumn("toxic", F.col("p_toxic") >= 0.5)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their source; what is left of each text is told by length and digest."""
    done = line_dedup.drop_lines(table(spark, sf_dir, "documents"), F.col("source"), counts=True)
    text = F.coalesce("text", F.lit(""))
    return done.select("doc_id", "n_lines", "n_dropped", F.length(text).cast("long").alias("kept_chars"), digest(text).alias("kept_sha256"))


def op10_line_dedup_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages by the host of their address."""
    host = F.lower(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    done = line_dedup.drop_lines(table(spark, sf_dir, "pages"), host, "html", counts=True)
    html = F.coalesce("html", F.lit(""))
    return done.select("page_id", "n_lines", "n_dropped", F.length(html).cast("long").alias("kept_chars"), digest(html).alias("kept_sha256"))


def line_sql(table: str, key: str, text: str, host: str) -> str:
    return f"""
WITH p AS (SELECT {key}, {host} AS host, {text} AS text, string_split({text}, chr(10)) AS lines FROM {table}),
l AS (SELECT {key}, host, text, unnest(lines) AS line, generate_subscripts(lines, 1) AS at FROM p),
totals AS (SELECT host, count(DISTINCT text) + CAST(bool_or(text IS NULL) AS INT) AS n FROM p GROUP BY host),
c AS (SELECT host, trim(line) AS line, count(DISTINCT text) AS n FROM l WHERE trim(line) <> '' GROUP BY ALL),
d AS (SELECT c.host, c.line FROM c JOIN totals ON c.host IS NOT DISTINCT FROM totals.host WHERE c.n > {line_dedup.RATIO} * (totals.n + {line_dedup.SMOOTH})),
r AS (SELECT l.{key}, count(*) AS n_lines, count(d.line) AS n_dropped,
      coalesce(string_agg(CASE WHEN d.line IS NULL THEN l.line END, chr(10) ORDER BY l.at), '') AS kept
      FROM l LEFT JOIN d ON l.host IS NOT DISTINCT FROM d.host AND trim(l.line) = d.line GROUP BY l.{key})
SELECT p.{key}, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, length(coalesce(kept, '')) AS kept_chars, sha256(coalesce(kept, '')) AS kept_sha256
FROM p LEFT JOIN r ON p.{key} = r.{key}"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_format, op2_pii, op3_secrets, op4_packing, op5_suffix_dedup, op6_quality_rules, op7_ngram_join, op8_decontamination, op9_toxicity, op10_line_dedup, op10_line_dedup_pages)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": OP1_SQL,
        "op10_line_dedup": line_sql("documents", "doc_id", "text", "source"),
        "op10_line_dedup_pages": line_sql("pages", "page_id", "html", "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1))"),
    }
