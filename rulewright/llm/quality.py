"""Quality rules as weak supervision.

Each rule votes for a document (good or bad) or abstains. Votes of all documents are counted by pattern (at most 3 to the
number of rules, combined before the shuffle), expectation-maximisation over these counts estimates each rule's accuracy on
either class and the share of good documents, and the posterior probability of good replaces the rule that all filters must
pass. The base limits (fewer than 10 words, or over 20 % repeated words) still reject.

Counting repeated words needs no shuffle: a document's five-word windows are hashed (64 bits), sorted and compared with
their neighbours inside the row; documents whose windows are all distinct skip the sort.

Defined results: null or empty texts have no words, all counts 0, and are rejected; each of repeated rows gets the same
answer; a posterior of exactly one half keeps; an empty table gives no rows; other columns, whatever their names, pass through
``filter_documents``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import let
from .scratch import Scratch

SPACE = "[\\x20\\x09-\\x0D]"
WINDOW = 5
MIN_WORDS, MAX_REPEATED = 10, 20
ROUNDS = 50
#: What EM assumes ahead, as votes (right, wrong) made up for each document: good documents prevail; a rule looks for one defect, so
#: it is seldom wrong on good documents and may miss most bad ones. The data may move estimates anywhere within LIMITS, which
#: only keep logarithms finite.
PRIOR, ON_GOOD, ON_BAD = (0.09, 0.01), (0.098, 0.002), (0.003, 0.007)
LIMITS = (0.001, 0.9995)

#: name: (good where, bad where) over the feature columns; else the rule abstains.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words >= 25", "n_words < 15"),
    "word_size": ("word_chars between 2 * n_words and 12 * n_words", "word_chars < 2 * n_words or word_chars > 16 * n_words"),
    "symbols": ("10 * n_symbols <= n_words", "4 * n_symbols > n_words"),
    "symbol_share": ("40 * n_symbols <= word_chars", "12 * n_symbols > word_chars"),
    "marks": ("40 * n_marks <= word_chars", "12 * n_marks > word_chars"),
    "lines": ("10 * n_dup_lines <= n_lines", "3 * n_dup_lines > n_lines"),
    "repeats": ("10 * n_repeat_words <= n_words", "5 * n_repeat_words > n_words"),
    "variety": ("10 * n_distinct >= 3 * n_words or n_distinct >= 150", "10 * n_distinct < n_words and n_distinct < 100"),
    "case": ("4 * n_upper <= word_chars", "2 * n_upper > word_chars"),
}
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_marks")


def repeat_words(words: Column, k: int = WINDOW) -> Column:
    """Words inside k-word windows that occur twice or more."""
    none = F.lit(0).cast("long")

    def covered(h: Column) -> Column:
        def positions(s: Column) -> Column:
            same = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
            return F.array_sort(F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"]))

        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        at = let(ranked, positions)
        gaps = let(at, lambda p: F.transform(p, lambda x, i: F.least(F.lit(k), F.coalesce(F.get(p, i + 1) - x, F.lit(k)))))
        return F.aggregate(gaps, none, lambda a, x: a + x)

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.size(h) - k + 1), lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, k))))

    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    return F.when(F.size(words) <= k, none).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h))))


def features(docs: DataFrame, text_col: str = "text", passed: str | None = None) -> DataFrame:
    """The columns FEATURES of the documents, and those named ``passed`` ahead, as a struct ``doc``: no name of theirs can clash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    names = docs.columns if passed is None else [passed]
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc"), F.col(f"`{text_col}`").alias("text"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = out.withColumns({"words": F.array_remove(F.split(text, SPACE + "+", -1), ""), "lines": lines})
    n = lambda c: c.cast("long")
    return out.select(
        "doc",
        n(F.size("words")).alias("n_words"),
        n(F.length(text) - F.regexp_count(text, F.lit(SPACE))).alias("word_chars"),
        n(F.regexp_count(text, F.lit("[#*$%&|<>]"))).alias("n_symbols"),
        n(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        n(F.size("lines")).alias("n_lines"),
        n(F.size(F.array_distinct("words"))).alias("n_distinct"),
        n(F.regexp_count(text, F.lit("[A-Z]"))).alias("n_upper"),
        n(F.regexp_count(text, F.lit("[!?]"))).alias("n_marks"),
    )


def votes() -> dict[str, Column]:
    """1 good, -1 bad, 0 abstains; nothing can be said of a document without words."""
    return {name: F.when(F.col("n_words") == 0, 0).when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0) for name, (good, bad) in RULES.items()}


def fit(patterns: Iterable[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """(share of good, for each rule its accuracy on good and on bad documents) from counts of vote patterns: the most probable
    values by expectation-maximisation. Abstaining says nothing of the class."""
    seen = sorted((tuple(p), c) for p, c in patterns if any(p))
    n = max(1, sum(c for _, c in seen))
    share = lambda right, wrong: min(max(right / (right + wrong), LIMITS[0]), LIMITS[1])
    prior, acc = share(*PRIOR), [(share(*ON_GOOD), share(*ON_BAD))] * n_rules
    for _ in range(rounds):
        good, bad = PRIOR[0] * n, PRIOR[1] * n
        right = [[x * n for x in (*ON_GOOD, *ON_BAD)] for _ in range(n_rules)]  # on good: right, wrong; on bad: right, wrong
        for p, c in seen:
            q = posterior(p, prior, acc)
            good, bad = good + c * q, bad + c * (1 - q)
            for j, v in enumerate(p):
                if v:
                    right[j][0 if v > 0 else 1] += c * q
                    right[j][3 if v > 0 else 2] += c * (1 - q)
        prior, acc = share(good, bad), [(share(a, b), share(d, e)) for a, b, d, e in right]
    return prior, acc


def weights(prior: float, acc: list[tuple[float, float]]) -> tuple[float, list[tuple[float, float]]]:
    """Log odds of good before the votes, and what a good and a bad vote of each rule add."""
    return math.log(prior / (1 - prior)), [(math.log(g / (1 - b)), math.log((1 - g) / b)) for g, b in acc]


def posterior(pattern: tuple[int, ...], prior: float, acc: list[tuple[float, float]]) -> float:
    z, w = weights(prior, acc)
    z += sum(w[j][0] if v > 0 else w[j][1] for j, v in enumerate(pattern) if v)
    return 1 / (1 + math.exp(-min(max(z, -500.0), 500.0)))


def judge(table: DataFrame) -> DataFrame:
    """A stored table of features with the votes, ``posterior``, ``base_failed`` and ``kept``."""
    told = votes()
    counts = table.select(*(c.alias(n) for n, c in told.items())).groupBy(*told).count().collect()
    prior, acc = fit([(tuple(r[n] for n in told), r["count"]) for r in counts], len(told))
    z, w = weights(prior, acc)
    odds = F.lit(z)
    for (good, bad), c in zip(w, told.values(), strict=True):
        odds = odds + F.when(c > 0, F.lit(good)).when(c < 0, F.lit(bad)).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    out = table.withColumns({f"vote_{n}": c for n, c in told.items()} | {"posterior": 1 / (1 + F.exp(-odds)), "base_failed": failed})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id with features, votes, posterior, base_failed and kept."""
    work = Scratch(docs.sparkSession, "quality")
    told = judge(work.save(features(docs, text_col, id_col), "features"))
    return told.select(F.col("doc").getField(id_col).alias(id_col), *(c for c in told.columns if c != "doc"))


def filter_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents kept, with their columns; texts are read and worked on once, and written once."""
    work = Scratch(docs.sparkSession, "quality")
    table = work.save(features(docs, text_col), "features")
    return judge(table).where("kept").select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))
