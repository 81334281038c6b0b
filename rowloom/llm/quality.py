"""Quality classifier: a sparse ensemble of rules over statistics of a text.

Trees of a random forest, fitted on a bounded sample of labelled rows, give their paths as conjunctive rules; a lasso
logistic regression over the rules' truth values keeps few of them; those become one Spark column expression, so that
scoring is a single pass of built-in functions over all texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .lasso import fit_weights

#: Labelled rows that the rules and weights are fitted on, at most; they are those with the least hashes of their ids.
SAMPLE_ROWS = 20_000


def statistics(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """Adds the statistics of every text; null and empty texts have zeros."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumn("_text", text).withColumn("_words", F.filter(F.split("_text", r"[ \t-\r]+"), lambda w: w != "")).withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x != ""))
    df = df.withColumn("s_chars", F.length("_text").cast("double")).withColumn("s_words", F.size("_words").cast("double")).withColumn("s_lines", F.size("_lines").cast("double"))
    share = lambda n, of: F.when(F.col(of) > 0, n / F.col(of)).otherwise(0.0)
    count = lambda pattern: F.regexp_count("_text", F.lit(pattern))
    made = {
        "s_signs": share(count(r"[#$%&*+<=>@\\^_`{|}~\[\]]"), "s_chars"), "s_bars": share(count(r"\|"), "s_words"), "s_exclaims": share(count("!"), "s_words"), "s_upper": share(count(r"\p{Lu}"), "s_chars"),
        "s_digits": share(count("[0-9]"), "s_chars"), "s_stops": share(count(r"[.,;:?]"), "s_words"), "s_word_length": share(F.col("s_chars"), "s_words"), "s_line_length": share(F.col("s_words"), "s_lines"),
        "s_distinct_words": share(F.size(F.array_distinct("_words")), "s_words"), "s_distinct_lines": share(F.size(F.array_distinct("_lines")), "s_lines"),
        "s_repeats": share(count(r"(?<![^\s])(\S+)\s(?=\1(?:\s|$))"), "s_words"),
    }
    return df.withColumns(made).drop("_text", "_words", "_lines"), ["s_chars", "s_words", "s_lines", *made]


@dataclass(frozen=True)
class RuleModel:
    """rules: conjunctions of (statistic, at most or above, threshold), with their weights."""

    rules: tuple[tuple[tuple[tuple[str, bool, float], ...], float], ...]
    intercept: float

    def score(self) -> Column:
        """The probability of label 1, over the statistics' columns."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def holds(rule) -> Column:
    out = F.lit(True)
    for name, low, threshold in rule:
        out = out & (F.col(name) <= threshold if low else F.col(name) > threshold)
    return out


def paths(node, names: list[str], before: tuple = ()):
    """The conjunctions from a tree's root to each node below it."""
    if node.numDescendants() == 0:
        return
    at, threshold = names[node.split().featureIndex()], float(node.split().threshold())
    for child, low in ((node.leftChild(), True), (node.rightChild(), False)):
        kept = [c for c in before if c[:2] != (at, low)]  # a later bound on the same side is the tighter one
        rule = tuple(sorted([*kept, (at, low, threshold)]))
        yield rule
        yield from paths(child, names, rule)


def fit(sample: DataFrame, names: list[str], label_col: str, trees: int = 24, depth: int = 3, penalty: float = 5e-4) -> RuleModel:
    """Rules and weights for label 1 against all others. With one class only, or no rows, the score is that class's or one half."""
    counts = {int(r[0]): r[1] for r in sample.groupBy(F.col(label_col) == 1).count().collect()}
    if len(counts) < 2:
        return RuleModel((), {1: 20.0, 0: -20.0}.get(next(iter(counts), -1), 0.0))
    rows = VectorAssembler(inputCols=names, outputCol="_features").transform(sample)
    forest = RandomForestClassifier(featuresCol="_features", labelCol=label_col, numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="onethird", minInstancesPerNode=5, seed=7).fit(rows)
    rules = sorted({r for t in forest.trees for r in paths(t._java_obj.rootNode(), names)})
    if not rules:
        return RuleModel((), math.log(counts[1] / counts[0]))
    weights, intercept = fit_weights(sample, rules, label_col, penalty)
    return RuleModel(tuple((r, w) for r, w in zip(rules, weights, strict=True) if w), intercept)


def fit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fit on at most ``sample_rows`` labelled rows. Null labels are left out; of several for one id the least counts."""
    few = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).cast("double").alias("_label")).orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)
    joined = docs.select(id_col, text_col).join(F.broadcast(few), id_col)  # bounded by sample_rows
    rows, names = statistics(joined, text_col)
    return fit(materialize(rows.select("_label", *names), "labelled").coalesce(1), names, "_label")


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 4 == 2


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Adds score and predicted to every row; other columns stay, whatever their names, but for older ones of these names.

    Learns only from rows outside ``held_out``. Null ids, repeated rows, null, empty and very long texts are scored,
    too; an empty table gives no rows.
    """
    model = fit_documents(docs, labels.filter(~held_out(F.col("doc_id"))))
    mine = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted"))).alias("row")
    rows, _ = statistics(docs.select(mine, "text"))
    rows = rows.select("row", F.inline(F.array(F.struct(model.score().alias("score")))))  # a filter on the score isn't pushed below it, to count everything again
    return rows.select("row.*", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    rows = scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
