"""Operator 4, quality classifier: a sparse ensemble of rules from trees.

Statistics of a text are Spark column expressions. On a bounded sample of
labelled rows a few shallow trees are boosted over them; every path from a root
to a node is a rule, a conjunction of comparisons. A lasso logistic regression
weighs the rules and drops most. The rules left are compiled into one column
expression, so scoring runs on the JVM without Python and without a shuffle.

Fitted on the driver: about ``SAMPLE`` rows, never over twice as many, chosen by
the hash of doc_id among labelled rows that are not held out. Labels, doc_id, lang and
source are no inputs of a score.

Defined cases: NULL text is empty; an empty text has all statistics 0 and the
score that follows; several labels of one document count once, as the smallest;
labels that are NULL or without a document are not learned from; with one class
or none the score is the share of label 1 among the labels, 0.5 without any;
repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import GAP, WORD, hash_sample

SAMPLE = 20_000
FOLDS = 5
THRESHOLD = 0.3
TREES = 24
DEPTH = 3
RATE = 0.3
BINS = 48
PENALTIES = (0.03, 0.01, 0.003, 0.001, 0.0003)
ITERATIONS = 400
NEGLIGIBLE = 0.02


def _times(pattern: str) -> Column:
    return F.regexp_count("t", F.lit(pattern))


def statistics() -> dict[str, Column]:
    """Name -> statistic of the column ``t``; shares are 0 where there is nothing to share."""
    chars, words, lines = F.col("chars"), F.col("words"), F.col("lines")
    share = lambda x, of: F.when(of > 0, x / of).otherwise(F.lit(0.0))
    return {
        "words": words.cast("double"),
        "word_length": share(F.col("solid"), words),
        "upper_share": share(F.col("upper"), F.col("solid")),
        "digit_share": share(F.col("digit"), F.col("solid")),
        "symbols_per_word": share(F.col("symbol"), words),
        "shouts_per_word": share(F.col("shout"), words),
        "stops_per_word": share(F.col("stop"), words),
        "bars_per_word": share(F.col("bar"), words),
        "distinct_words": share(F.col("distinct_words"), words),
        "distinct_lines": share(F.col("distinct_lines"), lines),
        "line_length": share(words, lines),
        "chars": chars.cast("double"),
    }


def with_statistics(rows: DataFrame) -> DataFrame:
    """Adds the statistics of ``text`` to its rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counted = (
        rows.withColumn("t", text)
        .withColumn("chars", F.length("t"))
        .withColumn("words", _times(WORD))
        .withColumn("lines", _times(r"[^\n]+"))
        .withColumn("solid", F.col("chars") - _times(r"[\x20\x09-\x0D]"))
        .withColumn("upper", _times(r"\p{Lu}"))
        .withColumn("digit", _times(r"[0-9]"))
        .withColumn("symbol", _times(r"[#*$%&<>\\^~={}\[\]]"))
        .withColumn("shout", _times(r"[!?]"))
        .withColumn("stop", _times(r"[.,;:]"))
        .withColumn("bar", _times(r"\|"))
        .withColumn("distinct_words", F.when(F.col("words") > 0, F.size(F.array_distinct(F.split(F.lower(F.trim("t")), GAP)))).otherwise(0))
        .withColumn("distinct_lines", F.when(F.col("lines") > 0, F.size(F.array_distinct(F.array_remove(F.split("t", "\n"), "")))).otherwise(0))
    )
    found = statistics()
    return counted.select(*rows.columns, F.struct(*[c.alias(n) for n, c in found.items()]).alias("s"))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the documents that are never learned from; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


Rule = tuple[tuple[str, bool, float], ...]


@dataclass(frozen=True)
class RuleModel:
    """Score: the logistic function of ``bias`` plus the weights of the rules that hold."""

    bias: float
    rules: tuple[Rule, ...] = ()
    weights: tuple[float, ...] = ()

    def column(self) -> Column:
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights):
            holds = F.lit(True)
            for name, above, bound in rule:
                value = F.col(f"s.{name}")
                holds = holds & (value > bound if above else value <= bound)
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def score(self, table: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(table.values())))
        total = np.full(n, self.bias)
        for rule, weight in zip(self.rules, self.weights):
            total += weight * _holds(rule, table)
        return 1 / (1 + np.exp(-total))


def _holds(rule: Rule, table: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(table.values()))), bool)
    for name, above, bound in rule:
        out &= table[name] > bound if above else table[name] <= bound
    return out


def _bounds(values: np.ndarray) -> np.ndarray:
    """Midpoints between neighbouring quantiles."""
    marks = np.unique(np.quantile(values, np.linspace(0, 1, BINS + 1)))
    return (marks[1:] + marks[:-1]) / 2


def tree_rules(table: dict[str, np.ndarray], y: np.ndarray) -> list[Rule]:
    """All paths of boosted trees, each once; a path keeps one bound per statistic and side."""
    bounds = {n: _bounds(v) for n, v in table.items()}
    bins = {n: np.searchsorted(bounds[n], v, side="left") for n, v in table.items()}
    margin, found = np.full(len(y), math.log(y.mean() / (1 - y.mean()))), {}

    def grow(rows: np.ndarray, path: dict, depth: int) -> None:
        p = 1 / (1 + np.exp(-margin_now[rows]))
        gradient, curve = y[rows] - p, p * (1 - p)
        if path:
            found[tuple(sorted((n, above, float(b)) for (n, above), b in path.items()))] = None
        best = None
        if depth and len(rows) > 20:
            value = lambda g, h: g * g / (h + 1.0)
            base = value(gradient.sum(), curve.sum())
            for name in table:
                size = len(bounds[name]) + 1
                g = np.cumsum(np.bincount(bins[name][rows], gradient, size))[:-1]
                h = np.cumsum(np.bincount(bins[name][rows], curve, size))[:-1]
                if len(g):
                    gain = value(g, h) + value(gradient.sum() - g, curve.sum() - h) - base
                    k = int(np.argmax(gain))
                    if gain[k] > 1e-3 and (best is None or gain[k] > best[0] + 1e-9):
                        best = gain[k], name, k
        if best is None:
            margin[rows] += RATE * gradient.sum() / (curve.sum() + 1.0)
            return
        _, name, k = best
        bound, below = bounds[name][k], bins[name][rows] <= k
        grow(rows[below], path | {(name, False): min(bound, path.get((name, False), math.inf))}, depth - 1)
        grow(rows[~below], path | {(name, True): max(bound, path.get((name, True), -math.inf))}, depth - 1)

    for _ in range(TREES):
        margin_now = margin.copy()
        grow(np.arange(len(y)), {}, DEPTH)
    return list(found)


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Bias and weights by accelerated proximal gradient; the bias is not penalised.

    Rows for which the same rules hold are one row that counts as often.
    """
    packed = np.packbits(x.astype(bool), axis=1) if x.shape[1] else np.zeros((len(x), 1), np.uint8)
    _, first, which = np.unique(packed, axis=0, return_index=True, return_inverse=True)
    which = which.ravel()
    n, width = len(y), x.shape[1]
    x, rows, ones = x[first], np.bincount(which), np.bincount(which, y)
    wide = np.hstack([np.ones((len(x), 1)), x]) * np.sqrt(rows)[:, None]
    step = 4 / max(1e-9, np.linalg.norm(wide, 2) ** 2 / n)
    weights, bias, ahead, ahead_bias, t = np.zeros(width), 0.0, np.zeros(width), 0.0, 1.0
    for _ in range(ITERATIONS):
        miss = rows / (1 + np.exp(-(x @ ahead + ahead_bias))) - ones
        moved = ahead - step * (x.T @ miss) / n
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        new_bias = ahead_bias - step * miss.sum() / n
        following = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = new + (t - 1) / following * (new - weights), new_bias + (t - 1) / following * (new_bias - bias)
        weights, bias, t = new, new_bias, following
    return bias, weights


def fit_rules(table: dict[str, np.ndarray], y: np.ndarray, checking: np.ndarray) -> RuleModel:
    """Rules and weights; the penalty is the one that does best on the rows ``checking``."""
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return RuleModel(math.log(share / (1 - share)))
    learning = ~checking
    if not checking.any() or y[learning].min() == y[learning].max():
        learning = checking = np.ones(len(y), bool)
    rules = tree_rules({n: v[learning] for n, v in table.items()}, y[learning])
    # Of rules that hold for the same rows, or for the complement, the shortest stays.
    truths: dict[bytes, tuple[Rule, np.ndarray]] = {}
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        truth = _holds(rule, table)
        if 0 < truth.sum() < len(y):
            truths.setdefault((truth if truth[0] else ~truth).tobytes(), (rule, truth))
    rules = [rule for rule, _ in truths.values()]
    x = np.array([truth for _, truth in truths.values()], float).T if rules else np.zeros((len(y), 0))
    losses = []
    for penalty in PENALTIES:
        bias, weights = lasso_logistic(x[learning], y[learning], penalty)
        margin = x[checking] @ weights + bias
        losses.append(np.mean(np.logaddexp(0, margin) - y[checking] * margin))
    # The largest penalty whose loss is near the least: fewer rules for about the same fit.
    penalty = next(p for p, loss in zip(PENALTIES, losses) if loss <= 1.1 * min(losses) + 1e-4)
    bias, weights = lasso_logistic(x, y, penalty)
    kept = np.flatnonzero(np.abs(weights) > NEGLIGIBLE)
    rules = [rules[k] for k in kept]
    bias, weights = lasso_logistic(x[:, kept], y, penalty)  # once more without the rest
    kept = np.flatnonzero(weights)
    return RuleModel(float(bias), tuple(rules[k] for k in kept), tuple(float(weights[k]) for k in kept))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> RuleModel:
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"))
    )
    known = hash_sample(known, ["doc_id"], sample, known.count())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    taken = with_statistics(rows).select("doc_id", "y", (fold == 1).alias("checking"), "s.*").dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()
    names = list(statistics())
    return fit_rules(
        {n: taken[n].to_numpy(float) for n in names}, taken["y"].to_numpy(float), taken["checking"].to_numpy(bool)
    )


def quality_scores(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    rows = with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return rows.select("doc_id", held_out().alias("held_out"), model.column().alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def op4_rule_ensemble(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_scores(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
