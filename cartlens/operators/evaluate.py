"""Evaluation of a scored frame ``(label 0/1, score)``: confusion counts,
threshold metrics, exact ROC-AUC and ROC points, threshold sweep and choice,
classification report and leaders.

All of it is aggregation. Anything cumulative over scores (AUC, ROC) uses
score ranges cut where the data has its scores: distinct scores are counted and
range-partitioned, offsets come from a window with one row a range, and the
running sums run inside one range each -- never one window over all scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lookups as L
from ..session import materialize


def _div0(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 (``zero_division=0``)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


# ---------------------------------------------------------------- G1, G2
def confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """One row ``(tn, fp, fn, tp)``; zero cells are present by construction."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    return df.agg(F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"),
                  F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"))


def metrics_from_counts(tn: Column, fp: Column, fn: Column, tp: Column) -> list[Column]:
    return [
        _div0(tp, tp + fp).alias("precision"),
        _div0(tp, tp + fn).alias("recall"),
        _div0(2 * tp, 2 * tp + fp + fn).alias("f1"),
        _div0(tp + tn, tp + tn + fp + fn).alias("accuracy"),
    ]


def binary_metrics(df: DataFrame, label: str = "label", score: str = "score",
                   threshold: float = L.DEFAULT_THRESHOLD) -> DataFrame:
    """Precision, recall, F1 and accuracy at ``score >= threshold``."""
    pred = (F.col(score) >= F.lit(threshold)).cast("int")
    c = confusion(df.withColumn("_pred", pred), label, "_pred")
    return c.select("tn", "fp", "fn", "tp",
                    *metrics_from_counts(F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp")))


# ---------------------------------------------------------------- G3, G4
def _score_table(df: DataFrame, label: str, score: str, buckets: int | None,
                 descending: bool, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score (of each group of ``by``): positives, negatives, and the
    counts strictly before it in the chosen order, computed range by range.

    The ranges come from Spark's range partitioning of the groups' distinct scores,
    so each has about as many of them however the scores are spread; few scores
    make few ranges unless ``buckets`` sets their number."""
    s = F.col(score)
    order = F.desc("s") if descending else F.asc("s")
    per = materialize(
        df.where(s.isNotNull() & F.col(label).isNotNull()).groupBy(*by, s.alias("s"))
        .agg(F.sum(F.col(label)).cast("long").alias("pos"),
             F.sum(1 - F.col(label)).cast("long").alias("neg"))
        .repartitionByRange(*([buckets] if buckets else []), *by, order).withColumn("b", F.spark_partition_id()))
    bt = per.groupBy(*by, "b").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    # a group has a row a range at most
    wb = Window.partitionBy(*by).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    wall = Window.partitionBy(*by)
    off = bt.select(*by, "b", F.coalesce(F.sum("bp").over(wb), F.lit(0)).alias("op"),
                    F.coalesce(F.sum("bn").over(wb), F.lit(0)).alias("on"),
                    F.sum("bp").over(wall).alias("P"), F.sum("bn").over(wall).alias("N"))
    ws = Window.partitionBy(*by, "b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (per.join(off, [*by, "b"])
            .select(*by, "s", "b", "pos", "neg", "P", "N",
                    (F.col("op") + F.coalesce(F.sum("pos").over(ws), F.lit(0))).alias("pos_before"),
                    (F.col("on") + F.coalesce(F.sum("neg").over(ws), F.lit(0))).alias("neg_before")))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score",
            buckets: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Exact ROC-AUC (ties count half): one row ``(auc)``, or one per group of ``by``;
    NULL with one class."""
    t = _score_table(df, label, score, buckets, descending=False, by=by)
    return t.groupBy(*by).agg(F.try_divide(
        F.sum(F.col("pos").cast("double") * (F.col("neg_before") + 0.5 * F.col("neg"))),
        F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "score",
              buckets: int | None = None) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, plus (inf, 0, 0)."""
    t = _score_table(df, label, score, buckets, descending=True)
    first = F.col("pos_before") + F.col("neg_before") == 0  # the highest score
    pts = t.select(F.explode(F.array(
        F.struct(F.col("s").alias("threshold"),
                 _div0(F.col("neg_before") + F.col("neg"), F.col("N")).alias("fpr"),
                 _div0(F.col("pos_before") + F.col("pos"), F.col("P")).alias("tpr"),
                 F.lit(True).alias("keep")),
        # the (inf, 0, 0) origin rides on the row of the highest score
        F.struct(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"),
                 F.lit(0.0).alias("tpr"), first.alias("keep")))).alias("p"))
    return pts.where("p.keep").select("p.threshold", "p.fpr", "p.tpr")


# ---------------------------------------------------------------- G5, G6
def sweep_thresholds(n: int = 19) -> list[float]:
    """0.05, 0.10, ..., 0.95 written as exact decimal literals i*5/100."""
    step = 100 // (n + 1)
    return [i * step / 100 for i in range(1, n + 1)]


def threshold_sweep(df: DataFrame, label: str = "label", score: str = "score",
                    thresholds: Sequence[float] | None = None) -> DataFrame:
    """(threshold, precision, recall, f1, tp, fp, fn) for each cut-off, in one scan."""
    ths = list(thresholds) if thresholds is not None else sweep_thresholds()
    y, s = F.col(label) == 1, F.col(score)
    aggs = [F.count_if(y).alias("P")]
    for i, t in enumerate(ths):
        aggs += [F.count_if(y & (s >= F.lit(t))).alias(f"tp{i}"),
                 F.count_if(~y & (s >= F.lit(t))).alias(f"fp{i}")]
    wide = df.agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"),
                 F.col(f"fp{i}").alias("fp"), (F.col("P") - F.col(f"tp{i}")).alias("fn"))
        for i, t in enumerate(ths)]))
    long = wide.select(rows.alias("r")).select("r.*")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return long.select("threshold", _div0(tp, tp + fp).alias("precision"),
                       _div0(tp, tp + fn).alias("recall"),
                       _div0(2 * tp, 2 * tp + fp + fn).alias("f1"), "tp", "fp", "fn")


def best_threshold(sweep: DataFrame, target_recall: float = L.TARGET_RECALL,
                   default: float = L.DEFAULT_THRESHOLD) -> DataFrame:
    """Highest precision among cut-offs with recall >= target (lowest cut-off
    on ties); one row, with ``found`` false and the default when none qualifies."""
    ok = sweep.where(F.col("recall") >= target_recall)
    best = ok.agg(F.min_by(F.struct("threshold", "precision", "recall", "f1"),
                           F.struct(-F.col("precision"), F.col("threshold"))).alias("b"))
    return best.select(
        F.coalesce(F.col("b.threshold"), F.lit(default)).alias("threshold"),
        F.col("b.precision").alias("precision"), F.col("b.recall").alias("recall"),
        F.col("b.f1").alias("f1"), F.col("b").isNotNull().alias("found"))


# ---------------------------------------------------------------- G7
def classification_report(df: DataFrame, label: str = "label", pred: str = "pred",
                          names: Sequence[str] = ("No", "Yes")) -> DataFrame:
    """Rows per class, accuracy, macro avg and weighted avg:
    (row_label, precision, recall, f1_score, support)."""
    c = confusion(df, label, pred)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    # class 0 seen as the positive class swaps the roles of the counts
    p0, r0 = _div0(tn, tn + fn), _div0(tn, tn + fp)
    f0 = _div0(2 * tn, 2 * tn + fn + fp)
    p1, r1 = _div0(tp, tp + fp), _div0(tp, tp + fn)
    f1 = _div0(2 * tp, 2 * tp + fp + fn)
    s0, s1 = (tn + fp).cast("double"), (tp + fn).cast("double")
    acc = _div0(tp + tn, n)

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("row_label"), p.alias("precision"),
                        r.alias("recall"), f.alias("f1_score"), s.alias("support"))

    rows = F.array(
        row(names[0], p0, r0, f0, s0),
        row(names[1], p1, r1, f1, s1),
        row("accuracy", acc, acc, acc, n.cast("double")),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n.cast("double")),
        row("weighted avg", _div0(p0 * s0 + p1 * s1, n), _div0(r0 * s0 + r1 * s1, n),
            _div0(f0 * s0 + f1 * s1, n), n.cast("double")),
    )
    return c.select(F.explode(rows).alias("r")).select("r.*")


# ---------------------------------------------------------------- G11
def leaders(results: DataFrame, model: str = "model") -> DataFrame:
    """Model with the highest F1 and with the highest AUC; first row wins ties."""
    return results.agg(
        F.min_by(model, F.struct(-F.col("f1"), F.col("_pos"))).alias("best_f1_model"),
        F.min_by(model, F.struct(-F.col("auc"), F.col("_pos"))).alias("best_auc_model"))
