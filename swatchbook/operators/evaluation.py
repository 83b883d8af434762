"""Retrieval metrics, the evaluation record and the history of best results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swatchbook.cluster import written

EPOCH_BLOCK = 4096


def directions(predictions: DataFrame) -> DataFrame:
    """``(direction, label, pred)``: image-to-text and text-to-image as rows."""
    sides = [
        F.struct(F.lit(name).alias("direction"), F.col("pos").alias("label"), F.col(column).alias("pred"))
        for name, column in (("img", "pred_img"), ("text", "pred_txt"))
    ]
    return predictions.select(F.inline(F.array(*sides)))


def confusion(predictions: DataFrame) -> DataFrame:
    """Rows per (direction, label, pred), combined on the map side."""
    return directions(predictions).groupBy("direction", "label", "pred").agg(F.count("*").alias("n"))


def accuracy(counts: DataFrame) -> DataFrame:
    """``(direction, accuracy)`` of a confusion table."""
    right = F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0))
    return counts.groupBy("direction").agg((right / F.sum("n")).alias("accuracy"))


def macro_scores(counts: DataFrame) -> DataFrame:
    """``(direction, precision, recall, f_score)``, averaged over classes.

    A class is a position in the batch, seen as label or as prediction. A
    score without a denominator counts as 0.
    """
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    n = F.col("n")
    as_label = F.struct(F.col("label").alias("class"), hit.alias("tp"), n.alias("actual"), zero.alias("guessed"))
    as_guess = F.struct(F.col("pred").alias("class"), zero.alias("tp"), zero.alias("actual"), n.alias("guessed"))
    sides = counts.select("direction", F.inline(F.array(as_label, as_guess)))
    tp, actual, guessed = F.col("tp"), F.col("actual"), F.col("guessed")
    per_class = sides.groupBy("direction", "class").agg(
        F.sum("tp").alias("tp"), F.sum("actual").alias("actual"), F.sum("guessed").alias("guessed")
    )
    return per_class.groupBy("direction").agg(
        F.avg(F.when(guessed > 0, tp / guessed).otherwise(0.0)).alias("precision"),
        F.avg(F.when(actual > 0, tp / actual).otherwise(0.0)).alias("recall"),
        F.avg(2 * tp / (actual + guessed)).alias("f_score"),
    )


def batch_loss(predictions: DataFrame) -> DataFrame:
    """Mean loss per batch."""
    return predictions.groupBy("batch_id").agg(F.avg("loss").alias("loss"))


def mean_loss(predictions: DataFrame) -> DataFrame:
    """Mean of the batch means: a short last batch weighs as much as any other."""
    return batch_loss(predictions).agg(F.avg("loss").alias("loss"))


def eval_report(predictions: DataFrame, max_batches: int | None = None) -> DataFrame:
    """The evaluation record: loss, then accuracy, precision, recall and F-score per direction.

    ``max_batches`` evaluates the first batches only, as an evaluation step
    limit does. The scored rows (five numbers each) are written once and read
    for the loss and for the counts.
    """
    if max_batches is not None:
        predictions = predictions.filter(F.col("batch_id") < max_batches)
    rows = written(predictions, "predictions")
    counts = written(confusion(rows), "confusion")
    scores = accuracy(counts).join(macro_scores(counts), "direction")
    named = scores.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.concat(F.lit(f"eval_{short}_"), "direction").alias("name"), F.col(column).alias("value"))
                    for short, column in (
                        ("acc", "accuracy"),
                        ("prec", "precision"),
                        ("rec", "recall"),
                        ("f_score", "f_score"),
                    )
                ]
            )
        )
    ).unionByName(mean_loss(rows).select(F.lit("eval_loss").alias("name"), F.col("loss").alias("value")))
    names = ["eval_loss"] + [f"eval_{s}_{d}" for d in ("img", "text") for s in ("acc", "prec", "rec", "f_score")]
    return named.agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])


def running_best(
    history: DataFrame,
    run: str = "run",
    epoch: str = "epoch",
    metric: str = "metric",
    every: int = 1,
    block: int = EPOCH_BLOCK,
) -> DataFrame:
    """Add ``is_best``: the metric is strictly above 0 and above all earlier epochs of its run.

    Only every ``every``-th epoch counts. The best of earlier blocks of epochs
    comes from per-block maxima, so a run of any length is many small windows.
    """
    kept = history.filter(F.pmod(F.col(epoch), F.lit(every)) == 0).withColumn(
        "_block", F.floor(F.col(epoch) / block)
    )
    earlier_blocks = Window.partitionBy(run).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    block_best = (
        kept.groupBy(run, "_block")
        .agg(F.max(metric).alias("_top"))
        .select(run, "_block", F.max("_top").over(earlier_blocks).alias("_before"))
    )
    inside = Window.partitionBy(run, "_block").orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    best = F.greatest(F.coalesce(F.max(metric).over(inside), F.lit(0.0)), F.coalesce("_before", F.lit(0.0)))
    return (
        kept.join(
            block_best.withColumnsRenamed({run: "_run", "_block": "_of"}),
            F.col(run).eqNullSafe(F.col("_run")) & F.col("_block").eqNullSafe(F.col("_of")),
        )
        .withColumn("is_best", F.col(metric) > best)
        .select(*history.columns, "is_best")
    )
