"""Mixing sources to target weights by entropy balancing, with DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swatchbook.cluster import written

WORD = r"[^\x20\x09-\x0D]+"
# Rates are whole multiples of 2^-30, so that their sums are exact and the
# same in any order of the rows.
UNIT = 30
MAX_STEPS = 60
# Documents of one source and size that are ranked together at most (on average).
CELL_ROWS = 5_000


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: int) -> DataFrame:
    """``(source, source_size, target)``: ``share`` of all sizes by weight, at most ``cap`` times a source's size.

    Sources take the weights in turn in the order of their code points, null
    last. What a capped source cannot take goes to the others by weight, until
    none is above: with sources ordered by cap and weight, the first one that
    stays below gives the size of one weight. ``sizes`` has source and total;
    it has one row per source, which the two windows see in one task.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = sizes.withColumn("_w", F.element_at(cycle, (F.pmod(turn - 1, F.lit(len(weights))) + 1).cast("int")))
    limit = F.col("total") * cap
    order = Window.orderBy((limit / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = weighed.select(
        "*",
        F.sum("total").over(everything).alias("_all"),
        F.coalesce(F.sum(limit).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("_rest"),
    )
    each = (F.col("_all") * share - F.col("_before")) / F.col("_rest")
    tested = ranked.withColumn("_each", F.when(each * F.col("_w") < limit, each))
    one = F.first("_each", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(limit.cast("double"), F.coalesce(F.col("_w") * F.col("_one"), limit.cast("double")))
    return tested.withColumn("_one", one).select(
        "source", F.col("total").alias("source_size"), target.alias("target"), (target >= limit).alias("_full")
    )


def _rate(tilt: Column, size: Column, mean: Column, cap: int) -> Column:
    """The exponentially tilted rate of a document, in units of 2^-30, at most ``cap``."""
    raw = F.exp(F.least(tilt * size / mean, F.lit(20.0))) * F.lit(float(1 << UNIT))
    return F.least(F.floor(raw), F.lit(cap << UNIT)).cast("bigint")


def tilts(histogram: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """``(source, _tilt, _mean, _full)``: the dual variable of every source.

    The rates that stay closest to one in relative entropy, keep to the cap
    and give a source its target are exp(tilt * size), cut at the cap. The
    tilt minimises a convex dual; each Newton step needs two sums per source,
    which one grouped aggregation over the histogram of sizes gives for all
    sources. A step that leaves the bracket around the solution halves it.
    """
    empty = F.lit(None).cast("double")
    state = targets.select(
        "source",
        "target",
        (F.col("_full") | (F.col("source_size") == 0)).alias("_full"),
        F.lit(0.0).alias("_tilt"),
        empty.alias("_low"),
        empty.alias("_high"),
        F.lit(False).alias("_done"),
    )
    means = histogram.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("_mean"))
    state = written(state.join(means, state["source"].eqNullSafe(means["source"])).drop(means["source"]), "tilts")
    for _ in range(MAX_STEPS):
        open_ones = state.filter("NOT _full AND NOT _done")
        if open_ones.isEmpty():
            break
        at = open_ones.select(F.col("source").alias("_s"), "_tilt", "_mean")
        x = F.col("size") / F.col("_mean")
        rate = _rate(F.col("_tilt"), F.col("size"), F.col("_mean"), cap)
        mass = (F.col("n") * F.col("size")).cast("decimal(20,0)") * rate.cast("decimal(12,0)")
        # The slope counts rates below the cap only; rounded, so that its sum is exact as well.
        slope = F.when(rate < (cap << UNIT), F.floor(mass.cast("double") * x / F.lit(float(1 << UNIT)) * 64)).otherwise(0)
        sums = (
            histogram.join(at, F.col("source").eqNullSafe(F.col("_s")))
            .groupBy("_s")
            .agg(F.sum(mass).alias("_mass"), F.sum(slope.cast("decimal(30,0)")).alias("_slope"))
        )
        gap = F.col("_mass").cast("double") / F.lit(float(1 << UNIT)) - F.col("target")
        slope_of = F.col("_slope").cast("double") / 64
        stepped = (
            state.join(sums, state["source"].eqNullSafe(sums["_s"]), "left")
            .withColumn("_gap", gap)
            .withColumn("_low", F.when(F.col("_gap") < 0, F.col("_tilt")).otherwise(F.col("_low")))
            .withColumn("_high", F.when(F.col("_gap") > 0, F.col("_tilt")).otherwise(F.col("_high")))
            .withColumn("_step", F.col("_tilt") - F.col("_gap") / F.when(slope_of > 0, slope_of))
        )
        wide = F.greatest(F.abs(F.col("_tilt")), F.lit(1.0))
        halved = (
            F.when(F.col("_low").isNull(), F.col("_high") - 2 * wide)
            .when(F.col("_high").isNull(), F.col("_low") + 2 * wide)
            .otherwise((F.col("_low") + F.col("_high")) / 2)
        )
        inside = (
            F.col("_step").isNotNull()
            & (F.col("_low").isNull() | (F.col("_step") > F.col("_low")))
            & (F.col("_high").isNull() | (F.col("_step") < F.col("_high")))
            & (F.abs(F.col("_step") - F.col("_tilt")) <= 4 * wide)
        )
        near = F.abs("_gap") <= F.col("target") * 1e-6 + 1
        done = F.col("_done") | F.coalesce(near, F.lit(False))
        state = written(
            stepped.select(
                "source",
                "target",
                "_full",
                F.when(done | F.col("_full"), F.col("_tilt")).when(inside, F.col("_step")).otherwise(halved).alias("_tilt"),
                "_low",
                "_high",
                done.alias("_done"),
                "_mean",
            ),
            "tilts",
        )
    return state.select("source", "_tilt", "_mean", "_full")


def _copies(cells: DataFrame, cap: int) -> DataFrame:
    """``(_s, _size, _c, _n, _copies)``: whole copies for each cell of documents of one rate.

    Along a class of sizes the copies given so far are the rounded sum of the
    rates. Long documents go first, and what they miss or exceed in words is
    made up by the rates of the shorter classes.
    """
    rounded = lambda c: F.floor((c + F.lit(1 << (UNIT - 1))) / F.lit(1 << UNIT))
    of_source = Window.partitionBy("source")
    so_far = of_source.orderBy(F.desc("size"), "_cell").rowsBetween(Window.unboundedPreceding, 0)
    gaps, parts = None, []
    for k in range(3):
        part = cells.filter(F.col("_class") == k)
        if gaps is None:
            part = part.withColumn("_gap", F.lit(0.0))
        else:
            part = part.join(gaps, F.col("source").eqNullSafe(F.col("_g")), "left")
        due = (F.col("_n") * F.col("size")).cast("decimal(20,0)") * F.col("_rate").cast("decimal(12,0)")
        words = F.sum(due).over(of_source).cast("double") / F.lit(float(1 << UNIT))
        factor = F.greatest(F.lit(0.0), 1 + F.coalesce("_gap", F.lit(0.0)) / F.when(words > 0, words))
        carried = part.withColumn("_words", words).withColumn(
            "_rate", F.least(F.floor(F.col("_rate") * F.coalesce(factor, F.lit(1.0))), F.lit(cap << UNIT)).cast("bigint")
        )
        summed = carried.withColumn("_sum", F.sum((F.col("_n") * F.col("_rate")).cast("decimal(38,0)")).over(so_far))
        whole = F.least(
            rounded(F.col("_sum")) - rounded(F.col("_sum") - F.col("_n") * F.col("_rate")), F.col("_n") * cap
        ).cast("bigint")
        done = written(summed.withColumn("_copies", whole), "copies")
        parts.append(
            done.select(
                F.col("source").alias("_s"), F.col("size").alias("_size"), F.col("_cell").alias("_c"), "_n", "_copies"
            )
        )
        missed = done.groupBy(F.col("source").alias("_g")).agg(
            (F.first("_words") + F.coalesce(F.first("_gap"), F.lit(0.0)) - F.sum(F.col("_copies") * F.col("size"))).alias(
                "_gap"
            )
        )
        if gaps is not None:
            # A source without documents in this class keeps its gap.
            skipped = gaps.join(missed.select(F.col("_g").alias("_m")), F.col("_g").eqNullSafe(F.col("_m")), "left_anti")
            missed = missed.union(skipped.select("_g", "_gap"))
        gaps = missed
    return parts[0].union(parts[1]).union(parts[2])


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    cap: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``(id_col, size, source_size, target, taken, copies)``, one row per row of ``docs``.

    The size of a document is its number of words between ASCII white space (a
    null or empty text: 0). Targets are those of :func:`source_targets`; a
    null source is a source. The rates of :func:`tilts` become whole copies
    by :func:`_copies`, so a source misses its target by a fraction of its
    mean document if it has short ones. ``taken`` is ``copies * size``, at
    most ``cap`` times the size.

    Documents of one source and size have one rate; they are counted in cells
    of some thousand rows, by the hash of the id, so a hot source is never in
    one task; the windows see one row per cell, or the rows of one cell. Sums
    are exact, so reruns agree. Rows that repeat an id are rows of their own;
    null ids are kept; an empty table gives an empty one; other columns are
    not read.
    """
    sized = written(
        docs.select(
            F.col(id_col).alias("_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        ),
        "sizes",
    )
    histogram = written(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    totals = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total"))
    targets = written(source_targets(totals, weights, share, cap), "targets")
    tilted = tilts(histogram, targets, cap)

    rates = histogram.join(
        tilted.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))
    ).select(
        F.col("source").alias("_s"),
        F.col("size").alias("_size"),
        F.ceil(F.col("n") / CELL_ROWS).alias("_cells"),
        F.when(F.col("_full"), F.lit(cap << UNIT))
        .otherwise(_rate(F.col("_tilt"), F.col("size"), F.col("_mean"), cap))
        .alias("_rate"),
        F.when(F.col("size") > F.col("_mean"), 0).when(F.col("size") > F.col("_mean") / 4, 1).otherwise(2).alias("_class"),
    )
    celled = written(
        sized.join(rates, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_size"))).select(
            "_id", "source", "size", F.pmod(F.xxhash64("_id"), "_cells").alias("_cell"), "_rate", "_class"
        ),
        "cells",
    )
    cells = celled.groupBy("source", "size", "_cell").agg(
        F.count("*").alias("_n"), F.first("_rate").alias("_rate"), F.first("_class").alias("_class")
    )
    given = _copies(written(cells, "cell-counts"), cap)
    ranked = celled.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("source", "size", "_cell").orderBy(F.xxhash64("_id", F.lit(6)), "_id"))
    )
    copied = ranked.join(
        given, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_size")) & (F.col("_cell") == F.col("_c"))
    ).select(
        "_id",
        "source",
        "size",
        (F.expr("_copies div _n") + F.when(F.col("_rank") <= F.col("_copies") % F.col("_n"), 1).otherwise(0)).alias("copies"),
    )
    return copied.join(
        targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))
    ).select(
        F.col("_id").alias(id_col),
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "copies",
    )
