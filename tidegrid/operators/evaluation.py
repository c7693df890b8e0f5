"""Event-detection average precision with time tolerances."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.config import TOLERANCES
from tidegrid.operators.blocks import Carry, carry
from tidegrid.operators.order_stats import running_totals
from tidegrid.sources.tables import drop_unlabelled
from tidegrid.staging import stage

GROUP = ["event", "tolerance"]
Tolerances = Mapping[str, Sequence[float]]


def check_inputs(truths: DataFrame, detections: DataFrame, tolerances: Tolerances) -> None:
    """Raise ``ValueError`` where the inputs cannot be scored."""
    if not tolerances:
        raise ValueError("no tolerances given: name at least one event")
    for name in ("series_id", "step", "event", "score"):
        if name not in detections.columns:
            raise ValueError(f"detections lack {name!r}; they have {sorted(detections.columns)}")
    for what, df, names in (("labels", truths, ["step"]), ("detections", detections, ["step", "score"])):
        for name in names:
            if not isinstance(df.schema[name].dataType, T.NumericType):
                raise ValueError(f"{what}.{name} is {df.schema[name].dataType.simpleString()}, a number is needed")
    # more names than expected is already an error, so the read is bounded
    found = truth_events(truths).select("event").distinct().limit(len(tolerances) + 1).collect()
    if {r["event"] for r in found} != set(tolerances):
        names = sorted(str(r["event"]) for r in found)
        raise ValueError(f"labels hold the events {names}, tolerances are given for {sorted(tolerances)}")


def truth_events(truths: DataFrame) -> DataFrame:
    """Labels without the markers of scoring intervals."""
    return truths.where(~F.col("event").isin("start", "end"))


def tolerance_array(tolerances: Tolerances) -> Column:
    """Tolerances of the row's event as an array; null for other events."""
    chosen = F.lit(None).cast("array<double>")
    for event, values in tolerances.items():
        chosen = F.when(F.col("event") == event, F.array(*[F.lit(float(v)) for v in values])).otherwise(chosen)
    return chosen


def evaluation_groups(truths: DataFrame, detections: DataFrame, tolerances: Tolerances = TOLERANCES) -> DataFrame:
    """Each event, tolerance and labelled series with its detections (null if none)."""
    events = F.array(*[F.lit(e) for e in tolerances])
    keys = (
        truth_events(truths)
        .select("series_id")
        .distinct()
        .withColumn("event", F.explode(events))
        .withColumn("tolerance", F.explode(tolerance_array(tolerances)))
    )
    found = detections.select("series_id", "event", F.col("step").cast("double").alias("step"), "score")
    return keys.join(found, ["series_id", "event"], "left")


def match_detections(
    truths: DataFrame,
    detections: DataFrame,
    tolerances: Tolerances = TOLERANCES,
    block_steps: float | None = None,
) -> DataFrame:
    """``event, tolerance, series_id, step, score, matched`` for every detection of a
    labelled series.

    Truths closer than twice the tolerance can compete for a detection; a wider gap
    separates them for good.  So truths fall into clusters and each detection reaches at
    most one.  A detection that reaches none is a false positive.  In a cluster of one
    truth the best detection wins, which is a ranking; where several truths compete, the
    greedy choice is made in rounds of certain matches, see :func:`_greedy_rounds`.
    Detections go by falling score (ties: earlier step) and take the nearest free truth
    closer than the tolerance (ties: earlier truth).
    """
    widest = max(max(v) for v in tolerances.values())
    width = float(block_steps or max(17280.0, 4 * widest))
    keys = ["series_id", "event"]
    tol = tolerance_array(tolerances)
    truth = drop_unlabelled(truth_events(truths)).select(
        *keys, F.col("step").cast("double").alias("step"), tol.alias("tols")
    )
    truth = truth.where(F.col("tols").isNotNull())
    labelled = truth_events(truths).select("series_id").distinct()
    found = (
        detections.select(
            *keys, F.col("step").cast("double").alias("step"), F.col("score").cast("double"), tol.alias("tols")
        )
        .dropna()
        .where(~F.isnan("step") & ~F.isnan("score"))
        .join(labelled, "series_id", "left_semi")
    )

    clustered = stage(_clusters(truth, keys, width, 2 * widest), "truth-clusters")
    reach = _nearest_truths(clustered, found, keys, width, widest)
    options = F.transform(
        F.sequence(F.lit(0), F.size("tols") - 1),
        lambda i: F.struct(
            F.get("tols", i).alias("tolerance"),
            F.when(F.col("step") - F.col("prev.step") < F.get("tols", i), F.get("prev.clusters", i))
            .when(F.col("next.step") - F.col("step") < F.get("tols", i), F.get("next.clusters", i))
            .alias("cluster"),
        ),
    )
    columns = ["event", "tolerance", "series_id", "step", "score"]
    rows = stage(
        reach.select(*keys, "step", "score", F.inline(options)).select(*columns, "cluster.first", "cluster.n"),
        "reachable-truths",
    )
    missed = rows.where("n is null").select(*columns, F.lit(0).alias("matched"))
    single = _best_of_cluster(rows.where("n = 1"), columns)
    targets = clustered.select(
        *keys, "step", "copy", F.inline(F.arrays_zip(F.col("tols").alias("tolerance"), F.col("clusters").alias("cluster")))
    )
    targets = targets.where("cluster.n > 1").select(*keys, "tolerance", "step", "copy")
    several = _greedy_rounds(rows.where("n > 1").select(*columns), targets, columns)
    return missed.unionByName(single).unionByName(several)


def _best_of_cluster(rows: DataFrame, columns: list[str], salts: int = 16) -> DataFrame:
    """Mark the best detection of each cluster (ties: earlier step).

    Ranked per cluster and salt first; then the winners meet, at most ``salts`` of them,
    so a cluster with very many detections is spread over tasks.
    """
    cluster = ["series_id", "event", "tolerance", "first"]
    best_first = [F.col("score").desc(), F.col("step")]
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    local = F.row_number().over(Window.partitionBy(*cluster, "_salt").orderBy(*best_first))
    salted = salted.withColumn("_lead", local == 1)
    meet = F.when(F.col("_lead"), F.lit(-1).cast("long")).otherwise(F.col("_salt"))
    salted = salted.withColumn("_meet", meet)
    final = F.row_number().over(Window.partitionBy(*cluster, "_meet").orderBy(*best_first))
    return salted.select(*columns, (F.col("_lead") & (final == 1)).cast("int").alias("matched"))


def _greedy_rounds(near: DataFrame, targets: DataFrame, columns: list[str]) -> DataFrame:
    """Greedy matching of detections that several truths compete for, without walking through them.

    Every pair within the tolerance is a link.  A link is certain if its truth is the nearest free
    one of its detection, and its detection the best of all that the truth could still go to: no
    better detection can take the truth later, and whatever took a nearer truth was better.  All certain links are
    matched at once, links of matched ends go, and the next round looks at what is left; the best
    detection left is always certain.  Scores without order along the series leave few rounds; scores that rise from
    truth to truth of a chain need a round for each.
    """
    part = ["series_id", "event", "tolerance"]
    near = stage(near.withColumn("_id", F.monotonically_increasing_id()), "rival-detections")
    cell = F.floor(F.col("step") / F.col("tolerance")).cast("long")
    truth = targets.select(
        *part, F.struct(F.col("step").alias("at"), "copy").alias("truth"), F.explode(F.sequence(cell - 1, cell + 1)).alias("_cell")
    )
    gap = F.abs(F.col("truth.at") - F.col("step"))
    links = near.withColumn("_cell", cell).join(truth, [*part, "_cell"]).where(gap < F.col("tolerance"))
    links = stage(
        links.select(
            *part,
            F.struct((-F.col("score")).alias("rank"), "step", F.col("_id").alias("id")).alias("det"),
            "truth",
            F.struct(gap.alias("gap"), "truth").alias("choice"),
        ),
        "links",
    )
    matched = []
    while not links.isEmpty():
        # aggregates, not windows: a truth with very many rivals is a partial minimum in every task
        nearest = links.groupBy(*part, "det").agg(F.min("choice").alias("choice"))
        best = links.groupBy(*part, "truth").agg(F.min("det").alias("det"))
        certain = nearest.select(*part, "det", F.col("choice.truth").alias("truth")).join(best, [*part, "det", "truth"])
        certain = stage(certain, "certain-links")
        matched.append(certain.select(F.col("det.id").alias("_id")))
        left = links.join(certain.select(*part, "det"), [*part, "det"], "left_anti")
        links = stage(left.join(certain.select(*part, "truth"), [*part, "truth"], "left_anti"), "links")
    if not matched:
        return near.select(*columns, F.lit(0).alias("matched"))
    hits = reduce(DataFrame.unionByName, matched).withColumn("_hit", F.lit(1))
    return near.join(hits, "_id", "left").select(*columns, F.coalesce("_hit", F.lit(0)).alias("matched"))


def _blocks_of(step: Column, width: float, before: float, after: float) -> Column:
    """Blocks a row is needed in when frames reach ``before``/``after`` steps."""
    first = F.floor((step - after) / width).cast("long")
    last = F.floor((step + before) / width).cast("long")
    return F.sequence(first, last)


def _clusters(truth: DataFrame, keys: list[str], width: float, reach: float) -> DataFrame:
    """Truths with ``clusters``: per tolerance the first step and the size of the cluster."""
    copies = truth.withColumn("block", F.explode(_blocks_of(F.col("step"), width, reach, 0.0)))
    w = Window.partitionBy(*keys, "block").orderBy("step")
    own = copies.withColumn("_prev", F.lag("step").over(w)).where(F.floor(F.col("step") / width) == F.col("block"))
    long = own.select("*", F.posexplode("tols").alias("_i", "_tol"))
    start = F.when(F.coalesce(F.col("step") - F.col("_prev") >= 2 * F.col("_tol"), F.lit(True)), F.col("step"))
    long = long.withColumn("_start", start)
    part = [*keys, "_i"]
    per_block = long.groupBy(*part, "block").agg(F.max("_start").alias("_last"))
    before = carry(per_block, part, "block", [Carry("_before", "max", "_last")])
    # by range: repeated truths see the start that one of them has
    running = Window.partitionBy(*part, "block").orderBy("step").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cluster = F.coalesce(F.max("_start").over(running), "_before")
    named = long.join(before, [*part, "block"]).withColumn("_cluster", cluster)
    sizes = named.groupBy(*part, "_cluster").agg(F.count(F.lit(1)).alias("_n"))
    named = named.join(sizes, [*part, "_cluster"])
    # repeated truths at one step share their clusters; keep how many there are
    grouped = named.groupBy(*keys, "step").agg(
        F.first("tols").alias("tols"),
        F.sort_array(F.collect_set(F.struct("_i", "_cluster", "_n"))).alias("_c"),
        F.sum(F.when(F.col("_i") == 0, 1)).alias("_copies"),
    )
    once = grouped.select(
        *keys, "step", "tols", F.transform("_c", lambda c: F.struct(c["_cluster"].alias("first"), c["_n"].alias("n"))).alias("clusters"), "_copies"
    )
    return once.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).drop("_copies")


def _nearest_truths(truth: DataFrame, found: DataFrame, keys: list[str], width: float, reach: float) -> DataFrame:
    """Detections with ``prev`` (last truth at or before) and ``next`` (first truth at or
    after), both null if farther than ``reach`` outside the block."""
    marks = truth.select(
        *keys, "step", F.struct("step", "clusters").alias("_truth"), F.lit(None).cast("double").alias("score"),
        F.lit(None).cast("array<double>").alias("tols"), F.lit(0).alias("_kind"),
        F.explode(_blocks_of(F.col("step"), width, reach, reach)).alias("block"),
    )
    rows = found.select(
        *keys, "step", F.lit(None).cast(marks.schema["_truth"].dataType).alias("_truth"), "score", "tols",
        F.lit(1).alias("_kind"), F.floor(F.col("step") / width).cast("long").alias("block"),
    )
    part = Window.partitionBy(*keys, "block")
    upto = Window.unboundedPreceding, Window.currentRow
    up = part.orderBy("step", "_kind").rowsBetween(*upto)
    down = part.orderBy(F.col("step").desc(), "_kind").rowsBetween(*upto)
    both = marks.unionByName(rows).withColumns(
        {"prev": F.last("_truth", ignorenulls=True).over(up), "next": F.last("_truth", ignorenulls=True).over(down)}
    )
    return both.where("_kind = 1")


def scored_levels(matched: DataFrame, truths: DataFrame) -> DataFrame:
    """Per event, tolerance and distinct score: hits and detections there (``tp``, ``n``)
    and from the best score down to there (``c_tp``, ``c_n``), with ``p`` truths in all."""
    prevalence = truth_events(truths).groupBy("event").agg(F.count(F.lit(1)).alias("p"))
    levels = matched.groupBy(*GROUP, "score").agg(F.sum("matched").alias("tp"), F.count(F.lit(1)).alias("n"))
    totals = running_totals(stage(levels, "score-levels"), GROUP, "score", ["tp", "n"])
    return totals.join(prevalence, "event")


def average_precision(matched: DataFrame, truths: DataFrame) -> DataFrame:
    """``event, tolerance, ap``: step integral of precision over recall."""
    levels = scored_levels(matched, truths)
    area = F.sum(F.col("tp") / F.col("p") * (F.col("c_tp") / F.col("c_n")))
    return levels.groupBy(*GROUP).agg(area.alias("ap"))


def pr_curve(matched: DataFrame, truths: DataFrame) -> DataFrame:
    """``event, tolerance, threshold, precision, recall``: thresholds down to the first one
    at full attained recall, closed by precision 1 at recall 0 (threshold null)."""
    levels = stage(scored_levels(matched, truths), "score-levels")
    ends = levels.groupBy(*GROUP).agg(F.max("c_tp").alias("_hits"), F.max("score").alias("_best"))
    kept = levels.join(ends, GROUP).where(
        (F.col("c_tp") - F.col("tp") < F.col("_hits")) | (F.col("score") == F.col("_best"))
    )
    points = kept.select(
        *GROUP,
        F.col("score").alias("threshold"),
        (F.col("c_tp") / F.col("c_n")).alias("precision"),
        (F.col("c_tp") / F.col("p")).alias("recall"),
    )
    close = ends.select(
        *GROUP,
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return points.unionByName(close)


def mean_ap(ap_table: DataFrame, truths: DataFrame) -> DataFrame:
    """One row ``mean_ap``: mean over the tolerances present, summed over events and
    divided by the number of events among the truths."""
    classes = truth_events(truths).select("event").distinct()
    per_event = ap_table.groupBy("event").agg(F.avg("ap").alias("ap"))
    joined = classes.join(per_event, "event", "left")
    return joined.agg((F.coalesce(F.sum("ap"), F.lit(0.0)) / F.count(F.lit(1))).alias("mean_ap"))


def event_detection_ap(
    truths: DataFrame, detections: DataFrame, tolerances: Tolerances = TOLERANCES, block_steps: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """Score a submission: ``(mean_ap, ap_table)``."""
    check_inputs(truths, detections, tolerances)
    matched = match_detections(truths, detections, tolerances, block_steps)
    table = stage(average_precision(matched, truths), "average-precision")
    return mean_ap(table, truths), table
