"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.words import PATTERN
from tidegrid.staging import stage

CELLS = 1 << 15
# rows that agree in these are interchangeable for the mixture
EQUAL = ["rank", "id", "size", "digest"]
# a group of equal rows of which some are taken and some are not
CUT = "first > 0 and first < n"


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Per source (``source``, null as its own source): ``source_size`` and ``target``.

    Sources in code-point order, null last, take ``weights`` in turn and divide ``share``
    times all sizes; a target stops at ``most`` times its source's size and the excess goes to
    the others by weight.  Filling up in order of size per weight gives the end state of
    that: source k is full if the level after filling those before it reaches its own.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("turn", F.lit(len(weights))) + 1).cast("int"))
    table = sums.withColumn("turn", turn).withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "turn")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    table = table.withColumn("level", left / F.sum("weight").over(rest)).withColumn("place", F.row_number().over(order))
    open_ = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("place", "level"))
    table = table.withColumn("first_open", F.min(open_).over(everything))
    full = F.col("first_open").isNull() | (F.col("place") < F.col("first_open.place"))
    target = F.when(full, F.col("cap")).otherwise(F.col("weight") * F.col("first_open.level"))
    return table.select("source", "source_size", target.alias("target"))


def sizes(docs: DataFrame, text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(PATTERN)), F.lit(0)).cast("long")


def _cut_groups(rows: DataFrame) -> DataFrame:
    """Set ``extra`` for the first ``first`` rows of each source; ``rows`` are one group a source.

    Rows are written once with a running id, so their order is settled; a count per input
    partition tells each of them where its numbers begin, so no group meets in one task.
    """
    held = stage(rows.withColumn("uid", F.monotonically_increasing_id()), "cut-groups")
    held = held.withColumn("of", F.shiftright("uid", 33))
    parts = held.groupBy(F.col("s").alias("s4"), F.col("of").alias("of4")).agg(F.count(F.lit(1)).alias("c"))
    ahead = F.sum("c").over(Window.partitionBy("s4").orderBy("of4")) - F.col("c")
    parts = parts.select("s4", "of4", ahead.alias("ahead"))
    held = held.join(parts, F.col("s").eqNullSafe(F.col("s4")) & (F.col("of") == F.col("of4")))
    place = F.row_number().over(Window.partitionBy("s", "of").orderBy("uid")) + F.col("ahead")
    return held.withColumn("extra", place <= F.col("first")).drop("uid", "of", "s4", "of4", "ahead")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """One row per document: ``row`` (struct of all columns), ``size``, ``source_size``, ``target``, ``taken``, ``copies``.

    A source with target/size = k + f gives every document k certain copies.  The last copy
    is drawn by Pareto order sampling: documents are ranked by their random odds divided by
    their inclusion odds f / (1 - f), and the first are taken until their words fill f times the
    source; the document at the border is taken if that comes nearer.  Random numbers
    are hashes of id, size and text, so reruns agree; equal ranks go by these.  Rows equal in all
    three (repeated rows) are one group; where the border falls into it, the rows up to the
    border are taken and the others are not.

    The border is found in three steps: two histograms of the ranks (``CELLS`` cells each,
    summed where the rows are) and a running sum over the few groups in the last cell.  No
    source is ever sorted or summed in one task; the rows of a cut group are numbered per input
    partition, with the counts of the partitions before.  Null texts and texts without words have size
    0 and are never taken; a null source is a source of its own; an empty table gives no rows.
    """
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(source).cast("string").alias("source"),
        F.col(id_col).cast("string").alias("id"),
        sizes(docs, text).alias("size"),
        F.md5(F.col(text).cast("binary")).alias("digest"),
    )
    narrow = stage(whole.select("source", "id", "size", "digest"), "sizes")
    table = source_targets(narrow, weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    table = table.withColumn("ratio", ratio).withColumn("whole", F.floor("ratio"))
    table = table.withColumn("part", F.col("ratio") - F.col("whole")).withColumn("want", F.col("part") * F.col("source_size"))
    table = stage(table.withColumnRenamed("source", "s"), "targets")

    def ranked(rows: DataFrame) -> DataFrame:
        rows = rows.join(table, F.col("source").eqNullSafe(F.col("s")), "left")
        key = F.concat_ws("|", F.lit(seed), F.coalesce("id", F.lit("-")), F.col("size").cast("string"), "digest")
        digits = F.substring(F.md5(key), 1, 12)
        u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)
        odds = u / (1 - u) * (1 - F.col("part")) / F.col("part")
        rank = F.when(F.col("part") > 0, odds / (1 + odds)).otherwise(1.0)
        rows = rows.withColumn("rank", rank).withColumn("c1", F.floor(F.col("rank") * CELLS))
        return rows.withColumn("c2", F.floor(F.col("rank") * CELLS * CELLS) - F.col("c1") * CELLS)

    def crossing(cells: DataFrame, cell: str, want) -> DataFrame:
        """Per source the cell where the running size passes ``want``, and the size before it."""
        up = Window.partitionBy("s").orderBy(cell)
        cells = cells.withColumn("before", F.sum("n").over(up) - F.col("n"))
        return cells.where((F.col("before") < want) & (F.col("before") + F.col("n") >= want)).drop("n")

    drawn = ranked(narrow).where("part > 0 and size > 0")
    one = drawn.groupBy("s", "c1", "want").agg(F.sum("size").alias("n"))
    one = stage(crossing(one, "c1", F.col("want")).select(F.col("s").alias("s1"), F.col("c1").alias("k1"), F.col("before").alias("b1")), "cells")
    at_one = F.col("s").eqNullSafe(F.col("s1"))
    two = drawn.join(one, at_one & (F.col("c1") == F.col("k1"))).groupBy("s", "k1", "b1", "c2", "want").agg(F.sum("size").alias("n"))
    two = crossing(two, "c2", F.col("want") - F.col("b1"))
    two = stage(two.select(F.col("s").alias("s2"), "k1", F.col("c2").alias("k2"), (F.col("b1") + F.col("before")).alias("b2")), "cells")
    cell = two.select(F.col("s2").alias("s1"), F.col("k1").alias("q1"), "k2", "b2")
    last = drawn.join(cell, F.col("s").eqNullSafe(F.col("s1")) & (F.col("c1") == F.col("q1")) & (F.col("c2") == F.col("k2")))
    last = last.groupBy("s", "want", "b2", *EQUAL).agg(F.count(F.lit(1)).alias("n"))
    fill = F.col("n") * F.col("size")
    up = Window.partitionBy("s").orderBy(*EQUAL).rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("need", F.col("want") - (F.sum(fill).over(up) - fill + F.col("b2")))
    # the one group of equal rows in which the words run out, and how many of its rows come nearest
    first = F.least(F.floor(F.col("need") / F.col("size") + 0.5), "n").alias("first")
    border = last.where((F.col("need") > 0) & (F.col("need") <= fill))
    border = stage(border.select(F.col("s").alias("s3"), F.struct(*EQUAL).alias("border"), "n", first), "borders")
    rows = ranked(whole).join(two.withColumnRenamed("k1", "e1").withColumnRenamed("k2", "e2"), F.col("s").eqNullSafe(F.col("s2")), "left")
    rows = rows.join(border, F.col("s").eqNullSafe(F.col("s3")), "left")
    below = (F.col("c1") < F.col("e1")) | ((F.col("c1") == F.col("e1")) & (F.col("c2") < F.col("e2")))
    same_cell = (F.col("c1") == F.col("e1")) & (F.col("c2") == F.col("e2"))
    at_border = F.struct(*EQUAL).eqNullSafe(F.col("border"))
    inside = same_cell & ((F.struct(*EQUAL) < F.col("border")) | (at_border & (F.col("first") == F.col("n"))))
    rows = rows.withColumn("extra", (F.col("part") > 0) & F.coalesce(below | inside, F.lit(False)))
    if border.where(CUT).head(1):
        cut = F.coalesce(same_cell & at_border & F.expr(CUT), F.lit(False))
        rows = rows.where(~cut).unionByName(_cut_groups(rows.where(cut)))
    extra = F.col("extra")
    copies = F.when(F.col("size") > 0, F.coalesce("whole", F.lit(0)) + extra.cast("long")).otherwise(F.lit(0)).cast("long")
    return rows.select(
        "row",
        "size",
        F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"),
        F.coalesce("target", F.lit(0.0)).alias("target"),
        (copies * F.col("size")).alias("taken"),
        copies.alias("copies"),
    )
