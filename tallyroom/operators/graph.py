"""Connected components and first-come choice over pairs, in a number of jobs that grows with the logarithm of the input."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.operators.scratch import Kept

#: Pairs of one component that a single row holds and folds.
FOLD = 20_000


def components(pairs: DataFrame, kept: Kept) -> DataFrame:
    """(node, component) of all nodes of the pairs (early < late): component is the smallest node that a node is linked to.

    Each round points the greater neighbours of a node at the least of its neighbourhood (large star), then a node and its lesser
    neighbours at the least of these (small star), until no pair changes: every component is a star then.
    """
    stars = kept.keep(pairs.select("late", "early").distinct())
    seen = None
    while True:
        ways = stars.unionByName(stars.select(F.col("early").alias("late"), F.col("late").alias("early")))
        least = ways.groupBy("late").agg(F.min("early").alias("m")).select("late", F.least("late", "m").alias("m"))
        large = ways.join(least, "late").where("early > late").select(F.col("early").alias("late"), F.col("m").alias("early")).distinct()
        low = large.groupBy("late").agg(F.min("early").alias("m"))
        moved = large.join(low, "late").select(F.explode(F.array(F.struct("late", F.col("m").alias("early")), F.struct(F.col("early").alias("late"), F.col("m").alias("early")))).alias("x")).select("x.*")
        new = kept.keep(moved.where("late <> early").distinct())
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("late", "early").cast("decimal(38,0)"))).first()
        kept.drop(stars)
        stars = new
        if state == seen:
            return stars.select(F.col("late").alias("node"), F.col("early").alias("component")).unionByName(stars.select(F.col("early").alias("node"), F.col("early").alias("component")).distinct())
        seen = state


def _folded(edges: DataFrame) -> DataFrame:
    """Ids that go, of components that fit into a row each: their pairs in order of the later row, folded over a bitmap of the rows gone."""
    nodes = edges.select("component", F.explode(F.array("early", "late")).alias("node")).distinct()
    nodes = nodes.withColumn("i", F.row_number().over(Window.partitionBy("component").orderBy("node")) - 1)
    place = lambda c: nodes.select("component", F.col("node").alias(c), F.col("i").alias(f"{c}_i"))
    placed = edges.join(place("early"), ["component", "early"]).join(place("late"), ["component", "late"])
    rows = placed.groupBy("component").agg(F.sort_array(F.collect_list(F.struct(F.col("late_i").alias("l"), F.col("early_i").alias("e")))).alias("pairs"), F.max("late_i").alias("n"))
    gone = F.expr(
        """aggregate(pairs, array_repeat(0L, cast(n div 64 as int) + 1), (gone, x) ->
            if((shiftright(gone[cast(x.e div 64 as int)], x.e % 64) & 1) = 1, gone, transform(gone, (w, k) -> if(k = x.l div 64, w | shiftleft(1L, x.l % 64), w))))"""
    )
    bits = rows.select("component", gone.alias("gone"))
    return nodes.join(bits, "component").where("(shiftright(gone[cast(i div 64 as int)], i % 64) & 1) = 1").select(F.col("node").alias("id"))


def _rounds(edges: DataFrame, kept: Kept) -> list[DataFrame]:
    """Ids that go, of components too large for a row: each round settles the rows that no undecided one precedes."""
    gone = []
    while not edges.limit(1).isEmpty():
        first = edges.select(F.col("early").alias("id")).distinct().join(edges.select(F.col("late").alias("id")), "id", "left_anti")
        lost = kept.keep(edges.join(first, edges.early == first.id, "left_semi").select(F.col("late").alias("id")).distinct())
        gone.append(lost)
        rest = edges.join(lost.select(F.col("id").alias("late")), "late", "left_anti").join(lost.select(F.col("id").alias("early")), "early", "left_anti")
        new = kept.keep(rest.select("early", "late"))
        edges = new
    return gone


def first_come(pairs: DataFrame, kept: Kept, fold: int = FOLD) -> DataFrame:
    """(id) of the rows that go when rows come in id order and one goes if it is paired with an earlier row that stayed.

    A component of up to fold pairs is decided in one row; larger ones in rounds, as many as their longest chain of decisions.
    """
    pairs = kept.keep(pairs.select(F.least("a", "b").alias("early"), F.greatest("a", "b").alias("late")).distinct())
    of = components(pairs, kept).withColumnRenamed("node", "early")
    edges = kept.keep(pairs.join(of, "early"))
    sizes = edges.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    out = _folded(edges.join(sizes.where(F.col("n") <= fold), "component", "left_semi"))
    large = kept.keep(edges.join(sizes.where(F.col("n") > fold), "component", "left_semi").select("early", "late"))
    for lost in _rounds(large, kept):
        out = out.unionByName(lost)
    return out
