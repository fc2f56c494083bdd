"""Connected components of a table of links, and work on them in tasks of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfuse.operators.scratch import kept


def components(links: DataFrame, label: str) -> DataFrame:
    """Rows (node, root), one for each node of ``links`` (a, b): equal roots mean connected.

    Each round every node points to the neighbour, or itself, of least rank, ranks being
    a hash that is new each round; pointers are followed once more, and the links between
    what is left go on to the next round, until none is left. Ranks keep chains short, so the
    number of links falls geometrically whatever the shape of the graph, and every round joins
    some nodes, so there is an end. Rounds are written to the shared
    folder. Links of a node to itself are ignored; nulls are not allowed.
    """
    written = lambda df, name: kept(df, f"{label}-{name}", compression="zstd")
    edges = written(links.select("a", "b").where("a <> b").distinct(), "links")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        turn = len(maps)
        both = edges.union(edges.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("rank"), F.col(c).alias("node"))  # noqa: B023, E731
        up = both.groupBy("a").agg(F.min(rank("b")).alias("least")).select(F.col("a").alias("node"), F.least(rank("a"), F.col("least"))["node"].alias("up"))
        up = written(up, "up")
        again = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jumped = written(up.join(again, "up", "left").select("node", F.coalesce("top", "up").alias("up")), "jumped")
        maps.append(jumped)
        a, b = (jumped.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up")) for c in "ab")
        rest = edges.join(a, "a").join(b, "b").select(F.col("a_up").alias("a"), F.col("b_up").alias("b")).where("a <> b")
        edges = written(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = maps[-1].withColumnRenamed("up", "root")
    for above in reversed(maps[:-1]):
        step = roots.select(F.col("node").alias("up"), "root")
        roots = written(above.join(step, "up", "left").select("node", F.coalesce("root", "up").alias("root")), "roots")
    return roots


def buckets(links: DataFrame, weights: DataFrame, most: int, label: str) -> DataFrame:
    """Rows (node, bucket): components of ``links`` (a, b) that weigh at most ``most`` together dealt to buckets of about that weight; null for
    nodes of a component that weighs more.

    A component weighs its links and the weights (node, n) of its nodes. All links of a component fall in one bucket, so work that
    only follows links gives the same in buckets as on the whole.
    """
    rooted = kept(weights.groupBy("node").agg(F.max("n").alias("n")).join(components(links, label), "node"), f"{label}-rooted")
    heavy = links.select(F.col("a").alias("node"), F.lit(1).cast("long").alias("n")).join(rooted.select("node", "root"), "node").select("root", "n").unionByName(rooted.select("root", "n"))
    sizes = kept(heavy.groupBy("root").agg(F.sum("n").alias("n")), f"{label}-sizes")
    total = sizes.where(F.col("n") <= most).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    dealt = F.when(F.col("n") <= most, F.pmod(F.xxhash64("root"), F.lit(-(-total // most) or 1)))
    return kept(rooted.select("node", "root").join(sizes.select("root", dealt.alias("bucket")), "root").select("node", "bucket"), f"{label}-buckets")
