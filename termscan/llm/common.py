"""What several operators share: tables, durable intermediates, 64-bit mixing, components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termscan.session import DurableTable

#: Rows and bytes of one Arrow batch: long texts must not meet by the thousand in one Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_written: list[DurableTable] = []


#: Whether the shuffle files of a query go when it has ended; a DataFrame that runs again would miss them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read back: survives lost executors and ends the lineage.

    What was shuffled for it goes at once and not with some later garbage collection.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        table = DurableTable(df, f"llm-{label}")
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    _written.append(table)
    return table.df


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``durable`` gave and that nothing reads from any more."""
    for table in [t for t in _written if any(t.df is x for x in tables)]:
        _written.remove(table)
        table.drop()


def drop_between(since: int, until: int) -> None:
    """Deletes the tables written on the way from number ``since`` up to ``until``, which nothing reads from any more."""
    for table in _written[since:until]:
        _written.remove(table)
        table.drop()


def written() -> int:
    """How many tables operators have written on their way so far."""
    return len(_written)


def release(since: int = 0) -> int:
    """Deletes the tables written on the way but for the first ``since`` of them, and says how many.

    To be called when the results that read from them are written.
    """
    count = len(_written) - since
    while len(_written) > since:
        _written.pop().drop()
    return count


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that this session's Python workers get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: ``(node, component)``, the component its smallest node.

    Nodes without edges are not listed; null ends and loops are ignored; no edges give no rows.
    """
    now, _ = _stars(edges.select(F.col(a).alias("a"), F.col(b).alias("b")))
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _stars(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges ``(u, v)`` from every node but the smallest of its component to that one, and how many they are.

    Alternates large-star and small-star steps until the edges are stars. Each step groups and joins by
    node, so no component is ever gathered, and each round is a table in the shared folder.
    """
    now = durable(
        edges.where("a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    count, left = _state(now)
    while left:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(light(low, 2 * count), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if 2 * count > LIGHT:
            large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(light(low, 2 * count), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, now = now, durable(small.union(low.select("u", "m")).distinct(), "edges")
        drop(old)
        count, left = _state(now)
    return now, count


def _state(edges: DataFrame) -> tuple[int, int]:
    """How many edges there are, and how many nodes have several smaller ends or both smaller and larger ones: none if all are stars."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    count, left = ends.agg(F.sum("up"), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()
    return count or 0, left


#: Rows of numbers up to which a counted table is broadcast (a few MB); a longer one is joined by a shuffle.
LIGHT = 200_000


def light(df: DataFrame, rows: int) -> DataFrame:
    """``df``, known to have up to ``rows`` rows, for a join that leaves the other side where it is if they are few."""
    return F.broadcast(df) if rows <= LIGHT else df


#: Pivot rounds go on until a member has so few pairs left to look at, or so many rounds are over.
FEW_PAIRS, PIVOT_ROUNDS = 4, 5
#: Groups of so many members have few pairs, which are looked at without rounds.
SMALL_GROUP = 2 * FEW_PAIRS


def shared(keyed: DataFrame) -> DataFrame:
    """The distinct rows of ``keyed`` (``key, node`` and more) whose key several nodes have; one shuffle."""
    group = Window.partitionBy("key")
    ends = {"__lo": F.min("node").over(group), "__hi": F.max("node").over(group)}
    return keyed.withColumns(ends).where("__lo < __hi").drop(*ends).distinct()


def link_groups(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    admissible: Callable[[str, str], F.Column] | None = None,
    centre: F.Column | None = None,
    bounds: DataFrame | None = None,
    bounded: Callable[[str, str], F.Column] | None = None,
) -> DataFrame:
    """Components of the nodes that meet under a key and pass ``verify``: ``(node, component)``.

    ``members`` holds ``key, node, m`` (the key's rows) and what ``admissible(left, right)`` reads from the two
    sides of a pair. All pairs of groups of up to ``SMALL_GROUP`` members are looked at. Expanding the
    larger ones into all their pairs would grow with the square of a group, so there each
    member is verified against one pivot of its group, in rounds with other pivots, at first the member
    with the least ``centre``, then one from any of the group's components; a pair already in one
    component needs no further look. Rounds go on while many pairs lie in different components. The
    last round takes every pair of members still in different components that ``bounded`` cannot
    rule out from ``bounds`` (one row per node): nothing is left out, and no pair is verified twice.
    """
    spark = members.sparkSession
    none = spark.range(0)
    done = none.select(F.col("id").alias("a"), F.col("id").alias("b"))
    stars, in_stars = none.select(F.col("id").alias("u"), F.col("id").alias("v")), 0

    def look(left: DataFrame, right: DataFrame, apart: F.Column) -> None:
        nonlocal done, stars, in_stars
        if admissible is not None:
            apart = apart & admissible("l", "r")
        pairs = (
            left.join(right, apart)
            .select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b"))
            .distinct()
            .join(done, ["a", "b"], "left_anti")
        )
        pairs = durable(pairs, "pairs")
        if not pairs.isEmpty():
            before = written()
            found = durable(verify(pairs).select("a", "b", "linked"), "links")
            drop_between(before, written() - 1)
            done = done.union(found.select("a", "b"))
            # what was found before stays: its components are stars
            old = stars
            stars, in_stars = _stars(found.where("linked").select("a", "b").union(stars))
            drop(old)
        drop(pairs)

    members = durable(members, "members")
    large = durable(members.where(F.col("m") > SMALL_GROUP), "large")
    small = members.where(F.col("m") <= SMALL_GROUP)
    left, right = small.alias("l"), small.alias("r")
    look(left, right, (F.col("l.key") == F.col("r.key")) & (F.col("l.node") < F.col("r.node")))
    drop(members)
    size = large.count()
    last = None
    for turn in range(PIVOT_ROUNDS + 1):
        label = stars.toDF("node", "component")
        own = large.join(light(label, in_stars), "node", "left").withColumn("component", F.coalesce("component", "node"))
        order = F.xxhash64("component", F.lit(turn)) if turn or centre is None else centre
        parts = own.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.min_by("node", order).alias("pivot"), F.min(order).alias("order"))
        spread = parts.groupBy("key").agg(
            F.min_by("pivot", "order").alias("pivot"), F.count(F.lit(1)).alias("parts"),
            ((F.sum("c").cast("double") * F.sum("c") - F.sum(F.col("c").cast("double") * F.col("c"))) / 2).alias("open"),
        ).where("parts > 1")
        spread = durable(spread, "groups")
        groups, left_open = spread.agg(F.count(F.lit(1)), F.sum("open")).first()
        if not left_open:
            drop(spread)
            break
        final = turn == PIVOT_ROUNDS or left_open <= FEW_PAIRS * size or (last is not None and left_open > 0.9 * last)
        last = left_open
        own = own.join(light(spread.select("key", "pivot"), groups), "key")
        if final and bounds is not None:
            own = own.join(bounds, "node")
        left, right = own.alias("l"), own.alias("r")
        apart = (F.col("l.key") == F.col("r.key")) & (F.col("l.component") != F.col("r.component"))
        if not final:
            right = own.where("node = pivot").alias("r")
        else:
            apart = apart & (F.col("l.node") < F.col("r.node"))
            if bounded is not None:
                apart = apart & bounded("l", "r")
        look(left, right, apart)
        drop(spread)
        if final:
            break
    drop(large)
    roots = stars.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return stars.toDF("node", "component").union(roots)
