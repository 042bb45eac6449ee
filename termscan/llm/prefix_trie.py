"""The trie of common beginnings of conversations, and sums over its subtrees by centroid decomposition.

A conversation's beginning of d turns is known by 128 bits: the exclusive or of a hash of each turn with
its place. Places and such running values are added up over a range-sorted table: tasks add up their own
stretch, and only the ends of stretches, two a task, are added up across tasks, so that one conversation
may be as long as it likes.

Rollup: every component of the forest is split at its centroid, the node below which, itself included,
lie half of its nodes or more, but below no child of it. The part below the centroid falls apart into its
children's subtrees, whose totals together with its own are added to every node on the path from the
centroid to the component's top; then each part goes on by itself. As parts at least halve, so many
rounds are needed as the number of nodes has binary digits. Components of up to ``LOCAL`` nodes are
finished, by the same steps, within a task each.

Who lies on a path, or below a centroid, the conversations themselves say: the path from any node to the
root is the beginning of every conversation that passes through it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from termscan.llm.common import durable, small_batches
from termscan.session import small_enough_to_broadcast

#: Conversations whose ids agree but for the last two digits start alike; at most so many turns less one.
BLOCK, HEADS = 100, 6
#: Nodes up to which a component is finished in one task.
LOCAL = 20_000
#: Characters of ids that are hashed as one row.
CHUNK = 1 << 16
#: Bytes of a row of centroids or carried sums in a broadcast.
ROW_BYTES = 64


def _running_kernel(key: str, xors: list[str], schema: pa.Schema):
    """Counts and exclusive ors up to each row of its key, within a task's stretch of a sorted table."""

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count, acc = None, 0, np.zeros(len(xors), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(key).to_numpy()
            values = [batch.column(x).to_numpy() for x in xors]
            first = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1])
            sizes = np.diff(np.append(first, len(ids)))
            rank = np.arange(1, len(ids) + 1) - np.repeat(first, sizes)
            run = [np.bitwise_xor.accumulate(v) for v in values]
            before = [np.repeat(np.where(first > 0, r[first - 1], 0), sizes) for r in run]
            run = [r ^ b for r, b in zip(run, before)]
            if ids[0] == now:
                rank[: sizes[0]] += count
                for r, a in zip(run, acc):
                    r[: sizes[0]] ^= a
            now, count, acc = ids[-1], int(rank[-1]), np.array([r[-1] for r in run], dtype=np.int64)
            data = {c: batch.column(c) for c in batch.schema.names} | {"rank": pa.array(rank)}
            data |= {f"run_{x}": pa.array(r) for x, r in zip(xors, run)}
            yield pa.RecordBatch.from_arrays([data[f.name].cast(f.type) for f in schema], schema=schema)

    return kernel


def running(rows: DataFrame, key: str, order: list[Column], xors: list[str] = ()) -> DataFrame:
    """``rows`` with ``rank``, from 1 by ``order`` within ``key``, and ``run_x``, the exclusive or of ``x`` up to the row.

    One sort by key and order, in ranges, so that a key may lie in many tasks. ``key`` and ``xors`` are longs
    without nulls.
    """
    spark = rows.sparkSession
    rows = durable(rows, "running")  # ranges are found by reading the rows once more
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    out = rows.select("*", F.lit(0).cast("long").alias("rank"), *[F.col(x).alias(f"run_{x}") for x in xors])
    part = ordered.mapInArrow(_running_kernel(key, list(xors), to_arrow_schema(out.schema)), out.schema)
    part = durable(part.withColumn("stretch", F.spark_partition_id()), "stretches")
    runs = [f"run_{x}" for x in xors]
    sides = part.groupBy("stretch").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    # a key that goes on in another stretch is the first or the last one of its own: two rows a task at most
    ends = part.join(F.broadcast(sides), "stretch").where((F.col(key) == F.col("lo")) | (F.col(key) == F.col("hi")))
    ends = ends.groupBy("stretch", key).agg(F.max("rank").alias("rank"), *[F.max_by(r, "rank").alias(r) for r in runs])
    window = f"OVER (PARTITION BY {key} ORDER BY stretch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    carried = ends.select("stretch", key, F.expr(f"sum(rank) {window}").alias("c_rank"), *[F.expr(f"bit_xor({r}) {window}").alias(f"c_{r}") for r in runs])
    carried = durable(carried.where("c_rank IS NOT NULL"), "carried")
    if small_enough_to_broadcast(2 * n * ROW_BYTES):
        carried = F.broadcast(carried)
    joined = part.join(carried, ["stretch", key], "left")
    added = {"rank": F.col("rank") + F.coalesce("c_rank", F.lit(0))}
    added |= {r: F.col(r).bitwiseXOR(F.coalesce(f"c_{r}", F.lit(0))) for r in runs}
    return joined.withColumns(added).select(*out.columns)


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, turn, role, a, b, chars)``: each turn by two hashes of role and text, its text by its length."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    return conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"),
        half(1).alias("a"), half(16).alias("b"), F.length(text).cast("long").alias("chars"),
    )


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv, pos, key1, key2, up1, up2, chars)``, one row per turn of a rebuilt conversation, and ``(conv, length)``.

    ``key`` is the beginning up to the turn, ``up`` the one before it. Rows with equal turns stand by role,
    then by the hash of role and text.
    """
    ranked = running(rows, "conv", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("a"), F.col("b")]).drop("role", "turn")
    ranked = durable(ranked, "turns")
    convs = ranked.groupBy("conv").agg(F.max("rank").alias("own"))
    convs = convs.select("conv", "own", (F.col("conv") - F.col("conv") % BLOCK).alias("base"),
                         (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).alias("h"))
    bases = convs.select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    convs = convs.join(bases, "base", "left").withColumn("lead", F.least("h", F.coalesce("base_own", F.lit(0))))
    convs = durable(convs.withColumn("length", F.col("lead") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "conversations")
    heads = ranked.where(F.col("rank") < HEADS).select(F.col("conv").alias("base"), "rank", "a", "b", "chars")
    lead = convs.where("lead > 0").select("conv", "base", "lead").join(heads, "base").where("rank <= lead")
    tail = ranked.join(convs.select("conv", "h", "lead"), "conv").where("rank > h")
    each = lead.select("conv", F.col("rank").alias("pos"), "a", "b", "chars").union(
        tail.select("conv", (F.col("rank") - F.col("h") + F.col("lead")).alias("pos"), "a", "b", "chars"))
    placed = each.select("conv", "pos", "chars", F.xxhash64("a", "b", "pos").alias("x"), F.xxhash64("pos", "b", "a", F.lit(1)).alias("y"))
    keyed = running(placed, "conv", [F.col("pos")], ["x", "y"])
    # the root's key is 0, 0, which is what nothing adds up to
    keyed = keyed.select("conv", "pos", F.col("run_x").alias("key1"), F.col("run_y").alias("key2"),
                         F.col("run_x").bitwiseXOR(F.col("x")).alias("up1"), F.col("run_y").bitwiseXOR(F.col("y")).alias("up2"), "chars")
    return durable(keyed, "beginnings"), convs.select("conv", "length")


def trie(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """``(key1, key2, up1, up2, depth, chars, rep, n_convs, size)`` of every node but the root.

    ``rep`` is the smallest member, ``size`` the number of nodes of the subtree: every node below is one of
    those that some member of the node is the smallest member of, which for a member lie in a row.
    """
    nodes = paths.groupBy("key1", "key2").agg(
        F.min("up1").alias("up1"), F.min("up2").alias("up2"), F.min("pos").alias("depth"), F.min("chars").alias("chars"),
        F.min("conv").alias("rep"), F.count(F.lit(1)).alias("n_convs"))
    nodes = durable(nodes, "nodes")
    tops = nodes.groupBy(F.col("rep").alias("conv")).agg(F.min("depth").alias("top"))
    tops = tops.join(convs, "conv").select("conv", "top", "length")
    own = paths.select("conv", "pos", "key1", "key2").join(tops, "conv")
    sizes = own.groupBy("key1", "key2").agg(F.sum(F.col("length") - F.greatest(F.col("top"), F.col("pos")) + 1).alias("size"))
    return durable(nodes.join(sizes, ["key1", "key2"]), "trie")


def _small(df: DataFrame, count: int) -> DataFrame:
    return F.broadcast(df) if small_enough_to_broadcast(count * ROW_BYTES) else df


def rollup(nodes: DataFrame, paths: DataFrame, values: list[str], local: int = LOCAL) -> DataFrame:
    """``(key1, key2, sum_v ..)``: for each node the sums of ``values`` over its subtree, by centroid decomposition.

    ``nodes`` holds ``key1, key2, up1, up2, depth, rep, size`` and the values (longs); its topmost nodes stand at
    one depth. ``paths`` holds ``conv, pos, key1, key2, up1, up2``, the way down to the end of each
    conversation, of which ``rep`` names one through the node.
    """
    key = ["key1", "key2"]
    top = nodes.groupBy().agg(F.min("depth").alias("least")).first().least
    if top is None:
        return nodes.select(*key, *[F.col(v).alias(f"sum_{v}") for v in values])
    tops = nodes.where(F.col("depth") == top).select(*key, F.col("size").alias("whole"))
    # the topmost nodes are components' tops; the node at that depth on a node's way is its own
    way = paths.where(F.col("pos") == top).select(F.col("conv").alias("rep"), *key).join(tops, key)
    way = way.select("rep", F.col("key1").alias("c1"), F.col("key2").alias("c2"), "whole")
    state = nodes.select(*key, "up1", "up2", "depth", "rep", "size", *values, *[F.lit(0).cast("long").alias(f"sum_{v}") for v in values])
    state = durable(state.join(way, "rep"), "components")
    done: list[DataFrame] = []
    while True:
        large = state.where(F.col("whole") > local)
        centroids = large.where("2 * size >= whole").groupBy("c1", "c2").agg(F.min_by(F.struct("depth", "rep", "size", *key), "size").alias("m"))
        centroids = durable(centroids.select("c1", "c2", F.col("m.depth").alias("m_depth"), F.col("m.rep").alias("m_rep"), F.col("m.size").alias("m_size"),
                                             F.col("m.key1").alias("m1"), F.col("m.key2").alias("m2")), "centroids")
        count = centroids.count()
        done.append(_within(state.where(F.col("whole") <= local), values))
        if not count:
            break
        marked = large.join(_small(centroids, count), ["c1", "c2"])
        # the child of the centroid on the way to each node further down, by the node's own conversation
        down = marked.where("depth > m_depth").select("rep", (F.col("m_depth") + 1).alias("pos"), "m1", "m2").distinct()
        steps = paths.select(F.col("conv").alias("rep"), "pos", F.col("key1").alias("n1"), F.col("key2").alias("n2"), F.col("up1").alias("m1"), F.col("up2").alias("m2"))
        below = down.join(steps, ["rep", "pos", "m1", "m2"]).select("rep", "m1", "m2", "n1", "n2")
        marked = marked.join(below.withColumn("is_below", F.lit(True)), ["rep", "m1", "m2"], "left")
        inside = (F.col("key1") == F.col("m1")) & (F.col("key2") == F.col("m2"))
        marked = durable(marked.withColumns({"is_it": inside, "is_below": F.coalesce("is_below", F.lit(False)) & (F.col("depth") > F.col("m_depth"))}), "marked")
        totals = marked.where("is_it OR is_below").groupBy("c1", "c2").agg(*[F.sum(v).alias(f"t_{v}") for v in values])
        totals = durable(totals, "totals")
        # a node above the centroid is on the way to it if the centroid's conversation passes through it
        ways = marked.where("depth < m_depth").select(*key, F.col("m_rep").alias("conv")).join(paths.select("conv", *key), ["conv", *key])
        ways = ways.select(*key, F.lit(True).alias("on_way"))
        marked = marked.join(ways, key, "left").join(_small(totals, count), ["c1", "c2"])
        add = F.col("is_it") | F.coalesce("on_way", F.lit(False))
        marked = marked.withColumns({f"sum_{v}": F.col(f"sum_{v}") + F.when(add, F.col(f"t_{v}")).otherwise(0) for v in values})
        done.append(marked.where("is_it").select(*key, *[f"sum_{v}" for v in values]))
        left = marked.where("NOT is_it").select(
            "rep", *key, "up1", "up2", "depth", F.when(F.col("on_way"), F.col("size") - F.col("m_size")).otherwise(F.col("size")).alias("size"),
            *values, *[f"sum_{v}" for v in values], F.when(F.col("is_below"), F.col("n1")).otherwise(F.col("c1")).alias("c1"),
            F.when(F.col("is_below"), F.col("n2")).otherwise(F.col("c2")).alias("c2"), (F.col("whole") - F.col("m_size")).alias("rest"), "is_below")
        left = durable(left, "parts")
        wholes = left.where("is_below").groupBy("c1", "c2").agg(F.max("size").alias("part"))
        left = left.join(wholes, ["c1", "c2"], "left").withColumn("whole", F.when(F.col("is_below"), F.col("part")).otherwise(F.col("rest")))
        state = durable(left.select(*state.columns), "components")
    out = done[0]
    for df in done[1:]:
        out = out.union(df)
    return out


def _centroids(parent: list[int], own: np.ndarray) -> np.ndarray:
    """Subtree sums of a small forest (parents stand before their children, -1 above tops), by splitting at centroids."""
    n = len(parent)
    sums = np.zeros_like(own)
    children: list[list[int]] = [[] for _ in range(n)]
    for i, p in enumerate(parent):
        if p >= 0:
            children[p].append(i)
    gone = [False] * n
    work = [i for i, p in enumerate(parent) if p < 0]
    while work:
        top = work.pop()
        order = [top]
        for i in order:
            order.extend(c for c in children[i] if not gone[c])
        size = dict.fromkeys(order, 1)
        for i in reversed(order[1:]):
            size[parent[i]] += size[i]
        at, half = top, len(order) / 2
        while True:
            heavy = [c for c in children[at] if not gone[c] and size[c] >= half]
            if not heavy:
                break
            at = heavy[0]
        below = [at]
        for i in below:
            below.extend(c for c in children[i] if not gone[c])
        total = own[below].sum(axis=0)
        sums[at] += total
        gone[at] = True
        work.extend(c for c in children[at] if not gone[c])
        if at != top:
            up = parent[at]
            while True:
                sums[up] += total
                if up == top:
                    break
                up = parent[up]
            work.append(top)
    return sums


def _within_kernel(values: list[str], schema: pa.Schema):
    """Finishes whole components of a stream sorted by component and depth."""

    def finish(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        column = lambda c: table.column(c).to_numpy()
        keys = list(zip(column("key1").tolist(), column("key2").tolist()))
        at = {k: i for i, k in enumerate(keys)}
        parent = [at.get(k, -1) for k in zip(column("up1").tolist(), column("up2").tolist())]
        own = np.stack([column(v) for v in values], axis=1)
        sums = _centroids(parent, own)
        data = [table.column("key1"), table.column("key2"), *[pa.array(column(f"sum_{v}") + sums[:, i]) for i, v in enumerate(values)]]
        return pa.Table.from_arrays(data, schema=schema).combine_chunks().to_batches()[0]

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            c1, c2 = batch.column("c1").to_numpy(), batch.column("c2").to_numpy()
            cuts = (np.flatnonzero((np.diff(c1) != 0) | (np.diff(c2) != 0)) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(c1)]):
                if (c1[lo], c2[lo]) != now:
                    if held:
                        yield finish(held)
                    now, held = (c1[lo], c2[lo]), []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield finish(held)

    return kernel


def _within(state: DataFrame, values: list[str]) -> DataFrame:
    sums = [f"sum_{v}" for v in values]
    out = state.select("key1", "key2", *sums)
    rows = state.select("c1", "c2", "depth", "key1", "key2", "up1", "up2", *values, *sums)
    ordered = rows.repartition("c1", "c2").sortWithinPartitions("c1", "c2", "depth")
    return ordered.mapInArrow(_within_kernel(values, to_arrow_schema(out.schema)), out.schema)


def _digits_kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a stream sorted by node and id, joined by commas, in rows of at most ``CHUNK`` characters and an id."""
    now, first, held, size, out = None, 0, [], 0, []
    for batch in batches:
        for k1, k2, conv in zip(*(batch.column(c).to_pylist() for c in ("key1", "key2", "conv"))):
            if (k1, k2) != now or size > CHUNK:
                if held:
                    out.append((*now, first, ",".join(held)))
                now, first, held, size = (k1, k2), conv, [], 0
            held.append(str(conv))
            size += len(held[-1]) + 1
            if len(out) >= 64 and sum(len(r[3]) for r in out[-64:]) > CHUNK:
                yield _rows(out, _DIGITS)
                out = []
    if held:
        out.append((*now, first, ",".join(held)))
    if out:
        yield _rows(out, _DIGITS)


def _sha_kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the chunks of each node of a stream sorted by node and first id."""
    now, sha, out = None, None, []
    for batch in batches:
        for k1, k2, digits in zip(*(batch.column(c).to_pylist() for c in ("key1", "key2", "digits"))):
            if (k1, k2) != now:
                if now is not None:
                    out.append((*now, sha.hexdigest()))
                now, sha = (k1, k2), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(digits.encode())
        if len(out) >= 10_000:
            yield _rows(out, _SHA)
            out = []
    if now is not None:
        out.append((*now, sha.hexdigest()))
    if out:
        yield _rows(out, _SHA)


_DIGITS = pa.schema([("key1", pa.int64()), ("key2", pa.int64()), ("first", pa.int64()), ("digits", pa.string())])
_SHA = pa.schema([("key1", pa.int64()), ("key2", pa.int64()), ("ends_sha256", pa.string())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def ends(members: DataFrame) -> DataFrame:
    """``(key1, key2, ends_sha256)`` from ``(key1, key2, conv)``: the hash of the node's ids, ascending and joined by commas.

    A hash of one long text is a matter of one task; so ids are first joined in many tasks, and only rows of
    64 thousand characters meet at their node, where they are streamed through.
    """
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = members.repartitionByRange(n, "key1", "key2", "conv").sortWithinPartitions("key1", "key2", "conv")
    chunks = ordered.mapInArrow(_digits_kernel, "key1 long, key2 long, first long, digits string")
    return chunks.repartition("key1", "key2").sortWithinPartitions("key1", "key2", "first").mapInArrow(_sha_kernel, "key1 long, key2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, local: int = LOCAL, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per distinct beginning of the rebuilt conversations, the empty one included.

    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``. Rows
    without a conversation id are left out, null roles and texts are empty, null turns come first; rows with
    equal turns stand by role, then by a hash, so equal rows change nothing by their order. Further columns
    are not read. An empty table gives no rows, not even a root.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    paths, convs = rebuilt(turns(conversations, id_col, turn_col, role_col, text_col))
    nodes = trie(paths, convs)
    key = ["key1", "key2"]
    # the root stands apart: its numbers are one row, and nothing else is its child but nodes of depth 1
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("rep")).first()
    zero = F.lit(0).cast("long")
    children = nodes.where("depth > 1").groupBy(F.col("up1").alias("key1"), F.col("up2").alias("key2")).agg(F.count(F.lit(1)).alias("n_children"))
    full = nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    full = full.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")})
    full = durable(full, "nodes")
    sums = rollup(full.select(*key, "up1", "up2", "depth", "rep", "size", "leaf", "saved"), paths, ["leaf", "saved"], local)
    at_end = convs.where("length > 0").select("conv", F.col("length").alias("pos")).join(paths.select("conv", "pos", *key), ["conv", "pos"])
    hashes = ends(durable(at_end.select(*key, "conv"), "ends"))
    none = F.sha2(F.lit(b""), 256)
    whole = durable(full.join(sums, key).join(hashes, key, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none)), "sums")
    first = whole.where("depth = 1").agg(F.count(F.lit(1)).alias("children"), F.sum("sum_leaf").alias("leaves"), F.sum("sum_saved").alias("saved")).first()
    turnless = ends(convs.where("length = 0").select(zero.alias("key1"), zero.alias("key2"), "conv")).first()
    top = spark.range(1 if root.n_convs else 0).select(
        F.lit(root.rep).cast("long").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(root.n_convs).cast("long").alias("n_convs"), F.lit(first.children).cast("long").alias("n_children"),
        F.lit(max(first.leaves or 0, 1)).cast("long").alias("n_leaves"), F.lit(first.saved or 0).cast("long").alias("saved_tokens"),
        F.lit(turnless.ends_sha256 if turnless else hashlib.sha256().hexdigest()).alias("ends_sha256"))
    above = nodes.select(F.col("key1").alias("up1"), F.col("key2").alias("up2"), F.col("rep").alias("parent_conv_id"))
    smallest = F.lit(root.rep).cast("long")
    rest = whole.join(above, ["up1", "up2"], "left").select(
        F.col("rep").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.coalesce("parent_conv_id", smallest).alias("parent_conv_id"),
        "n_convs", F.col("n_children").cast("long").alias("n_children"), F.col("sum_leaf").alias("n_leaves"), F.col("sum_saved").alias("saved_tokens"), "ends_sha256")
    return top.union(rest)
