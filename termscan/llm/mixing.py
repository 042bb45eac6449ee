"""Mixing sources to target weights, all in built-in functions.

Each source's documents are laid end to end and cut into blocks of ``block_words`` words. The mix is a row
of slots, cut into output shards. How many slots of a shard each source gets is drawn from an urn that
holds as many lots of each source as its target asks for: without putting back, so the counts are
multinomial given the totals, which meet the targets and the bound of ``MOST`` rounds exactly. The draws of a
source are counted through all shards, and its n-th one is sent through a pseudorandom permutation of the
source's blocks, another one for each round, so that no block is taken twice before all are taken
once. Slots and blocks are joined by (source, block).

Permutations are Feistel networks on pairs of remainders, keyed by seed, source and round; a number that falls
outside the range is sent through again. Nothing is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termscan.llm.common import durable

WEIGHTS = (5.0, 2.0, 1.0)
#: A source gives at most so many times its words.
MOST = 3.0
BLOCK_WORDS = 64
SHARD_SLOTS = 1024
#: Documents of one source are placed in so many runs, so that no task orders a whole source.
RUNS = 1024
#: Rows of the table of sources up to which it is broadcast.
SMALL = 100_000
WORD = r"[^\x20\x09-\x0D]+"
#: A word with the white space behind it, the first one also with what is before it.
PIECES = r"(?:^[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
#: Key of the permutations, their rounds, and how often a number outside the range is sent through again.
SEED, ROUNDS, AGAIN = 20261201, 4, 16
#: Shards that are counted through together.
LOT = 4096


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """The place of ``x`` in a keyed pseudorandom permutation of 0 .. n - 1.

    ``x`` is seen as a pair of remainders of a and b with a b >= n and a b - n < a, so few numbers fall
    outside. From a number inside, no number outside comes twice before one inside does: up to a = ``AGAIN``
    they always end in time, beyond that all but surely (one in 16^16 for the least a), else an error is raised.
    """
    a = F.ceil(F.sqrt(n.cast("double")) - 1e-9).cast("long")
    b = F.ceil(n / a).cast("long")

    def once(y: Column) -> Column:
        left, right = F.floor(y / b).cast("long"), F.pmod(y, b)
        for k in range(ROUNDS):
            if k % 2:
                right = F.pmod(right + F.pmod(F.xxhash64(F.lit(SEED), F.lit(k), *key, left), b), b)
            else:
                left = F.pmod(left + F.pmod(F.xxhash64(F.lit(SEED), F.lit(k), *key, right), a), a)
        return left * b + right

    first = once(x)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(AGAIN)), first, lambda y, _: F.when(y < n, y).otherwise(once(y)))
    walked = F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a place of a permutation was not found")).cast("long"))
    return F.when(first < n, first).otherwise(walked)


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(row, doc, version, source, size)``: a number of each row of its own, a hash of its text, its words; a null text has none.

    The numbers are lasting only once the rows are written down.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = [F.col("__row") if "__row" in docs.columns else F.monotonically_increasing_id()]
    return docs.select(
        own[0].alias("row"), F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("version"),
        F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))


def targets(sized: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per source: ``source, named, source_size, target, n_blocks, n_slots, first_slot``.

    Sources in order of code points, null last, weigh ``WEIGHTS``, repeating. A source's target is its
    weight times a level that all uncapped sources share, or ``MOST`` times its size if that is less:
    where sharing the excess by weight again and again ends. Only one row per source is ordered here.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    ranked = totals.withColumn("weight", F.get(weights, (F.row_number().over(order) - 1) % len(WEIGHTS)))
    ranked = ranked.withColumn("cap", F.col("source_size") * MOST)
    # capped sources come first by cap / weight; the level follows from those not capped
    below = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = below.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # the level rises while the next source is capped and falls after, so the highest is the one that holds
    found = ranked.withColumn("level", level).withColumn("level", F.max("level").over(every))
    found = found.withColumn("target", F.least("cap", F.col("weight") * F.col("level")))
    found = found.withColumn("n_blocks", F.ceil(F.col("source_size") / block_words))
    slots = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("n_blocks") / F.col("source_size"))).otherwise(0)
    found = found.withColumn("n_slots", F.least(slots.cast("long"), (F.col("n_blocks") * int(MOST)).cast("long")))
    running = F.sum("n_slots").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return found.select(
        "source", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("named"),
        "source_size", "target", "n_blocks", "n_slots", (running - F.col("n_slots")).alias("first_slot"),
        F.sum("n_slots").over(every).alias("all_slots"),
    )


def _named(source: str = "source") -> Column:
    return F.struct(F.col(source).isNull().alias("none"), F.coalesce(F.col(source), F.lit("")).alias("name"))


def pieces(sized: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(named, block, row, size, lo, hi)``: the words ``lo .. hi - 1`` of a document that lie in a block."""
    run = F.pmod(F.coalesce("doc", F.lit(-1)), F.lit(RUNS))
    placed = sized.withColumn("named", _named()).withColumn("run", run)
    inside = Window.partitionBy("named", "run").orderBy("doc", "size", "version", "row").rowsBetween(Window.unboundedPreceding, -1)
    within = placed.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    lengths = placed.groupBy("named", "run").agg(F.sum("size").alias("length"))
    ahead = Window.partitionBy("named").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    lengths = lengths.select("named", "run", F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"))
    at = within.join(lengths, ["named", "run"]).where("size > 0").withColumn("start", F.col("start") + F.col("offset"))
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    each = at.withColumn("block", F.explode(F.sequence(first, last)))
    edge = F.col("block") * block_words - F.col("start")
    return each.select(
        "named", "block", "row", "size", F.greatest(edge, F.lit(0)).cast("long").alias("lo"),
        F.least(edge + block_words, F.col("size")).cast("long").alias("hi"),
    )


def shard_counts(shares: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``(named, shard, count)``: how many slots of each shard a source gets.

    Every lot of the urn is sent to a place of the mix; sources lie in it one after another.
    """
    n = F.col("n_slots")
    lots = shares.where(n > 0).select("named", "first_slot", "n_slots", "all_slots", F.explode(
        F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / shard_slots))).alias("part"))
    lots = lots.repartition("named", "part")  # a source is one row until here
    first = F.col("part") * shard_slots
    lots = lots.withColumn("k", F.explode(F.sequence(first, F.least(first + shard_slots, n) - 1)))
    place = permuted(F.col("first_slot") + F.col("k"), F.col("all_slots"), F.lit("urn"))
    return lots.groupBy("named", F.floor(place / shard_slots).alias("shard")).agg(F.count(F.lit(1)).alias("count"))


def slots(shares: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``(named, block, shard, slot)``: which block each slot of the mix takes."""
    counts = durable(shard_counts(shares, shard_slots).withColumn("lot", F.floor(F.col("shard") / LOT)), "counts")
    before = Window.partitionBy("named", "lot").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("named").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    lots = counts.groupBy("named", "lot").agg(F.sum("count").alias("all"))
    lots = lots.select("named", "lot", F.coalesce(F.sum("all").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("shard").orderBy("named").rowsBetween(Window.unboundedPreceding, -1)
    drawn = counts.withColumns({"before": F.coalesce(F.sum("count").over(before), F.lit(0)), "start": F.coalesce(F.sum("count").over(inside), F.lit(0))})
    drawn = drawn.join(lots, ["named", "lot"]).join(shares.select("named", "n_blocks", "all_slots"), "named")
    # a row becomes as many as a shard has slots, so Spark must not put these short ones into few tasks
    drawn = drawn.repartition(int(shares.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard", "named")
    each = drawn.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
    draw, size = F.col("ahead") + F.col("before") + F.col("k"), F.col("n_blocks")
    width = F.least(F.lit(shard_slots).cast("long"), F.col("all_slots") - F.col("shard") * shard_slots)
    each = each.select("named", "n_blocks", "shard", width.alias("width"), (F.col("start") + F.col("k")).alias("at"),
                       F.floor(draw / size).alias("turn"), F.pmod(draw, size).alias("index"))
    block = permuted(F.col("index"), size, F.lit("block"), F.col("named.none"), F.col("named.name"), F.col("turn"))
    slot = permuted(F.col("at"), F.col("width"), F.lit("slot"), F.col("shard"))
    return each.select("named", block.alias("block"), "shard", slot.alias("slot"))


def taken(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for each row of ``docs``.

    ``taken`` counts the words the mix takes of the document, repeats included. Documents without words
    take 0; a source without words has target 0. Rows that repeat an id, or repeat altogether, are
    documents of their own. An empty table gives no rows.
    """
    sized = durable(sizes(docs), "sizes")  # the texts are read once
    shares = durable(targets(sized), "shares")
    times = slots(shares).groupBy("named", "block").agg(F.count(F.lit(1)).alias("times"))
    # the planner takes the drawn slots for small, as they come from a row per source: never broadcast them
    drawn = pieces(sized).join(times.hint("merge"), ["named", "block"]).groupBy("row").agg(
        F.sum((F.col("hi") - F.col("lo")) * F.col("times")).cast("long").alias("drawn"))
    told = shares.select("named", "source_size", "target")
    if shares.count() <= SMALL:
        told = F.broadcast(told)
    rows = sized.withColumn("named", _named()).join(drawn, "row", "left").join(told, "named")
    return rows.select(F.col("doc").alias("doc_id"), "size", "source_size", "target", F.coalesce("drawn", F.lit(0).cast("long")).alias("taken"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix itself: the columns of ``docs`` (but such named so) plus ``shard, slot``, one row per piece that a slot takes.

    ``text`` holds the piece as it stands in the document, white space behind its words included: a document's
    pieces put together are its text. ``n_chars`` is the piece's length if there is such a column; the
    other columns are the document's. Every row is a document of its own, whether its id is null, repeated or
    its whole row is; documents without words give no piece; an empty table gives no rows.
    """
    keyed = durable(docs.drop("shard", "slot").withColumn("__row", F.monotonically_increasing_id()), "mixed")
    sized = durable(sizes(keyed), "sizes")
    shares = durable(targets(sized, block_words), "shares")
    cut = pieces(sized, block_words).join(slots(shares, shard_slots).hint("merge"), ["named", "block"])
    takes = cut.groupBy(F.col("row").alias("__row")).agg(F.collect_list(F.struct("lo", "hi", "shard", "slot")).alias("__takes"))
    words = F.array(F.regexp_extract_all(F.col("text"), F.lit(PIECES), F.lit(0)))

    def piece(all_words: Column, t: Column) -> Column:
        own = F.slice(all_words, (t["lo"] + 1).cast("int"), (t["hi"] - t["lo"]).cast("int"))
        return F.struct(F.array_join(own, "").alias("text"), t["shard"].alias("shard"), t["slot"].alias("slot"))

    # the words are bound once, whatever the number of pieces
    each = keyed.join(takes.hint("merge"), "__row").withColumn(
        "__piece", F.explode(F.flatten(F.transform(words, lambda ws: F.transform("__takes", lambda t: piece(ws, t))))))
    each = each.withColumn("text", F.col("__piece.text"))
    if "n_chars" in docs.columns:
        each = each.withColumn("n_chars", F.length("text").cast("long"))
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    return each.select(*columns, F.col("__piece.shard").alias("shard"), F.col("__piece.slot").alias("slot"))
