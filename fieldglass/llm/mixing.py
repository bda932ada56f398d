"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is a stream of words: its documents, one after the other. The stream is cut
into blocks of ``block_words`` words. A source's target is turned into an exact number of
blocks, its quota; above one epoch, blocks are taken again. A tree splits the vector of
quotas among the output shards: each node deals a random half of its blocks to each child,
and how many of them come from which source is drawn from the multivariate hypergeometric
distribution, so the children's quotas add up to the parent's exactly. A shard then takes
the next blocks of each source in a permuted order; ranges of shards do not overlap, and
rows are shuffled inside a shard only, by a sort on a hash.

All of it is DataFrame work. Only ids and sizes are shuffled, never texts. A hot source is
numbered in hash slots of its documents, which are joined to their sums. The draws depend on ids,
sizes and the seed alone, so reruns agree.

Defined results for odd input: null or empty texts have size 0 and are never taken; a null
source is a source of its own, last in order; repeated rows and repeated or null ids are
documents of their own; a table without words has targets of 0; an empty table gives an
empty mix. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from ..session import scratch_dir
from .graph import kept_table
from .native import words

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
BLOCK_WORDS = 128
SHARDS = 16
#: Slots of documents in which a source is numbered.
SLOTS = 4096
#: Primes for up to 2^31 - 2 blocks of a source and for more (fixed values, 2^31 - 1 and 2^61 - 1).
PRIME, LARGE_PRIME = 2147483647, 2305843009213693951


def sizes(docs: DataFrame) -> DataFrame:
    """Row id, doc_id, source and number of words of every document, kept in a table."""
    spark = docs.sparkSession
    path = scratch_dir(spark, "mix-sizes")
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "source",
        F.size(words(F.col("text"))).cast("long").alias("size"),
        F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("place"),
    ).write.parquet(path)
    return spark.read.parquet(path).withColumn("box", F.struct("source"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """One row per source: weight, size and target in words.

    Filling water into vessels: with sources ordered by how much they can hold per unit
    of weight, those before the level are full, and the rest share what is left.
    """
    # one row per source from here on, so these windows see as many rows as there are sources
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    sources = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.get(kinds, (F.row_number().over(by_name) - 1) % len(weights)))
        .withColumn("room", F.col("source_size") * F.lit(float(most)))
    )
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.col("total") - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / (
        F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    leveled = (
        sources.withColumns({
            "total": F.sum("source_size").over(whole).cast("double"), "all_weight": F.sum("weight").over(whole),
        })
        .withColumn("level", level)
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("room"))
        .withColumn("first_level", F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(whole)["level"])
    )
    return leveled.select(
        "source", "weight", "source_size",
        F.coalesce(F.least(F.col("room"), F.col("first_level") * F.col("weight")), F.col("room")).alias("target"),
    )


def quotas(target_rows: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """Blocks of every source, its quota of blocks, and the shift of its permutation."""
    n = F.ceil(F.col("source_size") / block_words)
    full = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    rest = F.round((F.col("target") - full * F.col("source_size")) / block_words)
    return (
        target_rows.withColumns({"n_blocks": n.cast("long"), "epochs": full.cast("long")})
        .withColumn("extra", F.least(rest.cast("long"), F.col("n_blocks")))
        .withColumn("quota", F.col("epochs") * F.col("n_blocks") + F.col("extra"))
        .withColumn("shift", F.lit(seed * 7919 + 12345).cast("long"))
        .withColumn("box", F.struct("source"))
    )


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, exact values below 2; error under 1e-9 from 8 on."""
    x = n + F.lit(8.0)  # shift up, then divide the added factors out again
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x)
    added = F.log((n + 1) * (n + 2) * (n + 3) * (n + 4)) + F.log((n + 5) * (n + 6) * (n + 7) * (n + 8))
    return series - added


def hypergeometric(good: Column, total: Column, draws: Column, u: Column) -> Column:
    """Number of good ones among ``draws`` of ``total``, by inverting the distribution at u.

    Values are visited outwards from the mode, so the work is a few standard deviations.
    """

    def body(p: Column) -> Column:
        good, total, draws, u, mode = p["g"], p["t"], p["d"], p["u"], p["m"]
        low, high = F.greatest(F.lit(0.0), draws + good - total), F.least(draws, good)
        choose = lambda a, b: _log_factorial(a) - _log_factorial(b) - _log_factorial(a - b)
        peak = F.exp(choose(good, mode) + choose(total - good, draws - mode) - choose(total, draws))
        spread = F.sqrt(draws * (good / total) * (1 - good / total) * (total - draws) / F.greatest(total - 1, F.lit(1.0)))
        reach = F.least(F.ceil(9 * spread) + 9, F.greatest(mode - low, high - mode)).cast("int")
        start = F.struct(
            (u - peak).alias("left"), peak.alias("up"), peak.alias("down"),
            F.when(u < peak, mode).alias("found"),
        )

        def step(s: Column, i: Column) -> Column:
            a, b = mode + i, mode - i
            up = F.when(a <= high, s["up"] * (good - a + 1) * (draws - a + 1) / (a * (total - good - draws + a))).otherwise(0.0)
            down = F.when(b >= low, s["down"] * (b + 1) * (total - good - draws + b + 1) / ((good - b) * (draws - b))).otherwise(0.0)
            return let(F.struct(up.alias("up"), down.alias("down")), lambda p: F.struct(
                (s["left"] - p["up"] - p["down"]).alias("left"), p["up"].alias("up"), p["down"].alias("down"),
                F.coalesce(
                    s["found"],
                    F.when((a <= high) & (s["left"] < p["up"]), a),
                    F.when((b >= low) & (s["left"] < p["up"] + p["down"]), b),
                ).alias("found"),
            ))

        steps = F.when(reach >= 1, F.transform(F.sequence(F.lit(1), F.greatest(reach, F.lit(1))), lambda i: i.cast("double")))
        walked = F.aggregate(F.coalesce(steps, F.array().cast("array<double>")), start, step)
        return F.coalesce(walked["found"], mode)

    known = (good <= 0) | (draws <= 0) | (total <= 0)
    share = (good.cast("double") + 1) / (total.cast("double") + 2)
    mode = F.least(F.floor((draws.cast("double") + 1) * share).cast("double"), good.cast("double"), draws.cast("double"))
    packed = F.struct(
        good.cast("double").alias("g"), total.cast("double").alias("t"), draws.cast("double").alias("d"),
        u.alias("u"), F.greatest(mode, (draws + good - total).cast("double"), F.lit(0.0)).alias("m"),
    )
    return F.when(known, F.lit(0).cast("long")).otherwise(let(packed, body).cast("long"))


def _unit(*parts: Column) -> Column:
    """Number in (0, 1) decided by the parts."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 50)) + 0.5) / float(1 << 50)


def split_tree(quota_rows: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """Blocks of every source in every shard: (source, shard, from, upto) draw numbers.

    Nodes hold the number of shards below them; a node's quotas are one array, one entry
    per source. The sources are dealt one after the other, each from what is left.
    """
    width = 1 << max(0, math.ceil(math.log2(max(1, shards))))
    entry = F.struct("source", F.col("quota").alias("q"))
    nodes = quota_rows.agg(
        F.array_sort(F.collect_list(entry)).alias("qs")
    ).select(F.lit(0).cast("long").alias("node"), F.lit(width).alias("w"), "qs")
    while width > 1:
        width //= 2
        below = lambda side, w=width: F.greatest(F.lit(0), F.least(F.lit(w), F.lit(shards) - (F.col("node") * 2 + side) * w))
        total = F.aggregate("qs", F.lit(0).cast("long"), lambda n, e: n + e["q"])
        share = F.floor(total * below(0) / F.greatest(below(0) + below(1), F.lit(1))).cast("long")

        def deal(s: Column, e: Column) -> Column:
            u = _unit(F.lit(seed), F.lit(width), F.col("node"), F.coalesce(e["source"], F.lit("\0")))
            return let(hypergeometric(e["q"], s["rest"], s["draws"], u), lambda k: F.struct(
                (s["rest"] - e["q"]).alias("rest"), (s["draws"] - k).alias("draws"),
                F.concat(s["out"], F.array(F.struct(e["source"].alias("source"), e["q"].alias("q"), k.alias("k")))).alias("out"),
            ))

        empty = F.array().cast("array<struct<source:string,q:bigint,k:bigint>>")
        dealt = nodes.withColumns({"total": total, "draws": share}).withColumn(
            "dealt", F.aggregate("qs", F.struct(F.col("total").alias("rest"), F.col("draws").alias("draws"), empty.alias("out")), deal)["out"]
        )
        nodes = dealt.select("node", "dealt", F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).select(
            (F.col("node") * 2 + F.col("side")).alias("node"), F.lit(width).alias("w"),
            F.transform("dealt", lambda e: F.struct(
                e["source"].alias("source"),
                F.when(F.col("side") == 0, e["k"]).otherwise(e["q"] - e["k"]).alias("q"),
            )).alias("qs"),
        )
        nodes = kept_table(nodes, "tree")  # a row per node; else every level is planned inside the next
    leaves = nodes.filter(F.col("node") < shards).select(F.col("node").alias("shard"), F.inline("qs"))
    upto = F.sum("q").over(Window.partitionBy("source").orderBy("shard"))
    return leaves.withColumn("upto", upto).select("source", "shard", (F.col("upto") - F.col("q")).alias("from"), "upto")


def _streams(sized: DataFrame) -> DataFrame:
    """Words of the source that come before each document, counted slot by slot."""
    slotted = sized.withColumn("slot", F.col("place") % SLOTS)
    sums = slotted.groupBy("box", "slot").agg(F.sum("size").alias("slot_words"))
    earlier = Window.partitionBy("box").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("box", "slot", F.coalesce(F.sum("slot_words").over(earlier), F.lit(0)).alias("slot_from"))
    inside = Window.partitionBy("box", "slot").orderBy("place", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    return slotted.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["box", "slot"]).withColumn(
        "from", F.col("slot_from") + F.col("inside")
    )


def permuted(block: Column, n: Column, shift: Column) -> Column:
    """Place of a block in the order of drawing, a permutation of 0..n-1.

    The factor is a prime that does not divide n. Below 2^31 blocks the product fits a
    bigint; above, a larger prime is used and multiplied in 38 digits.
    """
    wide = lambda c: c.cast("decimal(19,0)")
    large = (wide(block) * wide(F.lit(LARGE_PRIME) % n) + shift) % wide(n)
    return F.when(n <= PRIME - 1, F.pmod(block * (F.lit(PRIME) % n) + shift, n)).otherwise(large.cast("long"))


def pieces(sized: DataFrame, quota_rows: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Every document cut at the block borders of its source: (row, block, start, words, draw...)."""
    streamed = _streams(sized.filter("size > 0")).join(
        quota_rows.select("box", "n_blocks", "epochs", "extra", "quota", "shift"), "box"
    )
    first, last = F.floor(F.col("from") / block_words), F.floor((F.col("from") + F.col("size") - 1) / block_words)
    cut = streamed.withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("block") * block_words, F.col("from"))
    end = F.least((F.col("block") + 1) * block_words, F.col("from") + F.col("size"))
    turn = permuted(F.col("block"), F.col("n_blocks"), F.col("shift"))
    return cut.withColumns({
        "start": begin - F.col("from"), "words": end - begin, "turn": turn,
        "copies": F.col("epochs") + (turn < F.col("extra")).cast("long"),
    })


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, shards: int = SHARDS,
    block_words: int = BLOCK_WORDS, seed: int = 0,
) -> DataFrame:
    """The mix: one row per taken piece, shuffled inside its shard.

    Columns: shard, doc_id, source, start and words (the range of the document's words),
    epoch, and ``sort`` by which a shard is ordered.
    """
    sized = sizes(docs)
    # a row per source; written, so that its windows are planned once
    quota_rows = kept_table(quotas(targets(sized, weights), block_words, seed), "quotas")
    return _shuffled(_placed(pieces(sized, quota_rows, block_words), quota_rows, shards, seed), seed)


def _placed(cut: DataFrame, quota_rows: DataFrame, shards: int, seed: int) -> DataFrame:
    tree = split_tree(quota_rows, shards, seed).select(F.struct("source").alias("box"), "shard", "from", "upto")
    ranges = tree.filter(F.col("upto") > F.col("from")).groupBy("box").agg(
        F.array_sort(F.collect_list(F.struct("from", "upto", "shard"))).alias("ranges")
    )
    drawn = cut.filter("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    number = F.col("epoch") * F.col("n_blocks") + F.col("turn")
    return drawn.withColumn("draw", number).drop("from").join(ranges, "box").withColumn(
        "shard",
        F.get(F.filter("ranges", lambda r: (r["from"] <= F.col("draw")) & (F.col("draw") < r["upto"])), F.lit(0))["shard"],
    ).filter(F.col("shard").isNotNull())  # what no shard has drawn is not in the mix


def _shuffled(placed: DataFrame, seed: int) -> DataFrame:
    return (
        placed.select(
            "shard", "doc_id", "source", F.col("start").cast("long").alias("start"), F.col("words").cast("long").alias("words"),
            "epoch", F.xxhash64(F.lit(seed), "source", "draw").alias("sort"), "row",
        )
        .repartition("shard", F.pmod("sort", F.lit(64)))
        .sortWithinPartitions("shard", "sort", "row", "start")
    )


def taken(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, shards: int = SHARDS,
    block_words: int = BLOCK_WORDS, seed: int = 0,
) -> DataFrame:
    """One row per document: size, size and target of its source, and words the mix takes.

    The counts come from the placed pieces of the mix. ``shards`` is the number of output shards that
    take a piece of the document.
    """
    sized = sizes(docs)
    # a row per source; written, so that its windows are planned once
    quota_rows = kept_table(quotas(targets(sized, weights), block_words, seed), "quotas")
    placed = _placed(pieces(sized, quota_rows, block_words), quota_rows, shards, seed)
    sums = placed.groupBy("row").agg(F.sum("words").cast("long").alias("taken"), F.countDistinct("shard").alias("n_shards"))
    return (
        sized.join(quota_rows.select("box", "source_size", "target"), "box")
        .join(sums, "row", "left")
        .select(
            "doc_id", "source", "size", "source_size", "target",
            F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), F.coalesce("n_shards", F.lit(0).cast("long")).alias("n_shards"),
        )
    )
