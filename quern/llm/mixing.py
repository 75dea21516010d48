"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame operations only.

Each source is dealt into blocks by a hash of doc_id. A source's target says how many whole passes over its blocks the mix takes and
how many words of one more pass: further blocks in a permuted order, then part of one block, its rows in hash order, and
one row more whose size is nearest to what is missing. Every block taken in
a pass is one unit of the source's quota. The tree splits the quotas of all sources among output shards: at each node the units are drawn
into halves without replacement, so that the halves' quotas are multivariate hypergeometric and add up exactly. A shard then gets the
next blocks of each source's permuted order, disjoint from other shards', and its rows are put in hash order.

Targets: the i-th source by code point (null last) weighs 5, 2, 1, repeating; sources share the words of all rows by weight, but none
above three times its own, the excess going to the others by weight.

Defined results: a null or empty text has size 0; null is a source of its own; rows that share a doc_id, or have none, share their hash
and so are taken together; an empty table gives no rows; other columns pass through `mixed` as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.llm.shared import materialize

WEIGHTS, PASSES = (5, 2, 1), 3
#: Finer parts of a block that is cut; output shards (a power of two) are so many at least, and so many that one has about so many words.
PARTS, SHARDS, SHARD_WORDS = 4096, 32, 1 << 25


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *(F.col(c) if isinstance(c, str) else c for c in columns))


def _sized(docs: DataFrame, seed: int, keep: bool) -> DataFrame:
    row = [F.struct("*").alias("row")] if keep else []
    key = F.xxhash64(F.lit(seed), F.col("doc_id")).alias("key")
    return docs.select(*row, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), word_count(F.col("text")).alias("size"), key)


def _dealt(sized: DataFrame, shards: int) -> DataFrame:
    """Rows with their block, of two for each shard, and the part of it; the bits that tell them overlap for no number of shards under 2**29."""
    return sized.withColumns({"block": F.pmod("key", F.lit(2 * shards)).cast("int"), "part": F.pmod(F.shiftrightunsigned("key", 30), F.lit(PARTS)).cast("int")})


def shard_count(words: int) -> int:
    """A power of two, so that a shard of the mix stays about as large however large the table is."""
    return max(SHARDS, 1 << max(0, -(-words // SHARD_WORDS) - 1).bit_length())


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from sizes(source, source_size), one row per source. The common level that uncapped sources get per weight is found by filling the sources in order of the level at which each is full."""
    weights = F.array(*map(F.lit, WEIGHTS))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", F.element_at(weights, (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1))
    w = w.withColumns({"most": PASSES * F.col("source_size"), "full_at": PASSES * F.col("source_size") / F.col("weight"), "all": F.sum("source_size").over(Window.partitionBy())})
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(0, Window.unboundedFollowing)
    w = w.withColumn("level", (F.col("all") - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(rest))
    fits = F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", F.col("source").isNull().alias("last"), "source", "level"))
    w = w.withColumn("fill", F.min(fits).over(Window.partitionBy())["level"])
    return w.select("source", "source_size", F.least(F.col("most").cast("double"), F.col("fill") * F.col("weight")).alias("target"))


def _same(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """left joined with right on keys, of which source may be null; right's key columns go."""
    other = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [left[k].eqNullSafe(other[f"_{k}"]) if k == "source" else left[k] == other[f"_{k}"] for k in keys]
    return left.join(other, on, how).drop(*(f"_{k}" for k in keys))


def _before_cut() -> Column:
    return F.coalesce((F.col("part") < F.col("cut_part")) | (F.col("part") == F.col("cut_part")) & (F.col("key") <= F.col("cut_key")), F.lit(False))


def plan(sized: DataFrame, seed: int, shards: int) -> DataFrame:
    """One row per source and block: source_size, target, the placements (copy, shard, cut) of the block, and where its cut falls: rows of an earlier part, or of that part with a key up to cut_key, are before it; rows of fill_key are taken with them."""
    parts = sized.groupBy("source", "block", "part").agg(F.sum("size").alias("size"))
    blocks = parts.groupBy("source", "block").agg(F.sum("size").alias("size"))
    goal = targets(blocks.groupBy("source").agg(F.sum("size").alias("source_size")))
    goal = goal.withColumn("passes", F.when(F.col("source_size") > 0, F.least(F.lit(PASSES), F.floor(F.col("target") / F.col("source_size") + 1e-12))).otherwise(0).cast("int"))
    goal = goal.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")) * (F.col("passes") < PASSES).cast("int"))
    in_source = Window.partitionBy("source").orderBy(_hash(seed, "source", "block"), "block")
    blocks = _same(blocks, goal, "source").withColumn("upto", F.sum("size").over(in_source.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = blocks.withColumn("more", F.when(F.col("upto") <= F.col("rest"), F.lit("whole")).when(F.col("upto") - F.col("size") < F.col("rest"), F.lit("cut")))
    blocks = materialize(blocks, "blocks")

    # the cut block: whole parts up to the cut, then keys of one part; the gap is what is still missing
    cut = blocks.where("more = 'cut'").select("source", "block", (F.col("rest") - F.col("upto") + F.col("size")).alias("rest"))
    by_part = Window.partitionBy("source", "block").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    cut_part = _same(parts, cut, "source", "block").withColumn("upto", F.sum("size").over(by_part))
    cut_part = cut_part.where("upto > rest AND upto - size <= rest").select("source", "block", F.col("part").alias("cut_part"), (F.col("rest") - F.col("upto") + F.col("size")).alias("rest"))
    keys = _same(sized, cut_part.withColumn("part", F.col("cut_part")), "source", "block", "part").groupBy("source", "block", "rest", "key").agg(F.sum("size").alias("size"))
    by_key = Window.partitionBy("source", "block").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    keys = keys.withColumn("upto", F.sum("size").over(by_key)).where("upto <= rest")
    cut_key = keys.groupBy("source", "block").agg(F.max("key").alias("cut_key"), F.max("upto").alias("upto"))
    cuts = _same(cut_part, cut_key, "source", "block", how="left")
    cuts = materialize(cuts.select("source", "block", "cut_part", "cut_key", (F.col("rest") - F.coalesce("upto", F.lit(0))).alias("gap")), "cuts")

    # of the rows that the last pass has not taken, the one whose size is nearest to the gap fills it, if that is nearer than leaving it
    left = _same(blocks.where("more IS NULL OR more = 'cut'").select("source", "block"), cuts.select("source", "gap"), "source")
    left = _same(left, cuts.drop("gap"), "source", "block", how="left")
    left = _same(sized, left, "source", "block").where(~_before_cut()).groupBy("source", "block", "key", "gap").agg(F.sum("size").alias("size"))
    nearest = F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "key", "block")).alias("n")
    fill = left.where("size > 0 AND size < 2 * gap").groupBy("source").agg(nearest).select("source", "n.block", F.col("n.key").alias("fill_key"))
    cuts = materialize(_same(_same(blocks.select("source", "block"), cuts.drop("gap"), "source", "block", how="left"), fill, "source", "block", how="left"), "fills")
    blocks = _same(blocks, cuts, "source", "block").withColumn("more", F.coalesce("more", F.when(F.col("fill_key").isNotNull(), F.lit("cut"))))

    # units of the quotas: a block for each pass, and one for what is taken of it in the last
    units = blocks.select("source", "block", F.posexplode(F.expr("array_repeat(more = 'cut' AND more IS NOT NULL, passes + int(more IS NOT NULL))")).alias("copy", "cut"), "passes")
    units = units.withColumn("cut", F.col("cut") & (F.col("copy") == F.col("passes"))).drop("passes")
    order = Window.partitionBy("source").orderBy(_hash(seed + 1, "source", "block", "copy"), "block", "copy")
    units = materialize(units.withColumn("rank", F.row_number().over(order)), "units")
    shard_of = split_quotas(units.select("source", "rank"), seed + 2, shards)
    placed = _same(units, shard_of, "source", "rank").groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard", "cut"))).alias("placements"))
    return _same(blocks.select("source", "block", "source_size", "target", "cut_part", "cut_key", "fill_key"), placed, "source", "block", how="left")


def split_quotas(units: DataFrame, seed: int, shards: int) -> DataFrame:
    """(source, rank, shard) from units(source, rank), ranks from 1 in each source. At every node the units are drawn into halves; then each source's shares, in shard order, are its ranks' ranges."""
    tree = units.select("source", F.col("rank").alias("unit"), F.lit(0).alias("node"))
    for level in range(shards.bit_length() - 1):
        node = Window.partitionBy("node")
        drawn = F.row_number().over(node.orderBy(_hash(seed, F.lit(level), "source", "unit"), F.col("source").asc_nulls_last(), "unit"))
        # an odd unit goes to either half by the node's hash
        half = F.floor((F.count("*").over(node) + F.pmod(_hash(seed, F.lit(level), "node"), F.lit(2))) / 2)
        tree = tree.withColumn("node", 2 * F.col("node") + (drawn > half).cast("int"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy("node", "unit"))
    return tree.select("source", rank.alias("rank"), F.col("node").alias("shard"))


def _placed(docs: DataFrame, seed: int, shards: int | None, keep: bool) -> tuple[DataFrame, int]:
    """Each row with its size, its source's size and target, and its placements; and the number of shards."""
    sized = materialize(_sized(docs, seed, keep=False), "sizes")
    shards = shards or shard_count(sized.agg(F.sum("size")).first()[0] or 0)
    rows = _dealt(_sized(docs, seed, keep=True) if keep else sized, shards)
    sized = _dealt(sized, shards)
    out = _same(rows, materialize(plan(sized, seed, shards), "mix"), "source", "block", how="left")
    in_part = _before_cut() | F.coalesce(F.col("key") == F.col("fill_key"), F.lit(False))
    placements = F.filter(F.coalesce("placements", F.array().cast("array<struct<copy:int,shard:int,cut:boolean>>")), lambda p: ~p["cut"] | in_part)
    return out.withColumn("placements", placements), shards


def mix_plan(docs: DataFrame, seed: int = 7, shards: int | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards) of every row: the words that the mix takes of it, and the shards that they go to. shards: a power of two, by default from the words of all rows."""
    placed, _ = _placed(docs, seed, shards, keep=False)
    return placed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("placements")).alias("taken"), F.transform("placements", lambda p: p["shard"]).alias("shards"))


def mixed(docs: DataFrame, seed: int = 7, shards: int | None = None) -> DataFrame:
    """The mix itself: docs' columns, a row for each copy taken, a partition for each shard, its rows in hash order."""
    placed, shards = _placed(docs, seed, shards, keep=True)
    copies = placed.select("row", "key", F.explode("placements").alias("place"))
    copies = copies.withColumns({"shard": F.col("place.shard"), "at": F.xxhash64(F.lit(seed), "place.shard", "key", "place.copy")})
    return copies.repartitionById(shards, "shard").sortWithinPartitions("shard", "at").select("row.*")
