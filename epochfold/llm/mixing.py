"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents fall into blocks by a hash of their id. Water filling turns weights into a target per source, and
the target into an exact quota of blocks: whole passes over the source, then blocks in permuted order up to the target,
the last of them in part. A binary tree over the output shards splits the quotas: a node holds the number of blocks of
each source, and its left half draws its share of them without replacement (one hypergeometric draw a source, each
given what the sources before it took). Leaves own disjoint runs of each source's permuted blocks; rows are then
shuffled inside their shard alone.

Only block and source statistics are shuffled, not texts. A source may hold any share of the rows: its blocks are
many, sums are made before the shuffle, and blocks are put in order by piles, so nothing gathers a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochfold.llm import common as C

WEIGHTS = (5, 2, 1)
#: Targets stop at so many times their source's size, and so do documents.
MOST = 3
#: Documents in a block, on average.
BLOCK_DOCS = 128
#: Blocks in an output shard, on average, and the most shards that are planned.
SHARD_BLOCKS, MOST_SHARDS = 64, 1 << 16
#: Bits of the permuted order that part a source's blocks into piles.
PILES = 8
#: Columns that a plan adds.
ADDED = ("size", "source_size", "target", "placements")
#: Up to so many sources, their table is broadcast.
FEW_SOURCES = 10_000


def source_targets(stats: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """stats(source, source_size) with target: weights in turn to sources by code point, null last; capped shares.

    The share of capped sources goes to the others by weight until none is above. Sources sorted by cap over weight are
    capped in that order, so the level is found by running sums over the sources, a row each.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    s = stats.select("*", w.alias("_w"), (F.col("source_size") * float(most)).alias("_cap"))
    every = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    to_here, whole = every.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.select(
        "*",
        F.coalesce(F.sum("_cap").over(to_here), F.lit(0.0)).alias("_capped"),
        F.coalesce(F.sum("_w").over(to_here), F.lit(0.0)).alias("_capped_w"),
        F.sum("_w").over(whole).alias("_all_w"),
        F.sum(F.col("source_size").cast("double")).over(whole).alias("_all"),
    )
    level = F.greatest(F.lit(0.0), F.col("_all") - F.col("_capped")) / (F.col("_all_w") - F.col("_capped_w"))
    # the first source that isn't full at its level ends the run of capped ones; from there the level holds
    s = s.withColumn("_level", F.when(level * F.col("_w") <= F.col("_cap"), level))
    s = s.withColumn("_final", F.first("_level", ignorenulls=True).over(every.rowsBetween(Window.unboundedPreceding, 0)))
    return s.select(*stats.columns, F.coalesce(F.least(F.col("_cap"), F.col("_final") * F.col("_w")), F.col("_cap")).alias("target"))


def _log_factorial(n: Column) -> Column:
    """log(n!) by Stirling's series, shifted by 8 so that small n are exact to about 1e-12."""
    x = n.cast("double") + 9.0
    low = F.lit(0.0)
    for i in range(1, 9):
        low = low + F.log(n.cast("double") + float(i))
    series = 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + series - low


def _log_choose(n: Column, k: Column) -> Column:
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of drawn items out of total are among the marked ones, by inverting the distribution at u in [0, 1).

    The sum runs over the values within 12 standard deviations of the mean; all others weigh under 1e-30 together.
    """
    lo, hi = F.greatest(F.lit(0), drawn + marked - total), F.least(drawn, marked)
    t = F.greatest(total.cast("double"), F.lit(1.0))
    mean = drawn * (marked / t)
    sd = F.sqrt(F.greatest(F.lit(0.0), mean * (1 - marked / t) * (1 - drawn / t)))
    a = F.greatest(lo, F.floor(mean - 12 * sd - 12)).cast("long")
    b = F.least(hi, F.ceil(mean + 12 * sd + 12)).cast("long")

    def step(acc: Column, k: Column) -> Column:
        p = F.exp(_log_choose(marked, k) + _log_choose(total - marked, drawn - k) - _log_choose(total, drawn))
        return F.struct((acc["p"] + p).alias("p"), F.when(acc["p"] <= u, k).otherwise(acc["k"]).alias("k"))

    start = F.struct(F.lit(0.0).alias("p"), a.alias("k"))
    return F.when(a >= b, a).otherwise(F.aggregate(F.sequence(a, b), start, step, lambda acc: acc["k"]))


def _draw_at(level: int, seed: int):
    def draw(acc: Column, x: Column) -> Column:
        u = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("shard"), x["s"]), F.lit(1 << 52)).cast("double") / float(1 << 52)
        k = hypergeometric(acc["left"], x["n"], acc["draw"], u)
        return F.struct((acc["left"] - x["n"]).alias("left"), (acc["draw"] - k).alias("draw"), F.concat(acc["out"], F.array(k)).alias("out"))

    return draw


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """quotas(source, quota) split among shards: rows of (shard, source, from, to), runs of permuted blocks.

    A node is one row with the quota of every source; each level makes two rows of one.
    """
    node = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col("quota").cast("long").alias("q"), F.col("_sid").alias("s")))).alias("_at"))
    node = node.select(F.transform("_at", lambda x: F.struct(x["s"].alias("s"), x["q"].alias("n"), F.lit(0).cast("long").alias("f"))).alias("_at"), F.lit(0).cast("long").alias("shard"))
    for level in range(max(0, math.ceil(math.log2(max(1, shards))))):
        total = F.aggregate("_at", F.lit(0).cast("long"), lambda a, x: a + x["n"])
        node = node.select("*", total.alias("_all"))

        start = F.struct(F.col("_all").alias("left"), F.ceil(F.col("_all") / 2).cast("long").alias("draw"), F.array().cast("array<bigint>").alias("out"))
        node = node.select("*", F.aggregate("_at", start, _draw_at(level, seed), lambda acc: acc["out"]).alias("_k"))
        left = F.zip_with("_at", "_k", lambda x, k: F.struct(x["s"].alias("s"), k.alias("n"), x["f"].alias("f")))
        right = F.zip_with("_at", "_k", lambda x, k: F.struct(x["s"].alias("s"), (x["n"] - k).alias("n"), (x["f"] + k).alias("f")))
        half = F.struct((F.col("shard") * 2).alias("shard"), left.alias("_at")), F.struct((F.col("shard") * 2 + 1).alias("shard"), right.alias("_at"))
        node = node.select(F.explode(F.array(*half)).alias("_n")).select("_n.*")
    runs = node.select("shard", F.explode("_at").alias("_x"))
    return runs.where("_x.n > 0").select("shard", F.col("_x.s").alias("_sid"), F.col("_x.f").alias("_from"), (F.col("_x.f") + F.col("_x.n")).alias("_to"))


def _row_hashes(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """docs with _h, a hash of its own for each row: of the id where ids are unique, else of id, text, source and a count.

    Equal rows are counted in two levels, inside the partitions of a stored copy and over these, so no task holds them all.
    """
    if C.unique_ids(docs, id_col):
        return docs.withColumn("_h", F.xxhash64(F.lit(seed), id_col))
    same = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(id_col).isNull(), F.col(text_col), F.col(source_col))
    rows = C.stash(docs.select("*", same.alias("_same"), F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")), "mix-rows")
    local = rows.select("_same", "_part", "_row", (F.row_number().over(Window.partitionBy("_same", "_part").orderBy("_row")) - 1).alias("_in"))
    parts = rows.groupBy("_same", "_part").agg(F.count("*").alias("_n"))
    before = parts.select("_same", "_part", (F.sum("_n").over(Window.partitionBy("_same").orderBy("_part")) - F.col("_n")).alias("_before"))
    turn = C.stash(local.join(before, ["_same", "_part"]).select("_row", (F.col("_in") + F.col("_before")).cast("long").alias("_turn")), "mix-turns")
    return rows.join(turn, "_row").withColumn("_h", F.xxhash64(F.lit(seed), "_same", "_turn")).drop("_row", "_same", "_part", "_turn")


def _in_order(blocks: DataFrame, seed: int) -> DataFrame:
    """blocks(_sid, _b, _words, ..) in a permuted order: _i, the place in it, _n blocks of the source, _before, the words before.

    Places are found in two levels, in PILES equal parts of the order's range and then over these, a row a source and part.
    """
    at = F.xxhash64(F.lit(seed), "_sid", "_b")
    blocks = blocks.select("*", at.alias("_o"), F.shiftright(at, 64 - PILES).alias("_pile"))
    piles = blocks.groupBy("_sid", "_pile").agg(F.count("*").alias("_pn"), F.sum("_words").alias("_pw"))
    along = Window.partitionBy("_sid").orderBy("_pile")
    piles = piles.select("_sid", "_pile", (F.sum("_pn").over(along) - F.col("_pn")).alias("_p0"), (F.sum("_pw").over(along) - F.col("_pw")).alias("_w0"), F.sum("_pn").over(Window.partitionBy("_sid")).alias("_n"))
    inside = Window.partitionBy("_sid", "_pile").orderBy("_o", "_b")
    blocks = blocks.select("*", (F.row_number().over(inside) - 1).alias("_in"), (F.sum("_words").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_words")).alias("_win"))
    out = blocks.join(piles, ["_sid", "_pile"])
    return out.select("*", (F.col("_p0") + F.col("_in")).cast("long").alias("_i"), (F.col("_w0") + F.col("_win")).alias("_before")).drop("_o", "_pile", "_p0", "_w0", "_in", "_win")


def plan_mix(docs: DataFrame, seed: int = 1, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block_docs: int = BLOCK_DOCS, id_col: str = "doc_id") -> DataFrame:
    """docs with size, source_size, target and placements: array<struct<shard, pass>>, one entry each time a row is taken.

    Defined cases: a null text or one without words has size 0 and is taken with its block, at no cost; a null source
    is a source of its own, sorted last; where ids are null or repeat, rows are told apart by text, source and a count
    of equal rows, so each is taken by itself; an empty table gives an empty result. docs' own columns of the added
    names are replaced, and nothing else of docs is changed, whatever its name.
    """
    # docs' columns get names that no helper column has
    inner = {c: f"doc{i}_" for i, c in enumerate(docs.columns)}
    own_id, text, source = inner[id_col], inner["text"], inner["source"]
    size = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(C.WORD)).cast("long")
    base = _row_hashes(docs.toDF(*inner.values()), seed, own_id, text, source).withColumn("size", size)
    sized = C.stash(base.select(F.col(source).alias("source"), "size", "_h"), "mix-sizes")

    stats = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    stats = source_targets(stats, weights, most)
    stats = stats.select("*", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).alias("_sid"), F.ceil(F.col("_docs") / block_docs).cast("long").alias("_blocks"))
    stats = C.stash(stats.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long")), "mix-sources")
    n_sources = stats.count()
    small = F.broadcast(stats) if n_sources <= FEW_SOURCES else stats

    keyed = sized.join(small, sized["source"].eqNullSafe(stats["source"])).drop(stats["source"])
    keyed = keyed.withColumn("_b", F.pmod("_h", F.greatest("_blocks", F.lit(1))))
    # blocks in permuted order, with the words before each
    blocks = keyed.groupBy("_sid", "_b").agg(F.sum("size").alias("_words"), F.first("_whole").alias("_whole"), F.first("target").alias("_target"), F.first("source_size").alias("_ss"))
    blocks = _in_order(blocks, seed + 1)
    rest = F.col("_target") - F.col("_whole") * F.col("_ss")
    blocks = blocks.select("*", (rest - F.col("_before")).alias("_room"))
    blocks = C.stash(blocks.withColumn("_take", F.when(F.col("_room") >= F.col("_words"), 2).when((F.col("_room") > 0) & (F.col("_words") > 0), 1).otherwise(0)), "mix-blocks")

    quotas = blocks.groupBy("_sid").agg((F.max("_n") * F.max("_whole") + F.sum((F.col("_take") > 0).cast("long"))).alias("quota"))
    n_blocks = quotas.agg(F.sum("quota")).first()[0] or 0
    shards = min(MOST_SHARDS, 1 << max(0, math.ceil(math.log2(max(1, n_blocks / SHARD_BLOCKS)))))
    runs = C.stash(splitting_tree(quotas, shards, seed + 2), "mix-runs")
    # each pass over a source takes its blocks in the same permuted order: copy number i + n * pass
    copies = blocks.select("_sid", "_b", "_take", "_room", "_i", "_n", F.explode(F.expr("sequence(0L, _whole - if(_take > 0, 0L, 1L))")).alias("pass")) if n_blocks else blocks.select("_sid", "_b", "_take", "_room", "_i", "_n", F.lit(0).cast("long").alias("pass")).limit(0)
    copies = copies.where(F.col("pass") >= 0).withColumn("_copy", F.col("_i") + F.col("_n") * F.col("pass"))
    # a run is found through the pages of copy numbers that it touches
    page = 64
    runs = runs.select("*", F.explode(F.expr(f"sequence(_from div {page}, (_to - 1) div {page})")).alias("_page"))
    placed = copies.withColumn("_page", F.expr(f"_copy div {page}")).join(runs, ["_sid", "_page"]).where("_copy >= _from AND _copy < _to")
    placed = placed.groupBy("_sid", "_b").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("_places"))

    # the block that meets the target is taken in part: documents in hashed order, as long as they fit
    part = blocks.where("_take = 1").select("_sid", "_b", "_room")
    inside = keyed.join(part, ["_sid", "_b"]).groupBy("_sid", "_b", "_room").agg(F.array_sort(F.collect_list(F.struct("_h", "size"))).alias("_docs_in"))

    def fit(acc: Column, x: Column) -> Column:
        ok = x["size"] <= acc["room"]
        return F.struct(F.when(ok, acc["room"] - x["size"]).otherwise(acc["room"]).alias("room"), F.when(ok, F.concat(acc["in"], F.array(x["_h"]))).otherwise(acc["in"]).alias("in"))

    start = F.struct(F.col("_room").alias("room"), F.array().cast("array<bigint>").alias("in"))
    chosen = inside.select("_sid", "_b", F.aggregate("_docs_in", start, fit, lambda a: a["in"]).alias("_in"))
    plan = C.stash(
        blocks.select("_sid", "_b", "_take", "_whole").join(placed, ["_sid", "_b"], "left").join(chosen, ["_sid", "_b"], "left"),
        "mix-plan",
    )

    s = stats.select(F.col("source").alias("_s"), "source_size", "target", "_sid", "_blocks")
    out = base.join(F.broadcast(s) if n_sources <= FEW_SOURCES else s, F.col(source).eqNullSafe(F.col("_s"))).withColumn("_b", F.pmod("_h", F.greatest("_blocks", F.lit(1))))
    out = out.join(plan, ["_sid", "_b"])
    kept = F.filter("_places", lambda x: (x["pass"] < F.col("_whole")) | (F.col("_take") == 2) | F.coalesce(F.array_contains("_in", F.col("_h")), F.lit(False)))
    out = out.withColumn("placements", F.coalesce(kept, F.array().cast("array<struct<pass:bigint,shard:bigint>>")))
    return out.select(*[F.col(i).alias(c) for c, i in inner.items() if c not in ADDED], *ADDED)


def mixed_rows(mix: DataFrame, columns: list[str], seed: int = 1, id_col: str = "doc_id") -> DataFrame:
    """A row for each time the mix takes a document: columns, shard and pass, shuffled inside each shard."""
    shard, turn, key, place = C.fresh(mix.select(*columns), "shard", "pass", "_key", "_p")
    rows = mix.select(*columns, F.explode("placements").alias(place)).select(*columns, F.col(place)["shard"].alias(shard), F.col(place)["pass"].alias(turn))
    rows = rows.withColumn(key, F.xxhash64(F.lit(seed + 3), shard, turn, id_col))
    return rows.repartition(F.col(shard)).sortWithinPartitions(shard, key, id_col).drop(key)


def mix_documents(docs: DataFrame, seed: int = 1, **kw) -> DataFrame:
    """docs as often as the mix takes them, shuffled inside its shards; the same columns, those of clashing names too."""
    away = dict(zip(ADDED, C.fresh(docs, *[f"_own_{c}" for c in ADDED]), strict=True))
    names = [away.get(c, c) for c in docs.columns]
    rows = mixed_rows(plan_mix(docs.withColumnsRenamed(away), seed, **kw), names, seed)
    return rows.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
