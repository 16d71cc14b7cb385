"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, then exact similarity.

Texts become lower-cased words of letters and digits. A window has as many words as an item; its weighted shingles are
its runs of five words with their counts. The similarity of a window to an item is the shared weight over the item's
weight. Windows of every item length stand where a shingle of the benchmark does: a document's words are looked up among
the items' anchor words (the longest word of each shingle), the shingle around a hit is compared, and its place in the
item gives the window's start. Where an item's words are moved against each other by an insertion or a deletion, the
windows between the starts so found are taken too: the best window never begins before the first of them or after the
last. A window that shares no shingle with an item has similarity 0. The corpus is read once, without a shuffle of texts.

Which items a window is held against is for the index to say. It has 32 blocks of two fingerprint bits for each window
length, keyed by length, block and bits: fingerprints within 31 bits agree in at least one block, so all items within
that radius are found. At a similarity of 0.8 a fingerprint differs in 13 bits on average (standard deviation about 3),
so a window that the radius loses is rarer than one in 10^7. What is left is verified on the shingles themselves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochfold.llm import common as C

SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, BLOCK_BITS = 32, 2
RADIUS = BLOCKS - 1
#: Rows of the items' shingle and block indexes that are broadcast at once (about 50 MB); a larger benchmark takes
#: several passes.
PIECE = 500_000


def tokens(text: Column) -> Column:
    """Lower-cased words of letters and digits; an empty array for an empty or null text."""
    return F.regexp_extract_all(C.ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"[^{C.ALNUM_GAP[1:-2]}]+"), F.lit(0))


def shingles(w: Column, k: Column) -> Column:
    """All runs of k words as strings; the whole sequence where there are fewer words."""
    runs = F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))
    return F.when(F.size(w) >= k, runs).otherwise(F.array(F.array_join(w, " ")))


def simhash(grams: Column) -> Column:
    """64 bits: one is set where over half of the shingles' hashes have it."""
    h = F.transform(grams, lambda g: F.xxhash64(g))
    bit = lambda b: F.when(F.size(F.filter(h, lambda x: F.call_function("getbit", x, b) == 1)) * 2 > F.size(h), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(bit(b)))


def shared_weight(a: Column, b: Column) -> Column:
    """The sum over shingles of the smaller of their two counts."""
    count = lambda arr, g: F.size(F.filter(arr, lambda x: x == g))
    return F.aggregate(F.array_distinct(F.array_intersect(a, b)), F.lit(0), lambda acc, g: acc + F.least(count(a, g), count(b, g)))


def _block(fp: Column, k: Column) -> Column:
    return F.call_function("shiftrightunsigned", fp, (k * BLOCK_BITS).cast("int")).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def item_table(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """key, item, n words, k words in a shingle, its shingles and fingerprint; items without words are left out."""
    items = benchmark.select(F.col(item_col).alias("item"), tokens(F.col(text_col)).alias("_w")).where(F.size("_w") > 0).distinct()
    items = items.select(F.monotonically_increasing_id().alias("key"), "item", "_w", F.size("_w").alias("n"), F.least(F.size("_w"), F.lit(SHINGLE)).alias("k"))
    items = items.select("*", shingles(F.col("_w"), F.col("k")).alias("grams"))
    return C.stash(items.select("key", "item", "n", "k", "grams", simhash(F.col("grams")).alias("fp")), "decon-items")


def anchor_index(items: DataFrame) -> DataFrame:
    """A row for each distinct shingle place: anchor (hash of its longest word), offset, gram hash, key, place, n, k."""
    rows = items.select("key", "n", "k", F.posexplode("grams").alias("place", "gram")).withColumn("_w", F.split("gram", " "))
    longest = F.array_max(F.transform("_w", lambda w, i: F.struct(F.length(w).alias("l"), w.alias("w"), i.alias("i"))))
    rows = rows.select("key", "n", "k", "place", "gram", longest.alias("_a"))
    return rows.select(F.xxhash64("_a.w").alias("anchor"), F.col("_a.i").alias("offset"), F.xxhash64("gram").alias("gram"), "key", "place", "n", "k")


def _slack(n: Column, similarity: float) -> Column:
    """How far the words of one item can be moved in a window that still reaches the similarity."""
    return F.ceil((1 - similarity) * (n - F.least(n, F.lit(SHINGLE)) + 1)).cast("int") + 1


def windows(docs: DataFrame, index: DataFrame, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """Item-sized windows of the documents at every place that can reach the similarity: _row, _id, n, start, window."""
    d = docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), tokens(F.col(text_col)).alias("_w"))
    d = d.select("_id", "_row", "_w", F.posexplode_outer("_w").alias("_pos", "_word"))
    hit = d.where(F.col("_word").isNotNull()).withColumn("anchor", F.xxhash64("_word")).join(F.broadcast(index), "anchor")
    at = F.col("_pos") - F.col("offset")
    hit = hit.where((at >= 0) & (at + F.col("k") <= F.size("_w")))
    hit = hit.where(F.xxhash64(F.array_join(F.slice("_w", at + 1, F.col("k")), " ")) == F.col("gram"))
    start = F.greatest(F.lit(0), F.least(at - F.col("place"), F.size("_w") - F.col("n")))
    slack = _slack(F.col("n"), similarity)
    hit = hit.select("_row", "_id", "key", "n", start.alias("start"), slack.alias("slack"), F.slice("_w", start + 1, F.col("n") + slack).alias("span"))
    hit = hit.groupBy("_row", "_id", "key", "n", "slack", "start").agg(F.first("span").alias("span"))
    # starts from here to the next one, if words of the same item can have been moved so far
    gap = F.lead("start").over(Window.partitionBy("_row", "_id", "key", "n").orderBy("start")) - F.col("start")
    hit = hit.withColumn("_more", F.when(gap <= F.col("slack"), gap - 1).otherwise(0))
    hit = hit.select("*", F.explode(F.sequence(F.lit(0), F.coalesce("_more", F.lit(0)))).alias("_by"))
    hit = hit.select("_row", "_id", "n", (F.col("start") + F.col("_by")).alias("start"), F.slice("span", F.col("_by") + 1, F.col("n")).alias("window"))
    return hit.groupBy("_row", "_id", "n", "start").agg(F.first("window").alias("window"))


def lookup(win: DataFrame, items: DataFrame) -> DataFrame:
    """Windows (n, fp and more) with the key of every item of their length within RADIUS bits, found by blocks, once each."""
    every = F.sequence(F.lit(0), F.lit(BLOCKS - 1))
    blocks = items.select("key", "n", F.col("fp").alias("item_fp"), F.explode(every).alias("block"))
    blocks = blocks.withColumn("bits", _block(F.col("item_fp"), F.col("block")))
    probe = win.select("*", F.explode(every).alias("block")).withColumn("bits", _block(F.col("fp"), F.col("block")))
    found = probe.join(F.broadcast(blocks), ["n", "block", "bits"])
    # of the blocks in which a pair agrees, the first alone goes on
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    earlier = F.exists(F.filter(every, lambda b: b < F.col("block")), lambda b: _block(apart, b) == 0)
    return found.where((F.bit_count(apart) <= RADIUS) & ~earlier).drop("block", "bits", "item_fp")


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """A row for each document and item that a window of it holds: id, item, start (word), similarity; the best window.

    Of equally good windows the earliest of those looked at counts. Defined cases: null and empty texts and items hold
    and match nothing; an item of fewer than five words is one shingle, found where its words stand in a row; a document
    shorter than its item is one window; repeated rows and null ids of documents get their own rows; an item under a null
    id is an item like others, and texts under one id are told as one; equal items all match; empty tables give an empty
    result; other columns are not read.
    """
    items = item_table(benchmark, item_col)
    index = C.stash(anchor_index(items), "decon-index")
    pieces = max(1, math.ceil((index.count() + BLOCKS * items.count()) / PIECE))
    part = lambda df, p: df if pieces == 1 else df.where(F.pmod(F.xxhash64("key"), F.lit(pieces)) == p)
    found = None
    for p in range(pieces):
        own = part(items, p)
        win = windows(docs, part(index, p), similarity, id_col, text_col)
        win = win.select("*", shingles(F.col("window"), F.least(F.col("n"), F.lit(SHINGLE))).alias("own"))
        near = lookup(win.select("_row", "_id", "n", "start", "own", simhash(F.col("own")).alias("fp")), own)
        near = near.join(F.broadcast(own.select("key", "item", "grams")), "key")
        near = near.select("_row", "_id", "item", "start", (shared_weight(F.col("own"), F.col("grams")) / F.size("grams")).alias("similarity"))
        near = near.where(F.col("similarity") >= similarity)
        found = near if found is None else found.unionByName(near)
    best = found.groupBy("_row", "_id", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("_b"))
    return best.select(F.col("_id").alias(id_col), F.col("item").alias(item_col), (-F.col("_b.s")).alias("start"), F.col("_b.similarity").alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that hold a benchmark item; same columns.

    A document is found by its id and a hash of its text, so rows that share an id are judged each by its own text.
    """
    mark, key = C.fresh(docs, "_mark", "_text_hash")
    held = contaminated(docs.select(F.struct(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h")).alias("doc_id"), text_col), benchmark, similarity, "doc_id", text_col)
    held = C.stash(held.select(F.col("doc_id.i").alias(mark), F.col("doc_id.h").alias(key)).distinct(), "decon-held")
    return C.without_rows(docs, held, docs[id_col].eqNullSafe(held[mark]) & (F.xxhash64(docs[text_col]) == held[key]))
