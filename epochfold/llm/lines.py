"""Line dedup on content-defined chunks of lines.

A line's digest and the one before it are hashed together, rolling over the lines; where that hash is 0 modulo MEAN_LINES,
and isn't for the line before, a chunk ends, unless a text's first or last line would stand alone. Chunks thus hold two
lines or more, and their borders move with the text: a line put in or taken out changes the chunks around it alone.
Chunks of two lines or more that stand more than once in the corpus keep their first place, by id and order, and go
elsewhere, after their bytes have been compared.

Hashes are counted first; the bytes of chunks are only read again for hashes that repeat, and partial aggregates make a
hot chunk one row a task. Texts are shuffled once, to take the removed lines out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochfold.llm import common as C

MEAN_LINES, LEAST_LINES = 4, 2
#: Up to so many repeated hashes (8 bytes each), their table is broadcast; more are joined by shuffle.
FEW = 1_000_000


def chunk_marks(digests: str, mean: int = MEAN_LINES) -> Column:
    """For each line, whether its hash with the line before is 0 modulo mean. digests: a column of the lines' MD5.

    The digests are a column of their own, as an expression inside the lambda would be worked out again for each line.
    """
    rolled = lambda i: F.md5(F.concat(F.coalesce(F.get(digests, i - 1), F.lit("")), F.get(digests, i)))
    return F.transform(digests, lambda _, i: F.conv(F.substring(rolled(i), 1, 4), 16, 10).cast("int") % mean == 0)


def chunk_ends(marks: str) -> Column:
    """Numbers (from 1) of the lines that end a chunk, from a column of marks; the last line always does."""
    n = F.size(marks)
    inside = lambda i: (i >= 2) & (i != n - 1) & F.get(marks, i - 1) & ~F.get(marks, i - 2)
    return F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | inside(i))


def _with_chunks(docs: DataFrame, mean: int) -> DataFrame:
    """docs(k, text) with _lines and _chunks: array<struct<i, a, n, text>>; none for a null text."""
    d = docs.select("*", F.split("text", "\n").alias("_lines"))
    d = d.select("*", F.transform("_lines", lambda x: F.md5(x)).alias("_digests"))
    d = d.select("*", chunk_marks("_digests", mean).alias("_marks")).drop("_digests")
    d = d.select("*", chunk_ends("_marks").alias("_ends")).drop("_marks")
    start = lambda i: F.when(i == 0, F.lit(1)).otherwise(F.get("_ends", i - 1) + 1)
    part = lambda e, i: F.struct(i.alias("i"), start(i).alias("a"), (e - start(i) + 1).alias("n"))
    return d.withColumn("_chunks", F.transform("_ends", part))


def repeated_chunks(keyed: DataFrame, mean: int = MEAN_LINES, least: int = LEAST_LINES) -> DataFrame:
    """keyed(k, text) -> (k, i): the chunks that repeat an earlier one, byte by byte."""
    # the outer explode keeps the planner from testing for empty chunks below the projections, lambda inside lambda
    own = _with_chunks(keyed, mean).select("k", "_lines", F.explode_outer("_chunks").alias("_c")).where(F.col("_c.n") >= least)
    own = own.select("k", "_c.i", F.array_join(F.slice("_lines", F.col("_c.a"), F.col("_c.n")), "\n").alias("_t"))
    own = own.select("k", "i", "_t", F.xxhash64("_t").alias("h"))
    places = C.stash(own.select("k", "i", "h"), "lines-places")
    twice = C.stash(places.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "lines-twice")
    # grouping by the bytes themselves is their comparison; equal hashes of different bytes part here
    by_bytes = lambda df: df.groupBy("h", "_t").agg(F.min(F.struct("k", "i")).alias("first"), F.count("*").alias("c"))
    # where too many repeat to broadcast, copies meet in the tasks before texts are shuffled, and the join moves a row a text
    texts = by_bytes(own.join(F.broadcast(twice), "h")) if twice.count() <= FEW else by_bytes(own).select("h", "first", "c").join(twice, "h")
    kinds = C.stash(texts.groupBy("h").agg(F.count("*").alias("kinds"), F.first("first").alias("first")), "lines-kinds")
    same = places.join(kinds.where("kinds = 1"), "h").where(F.struct("k", "i") > F.col("first")).select("k", "i")
    apart = kinds.where("kinds > 1").select("h")
    if apart.isEmpty():
        return same
    mixed = own.join(apart, "h")
    firsts = mixed.groupBy("h", "_t").agg(F.min(F.struct("k", "i")).alias("first"))
    return same.unionByName(mixed.join(firsts, ["h", "_t"]).where(F.struct("k", "i") > F.col("first")).select("k", "i"))


def dedup_lines(docs: DataFrame, mean: int = MEAN_LINES, least: int = LEAST_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, n_lines, n_removed and text, the lines that stay.

    Defined cases: a null text has no lines and stays null; an empty one is a line; texts of one line stay; repeated rows
    and rows that share an id or have none are told apart by row numbers of a stored copy, so one of them keeps its
    chunks; an empty table gives an empty result; other columns of docs are not read.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    kind = dict(base.dtypes)["_id"]
    unique = kind in ("bigint", "int", "smallint", "tinyint") and base.groupBy("_id").count().where("count > 1 OR _id IS NULL").isEmpty()
    if unique:
        keyed = base.select(F.col("_id").alias("k"), "_id", "text")
    else:
        # numbers follow the ids (null first), so that "first" is by id here as well
        order = base.repartitionByRange(F.col("_id").asc_nulls_first()).sortWithinPartitions(F.col("_id").asc_nulls_first(), "text")
        keyed = C.stash(order.select(F.monotonically_increasing_id().alias("k"), "_id", "text"), "lines-rows")
    gone = repeated_chunks(keyed.select("k", "text"), mean, least).groupBy("k").agg(F.collect_set("i").alias("_gone"))
    out = _with_chunks(keyed.join(gone, "k", "left"), mean)
    none = F.array().cast("array<int>")
    stay = F.filter("_chunks", lambda c: ~F.coalesce(F.array_contains(F.coalesce("_gone", none), c["i"]), F.lit(False)))
    kept = F.flatten(F.transform(stay, lambda c: F.slice("_lines", c["a"], c["n"])))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines"))
    left = F.when(F.col("_gone").isNull(), n).otherwise(F.size(kept))
    return out.select(F.col("_id").alias(id_col), n.cast("long").alias("n_lines"), (n - left).cast("long").alias("n_removed"), text.alias(text_col))
