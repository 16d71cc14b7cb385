"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints with at most 4 differing bits share at least 4 of their 8 bytes, each at its own position.
Postings by a single positional byte would hold 1/256 of all fingerprints, so the index takes positions three at a
time: 20 triples of positions are enough for every set of 4 positions to hold one (a Turan design: two of its triples'
positions lie in one part of (3, 3, 2) and the third in the next, or all in one part). Inside a posting, shared
positional bytes are tallied for each pair, pairs under 4 are dropped, and the rest verified by their differing bits.

Only distinct fingerprints enter the index, and a posting yields a spanning forest of its links, at most one for each
member, never all pairs. A posting beyond a fixed size is dealt out as pairs of its chunks, so a task's memory is bounded.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochfold.llm import common as C
from epochfold.llm.components import components

#: Fingerprints link at so many differing bits or fewer.
BITS = 4
#: Bytes that linked fingerprints share at least.
SHARED = 8 - BITS
#: Members of a posting that one task compares at once.
CHUNK = 2048


def fingerprint(text: Column, shingle: int = 4) -> Column:
    """The array of a text's shingle hashes: XXH64, seed 42, of its lower-cased words joined by a space."""
    w = C.words(C.ascii_lower(text))
    return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(_shingles(w, shingle))


def _shingles(w: Column, n: int) -> Column:
    grams = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.concat_ws(" ", *[F.element_at(w, i + k) for k in range(n)])))
    return F.when(F.size(w) < n, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(grams)


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = 4, text_col: str = "text") -> DataFrame:
    """keep's columns with fp (long), a row for each row of docs; a text without words has fingerprint 0.

    The bits of all hashes are counted two to a long, 32 bits each: a text holds fewer than 2^31 shingles.
    """
    w = F.col("_w")
    n = shingle
    rows = docs.select(*keep, F.monotonically_increasing_id().alias("_row"), C.words(C.ascii_lower(F.col(text_col))).alias("_w"))
    # a text of one word or more has its shingles exploded; the outer explode keeps empty texts
    index = F.when(F.size(w) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (n - 1))))
    rows = rows.select(*keep, "_row", "_w", F.explode_outer(index).alias("_i"))
    gram = F.when(F.col("_i").isNull(), F.lit(None)).otherwise(F.xxhash64(F.array_join(F.slice(w, F.col("_i"), F.lit(n)), " ")))
    rows = rows.select(*keep, "_row", gram.alias("_h"))
    pair = F.lit((1 << 32) | 1)
    sums = [F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(pair)).alias(f"_s{i}") for i in range(32)]
    got = rows.groupBy("_row", *keep).agg(F.count("_h").alias("_n"), *sums)
    fp = F.lit(0).cast("long")
    for i in range(32):
        low, high = F.col(f"_s{i}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"_s{i}", 32)
        for bit, count in ((i, low), (i + 32, high)):
            one = F.lit((1 << bit) if bit < 63 else -(1 << 63)).cast("long")
            fp = fp.bitwiseOR(F.when(count * 2 > F.col("_n"), one).otherwise(F.lit(0).cast("long")))
    return got.select(*keep, fp.alias("fp"))


def position_triples() -> list[tuple[int, int, int]]:
    """20 triples of the 8 byte positions; every 4 positions hold one of them."""
    part = lambda p: p // 3
    count = lambda t, k: sum(part(p) == k for p in t)
    return [t for t in combinations(range(8), 3) if any(count(t, k) == 3 or (count(t, k) == 2 and count(t, (k + 1) % 3) == 1) for k in range(3))]


def _links_of(fps: np.ndarray, others: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside fps, or between fps and others where that is another chunk."""
    same = others is fps
    n = len(fps) + (0 if same else len(others))
    nodes = fps if same else np.concatenate([fps, others])
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a_out, b_out = [], []
    shift = 0 if same else len(fps)
    by_byte = nodes.view(np.uint8).reshape(n, 8)
    for i in range(len(fps)):
        lo = i + 1 if same else shift
        shared = (by_byte[lo:] == by_byte[i]).sum(axis=1)
        near = np.nonzero(shared >= 8 - bits)[0] + lo
        near = near[np.bitwise_count(nodes[near] ^ nodes[i]) <= bits]
        for j in near:
            x, y = root(i), root(int(j))
            if x != y:
                parent[max(x, y)] = min(x, y)
                a_out.append(i)
                b_out.append(int(j))
    return nodes[a_out], nodes[b_out]


def _match(bits: int):
    def run(batches):
        for pdf in batches:
            out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for mine, other in zip(pdf["fps"], pdf["others"], strict=True):
                mine = np.ascontiguousarray(mine, dtype=np.int64).view(np.uint64)
                rest = mine if other is None else np.ascontiguousarray(other, dtype=np.int64).view(np.uint64)
                a, b = _links_of(mine, rest, bits)
                out_a.append(a.view(np.int64))
                out_b.append(b.view(np.int64))
            yield pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    return run


def links(fps: DataFrame, bits: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """Distinct fingerprints fps(fp) -> (a, b): links whose components are those of all pairs within bits.

    Every link of two fingerprints lies in a posting that holds both, and each posting yields a spanning forest.
    """
    if bits != BITS:
        raise ValueError("the index is laid out for 4 differing bits")
    triples = F.array(*[F.struct(F.lit(k).alias("k"), _positions(t).alias("v")) for k, t in enumerate(position_triples())])
    posts = fps.select("fp", F.explode(triples).alias("_t")).select(F.shiftleft(F.col("_t.k").cast("long"), 24).bitwiseOR(F.col("_t.v")).alias("key"), "fp")
    sizes = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    posts = posts.join(sizes, "key").withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    posts = posts.withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    chunks = posts.groupBy("key", "c").agg(F.collect_list("fp").alias("fps"), F.first("chunks").alias("chunks"))
    alone = chunks.select("fps", F.lit(None).cast("array<bigint>").alias("others"))
    # chunk pairs of a large posting meet in tasks of their own
    large = C.stash(chunks.where("chunks > 1"), "simhash-chunks")
    paired = large.select("key", "c", "fps", F.explode(F.expr("filter(sequence(0, chunks - 1), o -> o > c)")).alias("o"))
    paired = paired.join(large.select("key", F.col("c").alias("o"), F.col("fps").alias("others")), ["key", "o"]).select("fps", "others")
    # groups come in arrays, so that one batch of the Python worker holds many of them
    return alone.unionByName(paired).mapInPandas(_match(bits), "a long, b long")


def _positions(t: tuple[int, int, int]) -> Column:
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    return F.shiftleft(byte(t[0]), 16).bitwiseOR(F.shiftleft(byte(t[1]), 8)).bitwiseOR(byte(t[2])).cast("long")


def near_duplicates(docs: DataFrame, shingle: int = 4, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id, fp (long), n_same (rows of this fingerprint) and component_id.

    component_id is the smallest id that a row reaches over links, its own included.

    Defined cases: a null text counts as empty; texts without words have fingerprint 0 and link like any other; a text
    of fewer words than a shingle is one shingle; repeated rows get a row each; a null id takes part but is never a
    component's id unless all ids of its component are null; an empty table gives an empty result.
    """
    fps = C.stash(fingerprints(docs.select(id_col, text_col), [id_col], shingle, text_col), "simhash-fps")
    distinct = fps.groupBy("fp").agg(F.min(id_col).alias("_first"), F.count("*").alias("n_same"))
    distinct = C.stash(distinct, "simhash-distinct")
    linked = components(links(distinct.select("fp"), bits), "simhash-links")
    by_fp = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("_c", F.coalesce("component", "fp"))
    least = by_fp.groupBy("_c").agg(F.min("_first").alias("component_id"))
    by_fp = C.stash(by_fp.join(least, "_c").select("fp", "n_same", "component_id"), "simhash-classes")
    return fps.join(by_fp, "fp").select(id_col, "fp", "n_same", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest id (null last); same columns.

    Only the list of rows that go is joined to the texts. Where ids are null or repeat, rows are told apart by the row
    numbers of a stored copy, and the first of equal ids stays.
    """
    if C.unique_ids(docs, id_col):
        near = near_duplicates(docs, shingle, bits, id_col, text_col)
        gone = C.stash(near.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")), "simhash-gone")
        return C.without_rows(docs, gone, docs[id_col] == gone["_gone"])
    (key,) = C.fresh(docs, "_k")
    kept = C.stash(docs.withColumn(key, F.monotonically_increasing_id()), "simhash-rows")
    near = near_duplicates(kept, shingle, bits, key, text_col).select(key, "component_id")
    near = near.join(kept.select(key, F.col(id_col).alias("_id")), key)
    lead = near.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col(key).alias("k"))).alias("_m"))
    gone = C.stash(near.join(lead, "component_id").where(F.col(key) != F.col("_m.k")).select(F.col(key).alias("_gone")), "simhash-gone")
    return C.without_rows(kept, gone, kept[key] == gone["_gone"]).drop(key)
