"""Ranked lexical search: the k best documents of every query item, by WAND over document shards.

The terms of the documents that any item holds are counted, written once and dealt into shards of some thousand
documents. A task inverts its shard, notes the largest impact that every term has there, and walks the posting lists of
each item document by document: lists are kept in order of their next document, the pivot is the first document at
which the summed largest impacts could reach the item's heap, and all lists before it skip right there. The shards'
heaps are merged by a window.

Impacts are whole numbers: a term weighs w = floor(1000 ln((2N+2)/(2df+1))), a document m = 100-B+((B n N) div L) with
n its terms, N the documents with any and L all their terms, and the impact of tf occurrences is
w ((10^9 tf) div (1000 tf + 8m)).
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochfold.llm import common as C

K, B = 10, 75
#: Items are ranked in blocks of about so many bytes of their texts, so what is sent to workers is bounded.
BLOCK_BYTES = 4_000_000
#: Documents of a shard, about; and postings that a worker inverts at a time, should they be very long.
SHARD_DOCS, SHARD_POSTINGS = 10_000, 2_000_000
#: Stands for the id of a row without one, behind all others of its score.
NO_ID = 2**63 - 1

# letters are folded; what is neither letter, digit nor beyond ASCII becomes a space
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased; none of a null text."""
    return (text or "").encode().translate(_FOLD).split()


def wand(lists: list[tuple], ids: np.ndarray, heap: list[tuple[int, int]], k: int) -> int:
    """Ranks a shard's documents for one item into heap, of (score, -id); returns how many it scored.

    lists: for each term its documents (ascending positions in ids), their impacts, the largest impact, and the term's
    repeats in the item. Heaps of earlier shards may be handed in, so what has to be beaten carries over.
    """
    t, scored = len(lists), 0
    at = [0] * t
    bounds = [most * repeats for _, _, most, repeats in lists]
    ahead = sorted(x[0][0] * t + i for i, x in enumerate(lists))  # next document and list in one number
    least = heap[0][0] if len(heap) == k else 1  # what a document has to reach; an equal score may win by its id
    while ahead:
        reach = 0
        for p, code in enumerate(ahead):
            reach += bounds[code % t]
            if reach >= least:
                break
        else:
            break
        pivot, moved = code // t, []
        if ahead[0] // t == pivot:
            score = p = 0
            for code in ahead:
                if code // t != pivot:
                    break
                i, p = code % t, p + 1
                docs, impacts, _, repeats = lists[i]
                score += impacts[at[i]] * repeats
                at[i] += 1
                if at[i] < len(docs):
                    moved.append(docs[at[i]] * t + i)
            scored += 1
            if score >= least:
                entry = (score, -int(ids[pivot]))
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
                least = heap[0][0] if len(heap) == k else 1
        else:
            for code in ahead[:p]:
                i = code % t
                docs = lists[i][0]
                at[i] = bisect_left(docs, pivot, at[i])
                if at[i] < len(docs):
                    moved.append(docs[at[i]] * t + i)
        ahead[:p] = moved
        ahead.sort()
    return scored


@dataclass(frozen=True)
class Weights:
    """What a score needs of the whole corpus: documents, terms, and a weight for each term of the items."""

    n_docs: int
    n_terms: int
    weights: np.ndarray


def invert(ids: np.ndarray, sizes: np.ndarray, ends: np.ndarray, term: np.ndarray, tf: np.ndarray, w: Weights) -> tuple[np.ndarray, dict[int, tuple]]:
    """A shard's ids in ascending order, and for each term (documents, impacts, largest impact)."""
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    m = np.array([100 - B + B * int(n) * w.n_docs // max(1, w.n_terms) for n in sizes], np.int64)
    held = np.diff(ends, prepend=0)
    tf = tf.astype(np.int64)
    impact = w.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, held)))
    doc = np.repeat(place, held)
    by = np.lexsort((doc, term))
    term, doc, impact = term[by], doc[by].astype(np.uint32), impact[by]
    found, starts = np.unique(term, return_index=True)
    index = {}
    for t, a, b in zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(term)], strict=True):
        index[t] = (array("I", doc[a:b].tobytes()), array("q", impact[a:b].tobytes()), int(impact[a:b].max()))
    return ids[order], index


def _counted(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tfs) for each document that has terms: how many, and those of vocabulary with their counts."""

    def run(batches):
        for b in batches:
            n, ts, fs, ids = [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = terms(text)
                if not own:
                    continue
                count = Counter(own)
                known = sorted((vocabulary[x], count[x]) for x in count.keys() & vocabulary.keys())
                ids.append(NO_ID if i is None else i)
                n.append(len(own))
                ts.append([x for x, _ in known])
                fs.append([x for _, x in known])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(ts, pa.list_(pa.int32())), pa.array(fs, pa.list_(pa.int32()))], names=["id", "n", "terms", "tfs"])

    C.small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "id long, n long, terms array<int>, tfs array<int>")


def _shard_heaps(counted: DataFrame, items: list[list[tuple[int, int]]], w: Weights, k: int) -> DataFrame:
    """(item, id, score): the k best documents of each item in each partition of counted."""

    def run(batches):
        heaps = [[] for _ in items]
        held, n = [], 0

        def rank() -> None:
            ids, sizes, ts, fs = (pa.chunked_array([b.column(c) for b in held]).combine_chunks() for c in range(4))
            ends = np.asarray(ts.offsets)[1:] - ts.offsets[0].as_py()
            own, index = invert(np.asarray(ids), np.asarray(sizes), ends, np.asarray(ts.flatten()), np.asarray(fs.flatten()), w)
            for heap, item in zip(heaps, items, strict=True):
                lists = [(*index[t], repeats) for t, repeats in item if t in index and index[t][2]]
                if lists:
                    wand(lists, own, heap, k)

        for b in batches:
            held.append(b)
            n += len(b.column(2).flatten())
            if n >= SHARD_POSTINGS:
                rank()
                held, n = [], 0
        if n:
            rank()
        found = [(i, -d, s) for i, heap in enumerate(heaps) for s, d in heap]
        for a in range(0, len(found), 10_000):
            part = list(zip(*found[a : a + 10_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.int64())], names=["item", "id", "score"])

    return counted.mapInArrow(run, "item int, id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """The k highest-scoring documents of each item with a score above 0: item_id, rank, doc_id, score.

    Equal scores rank by ascending doc_id. Defined cases: a null or empty text has no terms and is no document; an item
    without terms, or whose terms no document holds, gives no rows; every row of docs is a document and every row of
    items a query of its own, also where ids repeat; a row without an id ranks after its equals, with a null doc_id.
    ids of documents are whole numbers. Other columns are not read.
    """
    spark = docs.sparkSession
    queries = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(query_col), F.lit("")).alias("text"))
    blocks = -(-int(queries.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // BLOCK_BYTES)
    out = None
    for block in range(max(1, blocks)):
        # a block's items: about BLOCK_BYTES of text, whatever the table
        own = queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks))) == block).collect()
        bags = [Counter(terms(r["text"])) for r in own]
        words = sorted(set().union(*bags)) if bags else []
        vocabulary = {x: i for i, x in enumerate(words)}
        counted = C.stash(_counted(docs, vocabulary, id_col, text_col), "search-terms")
        n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = F.col("count").cast("double")
        weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * df + 1))).cast("long")
        weights = np.zeros(len(words), np.int64)
        for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().select("term", weight.alias("w")).collect():
            weights[r["term"]] = r["w"]  # at most a row for each term of the block
        bags = [[(vocabulary[x], c) for x, c in sorted(bag.items())] for bag in bags]
        shards = counted.repartition(max(1, -(-n_docs // SHARD_DOCS)))
        heaps = _shard_heaps(shards, bags, Weights(n_docs, n_terms, weights), k)
        best = Window.partitionBy("item").orderBy(F.desc("score"), "id")
        top = heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(own)], f"item int, item_id {dict(queries.dtypes)['item_id']}")
        doc = F.when(F.col("id") < NO_ID, F.col("id")).alias("doc_id")
        top = top.join(F.broadcast(names), "item").select("item_id", "rank", doc, "score")
        out = top if out is None else out.unionByName(top)
    return out
