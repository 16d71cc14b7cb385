"""SimHash near-copies at a similarity on shingle sets: wide fingerprints in a byte-position inverted index, then a check.

Texts are alike if the Jaccard index of their sets of five-word shingles is 0.8 or more. An edit changes five of these
shingles but two word pairs, so fingerprints are taken over word pairs: 256 bits, 32 positional bytes. At a similarity of
0.8 some 24 bits differ (standard deviation 5); RADIUS is 2.5 standard deviations beyond. What has no fewer than SHARED
common bytes is kept by the tally, then what differs by RADIUS bits or fewer. Sets at the similarity differ by so few
shingles that the parities of their numbers in CELLS cells differ in no more; that filter loses nothing. What is left is
compared on the sets themselves: no pair below the similarity is ever taken for alike.

A posting is keyed by the bytes at three positions, over 64 triples that use all positions alike: two unrelated
fingerprints meet in one of 2^24 postings for each triple. Pairs at the similarity that share none of the 64, or that
differ by more bits, don't meet there: 1 to 2 in 100 pairs (README), fewer of the groups, which pairs of others connect.

An exact round follows, for the pairs that the index leaves unconnected: in any one order of all shingles, two sets at the
similarity share k of the first n - ceil(0.8 n) + k of each. k grows with the smaller set, so long texts that have a
few shingles in common by chance are told by their count. The order puts the common shingles (as counted in one of SAMPLE
texts) last, so few texts meet in a posting; what it says changes the work, never the pairs. Only the filters that lose
nothing are used there, so every pair at the similarity is linked.

Only one text of each distinct set enters the index. A posting's members meet its smallest one first, then one drawn for
each posting anew; after that only pairs of members that aren't connected yet are looked at. So a large group of near
copies costs a few rows a member and not all of its pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochfold.llm import common as C
from epochfold.llm import word_hashes as W
from epochfold.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
#: Words of a fingerprint's features, its longs, the bits that may differ, the bytes shared at least.
FEATURE, LONGS, RADIUS, SHARED = 2, 4, 36, 8
BYTES = 8 * LONGS
#: Cells whose parities follow the fingerprint in a row's longs.
CELLS = 1024
#: Steps between the positions of a triple; each pair of steps makes a triple from every position.
STEPS = ((1, 4), (9, 15))
#: Triples whose postings draw a member to meet the others.
DRAWN = 8
#: Members of a posting that one task compares at once.
CHUNK = 2048
#: Up to so many rows of 8 or 16 bytes, a table is broadcast.
FEW = 1_000_000
#: One in so many texts tells which shingles are common: those that COMMON of them hold, the MOST_COMMON most common ones.
SAMPLE, COMMON, MOST_COMMON = 16, 4, 200_000
#: Shingles of a set for each one more that its prefix shares.
PER_SHARED = 100
#: Features whose bits are counted at once.
_AT_ONCE = 1 << 15


def triples() -> np.ndarray:
    """The positions of the index's keys, a row of three each."""
    return np.array([(p, (p + a) % BYTES, (p + b) % BYTES) for a, b in STEPS for p in range(BYTES)])


def fingerprint(features: np.ndarray) -> np.ndarray:
    """LONGS words of 64 bits; a bit is 1 if set in over half of the features' hashes. No features: zero."""
    counts = np.zeros((LONGS, 64), np.int64)
    for at in range(0, len(features), _AT_ONCE):
        for k in range(LONGS):
            h = W.mixed(features[at : at + _AT_ONCE] + np.uint64(k + 1))
            counts[k] += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(features), axis=1).view(np.uint64).ravel()


def _parities(g: np.ndarray) -> np.ndarray:
    """Is the number of hashes in a cell odd? Packed into longs."""
    held = np.bincount((g >> np.uint64(65 - CELLS.bit_length())).astype(np.int64), minlength=CELLS)
    return np.packbits((held & 1).astype(np.uint8)).view(np.int64)


def _each(batches, *widths: int):
    """For each slice of (key, text): keys, and for each text its hashed shingles of each width."""
    for b, raws in W.slices(batches):
        h, at = W.word_hashes(raws)
        every = [W.runs(h, n) for n in widths]
        texts = [[r[x : y - n + 1] if y - x >= n else W.shingles(h[x:y], n) for r, n in zip(every, widths, strict=True)] for x, y in zip(at[:-1], at[1:], strict=True)]
        yield b.column(0), texts


def _sign(shingle: int):
    def run(batches):
        for keys, texts in _each(batches, shingle, FEATURE):
            sets = [np.unique(g) for g, _ in texts]
            fps = [np.concatenate([fingerprint(f).view(np.int64), _parities(g)]) for g, (_, f) in zip(sets, texts, strict=True)]
            cols = [pa.array([len(g) for g in sets], pa.int64()), pa.array([hashlib.md5(g.tobytes()).digest() for g in sets], pa.binary()), pa.array(fps, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([keys, *cols], names=["key", "n", "digest", "fp"])

    return run


def _sketch(g: np.ndarray) -> bytes:
    """As _parities, of two cells or more a shingle; halves laid over each other are the sketch of half the cells."""
    cells = max(CELLS, 1 << (2 * len(g) - 1).bit_length())
    held = np.bincount((g & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((held & 1).astype(np.uint8)).tobytes()


def _sets(shingle: int):
    def run(batches):
        for keys, texts in _each(batches, shingle):
            sets = [np.unique(g) for (g,) in texts]
            cols = [pa.array([len(g) for g in sets], pa.int64()), pa.array([_sketch(g) for g in sets], pa.binary()), pa.array([g.view(np.int64) for g in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([keys, *cols], names=["key", "n", "sketch", "grams"])

    return run


_SETS = "key long, n long, sketch binary, grams array<bigint>"


def _few_cells_differ(similarity: float):
    """The rows (a, b) of (a, b, n, x, m, y) whose sketches x and y allow the similarity: it loses no pair."""
    share = (1 - similarity) / (1 + similarity)

    def run(batches):
        for b in batches:
            near = np.zeros(b.num_rows, bool)
            for i, (n, x, m, y) in enumerate(zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True)):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                width = min(len(x), len(y))
                differ = np.bitwise_xor.reduce(x.reshape(-1, width)) ^ np.bitwise_xor.reduce(y.reshape(-1, width))
                near[i] = np.bitwise_count(differ).sum(dtype=np.int64) <= (n + m) * share + 1e-9
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(near))

    return run


def _prefixes(shingle: int, similarity: float, common: np.ndarray):
    """(key, text) -> a row for each shingle of the set's prefix: g (its hash) and node. The order: rare ones by hash, then common ones."""
    by_hash = np.argsort(common)
    known = common[by_hash]

    def run(batches):
        for keys, texts in _each(batches, shingle):
            firsts = []
            for (g,) in texts:
                g = np.unique(g)
                n = len(g) - int(np.ceil(len(g) * similarity - 1e-9)) + 1 + len(g) // PER_SHARED if len(g) else 0
                if len(known):
                    at = np.minimum(np.searchsorted(known, g), len(known) - 1)
                    place = np.where(known[at] == g, by_hash[at], -1)
                    g = g[np.argsort(place, kind="stable")[:n]]
                firsts.append(g[:n].view(np.int64))
            nodes = np.repeat(keys.to_numpy(zero_copy_only=False), [len(g) for g in firsts])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *firsts])), pa.array(nodes, pa.int64())], names=["g", "node"])

    return run


def _postings(batches):
    """(node, fp) -> a row for each triple of positions: g (the triple and its bytes) and node."""
    at = triples()
    for b in batches:
        if not b.num_rows:
            continue
        longs = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)[:, :LONGS]
        fps = np.ascontiguousarray(longs).view(np.uint8).astype(np.int64)
        key = (np.arange(len(at)) << 24) | (fps[:, at[:, 0]] << 16) | (fps[:, at[:, 1]] << 8) | fps[:, at[:, 2]]
        nodes = np.repeat(b.column(0).to_numpy(zero_copy_only=False), len(at))
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(nodes)], names=["g", "node"])


def _possible(n: Column, fp: Column, m: Column, other: Column, similarity: float) -> Column:
    """Do sizes, shared positional bytes and differing bits allow these sets to be alike?"""
    differ = F.zip_with(fp, other, lambda x, y: x.bitwiseXOR(y))

    def unequal_bytes(z: Column) -> Column:
        for shift in (4, 2, 1):  # the lowest bit of a byte gathers all of its bits
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
        return F.bit_count(z.bitwiseAND(F.lit(0x0101010101010101)))

    first, rest = F.slice(differ, 1, LONGS), F.slice(differ, LONGS + 1, CELLS // 64)
    tally = BYTES - F.aggregate(first, F.lit(0), lambda a, z: a + unequal_bytes(z))
    bits = F.aggregate(first, F.lit(0), lambda a, z: a + F.bit_count(z))
    apart = F.aggregate(rest, F.lit(0), lambda a, z: a + F.bit_count(z))
    few = apart <= (n + m) * ((1 - similarity) / (1 + similarity)) + 1e-9
    return (F.least(n, m) >= F.greatest(n, m) * similarity - 1e-9) & (tally >= SHARED) & (bits <= RADIUS) & few


def _unconnected(similarity: float, exact: bool = False):
    """Pairs of members in different components that the filters leave; inside one chunk, or between two.

    A pair that shares several postings comes from the first of them alone. exact is for postings of prefixes: it uses the
    sizes and the parities alone (its fp holds no others), which lose nothing, and says how often a pair was met and how
    often it has to be.
    """
    at_triple, share = triples(), (1 - similarity) / (1 + similarity)

    def side(node, n, comp, fp):
        n = np.asarray(n, np.int64)
        by_size = np.argsort(n, kind="stable")
        words = np.ascontiguousarray(np.asarray(fp, np.int64).view(np.uint64).reshape(len(n), -1)[by_size])
        return np.asarray(node, np.int64)[by_size], n[by_size], np.asarray(comp, np.int64)[by_size], words

    def run(batches):
        for pdf in batches:
            out_a, out_b, need = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for r in pdf.itertuples(index=False):
                one = side(r.node, r.n, r.comp, r.fp)
                same = r.node2 is None
                node, n, comp, words = one if same else side(r.node2, r.n2, r.comp2, r.fp2)
                for i in range(len(one[0])):
                    size = one[1][i]
                    lo = i + 1 if same else np.searchsorted(n, int(np.ceil(similarity * size - 1e-9)))
                    hi = np.searchsorted(n, int(np.floor(size / similarity + 1e-9)), "right")
                    at = np.nonzero(comp[lo:hi] != one[2][i])[0] + lo
                    differ = words[at] ^ one[3][i]
                    bits = np.bitwise_count(differ)
                    few = bits[:, 0 if exact else LONGS :].sum(axis=1, dtype=np.int64) <= (n[at] + size) * share + 1e-9
                    if exact:
                        out_a.append(np.minimum(node[at[few]], one[0][i]))
                        out_b.append(np.maximum(node[at[few]], one[0][i]))
                        need.append(1 + np.minimum(n[at[few]], size) // PER_SHARED)
                        continue
                    equal = np.ascontiguousarray(differ[:, :LONGS]).view(np.uint8) == 0
                    near = (equal.sum(axis=1) >= SHARED) & (bits[:, :LONGS].sum(axis=1, dtype=np.int64) <= RADIUS)
                    near &= few
                    at, equal = at[near], equal[near]
                    at = at[~equal[:, at_triple[: r.g >> 24]].all(axis=2).any(axis=1)]
                    out_a.append(np.minimum(node[at], one[0][i]))
                    out_b.append(np.maximum(node[at], one[0][i]))
                    need.append(np.ones(len(at), np.int64))
            met = pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b), "need": np.concatenate(need)})
            yield met.groupby(["a", "b", "need"], as_index=False).size().rename(columns={"size": "met"})

    return run


def _light(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW else df


def _alike(pairs: DataFrame, docs: DataFrame, key: str, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity; sketches travel once a pair, sets once a pair that these allow."""
    nodes = C.stash(pairs.select(F.explode(F.array("a", "b")).alias("_node")).distinct(), "copies-nodes")
    held = docs.join(_light(nodes), docs[key] == nodes["_node"], "left_semi")
    sets = C.stash(held.mapInArrow(_sets(shingle), _SETS), "copies-sets")
    light = sets.select("key", "n", "sketch")
    near = pairs.join(light.toDF("a", "n", "x"), "a").join(light.toDF("b", "m", "y"), "b").select("a", "b", "n", "x", "m", "y")
    pairs = C.stash(near.mapInArrow(_few_cells_differ(similarity), "a long, b long"), "copies-near")
    sets = sets.select("key", "grams")
    both = pairs.join(sets.toDF("a", "_x"), "a").join(sets.toDF("b", "_y"), "b")
    both = both.select("a", "b", F.size(F.array_intersect("_x", "_y")).alias("_c"), (F.size("_x") + F.size("_y")).alias("_s"))
    return both.where(F.col("_c") >= (F.col("_s") - F.col("_c")) * similarity - 1e-9).select("a", "b")


def _hub_pairs(posts: DataFrame, drawn: bool, similarity: float) -> DataFrame:
    """Pairs of a posting's members in another component than its hub's: the smallest member, or one drawn by the posting."""
    rank = F.xxhash64("g", "node") if drawn else F.col("node")
    posts = posts.where(F.shiftright("g", 24) < DRAWN) if drawn else posts
    hubs = posts.groupBy("g").agg(F.min(F.struct(rank.alias("r"), "node", "n", "comp", "fp")).alias("hub"))
    hubs = C.stash(hubs.select("g", "hub.*").toDF("g", "r", "hub", "m", "comp2", "other").drop("r"), "copies-hubs")
    near = posts.join(hubs, "g").where("comp <> comp2").where(_possible(F.col("n"), F.col("fp"), F.col("m"), F.col("other"), similarity))
    return C.stash(near.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct(), "copies-tried")


def _live(posts: DataFrame, links: DataFrame) -> DataFrame:
    """Postings (g, node, n, fp, comp) with members in several components of links, comp up to date."""
    so_far = C.stash(components(links, "copies-stars"), "copies-components")
    posts = C.stash(posts.drop("comp").join(_light(so_far), "node", "left").select("g", "node", "n", "fp", F.coalesce("component", "node").alias("comp")), "copies-posts")
    live = C.stash(posts.groupBy("g").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo <> _hi").select("g"), "copies-live")
    return posts.join(_light(live), "g")


def _pairs_within(posts: DataFrame, similarity: float, chunk: int, exact: bool = False) -> DataFrame:
    """The pairs (a, b) that _unconnected finds in postings (g, node, n, fp, comp), dealt out in chunks of members."""
    posts = C.stash(posts, "copies-posts")
    sizes = C.stash(posts.groupBy("g").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")), "copies-sizes")
    posts = posts.join(_light(sizes), "g").withColumn("c", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    lists = posts.groupBy("g", "c").agg(F.collect_list(F.struct("node", "n", "comp", "fp")).alias("m"), F.first("chunks").alias("chunks"))
    lists = lists.select("g", "c", "chunks", "m.node", "m.n", "m.comp", F.flatten("m.fp").alias("fp"))
    names = ["node", "n", "comp", "fp"]
    alone = lists.select("g", *names, *[F.lit(None).cast("array<bigint>").alias(f"{x}2") for x in names])
    # chunk pairs of a large posting meet in tasks of their own
    large = C.stash(lists.where("chunks > 1"), "copies-chunks")
    paired = large.select("g", *names, F.explode(F.expr("filter(sequence(0, chunks - 1), o -> o > c)")).alias("o"))
    paired = paired.join(large.select("g", F.col("c").alias("o"), *[F.col(x).alias(f"{x}2") for x in names]), ["g", "o"]).drop("o")
    more = alone.unionByName(paired).mapInPandas(_unconnected(similarity, exact), "a long, b long, need long, met long")
    return C.stash(more.groupBy("a", "b", "need").agg(F.sum("met").alias("met")).where("met >= need").select("a", "b"), "copies-more")


def _common(docs: DataFrame, key: str, shingle: int) -> np.ndarray:
    """Hashes of the shingles that COMMON or more of one in SAMPLE texts hold, rarer ones first."""
    some = docs.where(F.pmod(F.xxhash64(key), F.lit(SAMPLE)) == 0).mapInArrow(_sets(shingle), _SETS)
    often = some.select(F.explode("grams").alias("g")).groupBy("g").count().where(F.col("count") >= COMMON)
    found = often.orderBy(F.desc("count"), "g").limit(MOST_COMMON).select("g").toPandas()["g"].to_numpy(np.int64)
    return found[::-1].copy().view(np.uint64)


def _missed(rest: DataFrame, twins: DataFrame, links: DataFrame, docs: DataFrame, key: str, shingle: int, similarity: float, chunk: int) -> DataFrame:
    """Links (a, b) at the similarity between sets that links leaves in different components: a join of prefixes."""
    once = C.without_rows(docs, twins.select(F.col("key").alias("_twin")), docs[key] == F.col("_twin"))
    so_far = _light(C.stash(components(links, "copies-stars"), "copies-components"))
    first = once.mapInArrow(_prefixes(shingle, similarity, _common(once, key, shingle)), "g long, node long")
    first = C.stash(first, "copies-prefixes")
    comp = F.coalesce("component", "node")
    live = first.join(so_far, "node", "left").groupBy("g").agg(F.min(comp).alias("_lo"), F.max(comp).alias("_hi")).where("_lo <> _hi")
    live = C.stash(live.select("g"), "copies-live")
    posts = C.stash(first.join(_light(live), "g"), "copies-postings")
    known = rest.join(_light(C.stash(posts.select("node").distinct(), "copies-nodes")), "node", "left_semi")
    known = known.join(so_far, "node", "left").select("node", "n", F.slice("fp", LONGS + 1, CELLS // 64).alias("fp"), comp.alias("comp"))
    return _alike(_pairs_within(posts.join(known, "node"), similarity, chunk, exact=True), docs, key, shingle, similarity)


def near_copies(docs: DataFrame, key: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, chunk: int = CHUNK) -> DataFrame:
    """key, component: the smallest key that a row reaches over pairs at the similarity; rows without such a pair are left out.

    Keys are unique whole numbers. Texts without words, null ones among them, are alike.
    """
    docs = docs.select(F.col(key).cast("long").alias(key), text_col)
    C.small_batches(docs.sparkSession)
    signed = C.stash(docs.mapInArrow(_sign(shingle), "key long, n long, digest binary, fp array<bigint>"), "copies-signed")
    firsts = signed.groupBy("digest").agg(F.min("key").alias("node"), F.count("*").alias("_rows")).where("_rows > 1")
    twins = C.stash(signed.select("key", "digest").join(firsts, "digest").where("key <> node").select("key", "node"), "copies-twins")
    rest = C.without_rows(signed, twins, signed["key"] == twins["key"]).where("n > 0").select(F.col("key").alias("node"), "n", "fp")

    posts = rest.select("node", "fp").mapInArrow(_postings, "g long, node long")
    often = C.stash(posts.groupBy("g").count().where("count > 1").select("g"), "copies-shared")
    posts = posts.join(_light(often), "g").join(rest, "node")
    posts = C.stash(posts.select("g", "node", "n", "fp", F.col("node").alias("comp")), "copies-posts")
    links = None
    for drawn in (False, True):
        tried = _hub_pairs(posts, drawn, similarity)
        found = C.stash(_alike(tried, docs, key, shingle, similarity), "copies-links")
        links = found if links is None else links.unionByName(found)
        posts = _live(posts, links)

    links = links.unionByName(_alike(_pairs_within(posts, similarity, chunk), docs, key, shingle, similarity))
    links = links.unionByName(_missed(rest, twins, links, docs, key, shingle, similarity, chunk))

    linked = C.stash(components(links, "copies-stars"), "copies-linked")
    twin = twins.select("key", "node").unionByName(twins.select(F.col("node").alias("key"), "node").distinct())
    twin = twin.join(linked, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    return C.stash(linked.select(F.col("node").alias("key"), "component").unionByName(twin).distinct(), "copies-found")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest id (null last); same columns.

    Only the list of rows that go is joined to the texts. Where ids are null or repeat, rows are told apart by the row
    numbers of a stored copy, and the first of equal ids stays.
    """
    if C.unique_ids(docs, id_col):
        gone = near_copies(docs, id_col, text_col, shingle, similarity).where("key <> component").select(F.col("key").alias("_gone"))
        return C.without_rows(docs, gone, docs[id_col] == gone["_gone"])
    (key,) = C.fresh(docs, "_k")
    kept = C.stash(docs.withColumn(key, F.monotonically_increasing_id()), "copies-rows")
    near = near_copies(kept, key, text_col, shingle, similarity).join(kept.select(F.col(key).alias("key"), F.col(id_col).alias("_id")), "key")
    lead = near.groupBy("component").agg(F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("key").alias("k"))).alias("_m"))
    gone = C.stash(near.join(lead, "component").where(F.col("key") != F.col("_m.k")).select(F.col("key").alias("_gone")), "copies-gone")
    return C.without_rows(kept, gone, kept[key] == gone["_gone"]).drop(key)
