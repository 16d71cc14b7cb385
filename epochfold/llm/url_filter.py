"""URL filters: a blocked Bloom filter of listed entries, then an exact hash join.

An entry is a host and a path; it fits the host and its subdomains where the url's path starts with its own (a listed
page's: ends there or goes on with a slash). A url's probes are its host's suffixes with its path's prefixes, of the
lengths that the list has. Probes whose bits are all set in their block of the filter go to an exact join with the list,
which removes false positives.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochfold.llm import common as C

#: Bits of the filter for each entry, and bits set by each; a block is 256 bits, in four words.
BITS, HASHES, BLOCK = 16, 6, 256
#: A filter or list up to so many entries (about 100 MB) is broadcast; a larger one is joined by shuffle.
FEW = 1_000_000
#: Most path lengths that are probed one by one; a list with more of them is probed at every length.
MOST_LENGTHS = 2048

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://` or for null."""
    u = F.coalesce(url, F.lit(""))
    return C.ascii_lower(F.regexp_extract(u, _PARTS, 1)), F.regexp_extract(u, _PARTS, 2)


def _where(key: Column, blocks: int) -> tuple[Column, Column]:
    """The block of a key and its bits there, as (word, mask) pairs in one array."""
    h = F.xxhash64(key)
    bits = [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BLOCK)) for i in range(HASHES)]
    return F.pmod(h, F.lit(blocks)), F.array(*bits)


def bloom(entries: DataFrame, key: str, blocks: int) -> DataFrame:
    """Rows (block, w0..w3): the bits that the entries' keys set in each block; blocks without any are absent."""
    block, bits = _where(F.col(key), blocks)
    rows = entries.select(block.alias("block"), F.explode(bits).alias("bit"))
    word = lambda i: F.bit_or(F.when(F.expr(f"bit div 64 = {i}"), F.expr("shiftleft(1L, cast(bit % 64 as int))")).otherwise(F.lit(0).cast("long"))).alias(f"w{i}")
    return rows.groupBy("block").agg(*[word(i) for i in range(BLOCK // 64)])


def best_entries(urls: DataFrame, entries: DataFrame, at_slash: bool = False) -> DataFrame:
    """urls(host, path) and entries(host, path, ...) joined to the longest entry that fits each distinct url.

    Longest by host and path together, then by host, then the smaller entry by code point. With at_slash, a url's path
    goes on with a slash, if at all, where the entry's ends.
    """
    entries = C.stash(entries.dropDuplicates(["host", "path"]).withColumn("_key", F.concat_ws("\u0000", "host", "path")), "url-list")
    n, found = entries.count(), [r[0] for r in entries.select(F.length("path").alias("n")).distinct().limit(MOST_LENGTHS + 1).collect()]
    blocks = max(1, math.ceil(n * BITS / BLOCK))
    small = F.broadcast if n <= FEW else (lambda df: df)
    lengths = F.array(*[F.lit(x) for x in sorted(found)]) if len(found) <= MOST_LENGTHS else F.sequence(F.lit(0), F.length("path"))
    # suffixes at label borders: everything from the i-th label on
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    whole = lambda k: (k == F.length("path")) | (F.substring(F.col("path"), k + 1, F.lit(1)) == "/")
    fitting = lambda k: (k <= F.length("path")) & whole(k) if at_slash else k <= F.length("path")
    prefixes = F.transform(F.filter(lengths, fitting), lambda k: F.substring(F.col("path"), F.lit(1), k))
    probes = urls.select("host", "path").distinct().where("host <> '' or path <> ''")
    probes = probes.select("host", "path", F.explode(suffixes).alias("_h")).select("*", F.explode(prefixes).alias("_p"))
    probes = probes.withColumn("_key", F.concat_ws("\u0000", "_h", "_p"))
    block, bits = _where(F.col("_key"), blocks)
    probes = probes.select("*", block.alias("block"), bits.alias("_bits"))
    words = F.array(*[F.col(f"w{i}") for i in range(BLOCK // 64)])
    hits = probes.join(small(bloom(entries, "_key", blocks)), "block").withColumn("_words", words)
    hits = hits.where(F.expr("forall(_bits, b -> (shiftright(_words[cast(b div 64 as int)], cast(b % 64 as int)) & 1) = 1)"))
    exact = hits.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "_key").join(small(entries), "_key")
    rank = F.struct((F.length("host") + F.length("path")).alias("a"), F.length("host").alias("b"))
    best = exact.groupBy("_host", "_path").agg(F.max_by(F.struct(*[c for c in entries.columns if c != "_key"]), rank).alias("entry"))
    return best.select(F.col("_host").alias("host"), F.col("_path").alias("path"), "entry")


def canonical(host: Column, path: Column) -> tuple[Column, Column]:
    """The form in which pages are listed: host without user, `www.`, port and final dots, path without trailing slashes."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.*(:[0-9]*)?$", "")
    return F.regexp_replace(bare, r"^www\.", ""), F.regexp_replace(path, "/+$", "")


def url_filter(pages: DataFrame, rules: DataFrame, listed: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict. rules(host, path, verdict); listed(host, path) are blocked sites or pages.

    A rule that fits decides; else a listed entry blocks; else the url is allowed. Pages and listed entries are compared in
    canonical form, so user names, `www.`, ports, a final dot and trailing slashes make no difference. A listed page
    blocks itself and what lies below it: `/x` or `/x/` blocks `/x`, `/x/` and `/x/y`, but not `/xylophone`.

    Defined cases: a null url or one without `://` has an empty host and path, no rule, and is allowed; repeated rows
    are judged each; an empty list allows everything; columns of pages named like the added ones, in any case, are
    replaced, and all others are kept whatever their names.
    """
    added = ("host", "path", "rule", "verdict")
    inner = {c: f"page{i}_" for i, c in enumerate(pages.columns)}
    host, path = url_parts(F.col(inner[url_col]))
    base = pages.toDF(*inner.values()).withColumn("host", host).withColumn("path", path)
    entries = rules.select("host", "path", "verdict", F.lit(True).alias("is_rule"))
    chost, cpath = canonical(F.col("host"), F.col("path"))
    lhost, lpath = canonical(C.ascii_lower(F.col("host")), F.col("path"))
    more = listed.select(lhost.alias("host"), lpath.alias("path"), F.lit("block").alias("verdict"), F.lit(False).alias("is_rule"))
    ruled = best_entries(base.select("host", "path"), entries).select("host", "path", F.concat("entry.host", "entry.path").alias("rule"), F.col("entry.verdict").alias("_by_rule"))
    base = base.withColumn("_ch", chost).withColumn("_cp", cpath)
    found = best_entries(base.select(F.col("_ch").alias("host"), F.col("_cp").alias("path")), more, at_slash=True)
    found = found.select(F.col("host").alias("_ch"), F.col("path").alias("_cp"), F.col("entry.verdict").alias("_by_list"))
    out = base.join(ruled, ["host", "path"], "left").join(found, ["_ch", "_cp"], "left")
    kept = [F.col(i).alias(c) for c, i in inner.items() if c.lower() not in added]
    return out.select(*kept, "host", "path", "rule", F.coalesce("_by_rule", "_by_list", F.lit("allow")).alias("verdict"))
