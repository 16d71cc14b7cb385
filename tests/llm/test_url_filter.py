from epochfold.llm import queries, url_filter


def brute(url):
    u = url or ""
    if "://" not in u:
        return "", "", None, "allow"
    rest = u.split("://", 1)[1]
    i = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:i], rest[i:]
    j = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    path = tail[:j]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    bare = host.split("@")[-1].split(":")[0].rstrip(".")
    if any(bare == h or bare.endswith("." + h) for h, _ in queries.LISTED):
        return host, path, None, "block"
    return host, path, None, "allow"


URLS = [None, "", "no scheme", "http://", "http://Example.ORG/en/1", "http://example.org/en/12", "http://a.example.org/en/2", "http://notexample.org/es/", "https://x.com/fr/y?q#z", "https://x.com/fr", "http://com/de/", "http://x.com?/de/", "http://ads-track.example.com:80/de", "http://ads-track.example.net/x", "http://x.net/a\nb#c", "http://É.org/É", "a://b://c.org/", "http://org/", "http://x.com/de/1", "http://www.spam-farm.example.com/", "http://spam-farm.example.com", "http://spam-farm.example.com.:8/", "http://u:p@spam-farm.example.org?q"]


def test_against_brute_force(spark):
    rows = [(i, u, "clash", 1) for i, u in enumerate(URLS * 2)] + [(0, URLS[4], "clash", 1), (None, URLS[4], None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, extra int")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame(queries.LISTED, "host string, path string")
    out = url_filter.url_filter(pages, rules, listed).collect()
    assert len(out) == len(rows) and out[0].extra in (1, None)
    key = repr
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out), key=key) == sorted(((i, *brute(u)) for i, u, _, _ in rows), key=key)


def test_empty_list_and_table(spark):
    pages = spark.createDataFrame([(1, URLS[4])], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    listed = spark.createDataFrame([], "host string, path string")
    assert [r.verdict for r in url_filter.url_filter(pages, rules, listed).collect()] == ["allow"]
    assert url_filter.url_filter(pages.limit(0), rules, listed).count() == 0


def test_bloom_has_no_false_negative(spark):
    from pyspark.sql import functions as F

    keys = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"))
    bits = url_filter.bloom(keys, "key", 8)
    block, where = url_filter._where(F.col("key"), 8)
    hit = keys.select("key", block.alias("block"), where.alias("b")).join(bits, "block").withColumn("w", F.array("w0", "w1", "w2", "w3"))
    assert hit.where(F.expr("forall(b, b -> (shiftright(w[cast(b div 64 as int)], cast(b % 64 as int)) & 1) = 1)")).count() == 500


def test_listed_www_and_clashing_names(spark):
    pages = spark.createDataFrame([(1, "http://www.bad.com/x", "a", "b"), (2, "http://bad.com:8080/", "c", "d"), (3, "http://sub.bad.com/y", "e", "f"), (4, "http://notbad.com/", "g", "h")], "page_id long, url string, _ch string, _by_rule string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    listed = spark.createDataFrame([("www.Bad.com", "/")], "host string, path string")
    out = sorted(url_filter.url_filter(pages, rules, listed).collect())
    assert [(r.verdict, r["_ch"], r["_by_rule"]) for r in out] == [("block", "a", "b"), ("block", "c", "d"), ("block", "e", "f"), ("allow", "g", "h")]


def test_listed_pages_end_at_a_slash_and_hosts_are_bare(spark):
    urls = {
        "http://bad.com/x": "block", "http://bad.com/x/": "block", "http://bad.com/x/y?q": "block", "http://bad.com/xylophone": "allow", "http://bad.com/": "allow",
        "http://u@bad.com/x": "block", "http://bad.com./x": "block", "http://bad.com.:80/x//": "block", "http://worse.org": "block", "http://a.worse.org/any": "block",
        "http://bad.com/page.html": "block", "http://bad.com/page.html5": "allow", "http://bad.com/y": "block", "http://bad.com/yy": "allow",
    }
    pages = spark.createDataFrame(list(urls), "string").toDF("url")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    listed = spark.createDataFrame([("bad.com", "/x/"), ("worse.org", "/"), ("bad.com", "/page.html"), ("bad.com", "/y")], "host string, path string")
    assert {r.url: r.verdict for r in url_filter.url_filter(pages, rules, listed).collect()} == urls


def test_names_that_differ_by_case_are_replaced(spark):
    pages = spark.createDataFrame([("http://a.com/b", "h", "p")], "URL string, Host string, _key string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    out = url_filter.url_filter(pages, none, none, url_col="URL")
    assert out.columns == ["URL", "_key", "host", "path", "rule", "verdict"] and tuple(out.first()) == ("http://a.com/b", "p", "a.com", "/b", None, "allow")
