"""The named queries of the corpus operators, with production parameters, over whole tables; SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochfold.llm import common as C
from epochfold.llm import decontaminate, filter_audit, licenses, lines, media, mixing, quality, repeats, search, simhash, token_files, toxicity, url_filter
from epochfold.llm.simhash_sql import fingerprints_sql

# The url rules, and the sites listed as blocked.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
LISTED_SITES = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED = [(f"{s}.example.{t}", "/") for s in LISTED_SITES for t in ("com", "net", "org")]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.plan_mix(C.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = (F.col("size") * F.size("placements")).cast("long")
    shards = F.array_sort(F.transform("placements", lambda p: p["shard"]))
    return mix.select("doc_id", "size", "source_size", "target", taken.alias("taken"), shards.alias("shards"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_same")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = C.table(spark, sf_dir, "pages").select("page_id", "url")
    values = lambda rows, names: spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, rows))} AS t({names})")
    rules, listed = values(URL_RULES, "host, path, verdict"), values(LISTED, "host, path")
    return url_filter.url_filter(pages, rules, listed).drop("url")


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(C.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("n_blocks", F.size("blocks").cast("long")).drop("blocks")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(C.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, C.table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.classify(docs, model)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, C.table(spark, sf_dir, "benchmark").select("item_id", "text"))


def tokenizer_path() -> str:
    """The public byte-level vocabulary; a file that driver and executors find at the same place."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.through_files(C.table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


# The audited filters, as the conditions under which a document fails them.
AUDITED = {"A": "n_words < 100", "B": "100 * n_distinct < 80 * n_words", "C": "100 * n_upper > 10 * n_chars", "D": "marked", "E": "copy"}


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filter_audit.measures(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
    return filter_audit.audit(rows, AUDITED, {"good_lost": "good", "toxic_lost": "toxic"}).drop("filter")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.rank(docs, C.table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.classify(docs, toxicity.train(docs, C.table(spark, sf_dir, "labels").select("doc_id", "toxic")))


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
_LISTED_ROWS = ", ".join(f"('{h}')" for h, _ in LISTED)
_OP3_SQL = f"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{C.UPPER}', '{C.LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
r(h, q, v) AS (VALUES {_RULE_ROWS}), listed(h) AS (VALUES {_LISTED_ROWS}),
k AS (SELECT DISTINCT host, path FROM p),
ruled AS (
  SELECT host, path, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS verdict
  FROM k JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY ALL),
blocked AS (
  SELECT DISTINCT host, path FROM (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '\\.*(:[0-9]*)?$', '') AS bare FROM k)
  JOIN listed ON bare = h OR ends_with(bare, '.' || h))
SELECT page_id, host, path, ruled.rule AS rule,
       coalesce(ruled.verdict, CASE WHEN blocked.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN ruled USING (host, path) LEFT JOIN blocked USING (host, path)
"""


_TEMPLATE_ROWS = ", ".join(f"({k}, '{label}', {sorted(set(licenses._words(t)))!r})" for k, (label, t) in enumerate(licenses.TEMPLATES))
_PHRASE_ROWS = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in licenses.PHRASES)
_SPACED = lambda c: f"regexp_replace(' ' || translate(coalesce({c}, ''), '{C.UPPER}', '{C.LOWER}') || ' ', '{C.ALNUM_GAP}', ' ', 'g')"
_OP6_SQL = f"""
WITH phrase(p, label, n) AS (VALUES {_PHRASE_ROWS}),
template(k, label, words) AS (VALUES {_TEMPLATE_ROWS}),
d AS (SELECT doc_id, text, string_split(trim({_SPACED("text")}), ' ') AS w FROM documents),
place AS (
  SELECT doc_id, label, i FROM d JOIN phrase ON contains({_SPACED("text")}, ' ' || p || ' '),
         unnest(range(0, len(w) - n + 1)) AS u(i)
  WHERE array_to_string(w[i + 1 : i + n], ' ') = p),
base AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
         list_sort(list_distinct(list(label))) AS own FROM place GROUP BY doc_id),
split AS (SELECT doc_id, i, list_distinct(string_split(trim({_SPACED("l[i]")}), ' ')) AS w
          FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM d), unnest(range(1, len(l) + 1)) AS u(i)),
line AS (SELECT doc_id, i, false AS two, w FROM split
         UNION ALL SELECT a.doc_id, a.i, true, list_distinct(list_concat(a.w, b.w)) FROM split a JOIN split b ON a.doc_id = b.doc_id AND b.i = a.i + 1),
every AS (
  SELECT doc_id, i, two, k, label, len(list_intersect(words, w))::DOUBLE / len(words) AS c FROM line JOIN template ON list_has_any(words, w)
  WHERE len(list_intersect(words, w)) >= ceil({licenses.CONTAINMENT} * len(words) - 1e-9)),
hit AS (SELECT * FROM every h WHERE NOT two OR NOT EXISTS (
  SELECT 1 FROM every o WHERE NOT o.two AND o.doc_id = h.doc_id AND o.k = h.k AND o.i IN (h.i, h.i + 1))),
alike AS (SELECT doc_id, list(label) AS more, max(c) AS best, count(*) AS n_blocks FROM hit GROUP BY doc_id)
SELECT doc_id, CASE WHEN w = [''] THEN 0 ELSE len(w) END AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       array_to_string(coalesce(own, []), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score, coalesce(n_blocks, 0) AS n_blocks
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN alike USING (doc_id)
"""


_OP4_SQL = f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
marked AS (SELECT doc_id, i, l[i] AS x, len(l) AS n,
           ('0x' || substr(md5((CASE WHEN i > 1 THEN md5(l[i - 1]) ELSE '' END) || md5(l[i])), 1, 4))::INT % {lines.MEAN_LINES} = 0 AS mark
         FROM d, unnest(range(1, len(l) + 1)) AS u(i)),
line AS (SELECT *, i = n OR (i >= 2 AND i <> n - 1 AND mark AND NOT lag(mark) OVER (PARTITION BY doc_id ORDER BY i)) AS ends FROM marked),
numbered AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM line),
chunk AS (SELECT doc_id, c, count(*) AS n, string_agg(x, chr(10) ORDER BY i) AS t FROM numbered GROUP BY doc_id, c),
ranked AS (SELECT doc_id, c, n, t, n >= {lines.LEAST_LINES} AND row_number() OVER (PARTITION BY n >= {lines.LEAST_LINES}, t ORDER BY doc_id, c) > 1 AS gone FROM chunk),
kept AS (SELECT doc_id, sum(n) AS n_lines, sum(CASE WHEN gone THEN n ELSE 0 END) AS n_removed,
                coalesce(string_agg(t, chr(10) ORDER BY c) FILTER (WHERE NOT gone), '') AS t FROM ranked GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(t) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""


_COVERED = lambda source, n: f"""run AS (SELECT doc_id, i, sum(first::INT) OVER (PARTITION BY doc_id ORDER BY i) AS r
      FROM (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > {n}, true) AS first FROM {source}))
    SELECT doc_id, r, min(i) AS a, max(i) + {n} AS b FROM run GROUP BY doc_id, r"""  # noqa: E731
_OP5_SQL = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw, string_split_regex(trim(regexp_replace(translate(coalesce(text, ''), '{C.UPPER}', '{C.LOWER}'), '[ \\x09-\\x0D]+', ' ', 'g')), ' ') AS w FROM documents),
string AS (SELECT doc_id, i, md5(raw[i : i + {repeats.LENGTH - 1}]) AS h FROM d, unnest(range(1, octet_length(raw) - {repeats.LENGTH - 2})) AS u(i)),
twice AS (SELECT doc_id, i FROM string QUALIFY count(*) OVER (PARTITION BY h) > 1),
span AS (WITH {_COVERED('twice', repeats.LENGTH)}),
piece AS (SELECT d.doc_id, a, raw[lag(b, 1, 1) OVER (PARTITION BY d.doc_id ORDER BY a) : a - 1] AS x FROM d JOIN span USING (doc_id)
          UNION ALL SELECT d.doc_id, max(b), any_value(raw)[max(b) : octet_length(any_value(raw))] FROM d JOIN span USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, sha256(unhex(string_agg(hex(x), '' ORDER BY a))) AS kept_sha256 FROM piece GROUP BY doc_id),
gone AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id),
phrase AS (SELECT doc_id, i, md5(array_to_string(w[i : i + {repeats.PASSAGE - 1}], ' ')) AS h FROM d, unnest(range(1, len(w) - {repeats.PASSAGE - 2})) AS u(i)),
shared AS (SELECT doc_id, i FROM phrase QUALIFY min(doc_id) OVER (PARTITION BY h) <> max(doc_id) OVER (PARTITION BY h)),
passage AS (WITH {_COVERED('shared', repeats.PASSAGE)}),
told AS (SELECT doc_id, count(*) AS n_passages, sum(b - a) AS passage_words FROM passage GROUP BY doc_id)
SELECT doc_id, octet_length(raw)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       coalesce(kept_sha256, sha256(raw)) AS kept_sha256, coalesce(n_passages, 0)::BIGINT AS n_passages, coalesce(passage_words, 0)::BIGINT AS passage_words
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN told USING (doc_id)
"""


_ALNUM_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{C.UPPER}', '{C.LOWER}'), '[^{C.ALNUM_GAP[1:-2]}]+')"
_OP9_SQL = f"""
WITH item AS (SELECT row_number() OVER () AS key, item_id, w, len(w) AS n, least(len(w), {decontaminate.SHINGLE}) AS k
              FROM (SELECT DISTINCT item_id, {_ALNUM_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
item_gram AS (SELECT key, n, k, i AS place, array_to_string(w[i + 1 : i + k], ' ') AS g FROM item, unnest(range(0, n - k + 1)) AS u(i)),
d AS (SELECT doc_id, w, len(w) AS m FROM (SELECT doc_id, {_ALNUM_WORDS} AS w FROM documents) WHERE len(w) > 0),
doc_gram AS (SELECT doc_id, m, k, i AS pos, array_to_string(w[i + 1 : i + k], ' ') AS g FROM d, (SELECT DISTINCT k FROM item), unnest(range(0, m - k + 1)) AS u(i)),
hit AS (SELECT DISTINCT doc_id, key, n, k, greatest(0, least(pos - place, m - n)) AS start FROM doc_gram JOIN item_gram USING (k, g)),
near AS (SELECT *, lead(start) OVER (PARTITION BY doc_id, key ORDER BY start) - start AS gap FROM hit),
win AS (SELECT DISTINCT doc_id, n, k, start + b AS start FROM near,
        unnest(range(0, CASE WHEN gap <= ceil((1 - {decontaminate.SIMILARITY}::DOUBLE) * (n - k + 1)) + 1 THEN gap ELSE 1 END)) AS u(b)),
win_gram AS (SELECT doc_id, n, start, array_to_string(w[start + i + 1 : start + i + k], ' ') AS g, count(*) AS c
             FROM win JOIN d USING (doc_id), unnest(range(0, least(n, m) - k + 1)) AS u(i) GROUP BY ALL),
counted AS (SELECT key, n, g, count(*) AS c FROM item_gram GROUP BY ALL),
alike AS (SELECT doc_id, key, start, sum(least(a.c, b.c))::DOUBLE AS weight FROM win_gram a JOIN counted b USING (n, g) GROUP BY doc_id, key, start),
found AS (SELECT doc_id, item_id, start, weight / (n - k + 1) AS similarity FROM alike JOIN item USING (key) WHERE weight / (n - k + 1) >= {decontaminate.SIMILARITY}::DOUBLE)
SELECT doc_id, item_id, start::INT AS start, similarity FROM found
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""


_OP11_SQL = """
WITH m AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
labelled AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
flag AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (CASE WHEN len(w) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS fails
  FROM m LEFT JOIN labelled USING (doc_id)),
letter(k, x) AS (VALUES (0, 'A'), (1, 'B'), (2, 'C'), (3, 'D'), (4, 'E')),
step AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, s AS step, list_value(a.k, b.k, c.k, d.k, e.k)[s] AS k,
         list_sum(list_transform(list_value(a.k, b.k, c.k, d.k, e.k)[1 : s - 1], lambda j: 1 << j)) AS before
  FROM letter a, letter b, letter c, letter d, letter e, range(1, 6) AS r(s)
  WHERE len(list_distinct(list_value(a.k, b.k, c.k, d.k, e.k))) = 5),
told AS (SELECT filter_order, step::INT AS step, k, coalesce(before, 0)::INT AS before FROM step),
edge AS (SELECT DISTINCT k, before FROM told),
counted AS (
  SELECT part, k, before, count(*) FILTER (WHERE fails & (before | (1 << k)) = 0) AS kept, count(*) FILTER (WHERE fails & before = 0 AND fails & (1 << k) <> 0) AS removed,
         count(*) FILTER (WHERE fails & before <> 0 AND fails & (1 << k) <> 0) AS redundant, count(*) FILTER (WHERE fails = 1 << k) AS unique_fails,
         count(*) FILTER (WHERE fails & before = 0 AND fails & (1 << k) <> 0 AND good) AS good_lost,
         count(*) FILTER (WHERE fails & before = 0 AND fails & (1 << k) <> 0 AND toxic) AS toxic_lost
  FROM flag, edge GROUP BY part, k, before)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, k)::BIGINT AS shapley
FROM told JOIN counted USING (k, before)
"""
_TERMS = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), '{C.UPPER}', '{C.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_OP12_SQL = f"""
WITH d AS (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {_TERMS("text")} AS w FROM documents) WHERE len(w) > 0),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
q AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({_TERMS("text")}) AS term FROM benchmark) GROUP BY ALL),
held AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM held, total GROUP BY term, n_docs),
impact AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - {search.B} + ({search.B} * n * n_docs) // n_terms))) AS i FROM held JOIN weight USING (term), total),
scored AS (SELECT item_id, doc_id, sum(repeats * i)::BIGINT AS score FROM q JOIN impact USING (term) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY rank <= {search.K}
"""


def queries() -> dict:
    every = [
        op1_mixing, op2_simhash, op3_url_filter, op4_lines, op5_repeats, op6_licenses, op7_media, op8_quality, op9_decontamination, op10_tokens,
        op11_filter_audit, op12_search, op13_toxicity,
    ]
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_simhash": fingerprints_sql(4, simhash.BITS), "op3_url_filter": _OP3_SQL, "op4_lines": _OP4_SQL, "op5_repeats": _OP5_SQL, "op6_licenses": _OP6_SQL,
        "op9_decontamination": _OP9_SQL, "op11_filter_audit": _OP11_SQL, "op12_search": _OP12_SQL,
    }
