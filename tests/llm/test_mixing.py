import random
import re
from collections import Counter

from epochfold.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, extra int"


def targets(sizes: dict) -> dict:
    """Shares by weight, the excess of full sources reshared until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = float(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in full]
        rest, all_w = total - sum(full.values()), sum(w[s] for s in free)
        got = {s: rest * w[s] / all_w for s in free}
        over = [s for s in free if got[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return full | got
        full |= {s: 3.0 * sizes[s] for s in over}


def test_mix(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join("w" * rnd.randint(1, 9) for _ in range(rnd.randint(1, 60))), rnd.choice(["a", "a", "a", "b", "c", "é", "", None]), "x", 1) for i in range(1500)]
    rows += [(2000, None, "a", "x", 1), (2001, "", "only-empty", "x", 1), (None, "a b", "b", None, None), (3007, "same row", "c", "x", 1), (3007, "same row", "c", "x", 1), (2002, "word " * 3000, "a", "x", 1)]
    out = mixing.plan_mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    assert "extra" in out[0].asDict()
    by_id = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    assert all(r.size == by_id[r.doc_id] for r in out)
    sizes, taken = Counter(), Counter()
    for r in out:
        sizes[r.source] += r.size
        taken[r.source] += r.size * len(r.placements)
        assert len(r.placements) <= 3
    want = targets(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
    for s, n in taken.items():
        assert abs(n - want[s]) <= max(30, 0.02 * want[s]), s
    again = mixing.plan_mix(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)).collect()
    key = lambda r: (str(r.doc_id), r.size, str(r.placements))
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_rows_of_the_mix(spark):
    rows = [(i, "a b c", "ab"[i % 2], "x", 1) for i in range(200)]
    mix = mixing.plan_mix(spark.createDataFrame(rows, SCHEMA), block_docs=4)
    got = mixing.mixed_rows(mix, ["doc_id", "text", "source"]).collect()
    assert len(got) == sum(len(r.placements) for r in mix.collect())
    assert len({(r.doc_id, r["pass"]) for r in got}) == len(got)


def test_tree_splits_quotas_exactly(spark):
    quotas = spark.createDataFrame([(1, 1000), (2, 3), (3, 0), (4, 57)], "_sid int, quota long")
    runs = mixing.splitting_tree(quotas, 8, 5).collect()
    for s, q in ((1, 1000), (2, 3), (3, 0), (4, 57)):
        own = sorted((r._from, r._to) for r in runs if r._sid == s)
        assert sum(b - a for a, b in own) == q
        assert all(x[1] == y[0] for x, y in zip(own, own[1:]))
    loads = Counter()
    for r in runs:
        loads[r.shard] += r._to - r._from
    assert max(loads.values()) - min(loads.values()) <= 2


def test_hypergeometric_mean(spark):
    from pyspark.sql import functions as F

    df = spark.range(2000).select(mixing.hypergeometric(F.lit(400).cast("long"), F.lit(90).cast("long"), F.lit(200).cast("long"), (F.col("id") + 0.5) / 2000.0).alias("k"))
    r = df.agg(F.avg("k"), F.stddev_pop("k")).first()
    assert abs(r[0] - 45) < 0.05 and abs(r[1] - (200 * 0.225 * 0.775 * 200 / 399) ** 0.5) < 0.1


def test_empty(spark):
    assert mixing.plan_mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.plan_mix(spark.createDataFrame([(1, None, None, "x", 1)], SCHEMA)).first().target == 0


def test_null_and_repeated_ids_come_near_the_target(spark):
    for ids in (lambda i: None, lambda i: i % 6):
        rows = [(ids(i), " ".join(f"w{i}x{j}" for j in range(10)), "ab"[i % 2], "x", 1) for i in range(600)]
        out = mixing.plan_mix(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
        taken, want = Counter(), {r.source: r.target for r in out}
        for r in out:
            taken[r.source] += r.size * len(r.placements)
        assert len(out) == 600 and all(abs(taken[s] - want[s]) <= 10 for s in "ab")


def test_any_column_name_is_kept(spark):
    names = ["_sid", "_blocks", "_s", "_h", "_b", "source_size", "doc0_", "_places", "shard", "pass", "_key", "_own_size"]
    rows = [(i, "a b c", "ab"[i % 2], *[f"{n}{i}" for n in names]) for i in range(60)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    got = mixing.mix_documents(df)
    assert got.columns == df.columns
    assert {tuple(r) for r in got.collect()} <= set(rows) and got.count() >= 30
    assert "_h7" in {r["_h"] for r in mixing.plan_mix(df).collect()}


def test_columns_of_the_plans_own_names_are_kept(spark):
    rows = [(i, "two words", "a", i, str(i), -i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _p long, _key string, _h long")
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= set(rows)
