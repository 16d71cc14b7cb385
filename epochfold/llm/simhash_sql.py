"""Fingerprints and groups of op2 as DuckDB SQL; XXH64 is spelled out in 128-bit whole numbers."""

from __future__ import annotations

from epochfold.llm import common as C

# The primes of XXH64 and the seed.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
SEED = 42
_MOD = 1 << 64
_MASK = f"{_MOD - 1}::UHUGEINT"


def _n(v: int) -> str:
    return f"{v % _MOD}::UHUGEINT"


def _low(x: str) -> str:
    return f"(({x}) & {_MASK})"


def _times(x: str, p: int) -> str:
    return _low(f"({x}) * {_n(p)}")


def _rotated(x: str, r: int) -> str:
    """x turned left by r bits: the lower and the upper half of its product with 2^r."""
    return f"((({x}) * {_n(1 << r)} & {_MASK}) + (({x}) >> {64 - r}))"


def _round(acc: str, lane: str) -> str:
    return _times(_rotated(_low(f"{acc} + {_times(lane, P2)}"), 31), P1)


def _lane(at: str, n: int) -> str:
    """The n bytes of hex text x from byte `at` (from 0), the first one lowest, as a number."""
    return "('0x' || " + " || ".join(f"substr(x, 2 * ({at} + {j}) + 1, 2)" for j in reversed(range(n))) + ")::UBIGINT::UHUGEINT"


def hash_sql(source: str, column: str) -> str:
    """SELECT of each distinct text of source's column with its XXH64 as h (UBIGINT)."""
    chains = [_n(SEED + P1 + P2), _n(SEED + P2), _n(SEED), _n(SEED - P1)]
    stripes = ", ".join(f"list_reduce(list_transform(range(n // 32), lambda s: {_lane(f'(32 * s + {8 * j})', 8)}), lambda acc, lane: {_round('acc', 'lane')}, {v}) AS v{j}" for j, v in enumerate(chains))
    joined = _low(" + ".join(_rotated(f"v{j}", r) for j, r in enumerate((1, 7, 12, 18))))
    merged = ", ".join(f"{_low(_times(f'xor(m{j}, {_round(_n(0), f"v{j}")})', P1) + f' + {_n(P4)}')} AS m{j + 1}" for j in range(4))
    eights = f"list_reduce(list_transform(range((n % 32) // 8), lambda s: {_lane('(n // 32 * 32 + 8 * s)', 8)}), lambda acc, lane: {_low(_times(_rotated(f'xor(acc, {_round(_n(0), "lane")})', 27), P1) + f' + {_n(P4)}')}, t0)"
    four = f"CASE WHEN n % 8 >= 4 THEN {_low(_times(_rotated(f'xor(t1, {_times(_lane("(n // 8 * 8)", 4), P1)})', 23), P2) + f' + {_n(P3)}')} ELSE t1 END"
    ones = f"list_reduce(list_transform(range(n % 4), lambda s: {_lane('(n // 4 * 4 + s)', 1)}), lambda acc, b: {_times(_rotated(f'xor(acc, {_times("b", P5)})', 11), P1)}, t2)"
    return f"""SELECT g, t6::UBIGINT AS h FROM (
      SELECT g, hex(encode(g)) AS x, octet_length(encode(g)) AS n, {stripes}, {joined} AS m0, {merged},
        {_low(f"CASE WHEN n >= 32 THEN m4 ELSE {_n(SEED + P5)} END + n::UHUGEINT")} AS t0, {eights} AS t1, {four} AS t2, {ones} AS t3,
        {_times("xor(t3, t3 >> 33)", P2)} AS t4, {_times("xor(t4, t4 >> 29)", P3)} AS t5, xor(t5, t5 >> 32) AS t6
      FROM (SELECT DISTINCT {column} AS g FROM {source}))"""


def fingerprints_sql(shingle: int, bits: int) -> str:
    """doc_id, fingerprint, component_id and n_same of documents."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{C.UPPER}', '{C.LOWER}'), '{C.WORD}') AS w FROM documents),
gram AS (SELECT doc_id, array_to_string(w[i : i + {shingle - 1}], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - {shingle - 1}, 1) + 1)) AS u(i) WHERE len(w) > 0),
hashed AS ({hash_sql('gram', 'g')}),
voted AS (SELECT doc_id, b, 2 * count(*) FILTER (WHERE ((h >> b::UBIGINT) & 1) = 1) > count(*) AS one FROM gram JOIN hashed USING (g), unnest(range(64)) AS u(b) GROUP BY doc_id, b),
fp AS (SELECT doc_id, coalesce(sum(CASE WHEN one THEN 1::HUGEINT << b::HUGEINT ELSE 0::HUGEINT END), 0)::UBIGINT AS f FROM d LEFT JOIN voted USING (doc_id) GROUP BY doc_id),
own AS (SELECT f, min(doc_id) AS first, count(*) AS n_same FROM fp GROUP BY f),
link AS (SELECT a.f, b.f AS other FROM own a JOIN own b ON bit_count(xor(a.f, b.f)) <= {bits}),
reach(f, other) AS (SELECT f, f FROM own UNION SELECT reach.f, link.other FROM reach JOIN link ON link.f = reach.other),
part AS (SELECT reach.f, min(first) AS component_id FROM reach JOIN own ON own.f = reach.other GROUP BY reach.f)
SELECT doc_id, lower(lpad(hex(fp.f), 16, '0')) AS fingerprint, component_id, n_same FROM fp JOIN part ON part.f = fp.f JOIN own ON own.f = fp.f
"""
