"""The penalised logistic fit of each fold as DuckDB SQL: Newton's steps in a recursive query, solved by Cholesky factors."""

from __future__ import annotations

#: Newton's steps; they double the right digits each, and eight reach the last one.
STEPS = 15


def solve_sql(n: int) -> list[str]:
    """Aliases of a Cholesky factor of h and of the solution d of h d = g, each from those before it."""
    out = []
    for i in range(n):
        for j in range(i + 1):
            left = f"h{i}_{j}" + "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j))
            out.append(f"sqrt({left}) AS l{i}_{j}" if i == j else f"({left}) / l{j}_{j} AS l{i}_{j}")
    for i in range(n):
        out.append(f"(g{i}" + "".join(f" - l{i}_{k} * z{k}" for k in range(i)) + f") / l{i}_{i} AS z{i}")
    for i in reversed(range(n)):
        out.append(f"(z{i}" + "".join(f" - l{k}_{i} * d{k}" for k in range(i + 1, n)) + f") / l{i}_{i} AS d{i}")
    return out


def fit_sql(keys: str, row: str, p: int, source: str, strict: bool = True, c: str = "1.0::DOUBLE", name: str = "") -> str:
    """{name}fit(keys, b0.. and the offset last) and {name}preds(keys, row, y, proba, pred) of source's folds.

    source has keys, row, y, role and features f0 .. f(p - 1). Classes weigh the same; the offset isn't penalised; a fold
    of one training class says that class. To be used in a WITH RECURSIVE clause.
    """
    js, own = range(p), range(p + 1)
    x = [f"x{j}" for j in js] + ["1.0::DOUBLE"]
    b = ", ".join(f"b{j}" for j in own)
    score = " + ".join(f"b{j} * {x[j]}" for j in own)
    pen = lambda j: f"1.0::DOUBLE / {c}" if j < p else "0"
    grad = ", ".join(f"sum(w * (q - y) * {x[j]}) + any_value({pen(j)}) * b{j} AS g{j}" for j in own)
    hess = ", ".join(f"sum(w * q * (1 - q) * {x[i]} * {x[j]})" + (f" + any_value({pen(i)})" if i == j else "") + f" AS h{i}_{j}" for i in own for j in range(i + 1))
    stats = ", ".join(f"avg(f{j}) AS m{j}, CASE WHEN stddev_pop(f{j}) > 0 THEN stddev_pop(f{j}) ELSE 1 END AS s{j}" for j in js)
    return f"""{name}stat AS (SELECT {keys}, count(*) AS n_train, sum(y) AS n_pos, {stats} FROM {source} WHERE role = 'train' GROUP BY {keys}),
    {name}scaled AS (SELECT s.*, n_train, n_pos, {", ".join(f"(f{j} - m{j}) / s{j} AS x{j}" for j in js)},
        n_train / (2.0::DOUBLE * CASE WHEN y = 1 THEN n_pos ELSE n_train - n_pos END) AS w FROM {source} s JOIN {name}stat USING ({keys})),
    {name}learn AS (SELECT * FROM {name}scaled WHERE role = 'train' AND n_pos > 0 AND n_pos < n_train),
    {name}newton AS (SELECT DISTINCT {keys}, 0 AS t, {", ".join(f"0.0::DOUBLE AS b{j}" for j in own)} FROM {name}learn
        UNION ALL SELECT {keys}, t + 1, {", ".join(f"b{j} - d{j}" for j in own)} FROM (SELECT *, {", ".join(solve_sql(p + 1))} FROM (
        SELECT {keys}, t, {b}, {grad}, {hess} FROM (SELECT *, 1 / (1 + exp(-({score}))) AS q FROM {name}newton JOIN {name}learn USING ({keys}) WHERE t < {STEPS}) GROUP BY {keys}, t, {b}))),
    {name}fit AS (SELECT * FROM {name}newton WHERE t = {STEPS}),
    {name}said AS (SELECT {keys}, {row}, y, CASE WHEN n_pos = 0 THEN 0 WHEN n_pos = n_train THEN 1 ELSE 1 / (1 + exp(-({score}))) END AS proba
        FROM {name}scaled LEFT JOIN {name}fit USING ({keys}) WHERE role = 'test'),
    {name}preds AS (SELECT *, (proba {'>' if strict else '>='} 0.5)::INT AS pred FROM {name}said)"""
