"""Filter interaction audit: what each filter removes in every order, by a trie of filter states.

A state is the set of filters applied so far, whatever their order: 2^n states stand for n! orders. The trie is walked
depth first; a state's survivors are a persisted frame filtered from its parent's, each state is visited once and shared
by all prefixes that reach it, and at each edge the rows that the next filter really removes are counted.
"""

from __future__ import annotations

from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochfold.llm import common as C

#: Filters at most: the trie has 2^n states, the report n! orders.
MOST_FILTERS = 6


def measures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A narrow row for each row of docs: part, what the filters ask of the whole text, and its labels.

    n_words, n_distinct (case-sensitive words), n_upper (A-Z), n_chars (code points), marked (any of #$%&*|), copy
    (another row of a smaller id has the same text), good and toxic (any label row of the id says 1).
    A null text is empty, a null part the empty string. A row without an id comes after all ids: it is a copy where a row
    with an id has its text, and no row is a copy of it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(C.WORD), F.lit(0))
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.size(words).alias("n_words"), F.size(F.array_distinct(words)).alias("n_distinct"),
        (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))).alias("n_upper"), F.length(text).alias("n_chars"), text.rlike(r"[#$%&*|]").alias("marked"),
        F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("digest"),
    )
    rows = C.stash(rows, "audit-measures")
    # the first row of each text is looked up by its own id, so a large group of copies meets no common key
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    told = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    told = told.agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    same = rows["digest"].eqNullSafe(first["digest"]) & rows["id"].eqNullSafe(first["id"])
    rows = rows.join(first, same, "left").select(rows["*"], F.col("first").isNull().alias("copy")).drop("digest")
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return C.stash(rows.join(told, "id", "left").select(*rows.columns, no("good"), no("toxic")), "audit-rows")


def _fails(condition: str) -> Column:
    return F.coalesce(F.expr(condition), F.lit(False))


def walk(rows: DataFrame, filters: dict[str, str], losses: dict[str, str], part_col: str = "part") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the trie: nodes(part, state, kept), edges(part, state, filter, next, removed, a count for each loss).

    filters: name -> failing condition over rows' columns; losses: name -> condition of rows counted among the removed.
    A state is a bit mask over filters. Parts of which a state has no rows left have no row there.
    """
    if not 1 <= len(filters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    spark, names = rows.sparkSession, list(filters)
    path, done = C.scratch(spark, "audit-trie"), set()
    # the same counts in every state, so that all states share their compiled code; of a filter applied before, none fail
    counts = [F.count("*").alias("kept")]
    for k, name in enumerate(names):
        fails = _fails(filters[name])
        lost = [F.count_if(fails & _fails(c)).alias(n) for n, c in losses.items()]
        counts.append(F.struct(F.lit(k).alias("bit"), F.lit(name).alias("filter"), F.count_if(fails).alias("removed"), *lost).alias(f"edge{k}"))

    def visit(frame: DataFrame, state: int) -> None:
        done.add(state)
        node = frame.groupBy(F.col(part_col).alias("part")).agg(*counts)
        node.select("part", "kept", F.array(*(f"edge{k}" for k in range(len(names)))).alias("edges")).write.parquet(f"{path}/state={state}")
        for k, name in enumerate(names):
            after = state | 1 << k
            if after not in done:
                left = frame.where(~_fails(filters[name]))
                # survivors that filters not yet seen go on from are read again; those of a leaf are counted once
                again = any(after | 1 << j not in done for j in range(len(names)))
                visit(left.persist(StorageLevel.MEMORY_AND_DISK) if again else left, after)
                left.unpersist()

    root = rows.persist(StorageLevel.MEMORY_AND_DISK)
    visit(root, 0)
    root.unpersist()
    kind = ", ".join(f"{n}: bigint" for n in ["removed", *losses])
    nodes = spark.read.schema(f"part string, kept long, edges array<struct<bit: int, filter: string, {kind}>>, state int").parquet(path)
    edges = nodes.select("part", "state", F.explode("edges").alias("edge")).select("part", "state", "edge.*")
    edges = edges.where("shiftright(state, bit) & 1 = 0").withColumn("next", F.expr("state | shiftleft(1, bit)")).drop("bit")
    return nodes.select("part", "state", "kept"), edges


def _orders(spark: SparkSession, names: list[str]) -> DataFrame:
    rows = []
    for order in permutations(range(len(names))):
        state = 0
        for step, k in enumerate(order, 1):
            rows.append(("".join(names[j] for j in order), step, names[k], state, state | 1 << k))
            state |= 1 << k
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, state int, next int")


def report(nodes: DataFrame, edges: DataFrame, names: list[str], losses: list[str]) -> DataFrame:
    """A row for each part, order of the filters and step, zeros included; see audit."""
    n = len(names)
    parts = nodes.where("state = 0").select("part")
    steps = _orders(nodes.sparkSession, names)
    every = F.array(*(F.struct(F.lit(k).cast("int").alias("bit"), F.lit(x).alias("filter")) for k, x in enumerate(names)))
    # what a filter does in all orders: alone first, last, and summed with the number of orders that pass each edge
    ways = F.expr(f"factorial(bit_count(state)) * factorial({n - 1} - bit_count(state))")
    last = F.col("next") == F.lit(2**n - 1)
    totals = edges.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("state") == 0, F.col("removed"))).alias("fails"), F.coalesce(F.sum(F.when(last, F.col("removed"))), F.lit(0)).alias("unique_fails"),
        F.sum(F.col("removed") * ways).alias("shapley"),
    )
    # as many rows as orders x steps (n! x n) for each part: bounded by the number of filters
    out = parts.select("part", F.explode(every).alias("f")).select("part", "f.filter").join(F.broadcast(steps), "filter")
    out = out.join(edges.drop("next"), ["part", "state", "filter"], "left").join(totals, ["part", "filter"], "left")
    after = nodes.select("part", F.col("state").alias("next"), "kept")
    out = out.join(after, ["part", "next"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    removed = zero(F.col("removed"))
    return out.select(
        "part", "filter_order", "step", "filter", zero(F.col("kept")).alias("kept"), removed.alias("removed"), (zero(F.col("fails")) - removed).alias("redundant"),
        zero(F.col("unique_fails")).alias("unique_fails"), *(zero(F.col(c)).alias(c) for c in losses), zero(F.col("shapley")).alias("shapley"),
    )


def audit(rows: DataFrame, filters: dict[str, str], losses: dict[str, str], part_col: str = "part") -> DataFrame:
    """For each part, order of the filters and step: what the filter of that step removes there.

    Columns: part, filter_order, step, filter, kept (rows after the step), removed (here), redundant (failing the filter,
    removed before), unique_fails (failing this filter alone), a count of the removed for each of losses, shapley (the
    filter's removed, summed over all orders).
    Defined cases: a condition that is null counts as passed; an empty table gives no rows; repeated rows count as often
    as they stand; other columns of rows are carried unread, so their names don't matter but to the conditions.
    """
    nodes, edges = walk(rows, filters, losses, part_col)
    return report(nodes, edges, list(filters), list(losses))
