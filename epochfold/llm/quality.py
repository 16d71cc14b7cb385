"""Quality classifier: a generalised additive model with pairwise interactions, as lookup tables.

Cyclic boosting: in each round every feature in turn gets a shallow tree on the current residuals, over that feature's
quantile bins; the trees of a feature add up to one table of bin scores. Then the pairs whose first tree would lower
the loss most are boosted the same way: a tree of two levels cuts one feature, then the other in each part, and a pair's
trees add up to one table of two-dimensional bins. A score is the sum of the looked-up bins through the logistic function. Features are counts over the whole text alone: never labels, language, source or ids.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochfold.llm import common as C

#: The most labelled rows that a fit takes, chosen by a hash of their id: a documented bound, whatever the corpus.
FIT_ROWS = 6000
BINS, PAIR_BINS, ROUNDS, PAIRS, PAIR_ROUNDS, RATE, LEAVES, LEAST = 24, 6, 150, 6, 60, 0.15, 4, 12
THRESHOLD = 0.3

FEATURES = [
    "log_bytes", "log_words", "word_length", "upper", "lower", "digits", "beyond_ascii", "spaces", "newlines", "stops",
    "exclamation", "symbols", "pipes", "dashes", "other_marks", "distinct_words", "top_word", "distinct_lines", "repeated_bytes_in_lines",
    "line_length", "short_lines", "byte_entropy", "marked_words", "title_words",
]
_SYMBOLS = np.frombuffer(b"#$%&*+<=>@^_`{}~\\", np.uint8)
_OTHER = np.frombuffer(b"\"'(),/:;[]", np.uint8)
_MARKS = tuple("!#$%&*|@^~")


def features(text: str | None) -> np.ndarray:
    """The feature vector of one text; of an empty or null one, all zeros."""
    out = np.zeros(len(FEATURES))
    raw = (text or "").encode()
    if not raw:
        return out
    n = len(raw)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    m = max(1, len(words))
    each = Counter(words)
    lines = text.split("\n")
    by_line = Counter(lines)
    repeated = sum((k - 1) * len(x) for x, k in by_line.items())
    share = count[count > 0] / n
    out[:] = (
        np.log1p(n), np.log1p(len(words)), sum(map(len, words)) / m, count[65:91].sum() / n, count[97:123].sum() / n, count[48:58].sum() / n, count[128:].sum() / n, count[32] / n,
        count[10] / n, count[46] / n, count[33] / n, count[_SYMBOLS].sum() / n, count[124] / n, count[45] / n, count[_OTHER].sum() / n,
        len(each) / m, each.most_common(1)[0][1] / m if each else 0, len(by_line) / len(lines), repeated / max(1, len(text)),
        np.log1p(n / len(lines)), sum(len(x) < 30 for x in lines) / len(lines), -(share * np.log2(share)).sum(),
        sum(w.endswith(_MARKS) for w in words) / m, sum(w[0].isupper() for w in words) / m,
    )
    return out


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.stack([features(t) for t in texts]) if texts else np.zeros((0, len(FEATURES)))


@dataclass(frozen=True)
class Model:
    """edges: bin borders by feature; tables: bin scores by feature; pairs: (i, j, borders, borders, table)."""

    base: float
    edges: tuple
    tables: tuple
    pairs: tuple

    def raw(self, x: np.ndarray) -> np.ndarray:
        s = np.full(len(x), self.base)
        for k, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            s += t[np.searchsorted(e, x[:, k], side="right")]
        for i, j, a, b, t in self.pairs:
            s += t[np.searchsorted(a, x[:, i], side="right"), np.searchsorted(b, x[:, j], side="right")]
        return s

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _borders(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(grad: np.ndarray, hess: np.ndarray, count: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Leaf values by bin of a tree of so many leaves over one feature's ordered bins, best split first."""
    cuts = [(0, len(grad))]
    cg, ch, cn = (np.concatenate([[0], np.cumsum(x)]) for x in (grad, hess, count))
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1.0)
    while len(cuts) < leaves:
        best = (1e-9, None, 0)
        for a, b in cuts:
            mid = np.arange(a + 1, b)
            mid = mid[(cn[mid] - cn[a] >= LEAST) & (cn[b] - cn[mid] >= LEAST)]
            if len(mid):
                g = gain(a, mid) + gain(mid, b) - gain(a, b)
                k = int(g.argmax())
                if g[k] > best[0]:
                    best = (g[k], (a, b), int(mid[k]))
        if best[1] is None:
            break
        cuts.remove(best[1])
        cuts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(grad))
    for a, b in cuts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


def _pair_tree(grad: np.ndarray, hess: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Leaf values by cell of a pair's best tree of two levels: a cut of one feature, then of the other in each part."""
    best, most = np.zeros_like(grad), 1e-9
    for turned in (False, True):
        g, h, c = (v.T if turned else v for v in (grad, hess, count))
        for cut in range(1, len(g)):
            if min(c[:cut].sum(), c[cut:].sum()) < LEAST:
                continue
            out = np.empty_like(g)
            for part in (slice(0, cut), slice(cut, None)):
                out[part] = _tree(g[part].sum(axis=0), h[part].sum(axis=0), c[part].sum(axis=0), 2)
            gain = float((out * g).sum())
            if gain > most:
                best, most = out.T if turned else out, gain
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of rows x with labels y (0 or 1); with one class only, its smoothed share. Same rows, same model."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    edges = [_borders(x[:, k], BINS) if len(x) else np.zeros(0) for k in range(x.shape[1])]
    tables = [np.zeros(len(e) + 1) for e in edges]
    if len(np.unique(y)) < 2:
        return Model(base, tuple(edges), tuple(tables), ())
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]
    counts = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, tables, strict=True)]
    s = np.full(len(y), base)
    for _ in range(ROUNDS):
        for b, t, c in zip(bins, tables, counts, strict=True):
            p = 1 / (1 + np.exp(-s))
            step = RATE * _tree(np.bincount(b, y - p, len(t)), np.bincount(b, p * (1 - p), len(t)), c)
            t += step
            s += step[b]
    p = 1 / (1 + np.exp(-s))
    coarse = [_borders(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    cells = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(coarse)]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        wide = len(coarse[j]) + 1
        return np.bincount(cells[i] * wide + cells[j], v, (len(coarse[i]) + 1) * wide).reshape(-1, wide)

    def tree(i: int, j: int) -> np.ndarray:
        p = 1 / (1 + np.exp(-s))
        return _pair_tree(grid(i, j, y - p), grid(i, j, p * (1 - p)), grid(i, j, np.ones(len(y))))

    gains = [((tree(i, j) * grid(i, j, y - p)).sum(), i, j) for i, j in combinations(range(x.shape[1]), 2)]
    chosen = sorted(gains, key=lambda g: (-g[0], g[1], g[2]))[:PAIRS]
    pairs = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in chosen]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in pairs:
            step = RATE * tree(i, j)
            t += step
            s += step[cells[i], cells[j]]
    return Model(base, tuple(edges), tuple(tables), tuple((i, j, coarse[i], coarse[j], t) for i, j, t in pairs))


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(5)) == 0


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = FIT_ROWS) -> DataFrame:
    """Up to `most` labelled rows that aren't held out, by a hash of their id: (id, label, features), a row an id.

    Of rows that repeat an id, the one with the least features counts, so repeats can't lift the bound.
    """
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    own = own.groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    chosen = C.stash(own.orderBy(F.xxhash64(id_col), id_col).limit(most), "quality-ids")
    C.small_batches(docs.sparkSession)
    # the chosen ids are at most `most` rows, so they can be sent to all
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).select(F.col(id_col).alias("id"), "label", F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            x = matrix(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "label", "features"])

    made = rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, label int, features array<double>")
    return made.groupBy("id").agg(F.first("label").alias("label"), F.min("features").alias("features"))


def train(docs: DataFrame, labels: DataFrame, **columns) -> Model:
    """Fits on the driver: its input is bounded by FIT_ROWS rows of a few numbers, whatever the corpus."""
    rows = sorted(training_rows(docs, labels, **columns).collect(), key=lambda r: (r["id"], r["features"]))
    x = np.array([r["features"] for r in rows]).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r["label"] for r in rows], dtype=float))


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep's columns (the id alone unless given) with held_out, score and predicted, a row for each row of docs.

    Defined cases: a null text counts as empty and is scored like one; repeated rows get a row each; a null id is
    hashed as an empty text; an empty table gives an empty result, and one class or no labels a constant score.
    """
    keep = keep or [id_col]

    def run(batches):
        for b in batches:
            x = matrix(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model.score(x), pa.float64())], names=[*b.schema.names[:-1], "_score"])

    src = docs.select(*keep, F.col(text_col).alias("_text"))
    kinds = {f.name: f.dataType.simpleString() for f in src.schema}
    C.small_batches(docs.sparkSession)
    out = src.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", _score double")
    return out.select(*keep, held_out(id_col).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text scores threshold or more, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(model.score(matrix(b.column(at).to_pylist())) >= threshold))

    C.small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
