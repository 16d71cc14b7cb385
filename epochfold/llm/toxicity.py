"""Toxicity by compression distance: which of two zstandard dictionaries shortens a window of text more.

Two dictionaries are trained, one on windows of ordinary texts and one on toxic texts: on their words that ordinary
texts hold far less often, as the rest of a toxic text is ordinary too. Each window of a document is compressed with the
ordinary dictionary alone and with the toxic one beside it; the bytes saved are the window's distance. What a document's
windows of two widths save is summed up in a few figures, and a logistic function turns them into a score. It is fitted
on figures of each half of the labelled rows by the other half's dictionaries, and the cut with the fewest errors there
is put at THRESHOLD; then the dictionaries are trained on both halves.
Only the text counts: never labels, language, source or ids.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochfold.llm import common as C

#: The most labelled rows of each class that a fit takes, by a hash of their id: a documented bound, whatever the corpus.
FIT_TOXIC, FIT_ORDINARY = 4000, 8000
#: Windows of an ordinary text that its dictionary may learn from, evenly spaced; and the most toxic words.
FIT_WINDOWS, FIT_WORDS = 40, 4000
#: A toxic text's word teaches if so many times as large a share of toxic as of ordinary texts holds it, this share of
#: toxic texts and so many of them.
CONTRAST, LEAST_SHARE, LEAST_TEXTS = 8.0, 0.015, 4
ORDINARY_BYTES, TOXIC_BYTES, SEGMENT = 32768, 2048, 24
#: Words of a window, and words from one to the next.
WIDTHS = ((8, 4), (4, 2))
LEVEL, RIDGE, THRESHOLD = 3, 3.0, 0.7
_STEPS = range(2, 8)
_AT_LEAST = np.array(_STEPS)
N_FIGURES = len(WIDTHS) * (7 + len(_STEPS))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Words between spaces and ASCII control characters, A-Z lower-cased; none of a null text."""
    return (text or "").encode().translate(_LOWER).split()


def windows(own: list[bytes], width: int, step: int) -> list[bytes]:
    """Overlapping runs of words that cover the whole text, at least one."""
    return [b" " + b" ".join(own[i : i + width]) for i in range(0, max(1, len(own) - width + step), step)]


def _cuts(texts: list[str | None]) -> tuple[bytes, list[list[np.ndarray]]]:
    """The texts' words end to end, a space before each, and where each text's windows of each width start and end there."""
    body, cuts, at = [], [], 0
    for own in map(words, texts):
        part, n = b" " + b" ".join(own), len(own)
        edges = np.full(n + 1, at)
        if n:
            np.cumsum(np.fromiter(map(len, own), np.int64, n) + 1, out=edges[1:])
            edges[1:] += at
        firsts = [np.arange(0, max(1, n - width + step), step) for width, step in WIDTHS]
        cuts.append([np.stack([edges[i], edges[np.minimum(i + width, n)] if n else edges + 1]) for i, (width, _) in zip(firsts, WIDTHS, strict=True)])
        body.append(part)
        at += len(part)
    return b"".join(body), cuts


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on samples; of too few to train on, their own last bytes."""
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class Model:
    """The two dictionaries, and the logistic function over a document's figures; coef is empty for a constant score."""

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    spread: np.ndarray
    coef: np.ndarray
    base: float

    def savings(self, texts: list[str | None]) -> list[list[np.ndarray]]:
        """Bytes that the toxic dictionary saves, by text, width and window."""
        plain, both = _compressor(self.ordinary), _compressor(self.ordinary + self.toxic)
        if not texts:
            return []
        body, cuts = _cuts(texts)
        starts, ends = np.concatenate([c for text in cuts for c in text], axis=1)
        segments = np.stack([starts, ends - starts], axis=1).astype(np.uint64).tobytes()
        lengths = lambda by: np.fromiter(map(len, by.multi_compress_to_buffer(zstandard.BufferWithSegments(body, segments))), np.int64, len(starts))
        saved = lengths(plain) - lengths(both)
        each = iter(np.split(saved, np.cumsum([c.shape[1] for text in cuts for c in text])[:-1]))
        return [[next(each) for _ in WIDTHS] for _ in texts]

    def score(self, found: list[list[np.ndarray]]) -> np.ndarray:
        x = figures(found)
        raw = np.full(len(x), self.base) if not len(self.coef) else self.base + ((x - self.mean) / self.spread) @ self.coef
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def figures(found: list[list[np.ndarray]]) -> np.ndarray:
    """A row of numbers for each text from what its windows save."""
    rows = []
    for text in found:
        row = []
        for d in text:
            n, s = len(d), np.sort(d)
            held = n - np.searchsorted(s, _AT_LEAST)  # windows that save at least so many bytes
            most = s[::-1]
            row += [most[: max(1, n // 10)].mean(), most[:3].mean(), most[0], d.mean(), np.log(n), np.sqrt(held[5 - _STEPS[0]]), held[3 - _STEPS[0]] / np.sqrt(n)]
            row += np.minimum(0.25, held / n).tolist()
        rows.append(row)
    return np.array(rows, dtype=float).reshape(len(rows), N_FIGURES)


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(mean, spread, coefficients, base) of a ridge logistic fit whose cut with the fewest errors scores THRESHOLD."""
    at = float(np.log(THRESHOLD / (1 - THRESHOLD)))
    rate = (y.sum() + 0.5) / (len(y) + 1)
    none = np.zeros(0)
    if len(np.unique(y)) < 2:
        return none, none, none, float(np.log(rate / (1 - rate)))
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / spread]
    b, ridge = np.zeros(z.shape[1]), np.diag(np.r_[0.0, np.full(x.shape[1], RIDGE)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p) + 1e-9)) @ z + ridge, z.T @ (y - p) - ridge @ b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    raw = z @ b
    order = np.argsort(-raw, kind="stable")
    wrong = y.sum() + np.cumsum(np.where(y[order] == 1, -1, 1))  # with the rows up to here called toxic
    cut = int(wrong.argmin())
    lower = raw[order[cut + 1]] if cut + 1 < len(raw) else raw[order[cut]] - 1
    return mean, spread, b[1:], float(b[0] - (raw[order[cut]] + lower) / 2 + at)


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(3)) == 1


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Up to FIT_TOXIC and FIT_ORDINARY labelled rows that aren't held out, a row an id: id, label, part (0 or 1), text."""
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    own = own.groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    first = lambda k, n: own.where(F.col("label") == k).orderBy(F.xxhash64(id_col), id_col).limit(n)
    chosen = C.stash(first(1, FIT_TOXIC).unionByName(first(0, FIT_ORDINARY)), "toxicity-ids")
    # the chosen ids are at most FIT_TOXIC + FIT_ORDINARY rows, so they can be sent to all
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)
    rows = rows.groupBy(F.col(id_col).alias("id")).agg(F.first("label").alias("label"), F.min(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    part = F.pmod(F.crc32(F.concat_ws("/", F.col("id").cast("string"), F.lit("part"))), F.lit(2)).cast("int")
    return C.stash(rows.withColumn("part", part), "toxicity-rows")


def _lessons(rows: DataFrame) -> DataFrame:
    """(id, label, part, words, windows) of texts: their words, and the windows that the ordinary dictionary learns from.

    Of near copies within a part one teaches: texts whose smallest hash of five words is the same count as such.
    """

    def run(batches):
        for b in batches:
            out = []
            for i, label, part, text in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                own = words(text)
                runs = (b" ".join(own[j : j + 5]) for j in range(max(1, len(own) - 4)))
                sketch = min(blake2b(x, digest_size=8).digest() for x in runs)
                some = windows(own, *WIDTHS[0])
                out.append((i, label, part, sketch, sorted(set(own)), some[:: -(-len(some) // FIT_WINDOWS)]))
            kinds = [b.schema.field(0).type, pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary())]
            cols = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "label", "part", "sketch", "words", "windows"])

    kinds = f"id {dict(rows.dtypes)['id']}, label int, part int, sketch binary, words array<binary>, windows array<binary>"
    made = rows.select("id", "label", "part", "text").mapInArrow(run, kinds)
    return made.groupBy("label", "part", "sketch").agg(F.min_by(F.struct("id", "words", "windows"), "id").alias("one")).select("label", "part", "one.*")


def _dictionaries(taught: DataFrame) -> Model:
    """A model of the two dictionaries that taught gives, without a score."""
    n = {r["label"]: r["count"] for r in taught.groupBy("label").count().collect()}
    toxic, ordinary = n.get(1, 0), n.get(0, 0)
    each = taught.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("o"))
    often = f"t >= {max(LEAST_TEXTS, LEAST_SHARE * toxic)} AND t * {ordinary} > {CONTRAST} * (o + 0.5D) * {toxic}"
    marked = each.where(often).orderBy(F.desc("t"), "word").limit(FIT_WORDS)
    marked = marked.agg(F.collect_set("word").alias("marked"))  # FIT_WORDS words at most, so this row is small
    bad = taught.where("label = 1").join(F.broadcast(marked)).select("id", F.array_intersect("words", "marked").alias("w"), "windows").orderBy("id").collect()
    samples = [b" " + w for r in bad for w in r["w"]] or [bytes(w) for r in bad for w in r["windows"]]
    samples = [b"".join(samples[i : i + 8]) for i in range(0, len(samples), 8)]
    good = taught.where("label = 0").select("id", "windows").orderBy("id").collect()
    return Model(_dictionary([bytes(w) for r in good for w in r["windows"]], ORDINARY_BYTES), _dictionary(samples, TOXIC_BYTES), *(np.zeros(0),) * 3, 0.0)


def train(docs: DataFrame, labels: DataFrame, **columns) -> Model:
    """The model of labelled rows. Same rows, same model, however they are partitioned.

    What reaches the driver is bounded by FIT_TOXIC, FIT_ORDINARY, FIT_WINDOWS and FIT_WORDS. With one class or no labels
    the score is a constant, their smoothed share.
    """
    C.small_batches(docs.sparkSession)
    rows = training_rows(docs, labels, **columns)
    taught = C.stash(_lessons(rows), "toxicity-lessons")
    by_other = [_dictionaries(taught.where(F.col("part") == 1 - k)) for k in (0, 1)]

    def run(batches):
        for b in batches:
            parts, texts = np.asarray(b.column(2)), b.column(3).to_pylist()
            x = [None] * len(texts)
            for k, m in enumerate(by_other):
                at = np.flatnonzero(parts == k)
                for j, v in zip(at, figures(m.savings([texts[j] for j in at])), strict=True):
                    x[j] = v
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], names=["id", "label", "figures"])

    told = rows.select("id", "label", "part", "text").mapInArrow(run, f"id {dict(rows.dtypes)['id']}, label int, figures array<double>").orderBy("id").collect()
    x = np.array([r["figures"] for r in told], dtype=float).reshape(len(told), N_FIGURES)
    plain = _dictionaries(taught)
    return Model(plain.ordinary, plain.toxic, *calibrate(x, np.array([r["label"] for r in told], dtype=float)))


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep's columns (the id alone unless given) with held_out, score, predicted and the window that saves most.

    worst_word (from 0) is that window's first word, worst_saved the bytes that it saves. A row for each row of docs.
    Defined cases: a null text counts as empty and is scored like one; repeated rows get a row each; a null id is hashed
    as an empty text; an empty table gives an empty result; columns of docs that keep names may have any name but those
    of the result.
    """
    keep = keep or [id_col]
    at = C.fresh(docs.select(*keep), "text", "score", "word", "saved")

    def run(batches):
        for b in batches:
            found = model.savings(b.column(b.num_columns - 1).to_pylist())
            worst = [int(f[0].argmax()) for f in found]
            cols = [pa.array(model.score(found), pa.float64()), pa.array([w * WIDTHS[0][1] for w in worst], pa.int64()), pa.array([int(f[0][w]) for f, w in zip(found, worst, strict=True)], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=[*b.schema.names[:-1], *at[1:]])

    src = docs.select(*keep, F.col(text_col).alias(at[0]))
    kinds = {f.name: f.dataType.simpleString() for f in src.schema}
    C.small_batches(docs.sparkSession)
    out = src.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", {at[1]} double, {at[2]} long, {at[3]} long")
    return out.select(
        *keep, held_out(id_col).alias("held_out"), F.col(at[1]).alias("score"), (F.col(at[1]) >= threshold).cast("int").alias("predicted"),
        F.col(at[2]).alias("worst_word"), F.col(at[3]).alias("worst_saved"),
    )
