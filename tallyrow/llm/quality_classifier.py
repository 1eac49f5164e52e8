"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a whole text are binned at training quantiles. Cyclic boosting visits the
features in turn; each visit fits a shallow tree of a single feature to the gradient of
the logistic loss and adds its leaves to that feature's lookup table. The strongest
pairs then get tables of their own, boosted the same way with trees of two features. A
score is the sum of a bin's entry in each table: vectorised lookups and additions.

The model is fitted on at most about SAMPLE labelled rows, chosen by a hash of the id
(where many rows share ids, at most about twice as many, drawn by rows); every text is
scored whole.

Nulls: a null text is empty and scored as such; a null label isn't learned from; a null
id is carried, not held out, and has no label. Repeated rows each get their result. Without
labels of both kinds every score is the share of ones (0.5 without any). Extra columns
are ignored; filtered() carries them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrow.llm.bytescan import LINE, hashes, spans, texts_of
from tallyrow.llm.common import documents, freeing, remainder, ship

SAMPLE = 20_000
BINS = 24
COARSE = 6
ROUNDS = 120
PAIRS = 4
RATE = 0.15
#: Texts whose features are made at a time.
FEW = 250

FEATURES = ["words", "word_bytes", "symbols", "capitals", "marks", "digits", "stops", "commas", "pipes", "distinct", "runs", "repeats", "repeated_lines", "line_words"]

_CLASSES = np.zeros((256, 7), np.float32)
for _i, _chars in enumerate((b"#*$%&|<>", bytes(range(65, 91)), b"!?", b"0123456789", b".", b",;:", b"|")):
    _CLASSES[list(_chars), _i] = 1


def features(data: memoryview, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; words are split at ASCII white space."""
    n = len(offsets) - 1
    view = np.frombuffer(data, np.uint8)
    starts, ends, cut = spans(view, offsets)
    h = hashes(view, starts, ends)
    lines, stops, line_cut = spans(view, offsets, LINE)
    lh = hashes(view, lines, stops)
    out = np.zeros((n, len(FEATURES)), np.float32)
    size = (ends - starts).astype(np.float64)
    for i in range(n):
        a, b = cut[i], cut[i + 1]
        w = b - a
        if not w:
            continue
        c = np.bincount(view[offsets[i] : offsets[i + 1]], minlength=256) @ _CLASSES
        own = h[a:b]
        three = own[:-2] * np.uint64(3) + own[1:-1] * np.uint64(5) + own[2:] * np.uint64(7)
        ls = lh[line_cut[i] : line_cut[i + 1]]
        letters = max(1.0, float(size[a:b].sum()))
        out[i] = (
            np.log(w), size[a:b].mean(), c[0] / w, c[1] / letters, c[2] / w, c[3] / w, c[4] / w, c[5] / w, c[6] / w,
            len(np.unique(own)) / w, (own[1:] == own[:-1]).sum() / w, 1 - len(np.unique(three)) / max(1, len(three)), 1 - len(np.unique(ls)) / max(1, len(ls)), w / max(1, len(ls)),
        )
    return out


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values over ordered bins with gradient g and curvature h: best splits, depth times."""
    out = np.full(len(g), g.sum() / (h.sum() + 1))
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = left_g**2 / (left_h + 1) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1)
        at = int(gain.argmax()) + 1
        if gain[at - 1] > g.sum() ** 2 / (h.sum() + 1) + 1e-9:
            out[:at], out[at:] = _tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)
    return out


class Model:
    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS):
        mean = y.mean() if len(y) else 0.5
        self.start = float(np.log(max(mean, 1e-6) / max(1 - mean, 1e-6)))
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(y) else np.zeros(0) for j in range(x.shape[1])]
        self.coarse = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, COARSE + 1)[1:-1])) if len(y) else np.zeros(0) for j in range(x.shape[1])]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        if len(y) == 0 or mean in (0, 1):
            return
        f = np.full(len(y), self.start)
        bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]
        for _ in range(rounds):
            for j, b in enumerate(bins):
                p = 1 / (1 + np.exp(-f))
                step = RATE * _tree(np.bincount(b, y - p, len(self.tables[j])), np.bincount(b, p * (1 - p), len(self.tables[j])), 2)
                self.tables[j] += step
                f += step[b]
        rough = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.coarse)]

        def cells(i: int, j: int) -> tuple[np.ndarray, tuple[int, int]]:
            shape = (len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)
            return rough[i] * shape[1] + rough[j], shape

        p = 1 / (1 + np.exp(-f))

        def strength(pair: tuple[int, int]) -> float:
            c, shape = cells(*pair)
            return float((np.bincount(c, y - p, shape[0] * shape[1]) ** 2 / (np.bincount(c, p * (1 - p), shape[0] * shape[1]) + 1)).sum())

        for i, j in sorted(combinations(range(x.shape[1]), 2), key=strength, reverse=True)[:pairs]:
            c, shape = cells(i, j)
            table = np.zeros(shape[0] * shape[1])
            for _ in range(rounds // 4):
                p = 1 / (1 + np.exp(-f))
                g, h = np.bincount(c, y - p, len(table)).reshape(shape), np.bincount(c, p * (1 - p), len(table)).reshape(shape)
                rows = _tree(g.sum(1), h.sum(1), 1)  # the first feature splits, then the second within each side
                step = np.empty(shape)
                for v in np.unique(rows):
                    side = rows == v
                    step[side] = RATE * _tree(g[side].sum(0), h[side].sum(0), 1)
                table += step.ravel()
                f += step.ravel()[c]
            self.pairs.append((i, j, table.reshape(shape)))

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            f += t[np.searchsorted(e, x[:, j], side="right")]
        for i, j, t in self.pairs:
            f += t[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-f))


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, FEW):
            part = batch.slice(at, FEW)
            x = features(*texts_of(part, "text"))
            yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(list(x), pa.list_(pa.float32()))], ["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text; labels: doc_id, quality. learn: which rows, by doc_id."""
    ship(docs.sparkSession)
    own = labels.filter(learn & F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("y"))
    n = own.count()
    picked = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit((1 << 20) * sample / max(n, 1))).limit(2 * sample)
    # At most 2 * sample rows of two numbers.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    # Rows that share an id all meet its label; the driver gets a bounded number of them too.
    found = rows.count()
    if found > 2 * sample:
        rows = rows.filter(F.rand(7) < 2 * sample / found)
    rows = rows.select("text", "y").mapInArrow(freeing(_features_of), "y int, x array<float>")
    got = sorted((r.y, r.x) for r in rows.collect())
    return Model(np.array([x for _, x in got], np.float32).reshape(-1, len(FEATURES)), np.array([y for y, _ in got], float))


def scored(rows: DataFrame, model: Model, text: str) -> DataFrame:
    """rows with score."""
    ship(rows.sparkSession)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FEW):
                part = batch.slice(at, FEW)
                score = model.score(features(*texts_of(part, text)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names if c != text), pa.array(score, pa.float64())], [*(c for c in names if c != text), "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return rows.mapInArrow(freeing(run), StructType([*(f for f in rows.schema.fields if f.name != text), StructField("score", DoubleType())]))


def _learned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[Column, Model]:
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return held, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held, model = _learned(spark, docs, sf_dir)
    return scored(docs, model, "text").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def filtered(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that are predicted to be good, by a model learned from the labelled rows of the documents table."""
    _, model = _learned(spark, documents(spark, sf_dir).select("doc_id", "text"), sf_dir)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col("text").alias("_text"))
    return scored(rows, model, "_text").filter("score >= 0.5").select("_doc.*")
