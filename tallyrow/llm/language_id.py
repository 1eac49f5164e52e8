"""Language identification by the nearest of several centroids per language.

A text's vector has the hashed byte n-grams (2 to 4) of its lower-cased letters: sublinear
term frequency times IDF, at length 1. Each language's training vectors are clustered by
spherical k-means into at most CENTROIDS centroids; a text gets the language of the
centroid of greatest cosine. Each centroid has a reach, from the cosines of its own
members; a text beyond it is flagged as rejected (and is und under reject=True).

The model is fitted on at most about SAMPLE labelled texts of each language, of at most
SAMPLE_BYTES bytes each, chosen by a hash of the text; every text is scored whole.

Nulls: a null text, or one without a letter, is und with score 0; a null lang is never
learned from; a null id is carried, not held out. Ties go to the first language in order.
Repeated rows each get their result; copies are learned once. Without labelled rows
everything is und. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrow.llm.bytescan import texts_of
from tallyrow.llm.common import documents, remainder, ship

SAMPLE = 600
SAMPLE_BYTES = 50_000
CENTROIDS = 4
DIMENSIONS = 4096
#: A text is rejected if its cosine is under this share of the lowest percentile of its centroid's members.
REACH = 0.5

# Bytes that aren't part of letters become a space.
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def vectors(texts: pa.Array) -> np.ndarray:
    """A row of term weights (1 + log tf) for each text."""
    data, offsets = texts_of(pa.RecordBatch.from_arrays([pc.utf8_lower(texts)], ["t"]), "t")
    view = _LETTERS[np.frombuffer(data, np.uint8)].astype(np.uint32)
    out = np.zeros((len(offsets) - 1, DIMENSIONS), np.float32)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        x = view[a:b]
        h = x
        for n in (2, 3, 4):
            if len(x) < n:
                break
            h = h[:-1] * np.uint32(0x01000193) ^ x[n - 1 :] * np.uint32(0x85EBCA6B)
            out[i] += np.bincount((h * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMENSIONS)
    np.log1p(out, out=out)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Model:
    def __init__(self, texts: list[str], langs: list[str], k: int = CENTROIDS):
        x = np.concatenate([vectors(pa.array(texts[i : i + 500], pa.string())) for i in range(0, len(texts), 500)]) if texts else np.zeros((0, DIMENSIONS), np.float32)
        self.idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
        x = _unit(x * self.idf)
        names, centres, reach = [], [], []
        for lang in sorted(set(langs)):
            own = x[[i for i, v in enumerate(langs) if v == lang]]
            c = own[np.linspace(0, len(own) - 1, min(k, len(own))).astype(int)]
            for _ in range(12):
                near = np.argmax(own @ c.T, axis=1)
                c = _unit(np.stack([own[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))]))
            best = (own @ c.T).max(1)
            names += [lang] * len(c)
            centres.append(c)
            reach += [REACH * float(np.percentile(best, 1))] * len(c)
        self.names, self.reach = names, np.array(reach)
        self.centres = np.concatenate(centres) if centres else np.zeros((0, DIMENSIONS), np.float32)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether it is too far off, of each text."""
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts)), letters
        cos = _unit(vectors(texts) * self.idf) @ self.centres.T
        best = cos.argmax(1)
        score = np.where(letters, np.clip(cos[np.arange(len(best)), best].astype(float), 0, 1), 0.0)
        return [self.names[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)], score, letters & (score < self.reach[best])


def fit(docs: DataFrame, learn: Column, sample: int = SAMPLE) -> Model:
    """docs: text, lang; learn: which rows may be learned from."""
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES)).select("text", "lang")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    share = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(sample / n)) for lang, n in counts.items()), F.lit(0.0))
    picked = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20)).dropDuplicates(["text", "lang"])
    got = sorted((r.lang, r.text) for r in picked.limit(2 * sample * max(1, len(counts))).collect())
    return Model([t for _, t in got], [lang for lang, _ in got])


def identify(docs: DataFrame, model: Model, reject: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, rejected."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                langs, score, far = model.predict(part.column("text"))
                if reject:
                    langs = ["und" if f else v for v, f in zip(langs, far.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    out = identify(docs, fit(docs, ~held))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
