"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A bounded sample of labelled rows fits the space. Terms are hashed byte trigrams, trigrams of kinds of characters, and
words that do or don't repeat the one before; a text's counts are taken at one length for all texts, weighted by
rarity and projected on their leading singular directions. The labelled vectors are broadcast; every document is
compared with all of them by exact cosine, block by block, and the nearest vote with their labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of the labelled sample; with it the bound of what is collected and broadcast: rows x TERMS x 4 bytes.
MAX_LABELLED = 4000
TRIGRAMS, KINDS, LATENT, NEIGHBOURS, SHARPNESS = 1024, 8, 24, 9, 12
TERMS = TRIGRAMS + KINDS**3 + 2
#: Counts are taken as if each text had so many terms.
LENGTH = 3000
BLOCK_ROWS, PIECE = 512, 1 << 20
HELD_OUT_OF, THRESHOLD = 5, 0.3
#: Kind of each byte: lower, upper, digit, space, line and tab, comma and full stop, other ASCII, beyond ASCII.
_KIND = np.full(256, 6, dtype=np.uint32)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[32], _KIND[9:14], _KIND[[44, 46]], _KIND[128:] = 0, 1, 2, 3, 4, 5, 7


@dataclass
class Model:
    """What scoring needs; a few MB whatever the corpus."""

    rarity: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def counts_of(text: str) -> np.ndarray:
    """Counts of the terms of the whole text, in pieces of bounded size."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    counts = np.zeros(TERMS, dtype=np.float32)
    for at in range(0, len(data) - 2, PIECE):
        b = data[at : at + PIECE + 2].astype(np.uint32)
        mixed = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
        counts[:TRIGRAMS] += np.bincount((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(22), minlength=TRIGRAMS)
        k = _KIND[b]
        counts[TRIGRAMS:-2] += np.bincount((k[:-2] * KINDS + k[1:-1]) * KINDS + k[2:], minlength=KINDS**3)
    words = (text or "").split()
    counts[-2] = sum(map(eq, words, islice(words, 1, None)))
    counts[-1] = len(words) - counts[-2]
    return counts


def features(texts: list[str]) -> np.ndarray:
    return np.stack([counts_of(t) for t in texts]) if texts else np.empty((0, TERMS), dtype=np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _weighted(rarity: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(counts * (LENGTH / np.maximum(counts.sum(axis=1, keepdims=True), 1))) * rarity)


def embed(model: Model, counts: np.ndarray) -> np.ndarray:
    """Unit vectors of the latent space."""
    return _unit(_weighted(model.rarity, counts) @ model.directions).astype(np.float32)


def fit(counts: np.ndarray, labels: np.ndarray) -> Model:
    rarity = np.log((1.0 + len(counts)) / (1.0 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(1.0)
    weighted = _weighted(rarity, counts)
    _, directions = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
    model = Model(rarity, directions[:, ::-1][:, :LATENT].astype(np.float32), np.empty(0), labels)
    model.vectors = embed(model, counts)
    return model


def vote(model: Model, vectors: np.ndarray) -> np.ndarray:
    """Mean label of the nearest labelled vectors, weighted by similarity; ties go to the earlier of the sample."""
    near = vectors @ model.vectors.T
    k = min(NEIGHBOURS, near.shape[1])
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(near, top, axis=1), 1e-6).astype(np.float64) ** SHARPNESS
    return (weight * model.labels[top]).sum(axis=1) / weight.sum(axis=1)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % HELD_OUT_OF == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """At most ``bound`` rows (text, label) of labelled documents that are not held out, the same ones at every run.

    Rows are taken in the order of a hash of the id; repeated labels of a document are averaged and null ones
    left out. Only the ids of the sample are broadcast to the scan of the documents.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.avg("quality").alias("label")).orderBy(F.xxhash64(F.col("doc_id"), F.lit(3)), "doc_id").limit(bound)
    # Of an id with several rows the text that comes first by its hash is the labelled one.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    first = texts.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first"))
    return first.select("doc_id", "label", "first.text")


def train(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> Model | None:
    """Fit on the sample; the tasks send hashed counts of fixed size, never texts. None without labelled rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "counts": [c.tobytes() for c in features(batch["text"].tolist())]})

    rows = labelled_sample(docs, labels, bound).mapInPandas(run, "doc_id bigint, label double, counts binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: r["doc_id"])
    return fit(np.frombuffer(b"".join(r["counts"] for r in rows), dtype=np.float32).reshape(len(rows), TERMS), np.array([r["label"] for r in rows]))


def scorer(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED):
    """A function from a text column to its score; null and empty texts are scored as the empty text.

    Without any labelled row each score is 0.5. Texts are read whole; ties and repeated rows score alike.
    """
    model = train(docs, labels, bound)
    if model is None:
        return lambda text: F.lit(0.5)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = texts.tolist()
            parts = [vote(shared.value, embed(shared.value, features(values[i : i + BLOCK_ROWS]))) for i in range(0, len(values), BLOCK_ROWS)]
            yield pd.Series(np.concatenate(parts) if parts else np.empty(0))

    return lambda text: score(F.coalesce(text, F.lit("")))


def score_quality(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``; an empty table gives no rows.

    ``docs`` needs doc_id and text, ``labels`` doc_id and quality; other columns are not read. A null doc_id counts
    as not held out.
    """
    score = scorer(docs, labels, bound)
    scored = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
