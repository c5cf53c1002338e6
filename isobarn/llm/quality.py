"""Quality score of documents by a byte-level convolutional network in numpy (operator 10).

A filter is a table of one weight per offset and byte value, so a convolution over bytes is a sum of table rows.
Overlapping chunks cover the whole document; each filter's response is max-pooled per chunk; the mean, the largest and the
smallest of the chunks' maxima go through one linear layer with a sigmoid, which gives the probability. (A document of a
few words over and over is known by what its chunks lack: the smallest maxima.) The network is fitted in the driver on at
most TRAIN_ROWS labelled rows, all their chunks (a documented bound, whatever the corpus size); scoring reads every byte of every text.

Defined results: null or empty text is scored as one chunk of padding; rows with null labels or ids are not
learned from; without labels every score is 0.5; repeated rows are scored once each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobarn.llm.common import as_bytes, hash_sample, prepare

WIDTH = 6
FILTERS = 16
CHUNK = 512
#: Bound of the training sample: labelled rows.
TRAIN_ROWS = 1500
EPOCHS = 12
#: Chunks convolved at a time.
BLOCK = 16


def chunks(text: bytes | None, chunk: int = CHUNK, width: int = WIDTH) -> np.ndarray:
    """Rows of chunk + width - 1 bytes that cover the text; the last one ends with it, short texts are padded."""
    span = chunk + width - 1
    data = np.frombuffer(text or b"", np.uint8)
    if len(data) <= span:
        return np.pad(data, (0, span - len(data)))[None]
    starts = np.minimum(np.arange(0, len(data) - width + 1, chunk), len(data) - span)
    return np.lib.stride_tricks.sliding_window_view(data, span)[starts]


class ByteNetwork:
    """Filters (width, 256, filters) with bias, and the linear layer on pooled responses."""

    def __init__(self, seed: int = 7, width: int = WIDTH, filters: int = FILTERS):
        rng = np.random.default_rng(seed)
        self.params = {
            "filters": rng.normal(0, 0.25, (width, 256, filters)).astype(np.float32),
            "bias": np.zeros(filters, np.float32),
            "mean": rng.normal(0, 0.1, filters).astype(np.float32),
            "most": rng.normal(0, 0.1, filters).astype(np.float32),
            "least": rng.normal(0, 0.1, filters).astype(np.float32),
            "constant": np.zeros(1, np.float32),
        }

    def pooled(self, rows: np.ndarray, positions: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each chunk's maximum of each filter, and where it lies."""
        table, width = self.params["filters"], len(self.params["filters"])
        n = rows.shape[1] - width + 1
        best, where = np.empty((len(rows), table.shape[2]), np.float32), None
        if positions:
            where = np.empty(best.shape, np.int64)
        response = np.empty((BLOCK, n, table.shape[2]), np.float32)
        more = np.empty_like(response)
        for i in range(0, len(rows), BLOCK):
            part = rows[i : i + BLOCK].astype(np.intp)
            sums, next_ = response[: len(part)], more[: len(part)]
            np.take(table[0], part[:, :n], axis=0, out=sums, mode="clip")
            for k in range(1, width):
                np.take(table[k], part[:, k : k + n], axis=0, out=next_, mode="clip")
                sums += next_
            best[i : i + BLOCK] = sums.max(axis=1)
            if positions:
                where[i : i + BLOCK] = sums.argmax(axis=1)
        return np.maximum(best + self.params["bias"], 0), where

    def documents(self, maxima: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Mean, largest and smallest over each document's chunks, and the probability. first: each document's first row."""
        counts = np.diff(np.append(first, len(maxima)))[:, None]
        mean, most, least = np.add.reduceat(maxima, first) / counts, np.maximum.reduceat(maxima, first), np.minimum.reduceat(maxima, first)
        logit = mean @ self.params["mean"] + most @ self.params["most"] + least @ self.params["least"] + self.params["constant"]
        return mean, most, least, 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        cut = [chunks(x) for x in texts]
        if not cut:
            return np.zeros(0)
        first = np.cumsum([0] + [len(x) for x in cut[:-1]])
        return self.documents(np.concatenate([self.pooled(x)[0] for x in cut]), first)[3]

    def fit(self, cut: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 32, rate: float = 0.02, seed: int = 7) -> ByteNetwork:
        rng, p = np.random.default_rng(seed), self.params
        first_moment = {k: np.zeros_like(v) for k, v in p.items()}
        second = {k: np.zeros_like(v) for k, v in p.items()}
        step, width = 0, len(p["filters"])
        share = max(labels.mean(), 1e-6)
        weight = np.where(labels == 1, 1.0, np.sqrt(share / max(1 - share, 1e-6)))  # rarer bad rows count for more
        for epoch in range(epochs):
            order = rng.permutation(len(cut))
            for begin in range(0, len(cut), batch):
                own = order[begin : begin + batch]
                rows = np.concatenate([cut[i] for i in own])
                sizes = np.array([len(cut[i]) for i in own])
                first = np.cumsum(sizes) - sizes
                maxima, where = self.pooled(rows, positions=True)
                mean, most, least, probability = self.documents(maxima, first)
                error = ((probability - labels[own]) * weight[own] / len(own)).astype(np.float32)
                doc = np.repeat(np.arange(len(own)), sizes)
                g = {"mean": mean.T @ error, "most": most.T @ error, "least": least.T @ error, "constant": error.sum(keepdims=True)}
                at_most, at_least = ((maxima == x[doc]) & (maxima > 0) for x in (most, least))
                at_most, at_least = (x / np.maximum(np.add.reduceat(x, first, dtype=np.float32)[doc], 1) for x in (at_most, at_least))
                back = error[doc, None] * (p["mean"] / sizes[doc, None] + p["most"] * at_most + p["least"] * at_least) * (maxima > 0)
                g["bias"] = back.sum(axis=0)
                g["filters"] = np.zeros_like(p["filters"])
                filters = np.arange(back.shape[1])
                for k in range(width):
                    np.add.at(g["filters"][k], (np.take_along_axis(rows, where + k, axis=1), filters[None]), back)
                step += 1
                for name, grad in g.items():
                    first_moment[name] = 0.9 * first_moment[name] + 0.1 * grad
                    second[name] = 0.99 * second[name] + 0.01 * grad**2
                    size = rate * (0.7 ** (epoch // 3)) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                    p[name] -= (size * first_moment[name] / (np.sqrt(second[name]) + 1e-8)).astype(np.float32)
        return self


def learnable(doc_id: Column) -> Column:
    """Labels are learned only where crc32 of the id's text leaves another remainder than 1 by 3."""
    return F.crc32(doc_id.cast("string")) % 3 != 1


def training_sample(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[np.ndarray], np.ndarray]:
    """Chunks and labels of at most `rows` labelled documents, chosen by the hash of the id."""
    own = labels.where(F.col("quality").isNotNull() & learnable(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = hash_sample(own, "doc_id", rows)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [chunks(text).tobytes() for text in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["doc_id", "quality", "rows"])

    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    picked = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")  # at most `rows` rows
    found = picked.mapInArrow(take, "doc_id bigint, quality int, rows binary").limit(2 * rows).collect()
    found = sorted({(r["doc_id"], r["quality"], bytes(r["rows"])) for r in found})
    span = CHUNK + WIDTH - 1
    return [np.frombuffer(x, np.uint8).reshape(-1, span) for *_, x in found], np.array([q for _, q, _ in found], np.float32)


def trained(documents: DataFrame, labels: DataFrame) -> ByteNetwork | None:
    """The fitted network; None where one class or none is labelled."""
    prepare(documents.sparkSession)
    cut, target = training_sample(documents, labels)
    return ByteNetwork().fit(cut, target) if len(np.unique(target)) == 2 else None


def score_quality(documents: DataFrame, network: ByteNetwork | None) -> DataFrame:
    """doc_id and score (probability of good quality) of every row."""
    prepare(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(network)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(batch.num_columns - 1))
            score = shared.value.score(texts) if shared.value else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], [*batch.schema.names[:-1], "score"])

    picked = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, score double")


def keep_good(documents: DataFrame, network: ByteNetwork | None, least: float = 0.5) -> DataFrame:
    """The documents that score at least `least`, with all their columns, in one pass over the texts."""
    prepare(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(batch.schema.get_field_index("text")))
            score = shared.value.score(texts) if shared.value else np.full(len(texts), 0.5)
            yield batch.filter(pa.array(score >= least))

    return documents.mapInArrow(run, documents.schema)
