"""Document fingerprints: bottom-k sketches of shingle hashes (operator 2).

A sketch keeps the k smallest distinct hashes of a text's shingles and, if there are no more than k, is the whole set.
Sketches of parts merge into the sketch of the union. Two sketches estimate resemblance and containment; one
estimates the number of distinct shingles.

Shingles are runs of five words; a text of fewer words is one shingle, a text without words has none. Two empty
sketches have resemblance 1, an empty and a non-empty one 0. Null text counts as empty, repeated rows and equal
texts have equal sketches, extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobarn.llm.common import as_bytes, mix64, prepare

K = 128
WORDS = 5
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A random number for each byte value.
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """One 64-bit hash per shingle, repeats included; white space between words doesn't matter."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    gap = _SPACE[data]
    inside = np.concatenate([[False], ~gap, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    # a word's hash: the sum of its bytes' numbers by powers of an odd base, moved back to the word's start
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * _powers(_ODD, len(data)))])
    own = mix64((total[ends] - total[starts]) * _powers(_INVERSE, len(data))[starts])
    n = max(1, len(own) - words + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(words, len(own))):
        out = mix64(out * np.uint64(_ODD) + own[i : i + n])
    return out


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    if len(hashes) > 4 * k:  # only the smallest values matter; repeats may need a second look
        small = np.partition(hashes, 2 * k)[: 2 * k]
        found = np.unique(small)[:k]
        if len(found) == k:
            return found
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of two texts' shingles."""
    return np.union1d(a, b)[:k]


def _shared(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int]:
    union = merge(a, b, k)
    return int(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum()), len(union)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles among all shingles of both."""
    common, union = _shared(a, b, k)
    return common / union if union else 1.0


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles: exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[-1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    if not len(a):
        return 1.0
    union = merge(a, b, k)
    return min(1.0, resemblance(a, b, k) * distinct_count(union, k) / distinct_count(a, k))


def to_text(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def fingerprint(text: bytes, k: int = K, words: int = WORDS) -> np.ndarray:
    return sketch(shingle_hashes(text, words), k)


def fingerprints(documents: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """doc_id and fingerprint (hexadecimal) of every row."""
    prepare(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [to_text(fingerprint(x or b"", k, words)) for x in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    picked = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the beginning of the following one."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _compare(doc_id: int | None, text: str, own: np.ndarray, following: str, next_: np.ndarray, k: int, words: int) -> tuple:
    other = edited(text, following)
    changed = fingerprint(other.encode(), k, words)
    digest = hashlib.sha256(other.encode()).hexdigest()
    return doc_id, len(text), digest, to_text(own), to_text(changed), resemblance(own, changed, k), resemblance(own, next_, k)


_RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _RESULT.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
#: Ranges of ids for each shuffle partition at least; several make partitions even. Rows of a range, about, up to so many ranges: their
#: heads pass through the driver. Beyond, ranges get longer; tasks stream through them and hold one text.
RANGES = 4
RANGE_ROWS = 4000
MOST_RANGES = 8192
#: Stands for a missing id, after all others; its negative is a number as well.
_NO_ID = -(1 << 63) + 1


def _range_heads(placed: DataFrame, n: int) -> list[tuple[int, int]]:
    """First row of each of at most n ranges of about equal size, as (-id, hash), ascending: n pairs, from ids and hashes alone."""
    ids = placed.select((-F.greatest("doc_id", F.lit(_NO_ID))).alias("id"), "h")
    parts = ids.repartitionByRange(n, "id", "h").groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("id", "h")).alias("head"))
    return sorted({(r["id"], r["h"]) for r in parts.select("head.*").collect()})


def compare_with_next(documents: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's, by descending doc_id.

    Ids are cut into ranges, and each range's documents are sorted in one task; the first document of a range is
    also sent to the range before it, as the successor of its last one. Texts travel once, compressed. Null ids
    come last in the order; rows with one doc_id are ordered by a hash of their texts, so that they too are cut into ranges.
    """
    spark = documents.sparkSession
    prepare(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    placed = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    ranges = max(RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, -(-documents.count() // RANGE_ROWS)))
    n = -(-ranges // RANGES)
    heads = spark.sparkContext.broadcast(_range_heads(placed, ranges))  # a pair of numbers for each range

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        count = len(heads.value)
        for batch in batches:
            ids, hashes = (-np.maximum(batch.column(0).fill_null(_NO_ID).to_numpy(), _NO_ID)).tolist(), batch.column(2).to_pylist()
            # ranges are numbered from the largest ids on
            own = np.array([bisect_right(heads.value, x) - 1 for x in zip(ids, hashes)], np.int64)
            first = np.array([heads.value[r] == x for r, x in zip(own, zip(ids, hashes))], bool)
            z = [zstandard.ZstdCompressor(level=3).compress(x) for x in as_bytes(batch.column(1))]
            at = np.concatenate([np.arange(len(ids)), np.flatnonzero(first)])
            guest = np.arange(len(at)) >= len(ids)
            range_ = np.where(guest, (own[at] - 1) % count, own[at])
            columns = [pa.array(range_, pa.int64()), pa.array(guest), *(batch.column(c).take(pa.array(at)) for c in (0, 2)), pa.array([z[i] for i in at], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["range", "guest", "doc_id", "h", "z"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        range_, held, met = None, None, False
        for batch in batches:
            rows = []
            for now, guest, doc_id, _, z in zip(*(c.to_pylist() for c in batch.columns)):
                if now != range_:
                    range_, held, met = now, None, False
                if guest and met:
                    continue
                met = guest
                text = zstandard.ZstdDecompressor().decompress(z).decode()
                own = fingerprint(text.encode(), k, words)
                if held:
                    rows.append(_compare(*held, text, own, k, words))
                held = (doc_id, text, own)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(_KINDS), _KINDS)], _NAMES)

    dealt = placed.mapInArrow(deal, "range bigint, guest boolean, doc_id bigint, h bigint, z binary")
    return dealt.repartition(n, "range").sortWithinPartitions("range", "guest", F.col("doc_id").desc_nulls_last(), "h", "z").mapInArrow(compare, _RESULT)
