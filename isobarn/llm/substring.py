"""Removal of repeated passages by level-wise doubling (operator 4).

A window of `window` consecutive words is removed wherever its word sequence starts a second time in the corpus. The
search climbs levels of doubling length (18, 35 for a window of 35): a window that holds a sub-window which occurs
once can't occur twice, so only windows whose sub-windows are all repeated reach the next length. Below the last
level each window is represented by its smallest sub-window (by hash), which equal windows share, so a level moves
about one row for ten words. Occurrences are counted by grouping on hashes with partial sums; only what occurs once
returns to its document, which needs no join on a hot hash. Equal texts are found the same way, and one of
them stands for all at the last level. The last level's hashes have 96 bits, so windows are told apart at any size.

Texts travel compressed. Rows are told apart by 96 bits of hashes of id and text.

Defined results: null text has no words; texts shorter than the window keep all words; repeated rows are copies of
each other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobarn.llm.common import as_bytes, materialize, mix64, prepare

WINDOW = 35
#: The first level is the shortest half, quarter, ... of the window with at least so many words.
FIRST = 16
#: Marks among a document's single occurrences: its whole text occurs once; it stands for equal texts.
ALONE, FIRST_COPY = -1, -2
#: Words whose hashes a Python worker remembers.
CACHE_WORDS = 400_000

_known: dict[bytes, int] = {}


def levels(window: int = WINDOW, first: int = FIRST) -> list[int]:
    """Ascending window lengths; each is at most twice the one before."""
    found = [window]
    while (half := -(-found[0] // 2)) >= first:
        found.insert(0, half)
    return found


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    if len(_known) > CACHE_WORDS:
        _known.clear()
    get = _known.get

    def new(word: bytes) -> int:
        found = _known[word] = xxh64_intdigest(word)
        return found

    return np.fromiter([get(w) or new(w) for w in words], np.uint64, len(words))


def window_hashes(hashes: np.ndarray, length: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A hash of every window of `length` words, by doubling; empty where the text is shorter."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    own, size = hashes, 1
    while size < length:
        step = min(size, length - size)  # the last step overlaps
        own = mix64(own[: len(own) - step] * np.uint64(factor) + own[step:])
        size += step
    return own


def sliding(values: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """of (minimum or maximum) over every run of `width` values."""
    own, size = values, 1
    while size < width:
        step = min(size, width - size)
        own = of(own[: len(own) - step], own[step:])
        size += step
    return own


def alive(hashes: np.ndarray, window: int, single: dict[int, np.ndarray]) -> np.ndarray:
    """Which windows are not ruled out. single: positions of sub-windows that occur once, by level."""
    keep = np.ones(max(0, len(hashes) - window + 1), bool)
    for length, at in single.items():
        if len(keep) and len(at):
            own = window_hashes(hashes, length)
            once = np.full(len(own), np.uint64(0xFFFFFFFFFFFFFFFF))
            once[at] = own[at]
            width = window - length + 1
            keep &= sliding(own, width, np.minimum) != sliding(once, width, np.minimum)
    return keep


def representatives(hashes: np.ndarray, window: int, length: int, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the smallest sub-windows of the windows that are kept."""
    if not keep.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    own = window_hashes(hashes, length)
    width = window - length + 1
    least = np.where(keep, sliding(own, width, np.minimum), np.uint64(0))
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    at = np.flatnonzero((sliding(padded, width, np.maximum) == own) & (own > 0))
    return at, own[at]


def _compress(text: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(text)


def _restore(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


_HITS = "h1 bigint, h2 bigint, key bigint, low int, pos int, n int"


def _hits(rows: list[tuple[tuple[int, int], np.ndarray, np.ndarray, np.ndarray, int]]) -> pa.RecordBatch:
    """A batch of ((key, low), positions, first hashes, second hashes, weight)."""
    join = lambda i, kind: np.concatenate([x[i] for x in rows]).astype(kind) if rows else np.zeros(0, kind)
    sizes = [len(x[1]) for x in rows]
    columns = [
        join(2, np.uint64).view(np.int64),
        join(3, np.uint64).view(np.int64),
        np.repeat(np.array([x[0][0] for x in rows], np.int64), sizes),
        np.repeat(np.array([x[0][1] for x in rows], np.int32), sizes),
        join(1, np.int32),
        np.repeat(np.array([x[4] for x in rows], np.int32), sizes),
    ]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["h1", "h2", "key", "low", "pos", "n"])


def _first_level(source: DataFrame, window: int, length: int) -> DataFrame:
    """Representatives of all windows at the first level, and the digest of every text at position ALONE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for *key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                digest = np.frombuffer(hashlib.blake2b(text, digest_size=16).digest(), "<u8")
                rows.append((key, np.array([ALONE]), digest[:1], digest[1:], 1))
                words = text.split()
                if len(words) >= window:
                    hashes = word_hashes(words)
                    at, own = representatives(hashes, window, length, np.ones(len(words) - window + 1, bool))
                    rows.append((key, at, own, np.full(len(at), length, np.uint64), 1))
            yield _hits(rows)

    return source.select("key", "low", "text").mapInArrow(run, _HITS)


def _next_level(table: DataFrame, window: int, length: int, earlier: list[int]) -> DataFrame:
    """Representatives at a level, or all windows at the last one, of the documents that are still open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                hashes = word_hashes(_restore(x["z"]).split())
                keep = alive(hashes, window, _single(x, earlier))
                weight = 2 if x["first_copy"] else 1
                if length < window:
                    at, own = representatives(hashes, window, length, keep)
                    rows.append(((x["key"], x["low"]), at, own, np.full(len(at), length, np.uint64), weight))
                else:
                    at = np.flatnonzero(keep)
                    second = window_hashes(hashes, window, 0xC2B2AE3D27D4EB4F) & np.uint64(0xFFFFFFFF)
                    rows.append(((x["key"], x["low"]), at, window_hashes(hashes, window)[at], second[at], weight))
            yield _hits(rows)

    return table.mapInArrow(run, _HITS)


def _single(row: dict, earlier: list[int]) -> dict[int, np.ndarray]:
    return {length: np.array(row[f"once{length}"] or [], np.int64) for length in earlier}


def _once(hits: DataFrame, name: str) -> DataFrame:
    """Positions that occur once, by document; texts equal to others leave one mark, at their smallest key."""
    counted = hits.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min(F.struct("key", "low")).alias("row"), F.min("pos").alias("pos"))
    kept = counted.where((F.col("n") == 1) | (F.col("pos") == ALONE))
    mark = F.when(F.col("n") > 1, F.lit(FIRST_COPY)).otherwise(F.col("pos"))
    return kept.select("row.key", "row.low", mark.alias("pos")).groupBy("key", "low").agg(F.collect_list("pos").alias(name))


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _settle(joined: DataFrame, window: int, earlier: list[int], fresh: bool, last: bool) -> DataFrame:
    """Close the documents whose result is known: n_removed and kept are set, and the text is dropped."""
    schema = "key bigint, low int, doc_id bigint, n_words bigint, n_removed bigint, kept string, first_copy boolean, z binary"
    names = ["key", "low", "doc_id", "n_words", "n_removed", "kept", "first_copy", "z", *(f"once{x}" for x in earlier)]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary(), *[pa.list_(pa.int32())] * len(earlier)]
    before = earlier[:-1] if last else earlier

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                words = _restore(x["z"]).split()
                marks = [p for p in x[f"once{earlier[0]}"] or [] if p < 0]
                first_copy = x.get("first_copy") or FIRST_COPY in marks
                for length in earlier:
                    x[f"once{length}"] = [p for p in x[f"once{length}"] or [] if p >= 0]
                row = [x["key"], x["low"], x["doc_id"], len(words), None, None, first_copy, None, *[None] * len(earlier)]
                copied = fresh and not marks  # another row stands for this text
                if copied or len(words) < window:
                    gone = len(words) if len(words) >= window else 0
                    row[4:6] = gone, _digest([] if gone else words)
                else:
                    hashes = word_hashes(words)
                    keep = alive(hashes, window, _single(x, before))
                    if last:
                        keep[np.array(x[f"once{window}"] or [], np.int64)] = False
                    if last or not keep.any():
                        ends = np.zeros(len(words) + 1, np.int64)
                        ends[:-1][np.flatnonzero(keep)] += 1
                        np.subtract.at(ends, np.flatnonzero(keep) + window, 1)
                        covered = np.cumsum(ends)[:-1] > 0
                        row[4:6] = int(covered.sum()), _digest([w for w, c in zip(words, covered.tolist()) if not c])
                    else:
                        row[7:] = x["z"], *(x[f"once{length}"] for length in earlier)
                out.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names)

    return joined.mapInArrow(run, schema + "".join(f", once{x} array<int>" for x in earlier))


def _packed(source: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [_compress(x) for x in as_bytes(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(z, pa.binary())], ["key", "low", "doc_id", "z"])

    return source.select("key", "low", "doc_id", "text").mapInArrow(run, "key bigint, low int, doc_id bigint, z binary")


def remove_repeats(documents: DataFrame, window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    prepare(documents.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64("doc_id", text).alias("key"), F.hash(text, "doc_id").alias("low"))
    climbed, closed = levels(window, first), []
    open_ = _packed(source)
    for i, length in enumerate(climbed):
        last = length == window
        hits = _next_level(open_, window, length, climbed[:i]) if i else _first_level(source, window, length)
        joined = open_.join(_once(hits, f"once{length}"), ["key", "low"], "left")
        settled = materialize(_settle(joined, window, climbed[: i + 1], i == 0, last and i > 0), f"repeats{length}")
        closed.append(settled.where("z IS NULL"))
        open_ = settled.where("z IS NOT NULL").drop("n_words", "n_removed", "kept")
        if last and i == 0:  # a single level: the representatives are the windows themselves
            closed.append(_settle(open_, window, climbed, False, True))
    out = closed[0].select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))
    for more in closed[1:]:
        out = out.union(more.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256")))
    return out
