"""Best-fit packing of token pieces into sequences of bounded length (operator 1).

Lengths are integers up to the capacity, so the packing problem is fully described by one count per length.
The driver plans on that histogram (at most `capacity` rows, whatever the corpus size) with best-two-fit and
emits bin patterns with multiplicities; Spark then hands each piece the slot that its rank among the pieces
of the same length entitles it to. Ranks come from counters kept by the tokenising tasks plus prefix sums over
(length, task), so no length, however frequent, is gathered anywhere.

Defined results: null text counts as empty and gives one piece holding only the end token; repeated rows are
packed once each; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isobarn.llm.common import as_bytes, materialize, prepare

CAPACITY = 1024
END_ID = 2
#: Words whose ids a Python worker remembers; beyond this the older half is forgotten.
CACHE_WORDS = 300_000
#: The splitter of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space after white space (as any library sees it): there a text can't be cut at the space.
_AMBIGUOUS = re.compile("^ |[\\s\x1c-\x1f\x85\u180e\u200b\u2060\ufeff] ")


class WordTokenizer:
    """Token ids as little-endian uint32 bytes, remembering the ids of words.

    The byte-level splitter never lets a token cross from a non-space character into a following space. So a
    text may be cut before every space that follows a non-space character, and each " word" encoded alone.
    Texts with other uses of spaces, or with the strings of special tokens, are encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.special = [x["content"] for x in described.get("added_tokens", [])]
        self.by_rank = self._ranked(described)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _ranked(described: dict):
        """The same vocabulary as ranks, where ids follow the order of merges; None otherwise."""
        import tiktoken

        vocab = described["model"]["vocab"]
        merges = [x if isinstance(x, list) else x.split(" ") for x in described["model"]["merges"]]
        if described["pre_tokenizer"].get("type") != "ByteLevel" or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if i < 256 + len(merges)}
        return tiktoken.Encoding("words", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _encode(self, text: str) -> bytes:
        if self.by_rank is None or any(x in text for x in self.special):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.by_rank.encode_ordinary(text)).tobytes()

    def _word(self, word: str) -> bytes:
        found = self.young[word] = self.old.get(word) or self._encode(" " + word)
        return found

    def encode(self, text: str) -> bytes:
        if _AMBIGUOUS.search(text) or any(x in text for x in self.special):
            return self._encode(text)
        if len(self.young) > CACHE_WORDS:
            self.young, self.old = {}, self.young
        first, *words = text.split(" ")
        known = self.young
        return self._encode(first) + b"".join([known.get(w) or self._word(w) for w in words])


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def cut_lengths(total: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: all full, except that the first takes the remainder."""
    full, rest = divmod(total, capacity)
    return [rest] * (rest > 0) + [capacity] * full


def token_pieces(
    documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False
) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, [ids], task, rank.

    `rank` numbers the pieces of one length within one task from 0.
    """
    prepare(documents.sparkSession)
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        encoder = _tokenizer(tokenizer_path)
        for batch in batches:
            rows: list[tuple] = []
            texts = [x.decode() if x else "" for x in as_bytes(batch.column(1))]
            for doc_id, ids in zip(batch.column(0).to_pylist(), map(encoder.encode, texts)):
                ids += tail
                start = 0
                for piece, length in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    rank = int(seen[length])
                    seen[length] += 1
                    rows.append((doc_id, piece, start, length, zlib.crc32(own), own, task, rank))
                    start += length
            columns = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "task", "rank"]
            keep = [i for i in range(8) if keep_ids or i != 5]
            yield pa.RecordBatch.from_arrays([pa.array(columns[i], kinds[i]) for i in keep], [names[i] for i in keep])

    ids = "ids binary, " if keep_ids else ""
    schema = f"doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, {ids}task int, rank bigint"
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Bin patterns (multiplicity, lengths) that hold counts[length] pieces of each length.

    A bin is filled greedily, longest piece first. Then its shortest piece is replaced by the two unpacked
    pieces that fit its expanded gap most tightly, if they fit it more tightly than that piece did. The same
    pattern is repeated for as long as the counts allow it, so the work is bounded by the capacity.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} outside 1..{capacity}")
        left[length] = n
    patterns: list[tuple[int, list[int]]] = []
    while left.any():
        now, gap, bin_ = left.copy(), capacity, []
        while gap > 0 and len(fits := np.flatnonzero(now[1 : gap + 1])):
            length = int(fits[-1]) + 1
            take = min(int(now[length]), gap // length)
            bin_ += [length] * take
            now[length] -= take
            gap -= take * length
        if gap > 0 and bin_:
            least = bin_[-1]
            now[least] += 1
            pair = _tightest_pair(now, gap + least)
            if pair and sum(pair) > least:
                bin_[-1:] = pair
        lengths, used = np.unique(bin_, return_counts=True)
        times = int((left[lengths] // used).min())
        left[lengths] -= used * times
        patterns.append((times, sorted(bin_, reverse=True)))
    return patterns


def _tightest_pair(left: np.ndarray, room: int) -> list[int] | None:
    """Two available lengths with the largest sum within room."""
    present = np.flatnonzero(left[: room + 1])
    if not len(present):
        return None
    low, high, best = 0, len(present) - 1, None
    while low <= high:
        a, b = int(present[low]), int(present[high])
        if a + b > room:
            high -= 1
            continue
        if (low != high or left[a] > 1) and (best is None or a + b > sum(best)):
            best = [b, a]
        low += 1
    return best


def slots(patterns: list[tuple[int, list[int]]]) -> tuple[np.ndarray, ...]:
    """Runs of slots by (length, rank): start key, sequence base, slots per bin, offset; keys ascending.

    Piece number r of a run lies in sequence base + r // per_bin at offset + r % per_bin * length.
    """
    runs: list[tuple[int, int, int, int]] = []
    given: dict[int, int] = {}
    base = 0
    for times, lengths in patterns:
        offset = 0
        for length, per_bin in sorted(((x, lengths.count(x)) for x in set(lengths)), reverse=True):
            rank = given.get(length, 0)
            runs.append(((length << 44) + rank, base, per_bin, offset))
            given[length] = rank + times * per_bin
            offset += per_bin * length
        base += times
    runs.sort()
    return tuple(np.array(x, np.int64) for x in zip(*runs)) if runs else (np.zeros(0, np.int64),) * 4


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces that carry length, task and rank.

    `pieces` is read twice and should be materialised. The driver sees one count per length, no rows.
    """
    spark = pieces.sparkSession
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    table = spark.sparkContext.broadcast(slots(best_two_fit(counts, capacity)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    prefix = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    extra = [c for c in pieces.columns if c not in ("task", "rank")]
    ranked = pieces.join(prefix, ["length", "task"]).select(*extra, (F.col("before") + F.col("rank")).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, bases, per_bin, offsets = table.value
        for batch in batches:
            *kept, rank = batch.columns
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            key = (length << 44) + rank.to_numpy()
            at = np.searchsorted(keys, key, side="right") - 1
            nth = key - keys[at]
            placed = [pa.array(bases[at] + nth // per_bin[at]), pa.array(offsets[at] + nth % per_bin[at] * length)]
            yield pa.RecordBatch.from_arrays([*kept, *placed], [*extra, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(place, schema + ", sequence_id bigint, offset bigint")


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack all documents; one row per piece."""
    return pack(materialize(token_pieces(documents, tokenizer_path, capacity, end_id, keep_ids), "pieces"), capacity)
