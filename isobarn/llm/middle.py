"""Fill-in-the-middle transformation on a wavelet matrix over character classes (operator 12).

The bytes of a batch of texts are mapped to five classes: continuation bytes, characters within a word, first
characters of words, white space and line ends. A wavelet matrix over the classes answers how many bytes of a class stand
before any place. Sums of such ranks count boundaries: characters are all classes but the first, words and lines one class
each. Both cuts of all texts of a batch are found together by bisection on these counts.

Prefix, middle and suffix are marked by three sentinels. A text that is empty, holds a sentinel, or is dealt no
transformation by the hash of its id stays as it is (form `plain`).

Defined results: null text counts as empty; a null doc_id is hashed as the empty string; repeated rows give equal results;
texts are cut between units only, whatever their length; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobarn.llm.common import prepare

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, how many stay plain, and of 100 others, how many put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Classes of bytes.
WITHIN, INNER, FIRST, SPACE, LINE = range(5)
#: Units of a text: the classes whose bytes begin one.
UNITS = {"character": (INNER, FIRST, SPACE, LINE), "word": (FIRST,), "line": (LINE,)}
_KIND = np.full(256, INNER, np.uint8)
_KIND[0x80:0xC0] = WITHIN
_KIND[[9, 11, 12, 13, 32]] = SPACE
_KIND[10] = LINE


def classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of each byte; texts begin at `starts`, so words do not reach across them."""
    kind = _KIND[data]
    after = np.ones(len(data), bool)
    after[1:] = (kind[:-1] == SPACE) | (kind[:-1] == LINE)
    after[starts[starts < len(data)]] = True
    kind[after & (kind == INNER)] = FIRST
    return kind


class WaveletMatrix:
    """Ranks of symbols below 2 ** bits in a sequence: one bit vector a level, each in the order that the levels above sorted."""

    def __init__(self, symbols: np.ndarray, bits: int = 3):
        self.size, self.levels = len(symbols), []
        for bit in range(bits - 1, -1, -1):
            ones = symbols >> bit & 1 == 1
            words = np.zeros(self.size // 64 + 1, np.uint64)
            packed = np.packbits(ones, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((bit, words, before, self.size - int(before[-1])))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[at >> 6] + np.bitwise_count(words[at >> 6] & low)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands in the first `at` places, for each of `at`."""
        begin, at = np.zeros(1, np.int64), at.astype(np.int64)
        for bit, words, before, zeros in self.levels:
            if symbol >> bit & 1:
                begin, at = zeros + self._ones(words, before, begin), zeros + self._ones(words, before, at)
            else:
                begin, at = begin - self._ones(words, before, begin), at - self._ones(words, before, at)
        return at - begin

    def count(self, symbols: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        """Places of any of the symbols among the first `at`; by the other symbols where these are fewer."""
        others = [s for s in range(LINE + 1) if s not in symbols]
        if len(others) < len(symbols):
            return at - sum(self.rank(s, at) for s in others)
        return sum(self.rank(s, at) for s in symbols)

    def cut(self, symbols: tuple[int, ...], starts: np.ndarray, ends: np.ndarray, units: np.ndarray) -> np.ndarray:
        """The last place of each part starts..ends with so many units before it, by bisection on the counts."""
        most = self.count(symbols, starts) + units
        low, high = starts.copy(), ends.copy()
        while (open_ := low < high).any():
            middle = np.where(open_, (low + high + 1) // 2, low)
            fits = self.count(symbols, middle) <= most
            low, high = np.where(open_ & fits, middle, low), np.where(open_ & ~fits, middle - 1, high)
        return low


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column without nulls."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def drawn(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers of a document id: the first digits of the sha256 of `seed:id`."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def form_of(text: Column, plain: Column, order: Column) -> Column:
    """plain, spm (suffix first) or psm."""
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    stays = (text == "") | marked | (plain % 100 >= 100 - PLAIN)
    return F.when(stays, "plain").when(order % 100 < SUFFIX_FIRST, "spm").otherwise("psm")


def fill_in_middle(documents: DataFrame, unit: str = "character", seed: int = 1) -> DataFrame:
    """doc_id, n (units of the text), form, prefix_units, middle_units (null if plain), output of every row."""
    prepare(documents.sparkSession)
    symbols = UNITS[unit]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    h = drawn(F.col("doc_id"), seed)
    picked = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), form_of(text, h[2], h[3]).alias("form"), h[0].alias("h1"), h[1].alias("h2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _bytes_of(batch.column(1))
            matrix = WaveletMatrix(classes(data, offsets[:-1]))
            starts, ends = offsets[:-1], offsets[1:]
            n = matrix.count(symbols, ends) - matrix.count(symbols, starts)
            one, two = (batch.column(i).to_numpy() % (n + 1) for i in (3, 4))
            first, last = np.minimum(one, two), np.maximum(one, two)
            cuts = zip(starts.tolist(), matrix.cut(symbols, starts, ends, first).tolist(), matrix.cut(symbols, starts, ends, last).tolist(), ends.tolist())
            whole = memoryview(data)
            out = []
            for form, (a, b, c, d) in zip(batch.column(2).to_pylist(), cuts):
                head, middle, tail = (str(whole[i:j], "utf-8") for i, j in ((a, b), (b, c), (c, d)))
                if form == "plain":
                    out.append(head + middle + tail)
                elif form == "psm":
                    out.append(f"{PREFIX}{head}{SUFFIX}{tail}{MIDDLE}{middle}")
                else:
                    out.append(f"{SUFFIX}{tail}{PREFIX}{head}{MIDDLE}{middle}")
            plain = np.array(batch.column(2).to_pylist(), object) == "plain"
            numbers = [pa.array(n), batch.column(2), pa.array(first, mask=plain), pa.array(last - first, mask=plain)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array(out, pa.string())], ["doc_id", "n", "form", "prefix_units", "middle_units", "output"])

    return picked.mapInArrow(run, "doc_id bigint, n bigint, form string, prefix_units bigint, middle_units bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text behind an output. Sentinels are unambiguous, as no transformed text holds one and none begins within another."""
    rest = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))
    parts = []
    for second in (SUFFIX, PREFIX):
        one = F.substring_index(rest, second, 1)
        after = F.substring(rest, F.length(one) + F.lit(len(second) + 1), F.length(output))
        two = F.substring_index(after, MIDDLE, 1)
        middle = F.substring(after, F.length(two) + F.lit(len(MIDDLE) + 1), F.length(output))
        parts.append(F.concat(one, middle, two) if second == SUFFIX else F.concat(two, middle, one))
    return F.when(form == "psm", parts[0]).when(form == "spm", parts[1]).otherwise(output)
