"""Language identification by rank-order profiles (operator 9).

A language's profile is the ranking of its most frequent letter n-grams over all texts that may be learned from; a
document gets the language whose ranking is nearest to the document's own, by the sum of out-of-place distances.
Counting runs inside tasks and is summed by Spark; what reaches the driver is one list of PROFILE n-grams for each
language.

Defined results: null texts and texts without letters are `und` with score 0, as is everything if nothing can be
learned; rows without language or id are not learned from; equal distances go to the language first in the alphabet;
repeated rows count each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobarn.llm.common import prepare

#: N-grams of 1 to LONGEST letters; how many a profile and a document keep.
LONGEST = 3
PROFILE = 400
DOCUMENT = 300
#: Parts in which a language's n-grams are ranked before the parts' best are ranked together.
PARTS = 64
UNKNOWN = "und"
#: Different n-grams of a task's languages beyond which their counts are handed on.
HELD = 1_000_000

_LETTER = np.array([chr(i).isalpha() for i in range(0x10000)])


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, with each run of other characters as one space, inside spaces."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), np.uint32)
    letter = _LETTER[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        letter[i] = chr(points[i]).isalpha()
    points = np.where(letter, points, np.uint32(32))
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    return points[keep].astype(np.uint64)


def ngrams(text: str) -> np.ndarray:
    """Codes of all n-grams but the bare space; 21 bits a letter. Empty for a text without letters."""
    points = letters(text)
    if len(points) < 3:
        return np.zeros(0, np.uint64)
    out, own = [points[points != 32]], points
    for n in range(2, LONGEST + 1):
        own = (own[:-1] << np.uint64(21)) | points[n - 1 :]
        out.append(own)
    return np.concatenate(out)


def ranked(text: str, most: int = DOCUMENT) -> np.ndarray:
    """The text's most frequent n-grams, most frequent first."""
    codes, counts = np.unique(ngrams(text), return_counts=True)
    return codes[np.lexsort((codes, -counts))[:most]]


class Profiles:
    """Rankings by language."""

    def __init__(self, rankings: dict[str, list[int]]):
        self.names = sorted(rankings)
        self.sorted = []
        for name in self.names:
            codes = np.array(rankings[name], np.int64).view(np.uint64)
            order = np.argsort(codes)
            self.sorted.append((codes[order], order))

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance to each language; an n-gram missing from a profile counts PROFILE places."""
        rank, out = np.arange(len(own)), np.zeros(len(self.names))
        for i, (codes, order) in enumerate(self.sorted):
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            out[i] = np.where(codes[at] == own, np.abs(order[at] - rank), PROFILE).sum()
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked(text or "")
        if not len(own) or not self.names:
            return UNKNOWN, 0.0
        found = self.distances(own)
        best = int(np.argmin(found))
        others = np.delete(found, best)
        second = float(others.min()) if len(others) else float(len(own) * PROFILE)
        total = second + float(found[best])
        return self.names[best], second / total if total else 0.5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learned(documents: DataFrame) -> Profiles:
    """Profiles from all rows with text, language and id that are not held out."""
    prepare(documents.sparkSession)

    def handed(sums: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, (codes, counts) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts, pa.int64())], ["lang", "gram", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            texts: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.setdefault(lang, []).append(ngrams(text))
            for lang, parts in texts.items():
                codes, counts = np.unique(np.concatenate(parts), return_counts=True)
                if lang in sums:
                    both = np.concatenate([sums[lang][0], codes])
                    weight = np.concatenate([sums[lang][1], counts])
                    codes, where = np.unique(both, return_inverse=True)
                    counts = np.bincount(where, weight, len(codes)).astype(np.int64)
                sums[lang] = codes, counts
            if sum(len(codes) for codes, _ in sums.values()) > HELD:
                yield from handed(sums)
                sums = {}
        yield from handed(sums)

    rows = documents.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counted = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(count, "lang string, gram bigint, n bigint")
    total = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    within = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(PARTS))).orderBy(F.col("n").desc(), "gram")
    best = total.withColumn("r", F.row_number().over(within)).where(F.col("r") <= PROFILE)
    ranking = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "gram"))), 1, PROFILE)
    return Profiles({r["lang"]: [x["gram"] for x in r["ranking"]] for r in best.groupBy("lang").agg(ranking.alias("ranking")).collect()})  # PROFILE n-grams a language


def identify(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    prepare(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(profiles)  # PROFILE numbers a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(x) for x in batch.column(2).to_pylist()]
            columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "held_out", "lang_pred", "score"])

    picked = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
