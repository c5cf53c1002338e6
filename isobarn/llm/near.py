"""Near-dedup stage of the pipeline: one row of each group of texts whose five-word shingles are alike (Jaccard >= 0.8).

The method is operator 7's: SimHash fingerprints, keys of some of their bits, and the Gray-order index in the group of each key.
Operator 7's own measures (64 bits, four of them apart) find copies of about 0.95 and more only. Two equally large sets at 0.8 differ
in some 15 of 100 bits, so that no pigeonhole key divides anything; the stage therefore takes wide fingerprints of the sets:

- keys: each of `tables(k)` tables groups the sets by k bits of their own. k grows with the table, so that some 1,000 unlike sets at
  most share a key. Keys of over GROUP_LIMIT sets are dealt into blocks, and each pair of blocks is a group of its own; no pair is lost;
- index: PLACE words (256 bits) more are searched in each group by `simhash.GrayIndex`, for sets DISTANCE bits apart or fewer. Sets
  that it connects are candidates;
- check: candidates are compared on their whole shingle sets (`minmax.links`), all of them, however many copies a text has.
  Groups are the components of the links.

A pair at the threshold shares no key with probability 0.000002 at most, and is further apart than DISTANCE with 0.000002 (derived for FLIP,
the worst share of bits that differ for any two sizes of sets but 4 and 5, by enumeration up to 60 shingles; larger sets tend to
arccos(8 / 9) / pi = 0.1515). Unlike a limit on candidates, this is the same whatever the group's size.
Sets of up to SHORT shingles, of which one more or less turns more bits (SHORT_FLIP), meet in further tables.

Defined results: texts are compared in lower case; a text of fewer words is one shingle; null and wordless texts are
alike. Rows are judged each, whatever their doc_id: of a group the row with the smallest doc_id stays (null last), and
of several such rows one.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobarn.llm import minmax
from isobarn.llm.common import FEW, TAG, as_bytes, discard, materialize, mix64, prepare, tagged
from isobarn.llm.simhash import GROUP_LIMIT, GrayIndex, wide_fingerprint

WORDS = 5
#: Least Jaccard similarity, as a fraction of whole numbers.
LEAST = (4, 5)
#: Share of the bits that differ at the threshold: the most for sets of any two sizes, and for one of 4 and one of 5 shingles.
FLIP, SHORT_FLIP, SHORT = 0.1612, 0.1875, 5
#: Probability that two sets at the threshold share no key.
LOSS = 2e-6
#: 64-bit words that the index searches, and the bits that may differ: all but 0.000002 of the pairs with such shares are within.
PLACE = 4
DISTANCE, SHORT_DISTANCE = 70, 79
#: Bits of a key at least, and the binary logarithm of the unlike sets that share a key at most.
KEY_BITS, CROWD = 9, 10
#: Pairs that a task compares at a time.
PAIRS = 1 << 16


def key_bits(n: int) -> int:
    """Bits of a key for n sets."""
    return max(KEY_BITS, max(1, n - 1).bit_length() - CROWD)


def tables(bits: int, flip: float = FLIP) -> int:
    """Tables with keys of so many bits that two sets at the threshold need."""
    return ceil(log(LOSS) / log(1 - (1 - flip) ** bits))


def sketched(rows: DataFrame, bits: int) -> DataFrame:
    """doc_id, mark, n (size of the set), code, sketch (its wide fingerprint) of every row. rows: doc_id, mark, text."""
    prepare(rows.sparkSession)
    common, short = tables(bits), tables(bits, SHORT_FLIP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [minmax.shingle_set(x, WORDS) for x in as_bytes(batch.column(2))]
            wide = [wide_fingerprint(x, PLACE - -(common + (short if len(x) <= SHORT else 0)) * bits // 64).tobytes() if len(x) else b"" for x in sets]
            columns = [pa.array(list(map(len, sets)), pa.int64()), pa.array(list(map(minmax.code_of, sets)), pa.int64()), pa.array(wide, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "mark", "n", "code", "sketch"])

    return rows.select("doc_id", "mark", "text").mapInArrow(run, "doc_id bigint, mark bigint, n bigint, code bigint, sketch binary")


def keys_of(sketches: list[bytes], bits: int, n_tables: int) -> np.ndarray:
    """One row a sketch: its key in each table, which holds the table's number from bit 40 on."""
    words = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)[:, PLACE:]
    own = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")[:, : n_tables * bits]
    return (np.arange(n_tables) << 40) + own.reshape(len(sketches), n_tables, bits) @ (1 << np.arange(bits))


def keyed(codes: DataFrame, bits: int) -> DataFrame:
    """key, code and the words that the index searches, in every table. codes: code, n, sketch."""
    common = tables(bits)
    whole = common + tables(bits, SHORT_FLIP)
    places = [f"w{i}" for i in range(PLACE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, n, sketches = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for n_tables, rows in ((whole, np.flatnonzero(n <= SHORT)), (common, np.flatnonzero(n > SHORT))):
                if len(rows):
                    own = [sketches[i] for i in rows]
                    place = np.array([np.frombuffer(x, np.int64, PLACE) for x in own])
                    columns = [keys_of(own, bits, n_tables).ravel(), np.repeat(code[rows], n_tables), *(np.repeat(w, n_tables) for w in place.T)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "code", *places])

    return codes.where("n > 0").select("code", "n", "sketch").mapInArrow(run, "key bigint, code bigint, " + ", ".join(f"{w} bigint" for w in places))


def _near(key: np.ndarray, code: np.ndarray, words: np.ndarray, short: int) -> tuple[np.ndarray, np.ndarray]:
    """code, key of the members of each component of a group's index that has more than one. key: the group's key and blocks."""
    index = GrayIndex(words)
    root = index.components(SHORT_DISTANCE if key[0] >> 40 >= short else DISTANCE, max(1, min(2048, PAIRS // len(code))))
    code = code[index.order]
    others = np.bincount(root)[root] > 1
    name = mix64(np.array([key[0] ^ key[1] << 24 ^ key[2] << 44], np.int64).view(np.uint64)) ^ mix64(code[root[others]].view(np.uint64))
    return code[others], mix64(name).view(np.int64)


def candidates(codes: DataFrame, bits: int, total: int) -> DataFrame:
    """code, key: sets that the index connects in the group of a key share a key here. total: no fewer than there are codes."""
    spark = codes.sparkSession
    short = tables(bits)
    rows = keyed(codes, bits)
    if total > GROUP_LIMIT:
        many = rows.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > GROUP_LIMIT)
        large = materialize(many.select("key", F.ceil(F.col("many") / (GROUP_LIMIT // 2)).cast("int").alias("blocks")), "large")
        dealt = minmax.joined_left(rows, large, "key", large.count()).withColumn("at", F.pmod(F.xxhash64("code"), F.coalesce("blocks", F.lit(1))).cast("int"))
        others = F.when(F.col("blocks") > 1, F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("at"))).otherwise(F.array(F.lit(0)))
        rows = dealt.withColumn("other", F.explode(others)).withColumn("i", F.least("at", "other")).withColumn("j", F.greatest("at", "other"))
    else:
        large, rows = None, rows.withColumn("i", F.lit(0)).withColumn("j", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[np.ndarray] = []  # parts of the group that the next batch may go on with; columns in rows

        def close() -> list[tuple[np.ndarray, np.ndarray]]:
            if sum(x.shape[1] for x in open_) < 2:
                return []
            own = np.concatenate(open_, axis=1)
            return [_near(own[:3, 0], own[3], own[4:].view(np.uint64), short)]

        for batch in batches:
            rows = np.array([c.to_numpy().astype(np.int64, copy=False) for c in batch.columns])
            cuts = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1
            found = []
            for part in np.split(rows, cuts, axis=1) if rows.shape[1] else []:
                if open_ and (open_[0][:3, 0] != part[:3, 0]).any():
                    found += close()
                    open_ = []
                open_.append(part)
            yield _members(found)
        yield _members(close())

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = rows.select("key", "i", "j", "code", *(f"w{i}" for i in range(PLACE))).repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = materialize(met.mapInArrow(run, "code bigint, key bigint"), "candidates")
    if large is not None:
        discard(large)
    return found


def _members(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = [np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["code", "key"])


def drop_near_duplicates(documents: DataFrame) -> DataFrame:
    """One row of each group of like texts: that with the smallest doc_id."""
    rows = tagged(documents)
    picked = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(TAG).alias("mark"), F.col("text").cast("string").alias("text"))
    total = picked.count()
    bits = key_bits(total)
    own = materialize(sketched(picked, bits), "signatures")
    codes = minmax.distinct_codes(own, "sketch")
    near = candidates(codes, bits, total)
    found = minmax.links(picked, codes, near, WORDS, LEAST)
    roots = minmax.joined_left(codes.select("code", "least"), found.select(F.col("vertex").alias("code"), "root"), "code", found.count())
    kept = materialize(roots.groupBy(F.coalesce("root", "code").alias("root")).agg(F.min("least").alias("least")).select(F.col("least.mark").alias(TAG)), "kept")
    discard(own, codes, near, found)
    left = F.broadcast(kept) if kept.count() <= FEW else kept
    return rows.join(left, TAG, "left_semi").select(*documents.columns)
