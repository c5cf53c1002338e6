"""Min-max near-dedup: documents whose sets of word shingles are alike, and their groups (operator 11).

A permutation of the shingles' hashes gives two values of a signature, the least and the greatest hash, so HASHES permutations
give 2 * HASHES values, each equal for two sets with the probability of their Jaccard similarity. The values are banded, ROWS to a key:
two sets at 0.85 share none of the 24 keys with probability (1 - 0.85^5)^24 < 10^-6.

Equal sets are one code. Codes that share a key may be linked, and all are compared on their full sets; the comparison is exact
and emits no pairs. Codes that share keys, directly or by others, are a family. A family is compared as a whole, its sets sent once,
or bucket by bucket, whichever has fewer pairs: a family of copies of one text is whole, one that chains unlike texts falls
apart into its buckets. A group of more than BLOCK_ROWS sets or BLOCK_SHINGLES shingles is dealt into blocks, and each pair of blocks is a
task of its own, so memory is bounded whatever the group's size. In a task, common shingles are counted by products of
incidence matrices, and one link to the root of each component leaves it. The components of those links are the classes.

The work within one group of n near copies that are not equal grows as n * n (some nanoseconds a pair), as no link may be lost
and near copies of one text need not be near each other.

Defined results: null or wordless text has an empty set, which is linked with nothing, and is its own class; a text of fewer words
is one shingle; equal sets are always linked; repeated rows are rows of one class; a row with a null doc_id has the smallest doc_id
of its class, if there is one, and is not kept; shingles are told apart by 64-bit hashes; further columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobarn.llm.common import FEW, as_bytes, attach, discard, materialize, mix64, prepare
from isobarn.llm.components import connected_components
from isobarn.llm.simhash import merged
from isobarn.llm.sketch import shingle_hashes

WORDS = 3
#: Least similarity, as a fraction of whole numbers.
LEAST = (85, 100)
HASHES, ROWS = 60, 5
#: Sets and shingles of a block. Tasks hold two blocks and the counts of their pairs (64 MB).
BLOCK_ROWS = 2048
BLOCK_SHINGLES = 2 << 20
#: Shingles hashed at a time, and columns of an incidence matrix.
HASH_BLOCK = 4096
COLUMNS = 2048



def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, in lower case."""
    return np.unique(shingle_hashes((text or b"").lower(), words))


def code_of(own: np.ndarray) -> int:
    """One signed number for equal sets; 0 for an empty one."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(own.tobytes(), 42)).astype(np.int64)) if len(own) else 0


@cache
def _permutations(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """A number to flip by and an odd one to multiply by for each permutation."""
    return mix64(np.arange(1001, hashes + 1001, dtype=np.uint64))[:, None], mix64(np.arange(1, hashes + 1, dtype=np.uint64))[:, None] | np.uint64(1)


def signature(own: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """Least, then greatest value of each permutation of a non-empty set."""
    flip, multiply = _permutations(hashes)
    low, high = np.full(hashes, np.iinfo(np.uint64).max, np.uint64), np.zeros(hashes, np.uint64)
    for begin in range(0, len(own), HASH_BLOCK):
        part = (own[None, begin : begin + HASH_BLOCK] ^ flip) * multiply
        part ^= part >> np.uint64(32)
        low, high = np.minimum(low, part.min(axis=1)), np.maximum(high, part.max(axis=1))
    return np.concatenate([low, high])


def band_keys(own: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """The keys (signed) of a non-empty set."""
    bands = 2 * hashes // ROWS
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for row in signature(own, hashes).reshape(bands, ROWS).T:
        key = mix64(key ^ row)
    return key.view(np.int64)


def signed(rows: DataFrame, words: int = WORDS, hashes: int = HASHES) -> DataFrame:
    """doc_id, mark, n (size of the set), code, bands of every row. rows: doc_id, mark (bigint, tells rows of a doc_id apart), text."""
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x, words) for x in as_bytes(batch.column(2))]
            columns = [pa.array(list(map(len, sets)), pa.int64()), pa.array(list(map(code_of, sets)), pa.int64()), pa.array([band_keys(x, hashes) if len(x) else [] for x in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "mark", "n", "code", "bands"])

    return rows.select("doc_id", "mark", "text").mapInArrow(run, "doc_id bigint, mark bigint, n bigint, code bigint, bands array<bigint>")


def distinct_codes(rows: DataFrame, kept: str = "bands") -> DataFrame:
    """code, least (the row with the smallest doc_id, null last, then the smallest mark), n, bands, copies. rows: of `signed`, or with
    another column `kept` in place of bands that follows from the code."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    return materialize(rows.groupBy("code").agg(F.min(order).alias("least"), F.first("n").alias("n"), F.first(kept).alias(kept), F.count(F.lit(1)).alias("copies")), "codes")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share; only the part above the diagonal is meant."""
    m = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, m)
    element, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], element[1:] != element[:-1]])) if len(element) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(element)))
    counts = np.zeros((m, m), np.float32)
    few = min(32, m // 8)
    for t in range(2, few + 1):  # shingles of few sets: their pairs, one by one
        own = owner[first[times == t][:, None] + np.arange(t)]
        a, b = np.triu_indices(t, 1)
        step = max(1, (1 << 22) // len(a))
        for begin in range(0, len(own), step):
            part = own[begin : begin + step]
            np.add.at(counts.ravel(), (part[:, a] * m + part[:, b]).ravel(), np.float32(1))
    often = np.flatnonzero(times > max(1, few))
    for begin in range(0, len(often), COLUMNS):  # the others: a product of matrices
        own = often[begin : begin + COLUMNS]
        column = np.repeat(np.arange(len(own)), times[own])
        at = np.repeat(first[own] - np.concatenate([[0], np.cumsum(times[own])[:-1]]), times[own]) + np.arange(len(column))
        held = np.zeros((m, len(own)), np.float32)
        held[owner[at], column] = 1
        counts += held @ held.T
    return counts


def roots_of(sets: list[np.ndarray], least: tuple[int, int] = LEAST) -> np.ndarray:
    """Smallest member of each member's component under links of similar sets."""
    counts, m = common_counts(sets), len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, m)
    root = np.arange(m)
    for begin in range(0, m, 256):
        common = counts[begin : begin + 256].astype(np.int64)
        alike = sum(least) * common >= least[0] * (sizes[begin : begin + 256, None] + sizes)
        a, b = np.nonzero(alike)
        a += begin
        root = merged(m, a[a < b], b[a < b], root)
    return root


def banded(codes: DataFrame) -> DataFrame:
    """code, key: a row for each band of a code."""
    return codes.where("code <> 0").select("code", F.explode("bands").alias("key"))


def families(keyed: DataFrame) -> DataFrame:
    """code, key, family of every code that shares a key with another one; one row a key. keyed: code, key."""
    sizes = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min("code").alias("centre")).where("many > 1"), "buckets")
    members = materialize(joined(keyed, sizes.select("key", "centre"), "key", sizes.count()), "members")
    edges = members.where("code <> centre").select(F.col("code").alias("u"), F.col("centre").alias("v"))
    roots = connected_components(edges)
    named = joined_left(members.select("code", "key"), roots.select(F.col("vertex").alias("code"), "root"), "code", roots.count())
    found = materialize(named.select("code", "key", F.coalesce("root", "code").alias("family")), "families")
    discard(sizes, members, roots)
    return found


def joined(rows: DataFrame, facts: DataFrame, key: str, n: int) -> DataFrame:
    """rows with their facts, of which there are n; up to FEW are broadcast, and hot keys of more are split by AQE."""
    return rows.join(F.broadcast(facts) if n <= FEW else facts, key)


def joined_left(rows: DataFrame, facts: DataFrame, key: str, n: int) -> DataFrame:
    return rows.join(F.broadcast(facts) if n <= FEW else facts, key, "left")


def groups(codes: DataFrame, keyed: DataFrame) -> DataFrame:
    """group, i, j, code: every two codes that share a key meet in a group at least once. i, j: the pair of blocks of the group."""
    members = families(keyed)
    spread = F.xxhash64("code").cast("decimal(20,0)")
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.sum(spread).alias("sum"), F.min("family").alias("family"))
    # equal buckets are compared once
    buckets = materialize(buckets.groupBy("family", "many", "sum").agg(F.min("key").alias("key")), "buckets")
    whole = members.select("family", "code").distinct()
    pairs = whole.groupBy("family").agg(F.count(F.lit(1)).alias("own")).join(buckets.groupBy("family").agg(F.sum(F.col("many") * F.col("many")).alias("apart")), "family")
    pairs = materialize(pairs.select("family", (F.col("own") * F.col("own") <= F.col("apart")).alias("together")), "together")
    n = pairs.count()
    together = joined(whole, pairs.where("together").select("family"), "family", n).select(F.col("family").alias("group"), F.lit(0).alias("kind"), "code")
    split = joined(buckets, pairs.where("NOT together").select("family"), "family", n).select("key")
    apart = joined(members.select("key", "code"), split, "key", buckets.count()).select(F.col("key").alias("group"), F.lit(1).alias("kind"), "code")
    rows = together.union(apart).join(codes.select("code", "n", "least.doc_id", "least.mark"), "code")
    rows = materialize(rows.select(F.xxhash64("group", "kind").alias("group"), "code", "n", "doc_id", "mark"), "groups")
    sizes = rows.groupBy("group").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("many") / BLOCK_ROWS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    large = materialize(sizes.select("group", blocks.alias("blocks")).where("blocks > 1"), "large")
    dealt = joined_left(rows, large, "group", large.count()).withColumn("at", F.pmod(F.xxhash64("code"), F.coalesce("blocks", F.lit(1))).cast("int"))
    others = F.when(F.col("blocks") > 1, F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("at"))).otherwise(F.array(F.lit(0)))
    each = dealt.select("group", F.explode(others).alias("other"), "at", "code", "doc_id", "mark")
    found = materialize(each.select("group", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "code", "doc_id", "mark"), "wanted")
    discard(members, buckets, pairs, rows, large)
    return found


def links(rows: DataFrame, codes: DataFrame, keyed: DataFrame, words: int = WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """vertex, root: each code that is linked to a smaller one, and the smallest of its class. rows: doc_id, mark, text; keyed: code, key
    of the candidates, which share a key."""
    spark = rows.sparkSession
    wanted = groups(codes, keyed)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(x, words).tobytes() for x in as_bytes(batch.column(4))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(own, pa.binary())], ["group", "i", "j", "code", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, codes_, held = None, [], []

        def close() -> list[tuple[int, int]]:
            root = roots_of(held, least) if len(held) > 1 else []
            return [(codes_[a], codes_[b]) for a, b in enumerate(root) if a != b]

        for batch in batches:
            found = []
            for *now, code, shingles in zip(*(c.to_pylist() for c in batch.columns)):
                if now != key:
                    found += close()
                    key, codes_, held = now, [], []
                if not codes_ or codes_[-1] != code:  # repeated rows have one set
                    codes_.append(code)
                    held.append(np.frombuffer(shingles, np.uint64))
            yield _links(found)
        yield _links(close())

    picked = rows.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "text")
    small = F.broadcast(wanted) if wanted.count() <= FEW else wanted
    texts = picked.join(small, (picked["_mark"] == wanted["mark"]) & picked["_id"].eqNullSafe(wanted["doc_id"])).select("group", "i", "j", "code", "text")
    made = texts.mapInArrow(sets, "group bigint, i int, j int, code bigint, shingles binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = made.repartition(parts, "group", "i", "j").sortWithinPartitions("group", "i", "j", "code")
    alike = materialize(met.mapInArrow(compare, "u bigint, v bigint"), "alike")
    found = connected_components(alike)
    discard(wanted, alike)
    return found


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["u", "v"])


def near_duplicates(documents: DataFrame, words: int = WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    own = materialize(signed(rows, words), "signatures")
    codes = distinct_codes(own)
    found = links(rows, codes, banded(codes), words, least)
    rooted = joined_left(codes.where("code <> 0").select("code", "copies", "least.doc_id"), found.select(F.col("vertex").alias("code"), "root"), "code", found.count())
    rooted = materialize(rooted.select("code", "copies", "doc_id", F.coalesce("root", "code").alias("root")), "roots")
    total = rooted.agg(F.count(F.lit(1)).alias("codes"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()
    # a class of many codes, and a code of many rows, is a hot key of its join
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("many"))
    named = materialize(attach(rooted.select("code", "copies", "root"), smallest, "root", "many", total["codes"]).select("code", "component_id", "copies"), "named")
    full = attach(own.where("code <> 0").select("doc_id", "n", "code"), named, "code", "copies", total["rows"]).select("doc_id", "n", "component_id")
    out = full.union(own.where("code = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
