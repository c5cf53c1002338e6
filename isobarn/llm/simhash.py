"""SimHash near-duplicates through a Gray-order hierarchical index (operator 7).

Fingerprints of four-word shingles link when they differ in few bits. All distinct fingerprints are dealt out by
pigeonhole keys: two codes within `distance` bits agree on at least one of distance + 1 bit classes, so equal
values of a class meet in one task. A key that many codes share is split again by the classes of the remaining
bits, which loses no pair, until groups are small. Within a group the codes are sorted by Gray rank; bit
patterns that neighbours share are factored into upper nodes; a search adds up differences from the top and
drops whole nodes beyond the distance, or nodes whose codes are already known to be connected. Each group
sends a star of links, never its pairs; components of the stars are the components of all links.

Defined results: null or wordless text has fingerprint zero, linked like any other; repeated rows and equal
texts share a fingerprint and a component; rows with a null doc_id keep their fingerprint and name the smallest
non-null doc_id of their component (null if there is none); empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobarn.llm.common import as_bytes, attach, materialize, mix64, prepare
from isobarn.llm.components import connected_components

WORDS = 4
DISTANCE = 4
SEED = 42
#: Codes under one key beyond which the key is split by further bits.
GROUP_LIMIT = 4096
#: Codes or nodes under one upper node.
FAN = 8
#: Codes that search the index at a time.
SEARCH_BLOCK = 2048
#: Hashes whose bits are counted at a time, in one byte a bit.
COUNT_BLOCK = 255


def fingerprint(text: bytes | None, words: int = WORDS, seed: int = SEED) -> int:
    """Bit i is set where over half of the shingles' XXH64 have it set."""
    from xxhash import xxh64_intdigest

    found = (text or b"").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - words + 1)
    last = ends[min(words, len(found)) - 1 :]
    hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist())], "<u8")
    set_ = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_ > n, bitorder="little").view("<u8")[0])


def wide_fingerprint(own: np.ndarray, n_words: int) -> np.ndarray:
    """SimHash of 64 * n_words bits: a set's 64-bit hashes are mixed anew for each word, and a bit is set where over half of them have it set."""
    turn = mix64(np.arange(2001, n_words + 2001, dtype=np.uint64))
    set_ = np.zeros(64 * n_words, np.int64)
    for begin in range(0, len(own), COUNT_BLOCK):
        part = mix64(own[begin : begin + COUNT_BLOCK, None] ^ turn)
        set_ += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * set_ > len(own), bitorder="little").view(np.uint64)


def fingerprints(documents: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, code (the fingerprint as a signed 64-bit number) of every row."""
    prepare(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([fingerprint(x, words, seed) for x in as_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64))], ["doc_id", "code"])

    picked = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, code bigint")


def bit_classes(distance: int) -> list[list[int]]:
    """By level: masks that divide the 64 bits into distance + 1 classes, each level in another way."""
    n = distance + 1
    wide = -(-64 // n)
    rules = (lambda i: i // wide, lambda i: i % n, lambda i: i // 3 % n, lambda i: i // 7 % n, lambda i: i * 5 % 64 // 2 % n, lambda i: i // 11 % n)
    return [[sum(1 << i for i in range(64) if rule(i) == j) for j in range(n)] for rule in rules]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def keyed(codes: DataFrame, distance: int = DISTANCE, limit: int = GROUP_LIMIT) -> DataFrame:
    """code, key: codes within the distance share a key at least once; few codes share a key.

    Keys are hashes; a collision only joins two groups, whose codes are compared exactly anyway.
    """
    done: list[DataFrame] = []
    rows = codes.select("code", F.lit(0).cast("bigint").alias("key"), F.lit(-1).cast("bigint").alias("free"))
    levels = bit_classes(distance)
    for level, masks in enumerate(levels):
        parts = []
        for j, mask in enumerate(masks):
            own = F.col("free").bitwiseAND(F.lit(_signed(mask)))
            rest = F.col("free").bitwiseAND(F.lit(_signed(~mask & (1 << 64) - 1)))
            parts.append(F.struct(F.xxhash64("key", F.lit(j), F.col("code").bitwiseAND(own)).alias("key"), rest.alias("free")))
        rows = rows.select("code", F.explode(F.array(*parts)).alias("part")).select("code", "part.key", "part.free")
        if level == len(levels) - 1:
            break
        large = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("key"), "keys")
        if large.isEmpty():
            break
        done.append(rows.join(large, "key", "left_anti").select("code", "key"))
        rows = rows.join(large, "key", "left_semi").select("code", "key", "free")
    done.append(rows.select("code", "key"))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def gray_ranks(words: np.ndarray) -> np.ndarray:
    """The same for wide codes, word by word, the highest word first."""
    ranks, odd = [], np.zeros(words.shape[1], np.uint64)
    for word in words:
        ranks.append(gray_rank(word) ^ (np.uint64(0) - odd))
        odd = ranks[-1] & np.uint64(1)
    return np.array(ranks)


def merged(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Smallest member of each member's component, given links a-b and earlier roots."""
    root = np.arange(n) if root is None else root
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (up := root[root])[root != up].size:
            root = up


class GrayIndex:
    """Codes in Gray order under nodes that hold what all their codes share.

    A node's mask has the bits on which its codes agree and its parent's codes do not; the sum of differences
    on the masks along a path is the Hamming distance of a leaf, and a lower bound of it before.
    """

    def __init__(self, codes: np.ndarray):
        """codes: one number a code, or rows of them, one for each 64-bit word of wide codes."""
        words = np.atleast_2d(codes)
        self.order = np.lexsort(gray_ranks(words)[::-1])
        self.words = words[:, self.order]
        self.codes = self.words[0]
        ones, zeros = [self.words], [~self.words]
        while ones[-1].shape[1] > FAN:
            cut = np.arange(0, ones[-1].shape[1], FAN)
            ones.append(np.bitwise_and.reduceat(ones[-1], cut, axis=1))
            zeros.append(np.bitwise_and.reduceat(zeros[-1], cut, axis=1))
        self.pattern = ones
        agreed = [a | b for a, b in zip(ones, zeros)]
        self.mask = [own & ~np.repeat(up, FAN, axis=1)[:, : own.shape[1]] for own, up in zip(agreed, agreed[1:])] + [agreed[-1]]

    def components(self, distance: int, block: int = SEARCH_BLOCK) -> np.ndarray:
        """Root index of each code; codes within the distance of each other have one root. `block` codes search at a time."""
        words, n, top = self.words, len(self.codes), len(self.mask) - 1
        count = np.uint8 if len(words) < 4 else np.uint16
        near = sum(np.bitwise_count(w[1:] ^ w[:-1]).astype(np.int64) for w in words) <= distance
        root = merged(n, np.flatnonzero(near), np.flatnonzero(near) + 1)
        sizes = [m.shape[1] for m in self.mask]
        for begin in range(0, n, block):
            least, most = [root], [root]
            for level in range(top):
                cut = np.arange(0, len(least[level]), FAN)
                least.append(np.minimum.reduceat(least[level], cut))
                most.append(np.maximum.reduceat(most[level], cut))
            one = [np.where(a == b, a, -1) for a, b in zip(least, most)]  # the root of all codes of a node, or -1
            who = np.arange(begin, min(n, begin + block))
            # all nodes from the block's own on as a table, as long as most of them are left
            apart, start, level = np.zeros((len(who), 1), count), 0, top + 1
            left = np.ones(apart.shape, bool)
            while level and 4 * np.count_nonzero(left) >= left.size:
                level -= 1
                above, start = start, begin // FAN**level
                if level < top:
                    skip = slice(start - above * FAN, sizes[level] - above * FAN)
                    apart, left = (np.repeat(x, FAN, axis=1)[:, skip] for x in (apart, left))
                for own, pattern, mask in zip(words, self.pattern[level], self.mask[level]):
                    apart = apart + np.bitwise_count((own[who][:, None] ^ pattern[start:]) & mask[start:])
                behind = np.arange(start, sizes[level]) < (who // FAN**level)[:, None]  # each pair once
                left = left & (apart <= distance) & (one[level][start:] != root[who][:, None]) & ~behind
            at, which = np.nonzero(left)
            who, node, differ = who[at], which + start, apart[at, which]
            for level in range(level - 1, -1, -1):  # then the children of the nodes that are left
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                who, differ = np.repeat(who, FAN), np.repeat(differ, FAN)
                there = node < sizes[level]
                node, who, differ = node[there], who[there], differ[there]
                for own, pattern, mask in zip(words, self.pattern[level], self.mask[level]):
                    differ = differ + np.bitwise_count((own[who] ^ pattern[node]) & mask[node])
                keep = (differ <= distance) & (one[level][node] != root[who]) & (node >= who // FAN**level)
                node, who, differ = node[keep], who[keep], differ[keep]
            root = merged(n, who, node, root)
        return root


def stars(groups: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """u, v: one link from each code of a group to its root in that group. groups: code, key."""

    def star(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        index = GrayIndex(np.unique(np.concatenate(codes)))
        root = index.components(distance)
        other = np.flatnonzero(root != np.arange(len(root)))
        return index.codes[other], index.codes[root[other]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, open_ = None, []
        for batch in batches:
            keys = batch.column(1).to_numpy()
            codes = batch.column(0).to_numpy().view(np.uint64)
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            found = []
            for key, part in zip(keys[np.concatenate([[0], cuts])] if len(keys) else [], np.split(codes, cuts)):
                if key != last and open_:
                    if sum(map(len, open_)) > 1:
                        found.append(star(open_))
                    open_ = []
                last = key
                open_.append(part)
            yield _links(found)
        if sum(map(len, open_)) > 1:
            yield _links([star(open_)])

    spark = groups.sparkSession
    prepare(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return groups.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "u bigint, v bigint")


def _links(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = [np.concatenate([x[i] for x in found]).view(np.int64) if found else np.zeros(0, np.int64) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["u", "v"])


def near_duplicates(documents: DataFrame, distance: int = DISTANCE, words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    rows = materialize(fingerprints(documents, words), "fingerprints")
    codes = materialize(rows.groupBy("code").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "codes")
    links = connected_components(stars(keyed(codes.select("code"), distance), distance))
    rooted = codes.join(links, codes.code == links.vertex, "left").select("code", "least", "copies", F.coalesce("root", "code").alias("root"))
    rooted = materialize(rooted, "roots")
    total = rooted.agg(F.count(F.lit(1)).alias("codes"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()
    # a component of many codes, and a code of many rows, is a hot key of its join
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = materialize(attach(rooted.select("code", "copies", "root"), smallest, "root", "n", total["codes"]).select("code", "component_id", "copies"), "named")
    digits = F.lower(F.lpad(F.hex("code"), 16, "0"))
    return attach(rows, named, "code", "copies", total["rows"]).select("doc_id", digits.alias("fingerprint"), "component_id")
