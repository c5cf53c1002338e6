"""The near-dedup stage by its method: wide SimHash fingerprints, keys, the Gray-order index, and the exact check."""

import collections
import random

import numpy as np
import pytest

from isobarn.llm import minmax, near, simhash


@pytest.mark.parametrize("words, distance, turned, block", [(4, 70, 50, 16), (4, 70, 50, 2048), (2, 20, 18, 16), (1, 4, 5, 7)])
def test_index_of_wide_codes_finds_all_links(words, distance, turned, block):
    rng = np.random.default_rng(3)
    codes = np.repeat(rng.integers(0, 2**63, (words, 40)).astype(np.uint64), 13, axis=1)
    for j in range(codes.shape[1]):
        for bit in rng.choice(64 * words, rng.integers(0, turned), replace=False):
            codes[bit // 64, j] ^= np.uint64(1) << np.uint64(bit % 64)
    apart = sum(np.bitwise_count(w[:, None] ^ w).astype(int) for w in codes)
    want = simhash.merged(codes.shape[1], *np.nonzero(apart <= distance))
    index = simhash.GrayIndex(codes)
    got = np.empty_like(want)
    got[index.order] = index.components(distance, block)
    assert len(np.unique(want)) == len(np.unique(got)) == len(set(zip(want.tolist(), got.tolist())))


def test_wide_fingerprint_is_the_majority_of_each_bit():
    rng = np.random.default_rng(4)
    for n in (1, 4, 255, 256, 700):
        own = rng.integers(0, 2**63, n).astype(np.uint64)
        got = np.unpackbits(simhash.wide_fingerprint(own, 3).view(np.uint8), bitorder="little")
        mixed = minmax.mix64(own[:, None] ^ minmax.mix64(np.arange(2001, 2004, dtype=np.uint64)))
        want = [sum(int(x) >> bit & 1 for x in mixed[:, word]) * 2 > n for word in range(3) for bit in range(64)]
        assert got.tolist() == want


def _pairs(rng, n):
    """n pairs of texts of each shape, all with a Jaccard similarity of 0.8 or little more: (words, words more, last words changed)."""
    made = []
    for length, more, changed in [(8, 1, 0), (16, 3, 0), (44, 10, 0), (204, 50, 0), (13, 0, 1), (22, 0, 2), (112, 0, 12)]:
        for _ in range(n):
            base = [f"w{rng.randrange(10**9)}" for _ in range(length)]
            new = [f"w{rng.randrange(10**9)}" for _ in range(more + changed)]
            made.append((" ".join(base), " ".join(base[: length - changed] + new)))
    return made


@pytest.mark.parametrize("limit", [4096, 8])
def test_candidates_hold_every_pair_at_the_threshold(spark, limit, monkeypatch):
    monkeypatch.setattr(near, "GROUP_LIMIT", limit)  # with 8, keys are dealt into blocks
    pairs = _pairs(random.Random(6), 60)
    for a, b in pairs:
        a, b = (set(minmax.shingle_set(x.encode(), near.WORDS).tolist()) for x in (a, b))
        assert 0.8 <= len(a & b) / len(a | b) < 0.87
    rows = spark.createDataFrame([(2 * i + j, i, t) for i, pair in enumerate(pairs) for j, t in enumerate(pair)], "doc_id bigint, mark bigint, text string").repartition(3)
    bits = near.key_bits(2 * len(pairs))
    own = minmax.materialize(near.sketched(rows, bits), "signatures")
    found = near.candidates(minmax.distinct_codes(own, "sketch"), bits, 2 * len(pairs))
    doc = {r.code: r.doc_id for r in own.select("code", "doc_id").collect()}
    met = collections.defaultdict(set)
    for r in found.collect():
        met[r.key].add(doc[r.code])
    together = {(a, b) for ids in met.values() for a in ids for b in ids if a < b}
    assert together == {(2 * i, 2 * i + 1) for i in range(len(pairs))}


def test_stage_takes_its_candidates_from_simhash(spark, monkeypatch):
    def not_the_method(*_):
        raise AssertionError("min-max signatures")

    monkeypatch.setattr(minmax, "signed", not_the_method)
    indexed = []
    monkeypatch.setattr(near, "candidates", lambda *a, kept=near.candidates: indexed.append(kept(*a)) or indexed[-1])
    pairs = _pairs(random.Random(7), 5)
    rows = [(2 * i + j, t) for i, pair in enumerate(pairs) for j, t in enumerate(pair)]
    left = near.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r.doc_id for r in left.collect()) == list(range(0, 2 * len(pairs), 2)) and len(indexed) == 1


def test_tables_and_bits_keep_the_loss():
    for n in (2, 10**5, 2**20, 2**24, 10**9):
        bits = near.key_bits(n)
        assert n <= 2 ** (bits + near.CROWD) or bits > near.KEY_BITS
        for flip in (near.FLIP, near.SHORT_FLIP):
            assert (1 - (1 - flip) ** bits) ** near.tables(bits, flip) <= near.LOSS
