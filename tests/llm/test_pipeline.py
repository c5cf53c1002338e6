"""The pipeline's stages one after another, against brute force on a small fixture with null and repeated ids."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from isobarn.llm import pii, quality, queries

GRAM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=rng.randint(2, 8)))
    run = lambda n: " ".join(word() for _ in range(n))
    item = run(40)
    rows = [(i, run(rng.randint(40, 120))) for i in range(150)]
    rows += [(200 + i, " ".join(w + "%%%" for w in run(60).split())) for i in range(60)]  # junk
    near = rows[3][1].split()
    near[5] = "changed"
    rows += [(300, rows[1][1]), (301, rows[1][1]), (302, " ".join(near)), rows[2], (None, rows[4][1]), (None, run(60)), (7, "another text " + run(50))]
    rows += [(400, run(10) + " " + item + " " + run(20)), (401, item), (402, run(2000) + " " + item), (None, item + " x")]
    rows += [(500, run(30) + " a.b@c.de " + run(20) + " 10.0.0.1 " + run(5)), (501, None), (502, "")]
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 0 if 200 <= i < 260 else 1, 0) for i, _ in rows if i is not None]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, item


def _texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def _shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _near_left(rows):
    """doc_ids of the rows left: of each group of texts with Jaccard >= 0.8 the smallest."""
    root, sets = list(range(len(rows))), [_shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if 5 * len(sets[i] & sets[j]) >= 4 * union and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    groups = collections.defaultdict(list)
    for r, (i, _) in zip(root, rows):
        groups[r].append(i)
    return collections.Counter(min(ids, key=lambda x: (x is None, x)) for ids in groups.values())


def _clean(text, item):
    words, grams = GRAM.findall((text or "").lower()), GRAM.findall(item.lower())
    windows = {tuple(grams[s : s + 13]) for s in range(len(grams) - 12)}
    hit = {k for s in range(len(words) - 12) if tuple(words[s : s + 13]) in windows for k in range(s, s + 13)}
    return not hit or 20 * len(hit) < len(words)


def test_stages_one_after_another(spark, tables):
    folder, item = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "pii", "best_fit_packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = _texts(docs)
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), name)
        seen[name] = before, _texts(docs)
        assert set(spark.read.parquet(f"{folder}/documents.parquet").columns) <= set(docs.columns)
    # junk goes, and what goes scores below one half
    before, after = seen["quality_classifier"]
    source = spark.read.parquet(f"{folder}/documents.parquet")
    network = quality.trained(source, spark.read.parquet(f"{folder}/labels.parquet"))
    want = collections.Counter((i, t) for (i, t), s in zip(before, network.score([None if t is None else t.encode() for _, t in before])) if s >= 0.5)
    assert collections.Counter(after) == want
    held = [i for i, _ in before if i is not None and 200 <= i < 260 and zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([i not in {x for x, _ in after} for i in held]) > 0.9
    before, after = seen["simhash_near_dedup"]
    assert collections.Counter(i for i, _ in after) == _near_left(before)
    before, after = seen["benchmark_decontamination"]
    assert collections.Counter(after) == collections.Counter(x for x in before if _clean(x[1], item))
    assert 402 in {i for i, _ in after} or 402 not in {i for i, _ in before}
    before, after = seen["pii"]
    text = next((t for i, t in after if i == 500), None)
    assert text is None or "a.b@c.de" not in text and "[EMAIL]" in text and "[IP]" in text
    assert len(before) == len(after)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == collections.Counter(i for i, _ in after)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert collections.Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in whole) == collections.Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed)
    bins = collections.defaultdict(int)
    for r in whole:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 1024


def test_stages_on_an_empty_table(spark, tables):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != "best_fit_packing":
            docs = corpus_pipeline.materialize(docs, name)
    assert docs.count() == 0


def test_redaction_in_the_pipeline_uses_the_selector(spark, tables):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    score, thresholds = pii.selector(docs)
    assert isinstance(score, str) and len(thresholds) == len(pii.KINDS) and queries.tokenizer_path()
