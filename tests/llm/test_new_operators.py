"""Operators 11 to 13 against brute force: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import collections
import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from isobarn.llm import middle, minmax, queries, repair

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


# 11 min-max near-dedup
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _shingles(text, words=3):
    own = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    return frozenset(tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1))) if own else frozenset()


def _classes(rows):
    """Size of the set, smallest id of the class and whether it is the row's own, for every row, by comparing all sets."""
    ids = collections.defaultdict(list)
    for i, t in rows:
        ids[_shingles(t)].append(i)
    sets = [s for s in ids if s]
    up = {s: s for s in ids}

    def top(s):
        while up[s] is not s:
            s = up[s]
        return s

    for k, a in enumerate(sets):
        for b in sets[:k]:
            common = len(a & b)
            if 100 * common >= 85 * (len(a) + len(b) - common):
                up[top(a)] = top(b)
    least = {}
    for s, own in ids.items():
        found = [i for i in own if i is not None] + ([least[top(s)]] if top(s) in least else [])
        if found and s:
            least[top(s)] = min(found)
    out = collections.Counter()
    for i, t in rows:
        s = _shingles(t)
        c = least.get(top(s)) if s else i
        out[i, len(s), c, i is not None and i == c] += 1
    return out


def _copies(seed, n, words, edits):
    """n copies of one text with up to so many words changed, some of them copies of copies."""
    rng = random.Random(seed)
    made = [[f"w{rng.randrange(10**6)}" for _ in range(words)]]
    for _ in range(n - 1):
        own = list(rng.choice(made) if rng.random() < 0.3 else made[0])
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        made.append(own)
    return [" ".join(x) for x in made]


@pytest.mark.parametrize("block_rows", [2048, 40])
def test_classes_equal_brute_force(spark, documents, rows, monkeypatch, block_rows):
    monkeypatch.setattr(minmax, "BLOCK_ROWS", block_rows)
    texts = _copies(1, 400, 120, 9) + _copies(2, 60, 30, 2) + _copies(3, 30, 8, 1) + _copies(4, 6, 900, 60)
    texts += [None, "", "one", "ONE", "one two", "\t", "a b c d e f g", "a b c d e f g"] + [t.upper() for t in texts[:5]]
    random.Random(5).shuffle(texts)
    more = [(1000 + i, t) for i, t in enumerate(texts)] + [(1003, texts[9]), (None, texts[4]), (None, texts[11]), (1007, texts[7])]
    table = spark.createDataFrame(more, "doc_id bigint, text string").selectExpr("*", "1 AS n", "'z' AS code", "2 AS mark").unionByName(documents.select("doc_id", "text"), allowMissingColumns=True)
    found = collections.Counter(map(tuple, minmax.near_duplicates(table).collect()))
    assert found == _classes(more + rows)


def test_families_that_chain_are_split(spark):
    """Texts that share half their shingles with the next one share keys here and there, and no class."""
    rng = random.Random(7)
    words = [f"w{rng.randrange(10**6)}" for _ in range(6000)]
    rows = [(i, " ".join(words[10 * i : 10 * i + 100])) for i in range(590)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert collections.Counter(map(tuple, minmax.near_duplicates(table).collect())) == _classes(rows)


def test_common_counts_are_exact():
    rng = np.random.default_rng(3)
    for m, most in ((1, 5), (2, 0), (3, 30), (40, 60), (300, 25)):
        sets = [np.unique(rng.integers(0, 90, rng.integers(0, most + 1)).astype(np.uint64)) for _ in range(m)]
        counts = minmax.common_counts(sets)
        assert all(counts[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(m) for j in range(i + 1, m))


# 12 fill in the middle
def _cut(doc_id, text):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    head, mid, tail = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{tail}<P>{head}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{head}<S>{tail}<M>{mid}"


def test_fill_in_middle_equals_slices(spark, documents, rows):
    more = [(200 + i, t) for i, t in enumerate(["a<P>b", "<S>", "x<M", "<<<", "<P", "S>", "é", "😀😀😀", "á" * 40, "\n\n", "<S<P<M" * 5])]
    more += [(300 + i, "x<P"[: 1 + i % 3] * (i % 7)) for i in range(60)]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in more], "doc_id bigint, text string, n int, form string").select("doc_id", "text").unionByName(documents.select("doc_id", "text"))
    found = middle.fill_in_middle(table)
    found = found.withColumn("back", middle.restored(found.output, found.form)).collect()
    want = collections.Counter((i, *_cut(i, t or "")) for i, t in more + rows)
    assert collections.Counter((r.doc_id, r.n, r.form, r.prefix_units, r.middle_units, r.output) for r in found) == want
    assert collections.Counter((r.doc_id, r.back) for r in found) == collections.Counter((i, t or "") for i, t in more + rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit", ["word", "line"])
def test_cuts_by_other_units(spark, rows, unit):
    texts = [t for _, t in rows if t and not re.search("<[PSM]>", t)] + ["a b\nc d\n\ne", "\n", "é é\n😀"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    begins = (lambda t: [m.start() for m in re.finditer("[^\x20\x09-\x0d]+", t)]) if unit == "word" else (lambda t: [m.start() for m in re.finditer("\n", t)])
    for r in middle.fill_in_middle(table, unit).collect():
        at = begins(texts[r.doc_id])
        assert r.n == len(at)
        if r.form != "plain":
            ends = [*at, len(texts[r.doc_id])]
            a, b = ends[r.prefix_units], ends[r.prefix_units + r.middle_units]
            t = texts[r.doc_id]
            assert r.output == (f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}" if r.form == "psm" else f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}")


def test_wavelet_ranks_equal_counts():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 5, n).astype(np.uint8)
        matrix = middle.WaveletMatrix(symbols)
        at = np.arange(n + 1)
        for s in range(5):
            assert matrix.rank(s, at).tolist() == [int((symbols[:i] == s).sum()) for i in at]


# 13 conversation repair
def _damage(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        own = out[conv]
        role, text = " " if role is None else role, " " if text is None else text
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        own += [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, x in out.items()}


def _repair(rows):
    """Least (cost, edits) by plain recursion over whole strings, then the repaired text and the counts."""
    seen, marks, counts = set(), [], collections.Counter()
    for turn, role, text in rows:
        body = re.findall("[^\x20\x09-\x0d]", text)
        kind = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        marks.append((role[:1], kind))
        counts[kind] += 1
    counts["illegal"] = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
    step = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}

    @functools.cache
    def best(i, q, inserted=0):
        found = [] if inserted == 2 else [(c + 3, "I" + e) for c, e in [best(i, step[q][0], inserted + 1)] if e is not None]
        if i == len(marks):
            found += [(0, "")] if q in (0, 3) else []
        else:
            role, kind = marks[i]
            more = 3 * (kind == "truncated")
            options = [("D", 4, q)]
            if kind not in ("blank", "duplicate"):
                options.append(("R", 3 + more, step[q][0]))
                if role == "s" and q == 0:
                    options.append(("K", more, 1))
                elif role == step[q][1][0]:
                    options.append(("K", more, step[q][0]))
            found += [(cost + c, letter + e) for letter, cost, then in options for c, e in [best(i + 1, then)] if e is not None]
        return min(found) if found else (0, None)

    cost, edits = best(0, 0)
    at, q, out = 0, 0, []
    for e in edits:
        if e == "I":
            out.append(f"{step[q][1]}:")
        elif e == "R":
            out.append(f"{step[q][1]}:{rows[at][2]}")
        elif e == "K":
            out.append(f"{rows[at][1]}:{rows[at][2]}")
        if e != "D":
            q = 1 if e == "K" and marks[at][0] == "s" else step[q][0]
        at += e != "I"
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], cost, edits, sha("\n".join(out)))


SCHEMA = "conv_id bigint, turn bigint, role string, text string, live boolean, seen string, pos int, phase int"


def _talks(seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No!", "cut short", "", " \n", None, "Why? ", "é. ", "a.\tb", "?"]
    rows = []
    for conv in [*range(120), None]:
        rows += [(conv, rng.choice([t, t, t, t, t, t + 1, t + 2, None, 3]), rng.choice(roles[: rng.choice([3, 8])]), rng.choice(texts[: rng.choice([2, 10])]) if rng.random() < 0.5 else f"text {conv} {t}.") for t in range(rng.randint(1, 14))]
    rows.append((500, 0, "user", "dropped"))
    return rows


def test_repair_equals_brute_force(spark):
    dropped = next(i for i in range(1000, 3000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [*_talks(5), (dropped, 0, "user", "all of it goes.")]
    long = [(900, i, ["user", "assistant"][i % 2 if i % 7 else 0], f"turn {i}{'.' if i % 5 else ''}") for i in range(2000)]
    table = spark.createDataFrame([(*r, None, "x", 3, 7) for r in rows + long], SCHEMA).repartition(3)
    found = {r.conv_id: tuple(r)[1:] for r in repair.repair(repair.damaged(table)).collect()}
    own = _damage(rows)
    assert found.keys() == own.keys() | {900}
    for conv, x in own.items():
        assert found[conv] == _repair(x), (conv, x)
    assert found[dropped] == (0, 0, 0, 0, 0, 0, "", sha(""))
    # the repaired rows give the hash; the long conversation is a sequence of pairs
    made = collections.defaultdict(list)
    for r in repair.repair(repair.damaged(table), as_rows=True).collect():
        made[r.conv_id].append((r.place, r.edit, r.role, r.text))
    for conv, x in found.items():
        own = sorted(made[conv])
        assert [p for p, *_ in own] == list(range(len(own)))
        assert sha("\n".join(f"{role}:{text}" for _, _, role, text in own)) == x[-1]
        assert "".join(e for _, e, _, _ in own) == x[-2].replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(role[:1] for _, _, role, _ in own))


@pytest.mark.parametrize("block", [1, 2, 3, 4])
def test_blocks_of_any_length_agree(block):
    rng = random.Random(block)
    tables, single = repair.BlockTables(block), repair.BlockTables(1)
    for n in [*range(12), 200]:
        signs = bytes(rng.randrange(repair.SYMBOLS) for _ in range(n))
        assert tables.audit(signs) == single.audit(signs)


def test_nothing_gives_nothing(spark, nothing):
    assert middle.fill_in_middle(nothing).count() == 0 and minmax.near_duplicates(nothing).count() == 0
    talks = spark.createDataFrame([], SCHEMA)
    assert repair.repair(repair.damaged(talks)).count() == 0 and repair.repair(repair.damaged(talks), as_rows=True).count() == 0


def test_a_very_long_text_is_cut(spark):
    text = "wörter und\n" * 200_000
    r = middle.fill_in_middle(spark.createDataFrame([(4, text)], "doc_id bigint, text string")).first()
    assert (r.n, r.form, r.prefix_units, r.middle_units, r.output) == _cut(4, text)


def test_queries_have_sql():
    assert {"op12_fill_in_middle", "op13_conversation_repair"} <= queries.ORACLE.keys()
