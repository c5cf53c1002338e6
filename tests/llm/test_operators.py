"""Each operator against a brute-force version on texts with nulls, copies, repeated rows and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from isobarn.llm import boosting, chat, decontaminate, html, langid, minmax, near, packing, pii, quality, queries, simhash, sketch, substring

WORD = re.compile("[^\x20\x09-\x0d]+")


# 1 packing
def test_packing_is_gapless_and_ids_match(spark, documents, rows):
    from tokenizers import Tokenizer

    found = packing.pack_documents(documents, queries.tokenizer_path(), capacity=64).collect()
    encoder = Tokenizer.from_file(queries.tokenizer_path())
    want = collections.Counter()
    for doc_id, text in rows:
        ids = encoder.encode(text or "", add_special_tokens=False).ids + [2]
        start = 0
        for piece, length in enumerate(packing.cut_lengths(len(ids), 64)):
            want[doc_id, piece, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())] += 1
            start += length
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    bins = collections.defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r.length for r in found) // 64) * 1.05 + 1


def test_best_two_fit_replaces_the_shortest():
    # 6 + 3 leaves a gap of 1; replacing 3 by 2 + 2 closes it
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == (1, [6, 2, 2])
    rng = random.Random(1)
    counts = collections.Counter(rng.randint(1, 50) for _ in range(500))
    packed = collections.Counter()
    for times, lengths in packing.best_two_fit(counts, 50):
        assert sum(lengths) <= 50
        for x in lengths:
            packed[x] += times
    assert packed == counts


@pytest.mark.parametrize("text", ["", " ", "a  b", " a", "a \n b", "x<|endoftext|>y", "\x1c a\x1c b", "a​ b", "don't 12 é"])
def test_word_tokenizer_equals_whole(text):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing._tokenizer(queries.tokenizer_path()).encode(text), "<u4").tolist() == whole


# 2 fingerprints
def _shingles(text):
    words = WORD.findall(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_fingerprints_estimate_likeness(documents, rows):
    found = collections.defaultdict(list)
    for r in sketch.compare_with_next(documents).collect():
        found[r.doc_id, r.n_chars].append(r)
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), np.uint64(xxhash.xxh64_intdigest(x[1].encode(), 42)).astype(np.int64)))
    by_text = collections.defaultdict(set)
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        cut = len(t) // 3
        other = t[: len(t) - cut] + u[:cut]
        mine = [r for r in found[i, len(t)] if r.edited_sha256 == hashlib.sha256(other.encode()).hexdigest()]
        assert mine
        by_text[t].add(mine[0].fingerprint)
        a, b = _shingles(t), _shingles(other)
        assert abs(mine[0].near_edited - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.15
    assert sum(map(len, found.values())) == len(rows) and all(len(x) == 1 for x in by_text.values())


def test_sketches_merge():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 2**63, 5000).astype(np.uint64) for _ in range(2))
    both = np.concatenate([a, b])
    assert (sketch.merge(sketch.sketch(a), sketch.sketch(b)) == sketch.sketch(both)).all()
    wide = lambda x: x * np.uint64(2)
    assert abs(sketch.distinct_count(sketch.sketch(wide(a))) / 5000 - 1) < 0.3
    assert sketch.containment(sketch.sketch(wide(a)), sketch.sketch(wide(both))) > 0.75
    assert (sketch.from_text(sketch.to_text(sketch.sketch(a))) == sketch.sketch(a)).all()
    assert sketch.distinct_count(sketch.sketch(sketch.shingle_hashes(b"a b c d e f g"))) == 3


# 3 html
PAGE = """<html><head><title>T</title></head><body><nav><ul><li><a href=x>menu one two three</a></li></ul></nav>
<div class="cookie-notice">we use cookies on this site for many reasons</div><article><h1>Head &amp; line</h1>
<p><b>First  words<br>of the text<p>Second &eacute; block with <script>var t="</p>";</script>more</p>
<aside>see also these other pages please</aside><section id="comments"><p>what a nice text it was</p></section></article>
<form><p>give us your address now</p></form><footer>&copy; some one and all rights reserved</footer></body></html>"""
TEXT = "Head & line\nFirst words of the text\nSecond é block with more"


def test_html_extraction(spark):
    pages = [(i, f"u{i}", PAGE) for i in range(5)] + [(5, None, None), (6, "u", ""), (0, "u0", PAGE), (7, "u", "plain words only"), (8, "u", PAGE.replace("<article>", "").replace("</article>", ""))]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string").selectExpr("*", "'x' AS text", "'y' AS tag")
    found = html.main_text(table, html.learned(table)).collect()
    got = collections.defaultdict(set)
    for r in found:
        assert r.n_chars == len(r.text)
        got[r.page_id].add(r.text)
    assert got == {**{i: {TEXT} for i in range(5)}, 5: {""}, 6: {""}, 7: {"plain words only"}, 8: {TEXT}} and len(found) == len(pages)
    assert html.main_text(table.limit(0), html.learned(table.limit(0))).count() == 0


GOOD = "<p>" + "some good words stand here in the text " * 20 + "</p>"
PROSE = ("some good words stand here in the text " * 20).strip()


@pytest.mark.parametrize("page, text", [
    (f"<body><div class='has-sidebar'>{GOOD}</div><div class='sidebar'><p>other things here</p></div></body>", PROSE),
    (f"<article><div class='entry-header'><h1>Head line</h1></div>{GOOD}<div class=ad>buy now</div></article>", "Head line\n" + PROSE),
    ("<p title='a > b' data-x=\"</p>\">" + PROSE + "</p>", PROSE),
    (f"<nav>never closed{GOOD}", "never closed\n" + PROSE),
    (f"<article>{GOOD}</article><section id='comments'>{GOOD}</section>", PROSE),
    (f"<p>{PROSE} 1 < 2 <b", f"{PROSE} 1 < 2"),
    (f"<p>a <!-- <p> --> b{GOOD}<!-- open", f"a b\n{PROSE}"),
])
def test_html_pages(page, text):
    assert html.extract(page, html.Weights()) == text


CELLS = "".join(f"<tr><td>{i}</td><td>x{i}</td></tr>" for i in range(30))
ITEMS = "".join(f"<li>item {i}</li>" for i in range(30))


@pytest.mark.parametrize("page, text", [
    (f"<article>{GOOD}<table>{CELLS}</table><p>the end</p></article>", "\n".join([PROSE, *(x for i in range(30) for x in (str(i), f"x{i}")), "the end"])),
    (f"<article>{GOOD}<ul>{ITEMS}</ul><p>the end</p></article>", "\n".join([PROSE, *(f"item {i}" for i in range(30)), "the end"])),
    (f"<article>{GOOD}{'<figure><img src=x><figcaption>a view</figcaption></figure>' * 5}<p>the end</p></article>", "\n".join([PROSE, *["a view"] * 5, "the end"])),
    (f"<article><p class='byline'>by some one</p><h1>Head</h1>{GOOD}<p class='share-price'>the share price rose</p><div class='notice-of-hearing'>a hearing is held</div><p>bye now</p></article>", f"by some one\nHead\n{PROSE}\nthe share price rose\na hearing is held\nbye now"),
    (f"<body><form id='aspnetForm'><div class='site-menu'>one two three</div><article>{GOOD}<form>your name here</form></article></form></body>", PROSE),
    (f"<body><form><div>{GOOD}<p>the end</p></div></form></body>", f"{PROSE}\nthe end"),
    (f"<!-->{GOOD}", PROSE), (f"<article><!--->{GOOD}<!-- x --!><p>more</p></article>", f"{PROSE}\nmore"),
    (f"<body><main><article>{GOOD}<p>a</p></article><aside>other news here</aside></main></body>", f"{PROSE}\na"),
    (f"<body><div class='ad-slot'>buy it now</div><div class=text>{GOOD}<dl><dt>a</dt><dd>b</dd></dl></div><div class='related-posts'>more of it</div></body>", f"{PROSE}\na\nb"),
    ("<article><p>tie one</p></article><article><p>tie two</p></article>", "tie one"),
])
def test_html_articles_stay_whole(page, text):
    labelled = [html.labelled(f"<body><nav><ul><li><a>x</a></li></ul></nav><div class=ad>buy</div><article><h1>h</h1>{GOOD}</article><footer>f</footer></body>")] * 20
    assert html.extract(page, html.Weights()) == text and html.extract(page, html.learn(labelled)) == text


class _Tree:
    """A page as nested lists, by the standard library's parser: (tag, attributes, children); texts are strings."""

    def __init__(self, page):
        import html.parser as parser

        self.root = self.now = ["", {}, [], None]
        tree = self

        class Reader(parser.HTMLParser):
            def handle_starttag(self, tag, attributes):
                own = [tag, dict(attributes), [], tree.now]
                tree.now[2].append(own)
                tree.now = own

            def handle_endtag(self, tag):
                tree.now = tree.now[3]

            def handle_data(self, data):
                tree.now[2].append(data)

        Reader(convert_charrefs=False).feed(page)


def _plain_extract(page, weights):
    """The extraction by its definition, on a tree: what is left out, all runs of events, the article around the best, its blocks."""
    events = []  # tag or "", text, left out, elements around
    words = lambda node: sum(len(x.split()) if isinstance(x, str) else words(x) for x in node[2])
    holds = lambda node, tags: any(not isinstance(x, str) and (x[0] in tags or holds(x, tags)) for x in node[2])
    root = _Tree(page).root
    every = words(root)

    def walk(node, gone, around):
        for x in node[2]:
            if isinstance(x, str):
                events.append(["", x, gone, around])
                continue
            most = x[0] == "h1" or holds(x, ("h1",)) or 2 * words(x) > every
            named = [weights.chance(n) for n in html.names(" ".join(f'{k}="{v}"' for k, v in x[1].items()))]
            mine = x[0] not in ("html", "body", "article", "main") and not holds(x, ("article", "main"))
            if x[0] in ("form", "aside") and most:
                mine = False
            elif x[0] not in ("nav", "footer", "form", "aside"):
                mine = mine and bool(named) and max(named) >= (0.9 if most else 0.5)
            inner = [*around, x]
            events.append([x[0], None, gone or mine, inner])
            walk(x, gone or mine, inner)
            events.append(["/" + x[0], None, gone or mine, inner])

    walk(root, False, [])
    score = [0.0 if gone else float(len(text.split())) if tag == "" else -weights.of(tag) for tag, text, gone, _ in events]
    best, begin, end = 0.0, 0, 0
    for b in range(len(score)):
        for e in range(b + 1, len(score) + 1):
            if sum(score[b:e]) > best + 1e-9:
                best, begin, end = sum(score[b:e]), b, e
    span = lambda node: [i for i, (_, _, _, around) in enumerate(events) if any(x is node for x in around)]
    nodes = {id(x): x for *_, around in events for x in around}
    articles = [s for x in nodes.values() if x[0] in ("article", "main") and (s := span(x))]
    if end:
        within = [s for s in articles if s[0] <= begin and s[-1] + 1 >= end]
        first, last = ([s for s in articles if s[0] <= at <= s[-1]] for at in (begin, end - 1))
        small = lambda found: min(found, key=len)
        if within:
            begin, end = small(within)[0], small(within)[-1] + 1
        elif first or last:
            begin, end = small(first)[0] if first else begin, small(last)[-1] + 1 if last else end
        else:
            holders = [s for x in nodes.values() if x[0] in html._HOLDERS and (s := span(x))[0] <= begin and s[-1] + 1 >= end]
            count = lambda at: sum(len(events[i][1].split()) for i in at if events[i][0] == "" and not events[i][2])
            if holders and 2 * count(range(begin, end)) >= count(small(holders)):
                begin, end = small(holders)[0], small(holders)[-1] + 1
    tags = [t for t, *_ in events]
    counts = np.array([len(t.split()) if t is not None else 0 for _, t, _, _ in events], int)
    gone = np.array([g for _, _, g, _ in events], bool)
    begin = html.with_headline(tags, counts, gone, begin)
    out, open_ = [], []
    for tag, text, left, _ in [*events[begin:end], ["p", None, False, []]]:
        if tag == "" and not left:
            open_.append(text)
        elif tag and tag.lstrip("/") in html._BLOCKS:
            out.append(" ".join("".join(open_).split()))
            open_ = []
    return "\n".join(x for x in out if x)


def test_html_extraction_equals_its_definition():
    rng = random.Random(12)
    names = ["", "", " class='ad'", " class='share-price'", " id='left-sidebar'", " class='post'"]

    def made(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            if depth == 0 or rng.random() < 0.4:
                out.append(" ".join(rng.choices(["some", "words", "here", "now"], k=rng.choice([1, 2, 3, 15]))))
            else:
                tag = rng.choice(["p", "div", "section", "ul", "li", "td", "aside", "nav", "form", "article", "main", "h1", "span", "blink", "footer"])
                out.append(f"<{tag}{rng.choice(names)}>{made(depth - 1)}</{tag}>")
        return " ".join(out)

    kinds = collections.Counter()
    for _ in range(400):
        page = f"<html><body>{made(3)}</body></html>"
        weights = html.Weights(cost=rng.choice([5.0, 20.0]))
        got = html.extract(page, weights)
        assert got == _plain_extract(page, weights), page
        kinds[bool(got)] += 1
    assert kinds[True] > 300


def test_html_elements_closed_by_the_body_are_not_left_out():
    assert "main text" in html.extract("<body><aside>side<p>main text</body>", html.Weights())
    assert html.extract("<body><aside>side</aside><p>main text</body>", html.Weights()) == "main text"


def test_html_broken_pages_take_linear_time():
    import time

    for bad in ("<a", '<a "', "<a '\"", "<nav>", "<p>x</b>", "<script>", "<!--", "<div class=ad><span>"):
        began = time.time()
        html.extract(bad * 100_000 + GOOD, html.Weights())
        assert time.time() - began < 20


def test_region_is_the_best_of_all():
    rng = random.Random(9)
    for _ in range(200):
        own = [rng.choice([-3.0, -1.0, 0.0, 1.0, 2.0]) for _ in range(rng.randrange(12))]
        begin, end = html.region(own)
        best = max([0.0, *(sum(own[a:b]) for a in range(len(own)) for b in range(a + 1, len(own) + 1))])
        assert sum(own[begin:end]) == best


def test_names_learn_from_pages():
    page = lambda inner: f"<body><div class='promo'>shop now</div><article><div class='widget'>{inner}</div></article></body>"
    weights = html.learn([html.labelled(page(GOOD)) for _ in range(60)])
    assert weights.chance("promo") > 0.9 and html.extract(page(GOOD), weights) == PROSE
    usual = [html.labelled(f"<article>{GOOD}<div class='box-widget'>part of it</div></article>") for _ in range(60)]
    assert html.learn(usual).chance("box-widget") < 0.5 < html.prior("box-widget")


# 4 substrings
@pytest.mark.parametrize("window, first", [(35, 16), (35, 5), (6, 16)])
def test_substring_dedup(documents, rows, window, first):
    counts = collections.Counter()
    for _, text in rows:
        words = WORD.findall(text or "")
        counts.update(tuple(words[s : s + window]) for s in range(len(words) - window + 1))
    want = collections.Counter()
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        gone = set()
        for s in range(len(words) - window + 1):
            if counts[tuple(words[s : s + window])] > 1:
                gone.update(range(s, s + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        want[doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in substring.remove_repeats(documents, window, first).collect()) == want


def test_levels_double():
    assert substring.levels(35) == [18, 35] and substring.levels(35, 5) == [5, 9, 18, 35] and substring.levels(6) == [6]


# 5 personal data
NO_MODEL = ("0D", [float("inf")] * 5)
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def _base(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and _luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


ODD = ["a@b.c_d@e.f x", "1.2.3.4.5.6.7.8 300.1.1.1 1.1.1.1", "é 4111 1111-1111 1111 5 x 4111111111111111", "+1 (437) 555-0689-", "😀 a.b@c.d 😀 1.1.1.255", "12" * 3000, "a@b..c@d.e", "x" * 3000 + "@y.c", "1 " * 2000, "1.1.1.1@b.c +4111111111111111"]


def test_base_spans_and_redaction(spark, documents, rows):
    extra = spark.createDataFrame([(500 + i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string")
    both = documents.select("doc_id", "text").union(extra)
    model = ("z.f.digits", [12.0] * 5)  # any candidate with twelve digits joins the base spans
    found = collections.Counter((r.doc_id, r.t, r.b) for r in pii.personal_spans(both, model).select("doc_id", "text", pii.spans_text("_found.base").alias("b")).selectExpr("doc_id", "text AS t", "b").collect())
    want = collections.Counter((i, t, _base(t)) for i, t in [*rows, *((500 + i, t) for i, t in enumerate(ODD))])
    assert found == want
    assert pii.personal_spans(both, model).where("size(_found.spans) > size(_found.base)").count() > 0
    clean = {r.doc_id: r for r in pii.redact(documents, NO_MODEL).collect() if r.doc_id in (1, 32)}
    assert clean[32].text == "mail [EMAIL] and [CARD] at [IP] or [PHONE]" and clean[32].n_chars == len(clean[32].text)
    assert clean[1].text == "" and set(clean[1].asDict()) == set(documents.columns)


def _proposed(text):
    """(start, kind, stop) of all candidates, outside of base spans."""
    masked = list(text)
    for span in filter(None, _base(text).split(",")):
        a, b = map(int, span.split(":")[1:])
        masked[a:b] = pii.MASK * (b - a)
    masked = "".join(masked)
    return [(m.start(), k, m.end()) for k, kind in enumerate(pii.KINDS) for m in re.finditer(pii.GENERATORS[kind], masked)]


SPELLED = ["call (437) 555-0689 or 437.555.0690", "joe.x at mail dot example dot com, joe [at] mail[.]com", "1[.]2[.]3[.]4 and 300 . 1 . 1 . 1", "4111.1111.1111.1111 and 4111/1111/1111/1112",
           'token = "9f8e7d6c5b4a39281706f5e4d3c2b1a0aabbccdd"', "id 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "1.1.1.1@b.c 4111 1111-1111 1111 (1.2.3.4)"]


def test_candidates_and_selection_equal_brute_force(spark, rows):
    texts = [*SPELLED, *ODD, *(t for _, t in rows if t), " | ".join(SPELLED * 40)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    masked = table.selectExpr("doc_id", "text AS t").selectExpr("doc_id", f"{pii.masked_sql()} AS t")
    got = {r.doc_id: sorted(map(tuple, r.c)) for r in masked.selectExpr("doc_id", f"transform({pii.candidate_sql()}, c -> struct(c.start, c.kind, c.stop)) AS c").collect()}
    for i, text in enumerate(texts):
        assert got[i] == sorted(_proposed(text)), text
    # selection: the longest of overlapping candidates, ties by place and kind
    chosen = {r.doc_id: {tuple(x) for x in r.s} - {tuple(x) for x in r.b} for r in pii.personal_spans(table, ("z.f.chars", [8.0] * 5)).selectExpr("doc_id", "_found.spans s", "_found.base b").collect()}
    for i, text in enumerate(texts):
        strong = [c for c in _proposed(text) if c[2] - c[0] >= 8]
        better = lambda o, z: o[0] < z[2] and z[0] < o[2] and (z[0] - z[2], *z) > (o[0] - o[2], *o)
        assert chosen[i] == {z for z in strong if not any(better(o, z) for o in strong)}


def test_features_see_format_and_context(spark):
    table = spark.createDataFrame([(t,) for t in SPELLED], "t string")
    seen = {r.s: r.f for r in table.selectExpr(f"explode({pii.candidate_sql()}) AS c").selectExpr("c.s AS s", f"{pii._FEATURES} AS f").collect()}
    assert (seen["(437) 555-0689"].runs, seen["(437) 555-0689"].last_run, seen["(437) 555-0689"].brackets, seen["(437) 555-0689"].phone_word) == (3, 4, 2, 1)
    assert (seen["4111.1111.1111.1111"].check_digit, seen["4111/1111/1111/1112"].check_digit, seen["4111/1111/1111/1112"].slashes) == (1, 0, 3)
    assert (seen["1[.]2[.]3[.]4"].octets, seen["300 . 1 . 1 . 1"].octets) == (1, 0)
    assert (seen["joe.x at mail dot example dot com"].spelled_at, seen["joe.x at mail dot example dot com"].spelled_dot, seen["joe.x at mail dot example dot com"].top_domain) == (1, 1, 1)
    key = seen["9f8e7d6c5b4a39281706f5e4d3c2b1a0aabbccdd"]
    assert (key.key_word, key.assigned, key.quoted, key.hexadecimal) == (1, 1, 1, 1)


def _card(rng):
    digits = "4" + "".join(rng.choices("0123456789", k=14))
    return next(digits + c for c in "0123456789" if _luhn(digits + c))


def test_trees_add_other_spellings_and_leave_decoys(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choices("aeioulrnst", k=rng.randint(2, 9))) for _ in range(n))
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    plain = {
        "email": lambda: f"{prose(1)}.{digits(2)}@{prose(1)}.example.com", "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), "card": lambda: _card(rng),
        "phone": lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", "secret": lambda: 'token = "' + "".join(rng.choices("0123456789abcdef", k=40)) + '"',
    }
    docs = [f"{prose(20)} {plain[rng.choice(list(plain))]()} {prose(8)} {plain[rng.choice(list(plain))]()} {prose(9)}" for _ in range(700)]
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    score, thresholds = pii.selector(table)
    spelled = {
        "email": lambda: plain["email"]().replace("@", rng.choice([" @ ", " (at) ", "[at]"])), "ip": lambda: plain["ip"]().replace(".", rng.choice(["[.]", " . "])),
        "card": lambda: re.sub("(....)(?=.)", rng.choice([r"\1.", r"\1/"]), _card(rng)), "phone": lambda: rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}"]).format(digits(3), digits(3), digits(4)),
        "secret": lambda: "api_key: " + "".join(rng.choices("0123456789abcdef", k=32)),
    }
    decoys = [lambda: f"20{rng.randrange(10, 30)}-0{rng.randrange(1, 9)}-1{rng.randrange(9)}", lambda: "commit " + "".join(rng.choices("0123456789abcdef", k=40)), lambda: re.sub("(....)(?=.)", r"\1.", (lambda c: c[:-1] + str((int(c[-1]) + 3) % 10))(_card(rng))),
              lambda: f"{rng.randrange(256, 999)}[.]1[.]2[.]3", lambda: "at " + prose(1), lambda: f"{rng.randrange(1, 9)} {digits(3)} {digits(3)}"]
    cases = [(kind, f"{prose(9)} ", spelled[kind](), f" {prose(6)}") for kind in spelled for _ in range(60)] + [("", f"{prose(9)} ", d(), f" {prose(6)}") for d in decoys for _ in range(40)]
    held = spark.createDataFrame([(i, b + v + e) for i, (_, b, v, e) in enumerate(cases)], "doc_id bigint, text string")
    found = {r.doc_id: r.s for r in pii.personal_spans(held, (score, thresholds)).selectExpr("doc_id", "_found.spans s").collect()}
    caught = [any(s.kind == pii.KINDS.index(k) and s.start < len(b) + len(v) and s.stop > len(b) for s in found[i]) for i, (k, b, v, _) in enumerate(cases) if k]
    wrong = [len(found[i]) > 0 for i, (k, *_) in enumerate(cases) if not k]
    assert np.mean(caught) >= 0.9 and np.mean(wrong) <= 0.05


def test_redaction_of_long_text(spark):
    rng = random.Random(8)
    pieces = [rng.choice(["a@b.c", "1.2.3.4", "+1 (437) 555-0689", "word", "\U0001f600é"]) for _ in range(20000)]
    text = " | ".join(pieces)
    marks = {"a@b.c": "[EMAIL]", "1.2.3.4": "[IP]", "+1 (437) 555-0689": "[PHONE]"}
    table = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert pii.redact(table, NO_MODEL).first().text == " | ".join(marks.get(x, x) for x in pieces)


def test_selector_and_trees(documents, nothing):
    assert pii.selector(nothing)[1] == [float("inf")] * 5
    assert pii.selector(documents)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = boosting.fit(x, y, trees=40)
    score = boosting.predict(model, x)
    assert ((score > 0) == y).mean() > 0.9
    assert boosting.calibrated_threshold(np.array([3.0, 2.0, 1.0, 0.0]), np.array([1, 1, 0, 0]), 0.6) == 2.0
    assert boosting.calibrated_threshold(np.array([1.0]), np.array([0.0]), 0.9) == float("inf")


def test_tree_sql_equals_prediction(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2)).round(3)
    model = boosting.fit(x, (x[:, 0] > 0.2).astype(float), trees=5)
    table = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double")
    got = [r.s for r in table.selectExpr("i", boosting.to_sql(model, ["a", "b"]) + " AS s").orderBy("i").collect()]
    assert np.allclose(got, boosting.predict(model, x), atol=1e-3)


# 6 decontamination
def test_decontamination(spark, documents, rows, monkeypatch):
    grams, items = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"), {}
    texts = [rows[8][1], "one", "two words", None, "---", rows[12][1], rows[8][1].upper()]
    low = lambda t: grams.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    for item, text in enumerate(texts):
        words = low(text)
        n = min(13, len(words))
        for s in range(len(words) - n + 1 if n else 0):
            items.setdefault(tuple(words[s : s + n]), set()).add(str(item))
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    want = collections.Counter()
    for doc_id, text in rows:
        words, hit, own = low(text), set(), set()
        for n in range(1, 14):
            for s in range(len(words) - n + 1):
                if tuple(words[s : s + n]) in items:
                    hit.update(range(s, s + n))
                    own |= items[tuple(words[s : s + n])]
        want[doc_id, len(words), len(hit), len(own), tuple(sorted(own)), len(hit) > 0 and 20 * len(hit) >= len(words)] += 1
    for least, most in ((20, 29), (6, 6)):  # with the hash set as it is, and with one that lets most windows through
        monkeypatch.setattr(decontaminate, "LEAST_BITS", least)
        monkeypatch.setattr(decontaminate, "MOST_BITS", most)
        found = decontaminate.contamination(documents, bench).collect()
        assert collections.Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"]), r.contaminated) for r in found) == want
    assert decontaminate.contamination(documents, bench.limit(0)).where("n_hit > 0 OR contaminated").count() == 0
    assert decontaminate.contamination(documents.limit(0), bench).count() == 0
    assert decontaminate.drop_contaminated(documents, bench).columns == documents.columns


def test_decontamination_with_many_windows(spark, monkeypatch):
    rng = random.Random(6)
    items = [[f"w{rng.randrange(5000)}" for _ in range(2012)] for _ in range(100)]  # 200,000 windows
    texts = []
    for i in range(40):
        own = [f"w{rng.randrange(5000)}" for _ in range(400)]
        if i % 2:
            at = rng.randrange(1900)
            own[50 : 50 + i] = items[i][at : at + i]  # windows from 13 words on
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id bigint, text string")
    for broadcast in (64 << 20, 0):
        monkeypatch.setattr(decontaminate, "MOST_BROADCAST", broadcast)
        found = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.contamination(docs, bench).collect()}
        assert found == {i: (i, [str(i)]) if i % 2 and i >= 13 else (0, []) for i in range(40)}


def test_decontamination_drops_rows_and_not_ids(spark):
    item = " ".join(f"word{i}" for i in range(20))
    rows = [(1, item), (1, "clean text under the same id"), (None, item), (None, "clean text without an id"), (2, item), (2, item), (3, "clean"), (3, "clean")]
    bench = spark.createDataFrame([("a", item)], "item_id string, text string")
    found = decontaminate.drop_contaminated(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), bench).collect()
    assert collections.Counter(map(tuple, found)) == collections.Counter(r for r in rows if r[1] != item)


# 7 near duplicates
def test_simhash_components(documents, rows, nothing):
    def code(text):
        words = (text or "").encode().lower().split()
        if not words:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    codes = [code(t) for _, t in rows]
    root = list(range(len(codes)))
    for _ in root:
        for i, a in enumerate(codes):
            for j, b in enumerate(codes):
                if (a ^ b).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    least = collections.defaultdict(list)
    for r, (doc_id, _) in zip(root, rows):
        if doc_id is not None:
            least[r].append(doc_id)
    want = collections.Counter((doc_id, f"{c:016x}", min(least[r])) for (doc_id, _), c, r in zip(rows, codes, root))
    assert collections.Counter(tuple(r) for r in simhash.near_duplicates(documents).collect()) == want
    assert simhash.near_duplicates(nothing).count() == 0


def _jaccard(a, b):
    sets = []
    for text in (a, b):
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def _stays(rows):
    """Brute force: places of the rows that the near-dedup stage keeps, as the texts and ids left."""
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and 5 * _jaccard(rows[i][1], rows[j][1]) >= 4 - 1e-9:
                a, b = max(root[i], root[j]), min(root[i], root[j])
                root = [b if r == a else r for r in root]
    groups = collections.defaultdict(list)
    for r, row in zip(root, rows):
        groups[r].append(row[0])
    return collections.Counter(min(ids, key=lambda x: (x is None, x)) for ids in groups.values())


@pytest.mark.parametrize("block", [2048, 4])
def test_near_dedup_stage_finds_all_of_similarity(spark, block, monkeypatch):
    monkeypatch.setattr(minmax, "BLOCK_ROWS", block)  # with 4, groups are dealt into blocks
    rng = random.Random(5)
    rows = []
    for _ in range(25):
        base = [rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(120)]
        rows.append(" ".join(base))
        for changed in (1, 2, 3, 4, 6):  # Jaccard of about 0.92 down to 0.6
            own = list(base)
            for k in rng.sample(range(5, 115), changed):
                own[k] = "new" + str(rng.randrange(10**6))
            rows.append(" ".join(own))
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    rows = list(zip(ids, rows))
    found = near.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    want = _stays(rows)
    assert len(want) < 0.7 * len(rows)
    assert collections.Counter(r.doc_id for r in found) == want


def test_near_dedup_stage_in_one_large_group(spark, monkeypatch):
    """Near copies of one text, of which many are below the threshold to each other: rows left as by comparing all pairs."""
    monkeypatch.setattr(minmax, "BLOCK_ROWS", 150)
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    rows = []
    for i in range(500):
        own = list(base)
        for k in rng.sample(range(100), rng.randint(0, 8)):
            own[k] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    found = near.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert collections.Counter(r.doc_id for r in found) == _stays(rows)


def test_near_dedup_stage_drops_rows_and_not_ids(spark):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(1, text), (1, text), (1, "a different text under the same id"), (None, text), (None, "twice without an id"), (None, "twice without an id"), (5, None), (4, ""), (4, " ")]
    found = near.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    left = collections.Counter((r.doc_id, (r.text or "").strip()) for r in found)
    assert left == collections.Counter([(1, text), (1, rows[2][1]), (None, rows[4][1]), (4, "")])


@pytest.mark.parametrize("limit, few", [(4096, 500_000), (8, 500_000), (8, 0)])
def test_gray_index_finds_all_links(spark, limit, few, monkeypatch):
    from isobarn.llm import common

    monkeypatch.setattr(common, "FEW", few)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    codes = [*base]
    for c in base[:30]:  # chains of near codes
        for _ in range(12):
            c = c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))
            codes.append(c)
    codes = np.unique(np.array(codes, np.uint64))
    near = np.bitwise_count(codes[:, None] ^ codes[None]) <= 4
    a, b = np.nonzero(near)
    want = simhash.merged(len(codes), a, b)
    index = simhash.GrayIndex(codes)
    got = index.components(4)
    place = {int(c): i for i, c in enumerate(index.codes)}
    own = np.array([got[place[int(c)]] for c in codes])
    assert len(np.unique(own)) == len(np.unique(want)) == len({(int(x), int(y)) for x, y in zip(own, want)})
    from isobarn.llm.components import connected_components

    table = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "code bigint")
    links = connected_components(simhash.stars(simhash.keyed(table, 4, limit), 4)).collect()
    assert len(codes) - len(links) == len(np.unique(want))


# 8 chat
def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "%3C|", "<|end|>\n", "<|", "%", "<", "|>\n", "", None, "a<|user|>\nb", "<<SYS>>%25[INST]"]
    rows = [(i % 3 if i < 9 else None, i // 3, ["user", "assistant", None, "we|ird\n<|"][i % 4], t) for i, t in enumerate(odd)] + [(0, 0, "user", "twin"), (0, 0, "user", "twin")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS formatted", "2 AS loss", "3 AS head")
    found = {r.conv_id: r for r in chat.read_back(chat.formatted(chat.canonical(table))).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        assert [(t.role, t.text) for t in found[conv].turns] == [x[1:] for x in own]
        assert found[conv].loss_text == "".join(x[2] for x in own if x[1] == "assistant")
        assert found[conv].formatted.count("<|end|>") == len(own)


def test_layouts_map_to_turns(spark):
    one = [("user", "q"), ("assistant", "a")]
    tables = [
        spark.sql("SELECT 1 AS conv_id, array(struct('human' AS role, 'q' AS content), struct('gpt' AS role, 'a' AS content)) AS messages"),
        spark.sql("SELECT 1 AS id, array(struct('human' AS `from`, 'q' AS value), struct('gpt' AS `from`, 'a' AS value)) AS conversations, 9 AS extra"),
        spark.sql("SELECT 1 AS id, 'q' AS instruction, '' AS input, 'a' AS output"),
        spark.sql("SELECT 1 AS id, 'q' AS prompt, 'a' AS completion"),
    ]
    for table in tables:
        assert [(t.role, t.text) for t in chat.canonical(table).first().turns] == one
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical(spark.sql("SELECT 1 AS x"))


def test_records_of_mixed_layouts(spark):
    import json

    one = [("user", "q"), ("assistant", "a")]
    records = [
        {"conv_id": 1, "messages": [{"role": "human", "content": "q"}, {"role": "gpt", "content": "a"}]}, {"id": "2", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "extra": [1]},
        {"id": 3, "instruction": "q", "input": "", "output": "a"}, {"id": 4, "prompt": "q", "completion": "a"}, {"id": 5, "response": "a", "prompt": "q"}, {"x": 1}, {"id": 7, "conversations": [{"from": "gpt", "text": "a"}]},
    ]
    table = spark.createDataFrame([(json.dumps(x),) for x in records] + [(None,), ("no json",)], "record string")
    found = chat.canonical_records(table).collect()
    fine = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in found if r.layout is not None}
    assert fine == {str(i): one for i in range(1, 6)} and len(found) == 9
    assert all(r.conv_id is None and r.turns == [] for r in found if r.layout is None)


def test_layout_by_hash(spark):
    table = spark.sql("SELECT 1L AS conv_id, 0 AS turn, 'user' AS role, 'x' AS text, 'p' AS prompt, 9 AS other")
    assert chat.layout(table.drop("prompt")) is chat.layout(table) is chat.LAYOUTS[0]  # a name of another layout does no harm
    assert chat.read_back(chat.formatted(chat.canonical(table.limit(0)))).count() == 0


# 9 languages
def test_languages(spark):
    rng = random.Random(2)
    words = {"aa": ["the", "and", "ing", "heed"], "bb": ["le", "ré", "eau", "çon"], "cc": ["der", "ung", "ß", "sch"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(3, 60))), lang) for i, lang in enumerate(sorted(words) * 30)]
    rows += [(500, None, "aa"), (501, "12 !?", "aa"), (502, "the and", None), (None, "der ung", "cc"), (3, rows[3][1], "aa")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 AS gram", "2 AS n", "'q' AS score")
    found = langid.identify(table, langid.learned(table)).collect()
    assert len(found) == len(rows)
    truth = {i: lang for i, _, lang in rows}
    for r in found:
        if r.doc_id in (500, 501):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id != 502 and r.doc_id is not None:
            assert r.lang_pred == truth[r.doc_id] and 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert langid.identify(table, langid.learned(table.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_languages_equal_brute_force(spark):
    rng = random.Random(12)
    letters = {"aa": "abcdeé", "bb": "cdefghß", "cc": "aeiouñxy"}
    rows = [(i, " ".join("".join(rng.choices(letters[lang], k=rng.randint(1, 7))) for _ in range(rng.randint(1, 40))), lang) for i, lang in enumerate(sorted(letters) * 20)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")

    def grams(text):
        own = re.sub("[^a-zé-ÿß]+", " ", f" {text.lower()} ")
        return [own[i : i + n] for n in (1, 2, 3) for i in range(len(own) - n + 1) if own[i : i + n] != " "]

    def code(gram):
        out = 0
        for c in gram:
            out = out << 21 | ord(c)
        return out

    ranking = lambda counts, most: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:most]]
    profiles = {}
    for lang in letters:
        counts = collections.Counter(g for i, t, own in rows if own == lang and zlib.crc32(str(i).encode()) % 5 for g in grams(t))
        profiles[lang] = {g: r for r, g in enumerate(ranking(counts, langid.PROFILE))}
    for r in langid.identify(table, langid.learned(table)).collect():
        own = ranking(collections.Counter(grams(rows[r.doc_id][1])), langid.DOCUMENT)
        far = {lang: sum(abs(p[g] - i) if g in p else langid.PROFILE for i, g in enumerate(own)) for lang, p in profiles.items()}
        assert r.lang_pred == min(sorted(far), key=far.get)
        first, second = sorted(far.values())[:2]
        assert abs(r.score - (second / (first + second) if first + second else 0.5)) < 1e-9


# 10 quality
def test_quality(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choices(["some", "plain", "words", "in", "order"], k=rng.randint(5, 400)))
    bad = lambda: " ".join(w + "%%%" for w in good().split())
    rows = [(i, bad() if i % 3 == 0 else good()) for i in range(240)] + [(900, None), (901, ""), (None, "some words"), (5, "plain")]
    labels = [(i, int(i % 3 != 0)) for i in range(240)] + [(900, None), (None, 1)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "0 AS quality", "'z' AS score")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int")
    network = quality.trained(table, marks)
    found = quality.score_quality(table, network).collect()
    assert len(found) == len(rows)
    held = [(r.score >= 0.5) == (r.doc_id % 3 != 0) for r in found if r.doc_id is not None and r.doc_id < 240 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean(held) > 0.9
    kept = quality.keep_good(table, network)
    assert kept.columns == table.columns and kept.count() == sum(r.score >= 0.5 for r in found)
    assert quality.trained(table, marks.limit(0)) is None
    assert {r.score for r in quality.score_quality(table, None).collect()} == {0.5}


def test_network_equals_plain_convolution():
    net = quality.ByteNetwork()
    p = net.params
    rng = random.Random(3)
    for n in (0, 3, 517, 1300):
        text = bytes(rng.randbytes(n))
        own = []
        for row in quality.chunks(text):
            best = [max(sum(float(p["filters"][k, row[i + k], f]) for k in range(quality.WIDTH)) for i in range(len(row) - quality.WIDTH + 1)) for f in range(4)]
            own.append([max(b + float(p["bias"][f]), 0.0) for f, b in enumerate(best)])
        got = np.concatenate([net.pooled(quality.chunks(text))[0]])[:, :4]
        assert np.allclose(got, own, atol=1e-4)
    # the gradient lowers the loss on what it learns from
    texts = [b"abc " * 30, b"xyz " * 30] * 20
    fitted = quality.ByteNetwork().fit([quality.chunks(t) for t in texts], np.array([1.0, 0.0] * 20, np.float32), epochs=6)
    assert fitted.score([b"abc " * 40])[0] > 0.9 and fitted.score([b"xyz " * 40])[0] < 0.1


def test_chunks_cover_every_window():
    for n in (0, 1, 516, 517, 518, 1029, 5000):
        text = bytes(random.Random(n).randbytes(n))
        seen = {bytes(row[i : i + 6]) for row in quality.chunks(text) for i in range(512)}
        assert {text[i : i + 6] for i in range(n - 5)} <= seen


def test_empty_tables(spark, documents, nothing):
    assert packing.pack_documents(nothing, queries.tokenizer_path()).count() == 0
    assert sketch.compare_with_next(nothing).count() == 0
    assert sketch.fingerprints(documents).count() == documents.count()
    assert substring.remove_repeats(nothing).count() == 0
    assert pii.redact(nothing, NO_MODEL).count() == 0
    assert langid.identify(nothing, langid.learned(nothing)).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.trained(nothing, labels) is None and quality.score_quality(nothing, None).count() == 0
    assert near.drop_near_duplicates(nothing).count() == 0


def test_very_long_texts(spark):
    """A text of 200,000 words beside a short one, through every operator on documents."""
    rng = random.Random(11)
    long = " ".join(f"w{rng.randrange(30000)}" for _ in range(200_000))
    table = spark.createDataFrame([(1, long + " a@b.c"), (2, "short text here")], "doc_id bigint, text string")
    pieces = packing.pack_documents(table, queries.tokenizer_path()).where("doc_id = 1").agg({"length": "sum", "piece": "max"}).first()
    assert pieces["sum(length)"] > 200_000 and pieces["max(piece)"] * 1024 < pieces["sum(length)"]
    assert {r.doc_id: r.n_chars for r in sketch.compare_with_next(table).collect()}[1] == len(long) + 6
    assert {r.doc_id: r.n_words for r in substring.remove_repeats(table).collect()} == {1: 200_001, 2: 3}
    assert {r.doc_id: r.b for r in pii.personal_spans(table, NO_MODEL).select("doc_id", pii.spans_text("_found.base").alias("b")).collect()}[1] == f"email:{len(long) + 1}:{len(long) + 6}"
    bench = spark.createDataFrame([("i", " ".join(long.split()[-40:]))], "item_id string, text string")
    assert {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.contamination(table, bench).collect()}[1] == (200_003, 40)
    assert simhash.near_duplicates(table).count() == 2 and near.drop_near_duplicates(table).count() == 2
    assert langid.identify(table, langid.Profiles({"aa": [119]})).count() == 2
    assert quality.score_quality(table, quality.ByteNetwork()).count() == 2
    page = spark.createDataFrame([(1, "u", f"<article><p>{long}</p></article>")], "page_id bigint, url string, html string")
    assert html.main_text(page, html.Weights()).first().n_chars == len(long)
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id bigint, turn int, role string, text string")
    assert chat.read_back(chat.formatted(chat.canonical(turns))).first().loss_text == long


@pytest.mark.parametrize("few", [500_000, 0])
def test_hot_keys_are_joined_apart(spark, few, monkeypatch):
    from isobarn.llm import common
    from isobarn.llm.common import attach

    monkeypatch.setattr(common, "FEW", few)

    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 0, id) AS k", "id")
    facts = rows.groupBy("k").agg({"id": "min", "*": "count"}).withColumnsRenamed({"min(id)": "least", "count(1)": "n"})
    found = attach(rows, facts, "k", "n", 5000)
    assert found.columns == ["k", "id", "least"] and found.count() == 5000 and found.where("least <> if(id % 3 = 0, 0, id)").count() == 0
