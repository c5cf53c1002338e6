"""Main text of web pages by a maximum-scoring subsequence (operator 3).

A page is a sequence of words, which score positive, and tags, which score negative; one linear scan finds the
contiguous region with the largest sum. The region is then widened to the article (or main) that it lies in, or to the box (_HOLDERS) around it, if
it holds most of its words, so that the sum chooses among parts of a page and cuts nothing off within one: tables, lists, figures and short last
paragraphs of an article stay. Headings right before it belong to it, however short. The weights are learned from pages that label
themselves by holding exactly one article (or main) element: a tag, or a class, that is usual outside of it costs more; a tag that no
page has shown costs as much as tags of its kind.

Elements that the task names are no content by rule: menus (nav, menu), page headers, footers, asides, forms, scripts,
styles and what isn't text. Other sidebars, notices, adverts and readers' comments are known by the words of their class,
id or role only. Each such name has a weight, the chance that its element lies beside the content: it starts from a prior
(NAMES: a name that is such a word, or whose last word is one, apart from words that only say where or what box: `ad-slot` is
an advert, `share-price` a price) and moves with the labelled pages that use it. An element is left out from a chance of one half
on; one that holds the headline, an article or most of the page's words only if it is all but certain, and a form, aside or the like not
even then. What is left out scores nothing.

Tags are read as browsers read them: quoted attribute values may hold anything, and everything is one pass, so broken
pages take no longer.

Defined results: null counts as an empty page and gives an empty text; repeated rows are extracted each; of regions
with equal sums the first is taken; without labelled pages, weights are the defaults; elements that are never closed are
no reason to leave out the rest of a page; extra columns are ignored.
"""

from __future__ import annotations

import html as _entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobarn.llm.common import hash_sample, prepare

#: Bound of the labelled sample from which weights are learned.
SAMPLE_PAGES = 400
#: A tag costs EASY, and up to a learned number of words more if it is met outside of content.
EASY = 0.2
COSTS = [2.0, 5.0, 10.0, 20.0, 40.0, 80.0]
DEFAULT_COST = 20.0
#: Elements a prior counts for, the chances of a name that is one of NAMES and of one that holds one, and the chances from
#: which an element, and one with most of the page, is left out.
PRIOR, PLAIN, PARTLY = 4.0, 0.95, 0.7
LEFT_OUT, CERTAIN = 0.5, 0.9

_BLOCKS = set("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in "script style title textarea noscript iframe noembed noframes xmp".split()}
_NEVER = set("nav footer aside form button menu dialog object canvas audio video select template svg".split())
#: Of these, elements that pages wrap around their content now and then.
_WRAPPERS = set("aside form dialog object".split())
#: Tags of content, cheap until pages show otherwise.
_CONTENT = set(
    "p b i em strong a span br h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre code q cite small u s del ins sub sup mark time abbr dfn var samp kbd table caption thead tbody tfoot tr td th "
    "colgroup col figure figcaption img picture source details summary address hr wbr ruby rt rp".split()
)
#: Elements that pages put whole parts of themselves in.
_HOLDERS = set("div section td form aside fieldset center".split())
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_NAME, _PLAIN_ATTRIBUTES = re.compile(r"[a-zA-Z][^\s/>]*"), re.compile("[^>\"']*")
NAMES = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary contentinfo cookie cookies "
    "consent disqus footer masthead menu modal nav navbar navigation newsletter notice notices popup promo promotion related replies "
    "respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Words of a name that say where an element stands or what box it is, and not what it holds.
_PLACES = set("left right top bottom upper lower inner outer main site page global primary secondary mobile desktop wrapper wrap container box block slot unit area section region zone panel bar list item items group row column col links buttons icons form text content 1 2 3 4 5 6 7 8 9".split())


def names(attributes: str) -> list[str]:
    """The names that class, id and role give an element, in lower case, with - between their words."""
    out = []
    for found in _ATTRIBUTE.finditer(attributes):
        value = re.sub(r"([a-z])([A-Z])", r"\1-\2", found[2] or found[3] or found[4] or "")
        out += [re.sub(r"[^a-z0-9]+", "-", x).strip("-") for x in value.lower().split()]
    return [x for x in out if x]


def prior(name: str) -> float:
    """Chance that an element of that name is beside the content, before any page was seen."""
    if name in NAMES:
        return PLAIN
    told = [x for x in name.split("-") if x not in _PLACES]
    return PARTLY if told and told[-1] in NAMES else 0.05


class _Quotes:
    """Finds the end of tags; remembers from where on a character is absent, so that no page is searched twice."""

    def __init__(self, page: str):
        self.page, self.none = page, {}

    def find(self, what: str, at: int) -> int:
        if at >= self.none.get(what, len(self.page) + 1):
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.none[what] = at
        return found

    def tag_end(self, at: int) -> int:
        """Place of the > that ends a tag whose attributes start at `at`; -1 if there is none."""
        page, begin = self.page, at
        while True:
            at = _PLAIN_ATTRIBUTES.match(page, at).end()
            if at >= len(page):
                return -1
            if page[at] == ">":
                return at
            close = self.find(page[at], at + 1)
            if close < 0:  # a quote that is never closed counts as a letter
                return self.find(">", begin)
            at = close + 1


def tokens(page: str) -> Iterator[tuple[str, str, int]]:
    """(name, attributes, 0) of opening tags, (name, "", 1) of closing ones, ("", text, 0) of text."""
    quotes, at, size = _Quotes(page), 0, len(page)
    while at < size:
        open_ = page.find("<", at)
        if open_ < 0:
            open_ = size
        if open_ > at:
            yield "", page[at:open_], 0
        if open_ >= size:
            return
        follows = page[open_ + 1 : open_ + 2]
        if page.startswith("<!--", open_):
            if page.startswith((">", "->"), open_ + 4):  # an empty comment
                at = page.find(">", open_) + 1
                continue
            ends = [x + len(mark) for mark in ("-->", "--!>") if (x := quotes.find(mark, open_ + 4)) >= 0]
            if not ends:
                return
            at = min(ends)
            continue
        closing = follows == "/"
        name = _NAME.match(page, open_ + 1 + closing)
        if name is None and follows not in ("!", "?", "/"):
            yield "", "<", 0
            at = open_ + 1
            continue
        end = quotes.tag_end(name.end()) if name else quotes.find(">", open_)
        if end < 0:
            return
        at = end + 1
        if name is None:
            continue
        low = name[0].lower()
        if closing:
            yield low, "", 1
        elif low in _RAW:
            close = _RAW[low].search(page, at)
            if close is None:
                return
            end = quotes.find(">", close.end())
            at = end + 1 if end >= 0 else size
        else:
            yield low, page[name.end() : end], 0


class Page:
    """Events of a page, (tag, text, names), and the element that each opening tag begins: (first event, end, tag, names)."""

    def __init__(self, page: str):
        self.events: list[tuple[str, str | None, list[str]]] = []
        self.elements: list[list] = []
        open_: list[int] = []
        count: Counter = Counter()
        for name, text, closing in tokens(page):
            here = len(self.events)
            if not name:
                self.events.append(("", text, []))
            elif closing:
                self.events.append(("/" + name, None, []))
                while count[name]:  # elements inside that were left open end here as well
                    last = open_.pop()
                    tag = self.elements[last][2]
                    count[tag] -= 1
                    if tag == name or name not in ("body", "html"):
                        self.elements[last][1] = here + 1
                    if tag == name:
                        break
            else:
                own = names(text) if text else []
                self.events.append((name, None, own))
                if name not in _VOID:
                    open_.append(len(self.elements))
                    count[name] += 1
                    self.elements.append([here, None, name, own])
        self.words = np.array([len(t.split()) if t is not None else 0 for _, t, _ in self.events], np.int64)

    def beside(self, chance) -> np.ndarray:
        """Which events are in an element that is left out. chance: of a name."""
        n = len(self.events)
        total = np.concatenate([[0], np.cumsum(self.words)])
        tag = [t for t, _, _ in self.events]
        article = np.concatenate([[0], np.cumsum([t in ("article", "main") for t in tag])]) if n else np.zeros(1, np.int64)
        head = np.concatenate([[0], np.cumsum([t == "h1" for t in tag])]) if n else np.zeros(1, np.int64)
        inside = np.zeros(n + 1, np.int64)  # depth of articles
        for begin, end, name, _ in self.elements:
            if name in ("article", "main"):
                inside[begin] += 1
                inside[n if end is None else end] -= 1
        inside = np.cumsum(inside)
        out = np.zeros(n + 1, np.int64)
        for begin, end, name, own in self.elements:
            if end is None or name in ("html", "body", "article", "main") or article[end] > article[begin]:
                continue
            most = head[end] > head[begin] or 2 * (total[end] - total[begin]) > total[n]
            if name in _WRAPPERS and most:
                found = False
            elif name in _NEVER or (name == "header" and not inside[begin]):
                found = True
            elif own:
                found = max(map(chance, own)) >= (CERTAIN if most else LEFT_OUT)
            else:
                continue
            if found:
                out[begin] += 1
                out[end] -= 1
        return np.cumsum(out)[:n] > 0


class Weights:
    """Cost of each tag, in words, and the chance of each name to be beside the content."""

    def __init__(self, outside: dict[str, float] | None = None, cost: float = DEFAULT_COST, named: dict[str, float] | None = None):
        self.outside, self.cost, self.named = outside or {}, cost, named or {}

    def of(self, tag: str) -> float:
        known = self.outside.get(tag)
        if known is None:
            known = 0.05 if tag.lstrip("/") in _CONTENT else 0.1 if tag.lstrip("/") in ("div", "section") else 0.6
        return EASY + self.cost * known

    def chance(self, name: str) -> float:
        found = self.named.get(name)
        return prior(name) if found is None else found


def region(scores: list[float]) -> tuple[int, int]:
    """First and last (exclusive) place of the contiguous run with the largest sum."""
    best, begin, end, total, start = 0.0, 0, 0, 0.0, 0
    for i, score in enumerate(scores):
        total += score
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, begin, end = total, start, i + 1
    return begin, end


def with_headline(tags: list[str], words: np.ndarray, out: np.ndarray, begin: int) -> int:
    """Where the region begins with the headings that stand right before it, with nothing but tags between."""
    first, heading = begin, ""
    for i in range(begin - 1, -1, -1):
        tag = tags[i]
        if tag in ("/h1", "/h2", "/h3") and not heading:
            heading = tag[1:]
        elif tag == heading and heading:
            first, heading = i, ""
        elif tag in ("article", "main", "/article", "/main", "body") or (tag == "" and words[i] and not heading and not out[i]):
            break
    return first


def widened(page: Page, out: np.ndarray, begin: int, end: int) -> tuple[int, int]:
    """The region with the whole of what it lies in: the innermost article or main around it, those around its ends, or the innermost
    box, if the region has at least half of its words."""
    if begin >= end:
        return begin, end
    n = len(page.events)
    parts = [(a, n if b is None else b) for a, b, name, _ in page.elements if name in ("article", "main")]
    around = lambda x, y: min(((a, b) for a, b in parts if a <= x and b >= y), key=lambda r: r[1] - r[0], default=None)
    if whole := around(begin, end):
        return whole
    first, last = around(begin, begin + 1), around(end - 1, end)
    if first or last:
        return (first[0] if first else begin), (last[1] if last else end)
    total = np.concatenate([[0], np.cumsum(np.where(out, 0, page.words))])
    holders = [(a, b) for a, b, name, _ in page.elements if b is not None and name in _HOLDERS and a <= begin and b >= end]
    a, b = min(holders, key=lambda r: r[1] - r[0], default=(begin, end))
    return (a, b) if 2 * (total[end] - total[begin]) >= total[b] - total[a] else (begin, end)


def scores(tags: list[str], words: np.ndarray, out: np.ndarray, weights: Weights) -> list[float]:
    """What each event counts: words positive, tags negative, what is left out nothing."""
    return [0.0 if gone else (float(n) if tag == "" else -weights.of(tag)) for tag, n, gone in zip(tags, words.tolist(), out.tolist())]


def blocks(found: list[tuple[str, str | None, list[str]]], out: np.ndarray) -> list[str]:
    """Texts of the blocks, decoded, with single spaces; empty ones are left out."""
    texts, open_ = [], []
    for (tag, text, _), gone in [*zip(found, out.tolist()), (("p", None, []), False)]:
        if tag == "":
            if not gone:
                open_.append(text)
        elif tag == "br":
            open_.append(" ")
        elif tag.lstrip("/") in _BLOCKS:
            if block := " ".join(_entities.unescape("".join(open_)).split()):
                texts.append(block)
            open_ = []
    return texts


def extract(page: str | None, weights: Weights) -> str:
    own = Page(page or "")
    out = own.beside(weights.chance)
    tags = [t for t, _, _ in own.events]
    begin, end = widened(own, out, *region(scores(tags, own.words, out, weights)))
    begin = with_headline(tags, own.words, out, begin)
    return "\n".join(blocks(own.events[begin:end], out[begin:end]))


def labelled(page: str) -> dict | None:
    """Tags, words, places inside the article, and named elements, of a page with exactly one article or main element."""
    own = Page(page)
    for name in ("article", "main"):
        found = [(begin, end) for begin, end, tag, _ in own.elements if tag == name]
        if len(found) == 1 and found[0][1] is not None:
            begin, end = found[0]
            gone = own.beside(prior)
            total = np.concatenate([[0], np.cumsum(own.words)])
            held = lambda a, b: 2 * (total[b] - total[a]) > total[end] - total[begin]
            # 0 outside of the article, 1 inside, 2 inside with most of its words
            named = [(x, 0 if b is None or a < begin or b > end else 1 + int(held(a, b))) for a, b, _, xs in own.elements for x in xs if not a <= begin < (b or len(own.events))]
            return {"tags": [t for t, _, _ in own.events], "words": own.words.tolist(), "gone": gone.tolist(), "begin": begin + 1, "end": end - 1, "names": [x for x, _ in named], "inside": [i for _, i in named]}
    return None


def learn(pages: list[dict]) -> Weights:
    """Share of each tag's uses outside of articles, the cost of those that finds the articles' words best, and the chance
    of each name."""
    inside, outside = Counter(), Counter()
    name_in, name_out, name_most = Counter(), Counter(), Counter()
    for page in pages:
        for i, (tag, gone) in enumerate(zip(page["tags"], page["gone"])):
            if tag and not gone:
                (inside if page["begin"] <= i < page["end"] else outside)[tag] += 1
        for name, own in zip(page["names"], page["inside"]):
            (name_out, name_in, name_most)[own][name] += 1
    share = {tag: (outside[tag] + 0.1) / (inside[tag] + outside[tag] + 1.0) for tag in inside | outside}
    # an element that is a small part of an article may still be beside its text if its name says so
    named = {x: (prior(x) * (PRIOR + name_in[x] * (x in NAMES)) + name_out[x]) / (PRIOR + name_out[x] + name_in[x] + name_most[x]) for x in name_in | name_out | name_most}

    def error(cost: float) -> int:
        weights, wrong = Weights(share, cost), 0
        for page in pages:
            words, gone = np.array(page["words"]), np.array(page["gone"], bool)
            begin, end = region(scores(page["tags"], words, gone, weights))
            at = np.arange(len(words))
            wrong += int(words[~gone & (((at >= begin) & (at < end)) != ((at >= page["begin"]) & (at < page["end"])))].sum())
        return wrong

    return Weights(share, min(COSTS, key=lambda cost: (error(cost), abs(cost - DEFAULT_COST))), named) if pages else Weights()


_LABELLED = "tags array<string>, words array<bigint>, gone array<boolean>, begin bigint, end bigint, names array<string>, inside array<int>"


def learned(pages: DataFrame, most: int = SAMPLE_PAGES) -> Weights:
    """Weights from at most `most` pages, chosen by the hash of the id."""
    prepare(pages.sparkSession)
    kinds = [pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32())]
    keys = [x.split()[0] for x in _LABELLED.split(", ")]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for x in map(labelled, batch.column(0).to_pylist()) if x]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in zip(keys, kinds)], keys)

    chosen = hash_sample(pages.select("page_id", F.col("html").cast("string").alias("html")), "page_id", most).where("html IS NOT NULL")
    found = chosen.select("html").mapInArrow(describe, _LABELLED).collect()  # at most `most` pages
    return learn([r.asDict() for r in found])


def main_text(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    prepare(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(weights)  # a number for each tag and name of the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x, shared.value) for x in batch.column(2).to_pylist()]
            counts = pa.array(np.fromiter(map(len, texts), np.int64, len(texts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), counts], ["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return picked.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
