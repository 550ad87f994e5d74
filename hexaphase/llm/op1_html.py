"""Main text of web pages by two-pass block rules.

A scanner walks the tags once and cuts the page into blocks at block-level tags. First pass: each block is decided by its
length, the share of stop words and the share of its characters inside links. Good: SHORT characters or more with enough stop
words. Bad: mostly links, or long with hardly a stop word. All others, short ones above all, stay ambiguous. Second pass:
ambiguous blocks inherit the label of the nearest decided neighbours on both sides. If the two differ, or the page ends on
one side, a block is good if it is a paragraph or item in the same container as the good neighbour, or has some stop words
at SHORT characters or more; a headline follows the block after it. If no block at all is good, the container with the most text
in paragraphs is taken for the article.

Markup adds to this what text cannot tell. Parts that are no article by their element, class, id or role (menus, headers,
footers, sidebars, notices, adverts, forms, comments by readers) are left out, and do not count as neighbours. Classes, ids,
roles, forms, headers and asides are hints only: where less than LEAST_SHARE of a page's good text lies outside such parts,
the hint of the part that holds most of it is void, and so on until enough is outside. Neighbours of blocks inside an article
or main element are inside it too, and its edges count as good.

Defined cases: null or empty html gives the empty text. Broken markup (tags without an end, unclosed comments, unbalanced
quotes) never fails, and takes time in proportion to the page: what is no tag is text, elements end with what contains them,
and what follows an unclosed comment or script is dropped. Very long pages are scanned whole. In text of other than Latin
letters, whose stop words are not listed, length and links decide. Repeated rows are each extracted; an empty table gives no
rows; other columns are kept, and those named like a new one give way to it.
"""

from __future__ import annotations

import heapq
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import table

# Frequent words of four languages.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be because been but by can could do for from had has have he her his how
    i if in into is it its like may more no not of on one only or other our out over she so some than that the their them
    then there these they this to up was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis da das dass dem den der des die doch du durch ein eine einem einen einer er es
    für hat ich ihr im in ist kann man mit nach nicht noch nur oder sich sie sind so über um und uns unter vom von vor war
    was wenn wie wir zu zum zur
    à au aux avec ce ces cette comme dans de des du elle en entre est et il ils je la le les leur lui mais ne nous on ou où
    par pas plus pour qu que qui sa se ses si son sont sur un une vous
    al algo como con cuando de del el ella en entre es esta este ha hay la las le les lo los más me mi muy no nos o para
    pero por porque que se ser si sin sobre son su sus también te tiene todo un una uno y ya
    """.split()
)
BLOCK_TAGS = frozenset(
    """
    address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset
    figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol
    optgroup option p pre search section summary table tbody td tfoot th thead title tr ul
    """.split()
)
RAW_TAGS = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
#: Elements that are never part of an article, and those that only hint at it.
DROPPED_TAGS = frozenset("nav footer head menu dialog search svg math canvas object embed audio video map select datalist button".split())
HINT_TAGS = frozenset("header aside form fieldset".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE_TAGS = frozenset("p li dd dt blockquote pre figcaption".split())
LIST_TAGS = frozenset("ul ol dl menu li dd dt".split())
#: What an opening tag ends, if it is open at the top.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}}
BAD_WORDS = frozenset(
    """
    ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie
    cookies copyright disclaimer discussion disqus footer gdpr header login masthead menu menubar modal nav navbar navigation
    newsletter notice notices notification pager pagination paywall popup promo promoted promotion recommended related
    replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar
    topbar widget widgets
    """.split()
)
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
OWN_WORDS = frozenset("article post entry content story".split())
# Limits: links; characters of a short and a long block; stop words of a bad, an acceptable and a good block; characters between a headline and its text.
MAX_LINKS, SHORT, LONG, LOW_STOPS, SOME_STOPS, HIGH_STOPS, HEADING_REACH = 0.5, 70, 200, 0.04, 0.10, 0.20, 200
#: Share of the good text that lies outside hinted parts at least, if hints are to hold.
LEAST_SHARE = 0.1
#: How far a quoted value reaches at most, beyond which the quote counts as unbalanced, and how many open inline elements an end tag looks through.
QUOTED, INLINE = 1 << 16, 64

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"[>\"']")
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_PREFIX = re.compile(r"(?:has|with|without|no|is|show|hide)(?:[-_]|(?=[A-Z]))")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")
_LATIN = re.compile(r"[A-Za-z\u00C0-\u024F]")
_CLOSERS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW_TAGS}


def _hinted(names: str) -> bool:
    """Whether a class or an id names a part that is no article."""
    for name in names.split():
        words = {x.lower() for x in _SPLIT.split(name)}
        found = words & BAD_WORDS
        if found and not _PREFIX.match(name) and not (found == {"header"} and words & OWN_WORDS):
            return True
    return False


def _judged(tag: str, attrs: str, in_article: bool) -> str:
    """An element is "dropped", a "hint", or neither."""
    if tag in DROPPED_TAGS:
        return "dropped"
    kind = "hint" if tag in HINT_TAGS and not (tag == "header" and in_article) else ""
    if not attrs or tag in ("html", "body"):
        return kind
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.lower().replace(" ", ""):
            return "dropped"
        if name == "role" and value.lower() in BAD_ROLES or name in ("class", "id") and _hinted(value):
            kind = "hint"
    return kind


class Block:
    """A block with what the passes ask about it; hint: number of the innermost hinted element around it, or -1; article: of the article, or 0."""

    __slots__ = ("text", "links", "tag", "container", "hint", "article", "label", "stops")

    def __init__(self, text: str, links: int, tag: str, container: int, hint: int, article: int) -> None:
        self.text, self.links, self.tag, self.container, self.hint, self.article, self.label, self.stops = text, links, tag, container, hint, article, "", 0.0


class Element:
    __slots__ = ("tag", "number", "container", "dropped", "hint", "article", "byline", "block")

    def __init__(self, tag: str, number: int, container: int, dropped: str, hint: int, article: int, byline: bool) -> None:
        self.tag, self.number, self.container, self.dropped, self.hint, self.article, self.byline, self.block = tag, number, container, dropped, hint, article, byline, tag in BLOCK_TAGS


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Where the tag that begins before at ends; quoted values may hold what ends a tag elsewhere."""
    i = at
    while m := _MARK.search(page, i):
        mark = m[0]
        if mark == ">":
            return m.start()
        close = page.find(mark, m.end(), m.end() + QUOTED) if m.end() <= last[mark] else -1
        i = close + 1 if close >= 0 else m.end()
        if i > last[">"]:
            break
    return page.find(">", at)


class Scanner:
    """One pass over a page: its blocks in order, and the parents of its hinted elements."""

    def __init__(self, page: str) -> None:
        self.page, self.blocks, self.parents = page, [], []
        self.stack: list[Element] = []
        self.open: Counter[str] = Counter()
        self.bits: list[tuple[str, bool]] = []
        self.elements = 0
        self._scan()

    def _text(self, text: str) -> None:
        if text and not (self.stack and self.stack[-1].dropped):
            self.bits.append((text, self.open["a"] > 0))

    def _flush(self) -> None:
        if not self.bits:
            return
        text = _SPACE.sub(" ", html.unescape("".join(t for t, _ in self.bits))).strip()
        if text:
            top = next((e for e in reversed(self.stack[-INLINE:]) if e.block), None)
            links = len(_SPACE.sub(" ", html.unescape(" ".join(t for t, linked in self.bits if linked))).strip())
            if not (top and top.byline) or top.tag in HEADINGS:
                own = (top.tag, top.container, self.stack[-1].hint, self.stack[-1].article) if top else ("", 0, -1, 0)
                self.blocks.append(Block(text, links, *own))
        self.bits.clear()

    def _pop(self) -> Element:
        e = self.stack.pop()
        self.open[e.tag] -= 1
        return e

    def _close(self, tag: str) -> None:
        if not self.open[tag]:
            return
        if tag in BLOCK_TAGS:
            while self._pop().tag != tag:
                pass
            return
        for e in reversed(self.stack[-INLINE:]):  # an inline element does not end across a block
            if e.tag == tag:
                while self._pop().tag != tag:
                    pass
                return
            if e.block:
                return

    def _begin(self, tag: str, attrs: str) -> None:
        if tag in BLOCK_TAGS:  # a paragraph or headline ends where another block begins, an item where the next one does
            for k, e in enumerate(reversed(self.stack[-INLINE:])):
                if e.block:
                    if e.tag == "p" or e.tag in HEADINGS:
                        for _ in range(k + 1):
                            self._pop()
                    break
            while self.stack and self.stack[-1].tag in ENDS.get(tag, ()):
                self._pop()
        elif tag == "a" and self.open["a"]:
            self._close("a")
        up = self.stack[-1] if self.stack else Element("", 0, 0, "", -1, 0, False)
        kind = _judged(tag, attrs, up.article > 0)
        if tag not in BLOCK_TAGS and tag != "a" and not kind and not self.open[tag]:
            return
        self.elements += 1
        dropped, hint, article = up.dropped, up.hint, up.article
        if kind == "dropped":
            dropped = dropped or tag
        elif kind == "hint":
            self.parents.append(hint)
            hint = len(self.parents) - 1
        if tag in ("article", "main") and not kind:
            if dropped in ("nav", "footer", "menu"):  # left open by mistake
                dropped = ""
            article = article or self.elements
        container = up.container if tag in LIST_TAGS or not self.stack else up.number
        self.stack.append(Element(tag, self.elements, container, dropped, hint, article, up.byline or article > 0 and tag == "header"))
        self.open[tag] += 1

    def _scan(self) -> None:
        page, pos = self.page, 0
        last = {mark: page.rfind(mark) for mark in (">", '"', "'", "]]>")}
        while True:
            lt = page.find("<", pos)
            if lt < 0 or lt > last[">"]:  # no tag follows
                if page.startswith("<!--", lt) and lt >= 0:
                    self._text(page[pos:lt])
                else:
                    self._text(page[pos:].partition("<!--")[0])
                break
            self._text(page[pos:lt])
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 2)
                if end < 0:
                    break
                pos = end + 3
                continue
            if page.startswith("<![CDATA[", lt) and lt < last["]]>"]:
                end = page.find("]]>", lt)
                self._text(html.escape(page[lt + 9 : end]))
                pos = end + 3
                continue
            if page.startswith(("<!", "<?"), lt):
                pos = page.find(">", lt) + 1
                continue
            name = _NAME.match(page, lt + 1)
            if not name:
                self._text("<")
                pos = lt + 1
                continue
            end = _tag_end(page, name.end(), last)
            tag, pos = name[1].lower(), end + 1
            if tag in BLOCK_TAGS:
                self._flush()
            elif tag == "br":
                self._text(" ")
            if page[lt + 1] == "/":
                self._close(tag)
            elif tag in RAW_TAGS:
                close = _CLOSERS[tag].search(page, pos)
                if not close:
                    break
                pos = close.end()
            elif tag not in VOID_TAGS:
                self._begin(tag, page[name.end() : end])
        self._flush()


def decide(b: Block) -> None:
    """First pass: good, bad, or nothing."""
    n, words = len(b.text), _WORD.findall(b.text.lower())
    b.stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if b.links > MAX_LINKS * n:
        b.label = "bad"
    elif n >= SHORT and b.stops >= HIGH_STOPS:
        b.label = "good"
    elif n >= LONG and b.stops < LOW_STOPS and not b.article:
        b.label = "bad" if 2 * len(_LATIN.findall(b.text)) >= sum(map(len, words)) else "good"


def held_hints(found: list[Block], parents: list[int]) -> list[bool]:
    """Of each hinted element, whether its blocks go: its hint or one around it holds."""
    own, outside = [0] * len(parents), 0
    for b in found:
        size = len(b.text) if b.label == "good" or b.article and not b.label else 0
        if b.hint < 0:
            outside += size
        else:
            own[b.hint] += size
    whole, children = own[:], [[] for _ in parents]
    for i in range(len(parents) - 1, -1, -1):  # an element comes after those around it
        if parents[i] >= 0:
            whole[parents[i]] += whole[i]
            children[parents[i]].append(i)
    heap = [(-whole[i], i) for i, p in enumerate(parents) if p < 0]
    heapq.heapify(heap)
    total, void = outside - sum(w for w, _ in heap), [False] * len(parents)
    while heap and outside < LEAST_SHARE * total:
        _, i = heapq.heappop(heap)
        void[i] = True
        outside += own[i]
        for k in children[i]:
            heapq.heappush(heap, (-whole[k], k))
    gone: list[bool] = []
    for i, p in enumerate(parents):
        gone.append(not void[i] or p >= 0 and gone[p])
    return gone


def inherit(found: list[Block]) -> None:
    """Second pass, over the blocks of one article, or of all that are in none."""
    if not found[0].article and all(b.label != "good" for b in found):  # stop words tell nothing here
        size: Counter[int] = Counter()
        paragraphs = [b for b in found if b.tag == "p" and b.links <= MAX_LINKS * len(b.text)]
        for b in paragraphs:
            size[b.container] += len(b.text)
        most = max(size, key=lambda c: (size[c], -c), default=0)
        for b in paragraphs:
            if b.container == most and size[most] >= SHORT:
                b.label = "good"
    n, before, after = len(found), [], [None] * len(found)
    seen = None
    for b in found:
        before.append(seen)
        seen = b if b.label else seen
    seen, reach, ahead = None, 0, [0] * n
    for i in range(n - 1, -1, -1):
        after[i], ahead[i] = seen, reach
        if found[i].label:
            seen, reach = found[i], 0
        else:
            reach += len(found[i].text)
    labels = []
    for b, left, right, far in zip(found, before, after, ahead, strict=True):
        good, bad = ([x for x in (left, right) if x is not None and x.label == label] for label in ("good", "bad"))
        near = len(b.text) >= SHORT and b.stops >= SOME_STOPS
        if b.label:
            labels.append(b.label)
        elif b.article:
            labels.append("bad" if len(bad) == 2 else "good")
        elif b.tag in HEADINGS:
            labels.append("good" if right in good and (far <= HEADING_REACH or b.container == right.container) else "bad")
        elif len(good) == 2 or not good and not bad and near:
            labels.append("good")
        elif good and (near or b.tag in PROSE_TAGS and b.container == good[0].container):
            labels.append("good")
        else:
            labels.append("bad")
    for b, label in zip(found, labels, strict=True):
        b.label = label


def classify(found: list[Block], parents: list[int]) -> list[Block]:
    """The blocks with their labels, by the two passes; those of parts that are no article are bad."""
    for b in found:
        decide(b)
    gone = held_hints(found, parents)
    scopes: dict[int, list[Block]] = {}
    for b in found:
        if b.hint >= 0 and gone[b.hint]:
            b.label = "bad"
        else:
            scopes.setdefault(b.article, []).append(b)
    for own in scopes.values():
        inherit(own)
    return found


def main_text(page: str | None) -> str:
    scanner = Scanner(page or "")
    return "\n".join(b.text for b in classify(scanner.blocks, scanner.parents) if b.label == "good")


def extract(pages: DataFrame, html_col: str = "html", to: str = "text") -> DataFrame:
    """pages without their html, with the main text and its length in code points, n_chars."""
    at = pages.columns.index(html_col)
    kept = [i for i, c in enumerate(pages.columns) if c not in (html_col, to, "n_chars")]
    names = [f"c{i}" for i in range(len(pages.columns))]  # names that no dot or case can upset
    made = [*(names[i] for i in kept), "text", "n_chars"]
    schema = StructType([*(StructField(names[i], pages.schema.fields[i].dataType) for i in kept), StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(at)]
            columns = [batch.column(i) for i in kept] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=made)

    return pages.toDF(*names).mapInArrow(run, schema).toDF(*(pages.columns[i] for i in kept), to, "n_chars")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
