"""HTML extraction by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass labels each block on its own: bad where its place says so
(menus, headers, footers, sidebars, forms, notices, adverts, comments, by tag or role) or its words are mostly links; good
where it is long and reads as prose, by the density of function words or, in languages whose words are not listed, by
sentence marks; else near or short. Words in a class or an id vote: where all parts of a name speak of what is not the
article ("cookie-notice"), its element is bad; where one part does ("social-science"), or where the name is an article's or
main's own, the element is bad only if most of the page's prose lies outside it. In the second pass the ambiguous blocks
inherit the label of their nearest decided neighbours within the same article (or the same page where there is none).
Blocks of an article with no decided neighbour are its text. Where a list's items in an article are links, those of some words (references)
inherit like other ambiguous blocks; bare names, and outside articles paragraphs that are links, are text only between blocks
that are. Outside articles a short block that speaks of cookies and asks for consent is a notice, whatever its element's name.

Defined results: a null or empty page, and one without a good block, has the empty text; a page of any length or depth is
read whole, in time linear in its length; tags that are never closed end with what they stand in, but those of RAW with the
page; inline tags part no words; formulas are text; repeated rows are read each; extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import with_longs

SHORT, LONG = 70, 200  # characters
LINKS, LINKS_INSIDE = 0.3, 0.6  # share of characters in links from which a block is bad, and within an article
STOPS_LOW, STOPS_HIGH = 0.12, 0.25  # share of function words from which a text may be, and is, prose
SENTENCE = (20, 500)  # characters of a sentence in prose without listed words
LETTERS = 0.6  # their least share there

#: Common function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the and of to in is it that for with as are on be this by from was at or an a not have has but they which you "
    "der die das und den von zu mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
    "le la les de et un une du en que qui dans pour par sur au est pas avec ne se ce il sont plus "
    "el los las y con no para su del lo como más o pero sus al".split()
)
REFERENCE = 5  # words from which a linked item of a list reads as a reference
NOTICE = 600  # characters of a notice at most
#: Words of notices, in the languages of the stop words.
_COOKIES = re.compile(r"\bcookies?\b", re.IGNORECASE)
_ASKS = re.compile(
    r"\b(?:we use|site uses|we and our partners|accept|consent|agree|wir verwenden|wir nutzen|diese (?:web)?seite verwendet|akzeptier\w*|zustimm\w*|einwillig\w*|"
    r"nous utilisons|ce site utilise|accepter|acceptez|consentement|utilizamos|usamos|este sitio (?:utiliza|usa)|aceptar|acepta|consentimiento)\b",
    re.IGNORECASE,
)
#: Fixed values of the HTML standard.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())  # their content is no markup, up to the end tag or the end of the page
_RAW_ENDS = {tag: re.compile(rf"</{tag}\s*/?>", re.IGNORECASE) for tag in RAW}
FOREIGN = frozenset(("svg", "math"))  # '/>' closes them
#: What stands in these is not shown, or only where they fail.
UNSEEN = frozenset("annotation annotation-xml noscript iframe template svg noembed noframes object canvas select audio video".split())
BOILERPLATE = UNSEEN | frozenset("nav footer aside form menu dialog button fieldset head".split())
SCOPES = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words in a class or an id that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "notification sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments commentlist disqus reply replies respond "
    "share sharing social related recommended recommendations newsletter subscribe signup login popup modal overlay pagination pager widget toolbar topbar".split()
)
#: Words that say nothing beside those of MARKS.
_PLAIN = frozenset(
    "area bar block body bottom box button buttons col column container content entry fixed footer form group header icon icons inner item items left link links list "
    "main media module page panel post posts primary region right row secondary section site slot small stories story text top unit wrap wrapper articles".split()
)
_NEGATED = frozenset(("no", "with", "has", "without"))
_SENTENCE = re.compile(r"[.!?;:…][\"'”’»)\]]*(?:\s|\Z)|[。！？；।؟۔።]")
_DENSE = re.compile(r"[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")  # scripts in which a sign says more than a letter
_BOUNDS = frozenset("button caption html object select table td template th".split())  # a paragraph outside is not ended inside
_OUTER = frozenset(("nav", "header", "head", "form", "menu", "body", "html"))
_WRAPS = frozenset(("html", "body", "article", "main"))
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z/][^>]*\Z""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_CLOSED = re.compile(r"""(?:^|[\s"'])/\s*$""")
_EDGE = re.compile(r"^\W+|\W+$")
_P_ENDS = BLOCKS - {"body", "html", "head", "title", "option", "optgroup", "td", "th", "tr", "caption", "tbody", "thead", "tfoot"}


class Block:
    """A run of text: its characters in links, whether its place is bad, the number of its article or 0, the innermost element
    around it whose name votes, or 0, and whether it is an item of a list, and whether a paragraph."""

    __slots__ = ("text", "links", "bad", "scope", "mark", "item", "para", "label", "_prose")

    def __init__(self, text: str, links: int, bad: bool, scope: int, mark: int, item: bool, para: bool):
        self.text, self.links, self.bad, self.scope, self.mark, self.item, self.para, self.label, self._prose = text, links, bad, scope, mark, item, para, "", None

    def prose(self) -> int:
        if self._prose is None:
            self._prose = _prose(self.text)
        return self._prose


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(source)} if source.strip(" /") else {}


def _placed(tag: str, at: dict[str, str], inside: bool) -> bool:
    """Whether tag, role or style say that the element holds what is not the article."""
    if tag in BOILERPLATE or tag == "header" and not inside:
        return True
    return bool(at) and (at.get("role", "").lower() in ROLES or "hidden" in at or at.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", at.get("style", ""))))


def _named(tag: str, at: dict[str, str]) -> int:
    """What class and id say: 0 nothing, 1 perhaps not the article, 2 not the article."""
    most = 0
    if at and tag not in ("html", "body"):
        for name in ("class", "id"):
            for value in at.get(name, "").lower().split():
                words = {w for w in re.split(r"[^a-z]+", value) if w}
                if MARKS & words and not _NEGATED & words:
                    most = max(most, 2 if words <= MARKS | _PLAIN and tag not in SCOPES else 1)
    return most


class Stack:
    """Open elements: (tag, whether its content is bad, number of its article or 0, number of the innermost named element or 0).

    Where elements of each tag and kind stand is kept beside, so that no step walks down.
    """

    def __init__(self) -> None:
        self.open: list[tuple[str, bool, int, int]] = []
        self.at: dict[str, list[int]] = defaultdict(list)
        self.unseen: list[int] = []
        self.scopes: list[int] = []
        self.bounds: list[int] = []
        self.inner_bad = self.foreign = 0

    def push(self, tag: str, bad: bool, scope: int, mark: int) -> None:
        n = len(self.open)
        self.open.append((tag, bad, scope, mark))
        self.at[tag].append(n)
        for kind, where in ((UNSEEN, self.unseen), (SCOPES, self.scopes), (_BOUNDS, self.bounds)):
            if tag in kind:
                where.append(n)
        self.inner_bad += bad and tag not in _OUTER
        self.foreign += tag in FOREIGN

    def cut(self, n: int) -> None:
        """Close the elements from the n-th on."""
        while len(self.open) > n:
            tag, bad, _, _ = self.open.pop()
            self.at[tag].pop()
            for kind, where in ((UNSEEN, self.unseen), (SCOPES, self.scopes), (_BOUNDS, self.bounds)):
                if tag in kind:
                    where.pop()
            self.inner_bad -= bad and tag not in _OUTER
            self.foreign -= tag in FOREIGN

    def last(self, tag: str) -> int:
        return self.at[tag][-1] if self.at.get(tag) else -1


def blocks_of(page: str) -> tuple[list[Block], list[tuple[int, int]]]:
    """The blocks of a page in order, and the named elements from 1: (the named one around it, its vote)."""
    found: list[Block] = []
    named: list[tuple[int, int]] = [(0, 0)]
    text: list[str] = []
    linked: list[str] = []
    stack, scopes = Stack(), 0

    def flush() -> None:
        if text:
            whole = " ".join(_html.unescape("".join(text)).split())
            if whole:
                # the text stands before what is not shown
                top = stack.unseen[0] if stack.unseen else len(stack.open)
                _, bad, scope, mark = stack.open[top - 1] if top else ("", False, 0, 0)
                n = len(" ".join(_html.unescape("".join(linked)).split())) if linked else 0
                found.append(Block(whole, n, bad, scope, mark, bool(stack.at.get("li")), bool(stack.at.get("p"))))
            text.clear()
            linked.clear()

    def say(piece: str) -> None:
        if stack.unseen:
            return
        text.append(piece)
        if stack.at.get("a"):
            linked.append(piece)

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in BLOCKS and not stack.unseen:
                flush()
            i = stack.last(tag)
            if i >= 0 and (tag in _WRAPS or not stack.scopes or i > stack.scopes[-1]):
                if tag in BLOCKS and stack.unseen and stack.unseen[-1] >= i:
                    flush()
                stack.cut(i)
            continue
        source = m[3] or m[6] or ""
        if (stack.foreign or tag in FOREIGN or tag in UNSEEN) and _CLOSED.search(source):
            continue
        if tag in RAW:
            if tag in BLOCKS and not stack.unseen:
                flush()
            end = _RAW_ENDS[tag].search(page, at)
            at = end.end() if end else len(page)
            if tag == "textarea":
                say(" ")
            continue
        if tag in BLOCKS and not stack.unseen:
            flush()
            i = stack.last("p")
            if tag in _P_ENDS and i >= 0 and not (stack.bounds and stack.bounds[-1] > i):
                stack.cut(i)
        elif tag in ("br", "input"):
            say(" ")
        if tag in VOID:
            continue
        _, bad, scope, mark = stack.open[-1] if stack.open else ("", False, 0, 0)
        attributes = _attributes(source)
        own = _placed(tag, attributes, scope > 0)
        if vote := _named(tag, attributes):
            named.append((mark, vote))
            mark = len(named) - 1
        if tag in SCOPES:
            # an article within a menu or header that was never closed is no part of it; one among comments or teasers is
            bad = bad and stack.inner_bad > 0
            if not scope:
                scopes += 1
                scope = scopes
        stack.push(tag, bad or own, scope, mark)
    flush()
    return found, named


def _prose(text: str) -> int:
    """2 where a text reads as prose, 1 where it may, 0 where nothing says so."""
    words = text.split()
    stops = sum(_EDGE.sub("", w).lower() in STOP_WORDS for w in words) / max(1, len(words))
    if stops >= STOPS_HIGH:
        return 2
    # without listed words, sentences tell: two or more, of usual length
    sentences = len(_SENTENCE.findall(text))
    size = len(text) + 2 * len(_DENSE.findall(text))
    if sentences >= 2 and SENTENCE[0] <= size / sentences <= SENTENCE[1] and sum(map(str.isalpha, text)) >= LETTERS * len(text):
        return 2
    return 1 if stops >= STOPS_LOW or sentences else 0


def _notice(text: str) -> bool:
    """Whether a block outside articles speaks as a notice about cookies does, whatever its element is called."""
    return len(text) <= NOTICE and bool(_COOKIES.search(text) and _ASKS.search(text))


def _vote(blocks: list[Block], named: list[tuple[int, int]]) -> None:
    """Blocks are bad within an element whose name is sure, and within one whose name is not if most of the page's prose lies
    outside it; but prose within an article is bad by no such name."""
    if len(named) == 1:
        return
    sure, prose, whole = [False], [0] * len(named), 0
    for outer, vote in named[1:]:
        sure.append(sure[outer] or vote == 2)
    for b in blocks:
        if not (b.bad or sure[b.mark]) and b.links <= LINKS * len(b.text) and len(b.text) >= SHORT and b.prose() == 2:
            whole += len(b.text)
            prose[b.mark] += len(b.text)
    for i in range(len(named) - 1, 0, -1):  # elements come after those around them
        prose[named[i][0]] += prose[i]
    bad = [False]
    for i in range(1, len(named)):
        bad.append(sure[i] or bad[named[i][0]] or 2 * prose[i] < whole)
    for b in blocks:
        if bad[b.mark] and (sure[b.mark] or not b.scope or b.prose() < 2):
            b.bad = True


def _first_pass(blocks: list[Block]) -> None:
    articles = any(b.scope and not b.bad for b in blocks)
    for b in blocks:
        size = len(b.text)
        linked = b.links > (LINKS_INSIDE if b.scope else LINKS) * size
        # in an article a heading or a paragraph may be a link, and a list of links its bibliography: what stands around them decides
        if b.bad or articles and not b.scope or not b.scope and _notice(b.text) or linked and not b.scope and (b.item or not b.para):
            b.label = "bad"
        elif linked and not b.scope:
            b.label = "between"  # a paragraph that is a link: text, where it stands amid text
        elif linked and b.item:  # a reference is some words long; a bare name of elsewhere is text only amid text
            b.label = "near" if len(b.text.split()) >= REFERENCE else "between"
        elif size < SHORT and not _DENSE.search(b.text):
            b.label = "short"
        else:
            sure = b.prose() == 2 and size + 2 * len(_DENSE.findall(b.text)) >= LONG
            b.label = "good" if sure else "near"
    if not any(b.label == "good" for b in blocks):  # where no block is long, shorter prose decides
        for b in blocks:
            if b.label == "near" and b.prose() == 2:
                b.label = "good"


def _votes(b: Block) -> bool:
    """Decided by its words; within an article, an advert or notice says nothing of the blocks beside it."""
    return b.label in ("good", "bad") and not (b.bad and b.scope)


def _second_pass(blocks: list[Block]) -> None:
    before: list[tuple[int, str] | None] = []
    last: dict[int, tuple[int, str]] = {}
    for i, b in enumerate(blocks):
        before.append(last.get(b.scope))
        if _votes(b):
            last[b.scope] = (i, b.label)
    last = {}
    labels = []
    for i in range(len(blocks) - 1, -1, -1):
        b = blocks[i]
        if b.label in ("good", "bad"):
            if _votes(b):
                last[b.scope] = (i, b.label)
            labels.append(b.label)
            continue
        sides = [(abs(i - at), label != "good") for at, label in filter(None, (before[i], last.get(b.scope)))]
        if b.label == "between":
            labels.append("good" if len(sides) == 2 and not any(bad for _, bad in sides) else "bad")
        else:
            labels.append("bad" if sides and min(sides)[1] else "good")
    for b, label in zip(blocks, reversed(labels), strict=True):
        b.label = label


def main_text(page: str | None) -> str:
    blocks, named = blocks_of(page or "")
    _vote(blocks, named)
    _first_pass(blocks)
    _second_pass(blocks)
    return " ".join(b.text for b in blocks if b.label == "good")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars."""
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [main_text(x) for x in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    def work(rows: DataFrame) -> DataFrame:
        kinds = dict(rows.dtypes)
        return rows.mapInPandas(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")

    return with_longs(rows, ["page_id", "url"], work)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


QUERIES = {"op3_html_text": op3_html_text}
SQL: dict[str, str] = {}
