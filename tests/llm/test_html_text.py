import html
import random
import re
import time
from html.parser import HTMLParser

import pytest

from mensura.llm.html_text import extract, main_text, op3_html_text

LONG = "It was the best of times and it was the worst of times, for all of us in the city by the sea, with the rain on the roof and a light in the window of the old house at the end of the road that is not on a map."


def test_pages(spark):
    """The pages of the test tables have one article each; read plainly, its text is the result."""
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in op3_html_text(spark, sf).collect()}
    assert got.keys() == pages.keys()
    for k, page in pages.items():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.DOTALL)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*(?:>|\Z)", " ", body)).split())
        assert got[k]["text"] == want and got[k]["n_chars"] == len(want), k


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("Ouenha.", "Ouenha."),
        ("a < b &amp;&am &lt;p&gt; &#233;&nbsp;x", "a < b &&am <p> é x"),
        (f"<p>{LONG}<p>Short.<div class=sidebar>{LONG}</div>", f"{LONG} Short."),
        (f"<nav><a href=x>home</a><article><h1>T</h1>{LONG}<aside>{LONG}</aside></article>", f"T {LONG}"),
        (f"<body class=no-sidebar><header>Site</header><main><header><h1>T</h1></header><p>{LONG}</p><section id=comments><article>{LONG}</article></section><form>Name<input></form></main><div class='cookie-notice'>We use cookies</div>", f"T {LONG}"),
        (f"<div><p>{LONG}</p><ul><li><a href=1>One thing to see in the city of the sea</a></li><li><a href=2>Two</a></li></ul><p>{LONG}</p></div>", f"{LONG} {LONG}"),
        ("<article><p>One <b>bo</b>ld<br>line</p><script>var t='</p>'</script><style>p{}</style><!-- <p>no --><p>Two</p></article><footer>&copy;</footer>", "One bold line Two"),
        (f"<main><p title='a > b'>{LONG}</p><p hidden>no</p><div role=alert>no</div><p>x<", f"{LONG} x<"),
    ],
)
def test_rules(page, text):
    assert main_text(page) == text


RUSSIAN = "Утром в городе шёл дождь, и люди стояли у дверей. Потом вышло солнце, и дети побежали к реке. Старый рыбак молча смотрел на воду и думал о доме. Вечером все собрались у огня и слушали его рассказ."
CHINESE = "清晨的城市下着小雨,人们站在门口等待。后来太阳出来了,孩子们跑向河边。老渔夫默默地看着水面,想着远方的家。晚上大家围坐在火边,听他讲年轻时的故事,直到夜深。"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article class='social-science'><p>{LONG}</p></article>", LONG),
        (f"<div class='comment-policy related-work'><p>{LONG}</p></div>", LONG),
        (f"<article><p>{LONG}</p><section class=related-work><p>{LONG}</p></section></article>", f"{LONG} {LONG}"),
        (f"<div><p>{LONG}</p><p>{LONG}</p></div><div class=comment-thread-x><p>{LONG}</p></div>", f"{LONG} {LONG}"),
        (f"<div><p>{LONG}</p></div><div class=comment-list><p>{LONG}</p><p>{LONG}</p></div><div id=ad-slot-2>{LONG}</div>", LONG),
        (f"<ul><li><a href=1>Главная</a></li><li><a href=2>Новости города и области</a></li></ul><div><h1>Дождь</h1><p>{RUSSIAN}</p></div><footer>{RUSSIAN}</footer>", f"Дождь {RUSSIAN}"),
        (f"<nav><a href=1>首页</a></nav><div><p>{CHINESE}</p><p>{CHINESE}</p></div>", f"{CHINESE} {CHINESE}"),
        (f"<div><p>{LONG}</p><table><tr><td>{'12.5 ' * 20}</td></tr></table><p>{LONG}</p></div>", f"{LONG} {'12.5 ' * 20}{LONG}"),
        ("<article><p>foo<img src=x>bar foo<script>x</script>bar foo<svg/>bar fo<b>o</b>bar<br>x</p></article>", "foobar foobar foobar foobar x"),
        (f"<article><p>{LONG}{'<b><i><u>' * 9} x<div>y</div></article>", f"{LONG} x y"),
        (f"<article><p>One<table><tr><td><p>Two<td><p>Three</table>Four</article>", "One Two Three Four"),
        ("<article><ul><li><p>One<li><p>Two</ul></article>", "One Two"),
        (f"<article><h2><a href=1>Rain on the roof</a></h2><p>{LONG}</p><p><a href=2>The whole report of the year</a></p><ul><li><a href=3>More news</a></li></ul></article>", f"Rain on the roof {LONG} The whole report of the year"),
    ],
)
def test_kept(page, text):
    """No name, language, number or nesting loses text of the article."""
    assert main_text(page) == text


@pytest.mark.parametrize("page", ["<div>" * 200_000 + "x" + "</p></span>" * 200_000, "<div class=social-x>" * 50_000 + "</i>" * 50_000, "<article>" * 60_000 + "<p>x", "<nav><ul>" + "<li><article><svg>" * 30_000, "<p><b>" * 100_000])
def test_linear(page):
    """Deep and stray tags cost no more than others."""
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 10


def test_corners(spark):
    rows = [(1, None, None, "t"), (2, "u", "<p>" + "the a of " * 60000, "t"), (2, "u", "<p>" + "the a of " * 60000, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((r["page_id"], r["n_chars"]) for r in extract(df).collect()) == [(1, 0), (2, 539999), (2, 539999)]
    assert extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        *((f"<article><p>One <{tag}/>two</p><p>Three</p></article>", "One two Three") for tag in ("svg class='x' ", "math", "canvas", "iframe src='x' ")),
        *((f"<article><p>One <{tag}>no</p><p>Two</p></article>", "One Two") for tag in ("object data=x", "video", "select", "svg", "noscript")),
        *((f"<article><p>One <{tag}>no<div>no</div><p>no</p>no</{tag}> two</p><p>Three</p></article>", "One two Three") for tag in ("object", "video", "canvas", "noscript", "template")),
        ("<article><p>One <svg viewBox='0 0 1 1'><title>no</title><title/><path d='x'/><text>no</text></svg> two</p><p>Three</p></article>", "One two Three"),
        ("<article><p>So <math><mi>x</mi><mo>=</mo><mspace/><mn>1</mn><annotation>x=1</annotation></math> holds</p></article>", "So x=1 holds"),
        ("<article><p>One</p><script>no</p><p>no", "One"),
    ],
)
def test_unseen(page, text):
    """What is not shown ends with its end tag, with '/>' or with what it stands in."""
    assert main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><p>{LONG}</p><ul><li><a href=1>Smith, A. Rain on old roofs. 2019.</a></li><li><a href=2>Jones, B. The sea and its light. 2021.</a></li></ul></article>", f"{LONG} Smith, A. Rain on old roofs. 2019. Jones, B. The sea and its light. 2021."),
        (f"<article><p>{LONG}</p><ul><li><a href=1>Sea</a></li><li><a href=2>Rain</a></li></ul><p>{LONG}</p></article>", f"{LONG} Sea Rain {LONG}"),
        (f"<div><p>{LONG}</p><p><a href=1>The whole report of the rain on the roofs</a></p><p>{LONG}</p></div>", f"{LONG} The whole report of the rain on the roofs {LONG}"),
        (f"<div><p>{LONG}</p><p><a href=1>The whole report</a></p></div>", LONG),
        (f"<div class=cc-window>We use cookies to give you the best of it. Accept all.</div><div><p>{LONG}</p></div>", LONG),
        (f"<div><p>{LONG}</p></div><div class=x>Wir verwenden Cookies. Mit dem Besuch der Seite stimmen Sie dem zu und akzeptieren das.</div>", LONG),
        (f"<article><p>{LONG}</p><p>In the book it says that we use cookies with tea, and accept no others.</p></article>", f"{LONG} In the book it says that we use cookies with tea, and accept no others."),
    ],
)
def test_linked_text_and_notices(page, text):
    """Linked references stay with the article, links stay amid text; a notice is told by its words where no name tells it."""
    assert main_text(page) == text


STOPS = set("the and of to in is it that for with as are on be this by from was at or an a not have has but they which you".split())
BLOCK_TAGS = {"div", "p", "ul", "li", "h2", "article", "nav", "aside", "section", "footer"}


class Plain(HTMLParser):
    """Blocks of a well-formed page, each with all the elements around it."""

    def __init__(self):
        super().__init__()
        self.path, self.blocks, self.text, self.linked, self.count = [], [], "", "", 0

    def flush(self):
        text = " ".join(self.text.split())
        if text:
            self.blocks.append({"text": text, "links": len(" ".join(self.linked.split())), "path": list(self.path)})
        self.text = self.linked = ""

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK_TAGS:
            self.flush()
        self.count += 1
        self.path.append((self.count, tag, dict(attrs).get("class", "")))

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.flush()
        self.path.pop()

    def handle_data(self, data):
        self.text += data
        if any(tag == "a" for _, tag, _ in self.path):
            self.linked += data


def plain_vote(name):
    """Of the names that the pages below use."""
    return {"sidebar": 2, "cookie-notice": 2, "social-science": 1, "comment-x": 1}.get(name, 0)


def plain_prose(text):
    words = [re.sub(r"^\W+|\W+$", "", w).lower() for w in text.split()]
    share = sum(w in STOPS for w in words) / len(words)
    sentences = len(re.findall(r"[.!?;:](?=\s|\Z)", text))
    letters = sum(c.isalpha() for c in text) >= 0.6 * len(text)
    return 2 if share >= 0.25 or sentences >= 2 and 20 <= len(text) / sentences <= 500 and letters else 1 if share >= 0.12 or sentences else 0


def plain_main_text(page):
    parser = Plain()
    parser.feed(page)
    parser.flush()
    blocks = parser.blocks
    for b in blocks:
        tags = [tag for _, tag, _ in b["path"]]
        b["scope"] = next((i for i, tag, _ in b["path"] if tag == "article"), 0)
        # a nav or an aside around, unless an article stands within it that no nav or aside within the page proper surrounds
        b["bad"] = any(t in ("nav", "aside", "footer") for t in tags)
        b["item"], b["para"] = "li" in tags, "p" in tags
        b["prose"], b["size"] = plain_prose(b["text"]), len(b["text"])
        b["names"] = [(i, plain_vote(c)) for i, _, c in b["path"] if plain_vote(c)]
        b["sure"] = any(v == 2 for _, v in b["names"])
    told = [b for b in blocks if not b["bad"] and not b["sure"] and b["links"] <= 0.3 * b["size"] and b["size"] >= 70 and b["prose"] == 2]
    whole = sum(b["size"] for b in told)
    inside = lambda element: sum(b["size"] for b in told if any(i == element for i, _, _ in b["path"]))
    for b in blocks:
        doubted = b["sure"] or any(2 * inside(i) < whole for i, _ in b["names"])
        b["out"] = b["bad"] or doubted and (b["sure"] or not b["scope"] or b["prose"] < 2)
    articles = any(b["scope"] and not b["out"] for b in blocks)
    for b in blocks:
        linked = b["links"] > (0.6 if b["scope"] else 0.3) * b["size"]
        notice = not b["scope"] and "cookies" in b["text"] and "accept" in b["text"]
        if b["out"] or not b["scope"] and (articles or notice or linked and (b["item"] or not b["para"])):
            b["label"] = "bad"
        elif linked and not b["scope"] or linked and b["item"] and len(b["text"].split()) < 5:
            b["label"] = "between"
        elif linked and b["item"]:
            b["label"] = "near"
        elif b["size"] < 70:
            b["label"] = "short"
        else:
            b["label"] = "good" if b["prose"] == 2 and b["size"] >= 200 else "near"
    if all(b["label"] != "good" for b in blocks):
        for b in blocks:
            if b["label"] == "near" and b["prose"] == 2:
                b["label"] = "good"
    kept = []
    for i, b in enumerate(blocks):
        decided = [(abs(i - j), o["label"] != "good", j < i) for j, o in enumerate(blocks) if j != i and o["scope"] == b["scope"] and o["label"] in ("good", "bad") and not (o["out"] and o["scope"])]
        before, after = min([d for d in decided if d[2]], default=None), min([d for d in decided if not d[2]], default=None)
        sides = [d[:2] for d in (before, after) if d]
        if b["label"] in ("good", "bad"):
            good = b["label"] == "good"
        elif b["label"] == "between":
            good = len(sides) == 2 and not any(bad for _, bad in sides)
        else:
            good = not (sides and min(sides)[1])
        if good:
            kept.append(b["text"])
    return " ".join(kept)


def test_block_rules_against_a_plain_reading():
    """Random well-formed pages, read by a parser and rules of the test's own."""
    draw = random.Random(12)
    pieces = [LONG, LONG[:150], "Short line", "No words listed here zz yy xx ww vv uu tt ss rr qq pp oo nn mm ll kk jj ii hh gg", "12.5 13.5 " * 9, "We use cookies and you accept them.", "One. Two three four five six. Seven eight nine ten eleven."]
    link = lambda: f"<a href=x>{draw.choice(['More', 'A longer reference to the sea and its light', 'Old roofs, 2019'])}</a>"

    def body(depth, inside):
        out = []
        for _ in range(draw.randint(1, 4)):
            kind = draw.random()
            if kind < 0.45 or depth > 2:
                out.append(f"<p>{draw.choice([draw.choice(pieces), link(), draw.choice(pieces) + ' ' + link()])}</p>")
            elif kind < 0.55:
                out.append("<ul>" + "".join(f"<li>{draw.choice([link(), draw.choice(pieces)])}</li>" for _ in range(draw.randint(1, 3))) + "</ul>")
            elif kind < 0.6:
                out.append(f"<h2>{draw.choice(['Title', link()])}</h2>")
            elif kind < 0.7:
                out.append(f"<{(tag := draw.choice(['nav', 'aside', 'footer']))}><p>{draw.choice(pieces)}</p></{tag}>")
            elif kind < 0.8 and not inside:
                out.append(f"<article>{body(depth + 1, True)}</article>")
            else:
                out.append(f"<div class='{draw.choice(['', '', 'sidebar', 'cookie-notice', 'social-science', 'comment-x'])}'>{body(depth + 1, inside)}</div>")
        return "".join(out)

    told = 0
    for _ in range(1500):
        page = body(0, False)
        want = plain_main_text(page)
        told += bool(want)
        assert main_text(page) == want, page
    assert told > 500
