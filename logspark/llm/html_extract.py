"""Main text of web pages, by boosted trees over the nodes of the page.

*Model.*  Gradient-boosted trees (:mod:`boosting`) give every block node the
probability that its text is article text, from its tag, attribute tokens of
its own and of its ancestors, depth, text density, link share, its first
text, the text before and after it, and what its siblings are like
(:mod:`dom`); class words that tell of a setting (has-sidebar) name nothing.
They are trained, at every call, on pages laid out here in many ways (:class:`Layouts`: named as usual, without names,
or with names of other parts) and filled with paragraphs of a
bounded sample of the given pages (``SAMPLE_PAGES`` with the smallest hash),
so that every training node's label is known.

*Decoding.*  A node is article throughout, not article throughout, or mixed.
Below an article node all is article, below the second nothing is; only the
parts of a mixed node may differ.  A dynamic programme over the tree finds
the most likely choice for the whole page, so no node contradicts its
ancestors or descendants.  Where that keeps nothing, the part nearest to an
article is kept if it is not too unlikely (:func:`chosen`).

*Text.*  Kept pieces in page order, character references decoded, white
space runs to one blank, joined by one blank.  Scripts, styles and the like
are never text.  A null or empty page has the text ""; repeated rows are
extracted each for itself; an empty table gives no rows.  Very long pages are
read whole.  Between equally likely choices
article throughout stands before nothing, nothing before mixed.  Only
``page_id``, ``url`` and ``html`` are read, whatever else there is.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .dom import Node, features, parse

SAMPLE_PAGES = 64
SAMPLE_PARAGRAPHS = 400
SAMPLE_CHARS = 1_000
LAYOUTS = 1_300
MIXED_COST = 1.0
LEAST_ODDS = 0.0                                          # of a part that is kept where the likeliest choice keeps none
SCHEMA = "page_id long, url string, text string, n_chars long"

# The ways in which layouts name their parts: (tag, attributes).
ARTICLE = (("article", ""), ("main", ""), ("div", 'class="content"'), ("div", 'id="main-content"'), ("div", 'class="post"'),
           ("div", 'class="entry-content"'), ("section", 'class="story"'), ("div", 'class="article-body"'), ("div", 'role="main"'),
           ("article", 'class="post"'), ("div", 'itemprop="articleBody"'), ("div", 'class="c7"'), ("div", ""), ("article", ""))
MENUS = (("nav", ""), ("ul", 'class="menu"'), ("div", 'class="navbar"'), ("nav", 'class="main-nav"'), ("div", 'id="navigation"'),
         ("div", 'class="breadcrumbs"'), ("div", 'role="navigation"'), ("ol", 'class="breadcrumb"'), ("div", 'class="x1"'))
HEADERS = (("header", ""), ("div", 'class="header"'), ("div", 'id="masthead"'), ("header", 'class="site-header"'),
           ("div", 'class="topbar"'), ("div", 'role="banner"'))
FOOTERS = (("footer", ""), ("div", 'class="footer"'), ("div", 'id="site-footer"'), ("div", 'class="copyright"'),
           ("div", 'role="contentinfo"'), ("footer", 'class="page-foot"'))
SIDES = (("aside", ""), ("div", 'class="sidebar"'), ("div", 'id="right-rail"'), ("aside", 'class="widget"'),
         ("div", 'class="related-posts"'), ("section", 'class="recommended"'), ("div", 'class="trending"'), ("aside", 'class="side"'))
ADVERTS = (("div", 'class="ad"'), ("div", 'class="advert"'), ("div", 'class="ad-slot"'), ("section", 'class="promo"'),
           ("div", 'class="sponsored"'), ("div", 'id="banner"'), ("p", 'class="ads"'), ("aside", 'class="advertisement"'),
           ("div", 'class="promoted"'))
NOTICES = (("div", 'class="cookie-notice"'), ("div", 'id="consent"'), ("div", 'class="alert"'), ("p", 'class="notice"'),
           ("section", 'class="paywall"'), ("div", 'class="newsletter"'), ("div", 'class="gdpr-banner"'), ("dialog", 'class="popup"'),
           ("div", 'class="disclaimer"'), ("div", 'class="cookie"'), ("div", 'role="alert"'))
COMMENTS = (("section", 'class="comments"'), ("div", 'id="comments"'), ("div", 'class="comment-list"'), ("div", 'class="disqus"'),
            ("ol", 'class="commentlist"'), ("section", 'id="reader-comments"'), ("div", 'class="replies"'), ("div", 'class="discussion"'))
FORMS = (("form", ""), ("form", 'class="search"'), ("div", 'class="signup-form"'), ("form", 'id="login"'), ("div", 'class="contact-form"'))
SHARES = (("div", 'class="share"'), ("ul", 'class="social-links"'), ("div", 'class="tags"'))
# Classes of themes, which tell of the page's setting and stand on any element.
SETTINGS = ("sidebar", "comment", "comments", "nav", "menu", "header", "footer", "ads", "share", "cookie", "widget", "search")
SETTING_FORMS = ("has-{}", "no-{}", "{}-open", "{}-closed", "{}-right", "with-{}", "{}-layout", "single-{}", "{}", "theme-{}-2")
CONTENT_WORDS = ("post", "article", "content", "entry", "story", "main", "page")
PLAIN_TAGS = {"menu": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "side": ("aside", "div", "section"),
              "form": ("form",), "comment": ("div", "section", "ol")}
WRAPPERS = (("div", 'id="page"'), ("div", 'class="container"'), ("div", 'class="wrapper"'), ("div", ""), ("div", 'class="row"'))


class Layouts:
    """Pages of known structure.  ``page`` gives the source and, by the number
    in a ``data-role`` attribute's place, which nodes are article: article
    parts are written inside, all else outside, of ``self.good``."""

    def __init__(self, paragraphs: list[str], seed: int = 7):
        self.rng = random.Random(seed)
        self.naming = "told"
        self.long = [p for p in paragraphs if len(p) >= 80] or ["A longer sentence of words, to stand for a paragraph. " * 3]
        self.words = " ".join(paragraphs[:80]).split() or ["word"]

    def some(self, low: int, high: int) -> str:
        n = self.rng.randint(low, high)
        at = self.rng.randrange(max(1, len(self.words) - n))
        return " ".join(w.strip("<>") for w in self.words[at:at + n])

    def paragraph(self) -> str:
        return self.rng.choice(self.long) if self.rng.random() < 0.75 else self.some(1, 25)

    def opaque(self) -> str:
        """An attribute that tells nothing, or none."""
        rng = self.rng
        kind = rng.random()
        letters = "".join(rng.choice("bcdefgkmqrstvwxz") for _ in range(rng.randint(1, 2)))
        return "" if kind < 0.3 else f'class="{letters}{rng.randint(1, 99)}"' if kind < 0.8 else f'class="css-{rng.randint(10, 9_999)}"'

    def misled(self, rest: str, article: bool) -> str:
        """The attributes with words that belong to other parts of pages."""
        rng = self.rng
        if article:
            more = [rng.choice(SETTING_FORMS).format(rng.choice(SETTINGS)) for _ in range(rng.randint(1, 3))]
        else:
            name = rest.partition('"')[2].rstrip('"') or "box"
            more = [rng.choice((f"{rng.choice(CONTENT_WORDS)}-{name}", f"{name} {rng.choice(CONTENT_WORDS)}-bottom", name))]
        own = rest.partition('"')[2].rstrip('"').split() if article and "class" in rest else []
        return f'class="{" ".join(own + more)}"'

    def named(self, tag: str, rest: str, kind: str) -> str:
        """The start tag's inside, as the naming of this page has it."""
        if self.naming == "plain":
            semantic = tag in ("article", "main", "nav", "header", "footer", "aside", "form", "dialog")
            tag = tag if semantic and self.rng.random() < 0.4 else self.rng.choice(PLAIN_TAGS.get(kind, ("div", "section")))
            rest = self.opaque()
        elif self.naming == "misled" and self.rng.random() < 0.8:
            rest = self.misled(rest, kind in ("article", "wrapper"))
        return f"{tag} {rest}" if rest else tag

    def wrap(self, choice, inner: str, kind: str = "") -> str:
        opened = self.named(*self.rng.choice(choice), kind)
        tag = opened.split(" ")[0]
        if tag == "p":                                    # a paragraph holds no other
            inner = inner.replace("<p>", "").replace("</p>", " ")
        return f"<{opened}>{inner}</{tag}>"

    def comments(self) -> str:
        """Items of one template: who and when, what, perhaps answers."""
        rng = self.rng
        opened = rng.choice(('div class="comment"', "li", 'article class="comment"', "div"))
        if self.naming == "plain":
            opened = f"{rng.choice(('div', 'li', 'div', 'article'))} {self.opaque()}".strip()
        tag = opened.split(" ")[0]
        who = rng.choice(("", "", "<b>{}</b> ", "<span>{}</span><br>", "<p>{}</p>", "<div>{}</div>", "<p><b>{}</b></p>", "<h4>{}</h4>",
                          "<div><a href=/u>{}</a> 3 d</div>"))
        if self.naming == "plain" and not who:
            who = "<p>{}</p>"
        answer = rng.choice(("", "", '<a href="#r">{}</a>', "<button>{}</button>", "<p><a href=x>{}</a></p>"))
        block, share = rng.random() < 0.7, rng.random()

        def item(deep: int) -> str:
            said = self.paragraph() if rng.random() < share else self.some(3, 40)
            inner = who.format(self.some(1, 3)) + (f"<p>{said}</p>" if block else said) + answer.format(self.some(1, 1))
            if deep and rng.random() < 0.2:
                inner += f"<div>{item(deep - 1)}</div>"
            return f"<{opened}>{inner}</{tag}>"

        heading = f"<h3>{self.some(1, 3)}</h3>" if rng.random() < 0.6 else ""
        listed = "".join(item(2) for _ in range(rng.randint(2 if self.naming == "plain" else 1, 9)))
        return heading + (f"<div {self.opaque()}>{listed}</div>" if rng.random() < 0.3 else listed)

    def links(self, low: int = 3, high: int = 9) -> str:
        items = [f'<a href="/{i}">{self.some(1, 3)}</a>' for i in range(self.rng.randint(low, high))]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if self.rng.random() < 0.7 else " ".join(items)

    def outside(self, kind: str) -> str:
        rng, told = self.rng, self.naming != "plain"
        if kind == "menu":
            return self.wrap(MENUS, self.links(), kind)
        if kind == "header":
            return self.wrap(HEADERS, (f"<h1>{self.some(1, 4)}</h1>" if rng.random() < (0.5 if told else 0.2) else self.some(1, 6))
                             + (self.wrap(MENUS, self.links(), "menu") if rng.random() < 0.5 else "")
                             + (f"<p>{self.some(3, 12)}</p>" if rng.random() < 0.4 else ""), kind)
        if kind == "footer":
            return self.wrap(FOOTERS, ("&copy; " if rng.random() < 0.6 else "") + self.some(2, 30)
                             + (f"<p>{self.paragraph()}</p>" if told and rng.random() < 0.3 else "")
                             + (self.links() if rng.random() < 0.4 else ""), kind)
        if kind == "side":
            return self.wrap(SIDES, f"<h3>{self.some(1, 4)}</h3>" + "".join(
                f"<p>{self.paragraph()}</p>" for _ in range(rng.randint(0, 3 if told else 1)))
                + (self.links() if not told or rng.random() < 0.7 else ""), kind)
        if kind == "advert":
            return self.wrap(ADVERTS, self.some(2, 20) if rng.random() < (0.5 if told else 0.9) else f"<p>{self.paragraph()}</p>", kind)
        if kind == "notice":
            return self.wrap(NOTICES, self.some(4, 30) + ("" if told else "<button>OK</button>") if rng.random() < 0.6
                             else f"<p>{self.paragraph()}</p><button>OK</button>", kind)
        if kind == "form":
            return self.wrap(FORMS, f"<label>{self.some(1, 4)}</label><input name=q><button>{self.some(1, 2)}</button>"
                             + (f"<p>{self.some(3, 20)}</p>" if rng.random() < 0.3 else ""), kind)
        if kind == "share":
            return self.wrap(SHARES, self.links(2, 5), kind)
        return self.wrap(COMMENTS, self.comments(), kind)

    def article(self) -> str:
        rng, parts = self.rng, []
        for _ in range(rng.randint(1, 2) if rng.random() < 0.35 else rng.randint(2, 9)):
            kind = rng.random()
            text = " ".join(self.paragraph() for _ in range(1 if rng.random() < 0.92 else rng.randint(3, 30)))
            if kind < 0.72:
                text = f"<b>{text}</b>" if rng.random() < 0.1 else text
                parts.append(f"<p>{text}</p>" if rng.random() < 0.85 else f"<p>{text}<br>")
            elif kind < 0.8:
                parts.append(f"<h2>{self.some(1, 6)}</h2>")
            elif kind < 0.86:
                parts.append("<ul>" + "".join(f"<li>{self.some(2, 20)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.92:
                parts.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.95:
                parts.append(f"<figure><img src=x><figcaption>{self.some(2, 12)}</figcaption></figure>")
            elif kind < 0.98:
                parts.append(f"<div>{text}</div>")
            else:
                parts.append("<table>" + "".join(f"<tr><td>{self.some(1, 3)}</td><td>{self.some(1, 3)}</td></tr>" for _ in range(3)) + "</table>")
        if rng.random() < 0.8:
            parts.insert(0, f"<h1>{self.some(2, 10)}</h1>" if rng.random() < 0.8 else f"<header><h1>{self.some(2, 10)}</h1></header>")
        out = ""                                          # parts foreign to the article are marked
        for part in parts:
            out += part
            if rng.random() < 0.08:
                out += f"\x01{self.outside(rng.choice(('advert', 'notice', 'form', 'share', 'side')))}\x02"
        if rng.random() < 0.15:
            out += f"\x01{self.outside('comment')}\x02"
        opened = self.named(*rng.choice(ARTICLE), "article")
        return f"\x02<{opened}>{out}</{opened.split(' ')[0]}>\x01"

    def page(self) -> str:
        """Source in which \\x02 begins article text and \\x01 ends it.  Names
        tell of the parts, tell nothing (``plain``) or belong to other parts (``misled``)."""
        rng = self.rng
        self.naming = rng.choice(("told", "told", "told", "plain", "misled"))
        kinds = ["menu", "header", "footer", "side", "advert", "notice", "comment", "form", "share"]
        before = [self.outside(k) for k in rng.sample(kinds, rng.randint(0, 5)) if k not in ("footer", "comment")]
        after = [self.outside(k) for k in rng.sample(kinds, rng.randint(0, 5)) if k != "header"]
        if rng.random() < 0.08:                           # nothing but the article
            before, after = [], []
        body = self.article()
        for _ in range(rng.randint(0, 2)):
            opened = self.named(*rng.choice(WRAPPERS), "wrapper")
            inner_before, inner_after = (before, []) if rng.random() < 0.3 else ([], after if rng.random() < 0.3 else [])
            before, after = ([] if inner_before else before), ([] if inner_after else after)
            body = f"<{opened}>{''.join(inner_before)}{body}{''.join(inner_after)}</{opened.split(' ')[0]}>"
        start = f"body {self.misled('', True)}" if self.naming == "misled" and rng.random() < 0.4 else "body"
        return f"<html><head><title>{self.some(1, 5)}</title></head><{start}>\x01{''.join(before)}{body}{''.join(after)}</body></html>"


def labelled(source: str) -> tuple[list[list[float]], list[float]]:
    """Features and labels (share of article text at least a half) of the
    nodes of a marked page that have text."""
    nodes, pieces = parse(source.replace("\x01", "<i m=1>").replace("\x02", "<i m=2>"))
    _, marked = parse(source)
    good: dict[int, int] = {}
    inside, plain = False, iter(pieces)
    for _, text in marked:
        kept, length = 0, 0
        for letter in text:
            if letter in "\x01\x02":
                inside = letter == "\x02"
            else:
                length += 1
                kept += inside
        if text.strip("\x01\x02 "):
            node, _ = next(plain)
            if kept * 2 >= length:
                while node is not None:
                    good[id(node)] = good.get(id(node), 0) + length
                    node = node.parent
    rows = features(nodes)
    keep = [i for i, n in enumerate(nodes) if n.text]
    return [rows[i] for i in keep], [float(2 * good.get(id(nodes[i]), 0) >= nodes[i].text) for i in keep]


def train(paragraphs: list[str], layouts: int = LAYOUTS) -> BoostedTrees:
    maker, x, y = Layouts(paragraphs), [], []
    for _ in range(layouts):
        rows, labels = labelled(maker.page())
        x += rows
        y += labels
    return BoostedTrees(trees=120).fit(np.array(x), np.array(y))


def sample_paragraphs(pages: DataFrame) -> list[str]:
    """Paragraphs to fill layouts with: of ``SAMPLE_PAGES`` pages at most
    ``SAMPLE_PARAGRAPHS`` in all, each cut at ``SAMPLE_CHARS`` characters."""
    each = SAMPLE_PARAGRAPHS // SAMPLE_PAGES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for source in batch.column(0):
                texts = [t for n, t in parse(source.as_py() or "")[1] if n.tag == "p" and "<" not in t]
                out += [t[:SAMPLE_CHARS] for t in sorted(texts, key=len, reverse=True)[:each]]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["text"])

    few = pages.where("html is not null").orderBy(F.xxhash64("page_id", "url"), "page_id").limit(SAMPLE_PAGES)
    return sorted(r["text"] for r in few.select("html").mapInArrow(run, "text string").collect())[:SAMPLE_PARAGRAPHS]


def decode(nodes: list[Node], chance: np.ndarray) -> set[int]:
    """The ids of the nodes whose own text is kept.  Each node has three costs:
    that all below is article, that nothing is, and that its parts are chosen
    each for itself, which costs more the less the node looks like article."""
    p = np.clip(chance, 1e-4, 1 - 1e-4)
    yes, no = -np.log(p), -np.log(1 - p)
    number = {id(n): i for i, n in enumerate(nodes)}
    all_in, all_out, mixed = [0.0] * len(nodes), [0.0] * len(nodes), [0.0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        if not node.text:
            continue
        a, b, m = float(yes[i]), float(no[i]), MIXED_COST + 0.5 * max(0.0, float(yes[i] - no[i]))
        if node.own:
            m += min(float(yes[i]), float(no[i]))
        for child in node.children:
            c = number[id(child)]
            a, b, m = a + all_in[c], b + all_out[c], m + min(all_in[c], all_out[c], mixed[c])
        all_in[i], all_out[i], mixed[i] = a, b, m if node.children else a + b + 1.0
    kept: set[int] = set()
    todo = [(0, "")]
    while todo:
        i, state = todo.pop()
        if not state:
            least = min(all_in[i], all_out[i], mixed[i])
            state = "in" if all_in[i] == least else "out" if all_out[i] == least else ""
        if state == "out":
            continue
        if state == "in" or yes[i] <= no[i]:
            kept.add(id(nodes[i]))
        todo += [(number[id(c)], state) for c in nodes[i].children if c.text]
    return kept


def chosen(nodes: list[Node], chance: np.ndarray) -> set[int]:
    """:func:`decode`, and for the pages that it finds no article on the part
    likeliest to be one, if its odds (log, summed over its nodes) reach
    ``LEAST_ODDS``: few pages have no article."""
    kept = decode(nodes, chance)
    if any(n.own and id(n) in kept for n in nodes):
        return kept
    p = np.clip(chance, 1e-4, 1 - 1e-4)
    odds = (np.log(p) - np.log(1 - p)).tolist()
    number = {id(n): i for i, n in enumerate(nodes)}
    for i in range(len(nodes) - 1, 0, -1):
        if nodes[i].text:
            odds[number[id(nodes[i].parent)]] += odds[i]
    best = max((i for i, n in enumerate(nodes) if n.text), key=lambda i: odds[i], default=0)
    if odds[best] < LEAST_ODDS:
        return kept
    inside = {id(nodes[best])}
    for node in nodes[best + 1:]:                         # children stand behind their parents
        if id(node.parent) in inside:
            inside.add(id(node))
    return inside


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every page."""
    sent = pages.sparkSession.sparkContext.broadcast(train(sample_paragraphs(pages)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                parsed = [parse(s.as_py() or "") for s in part.column(2)]
                rows = [features(nodes) for nodes, _ in parsed]
                chance = model.predict(np.array([r for page in rows for r in page]))
                texts, first = [], 0
                for nodes, pieces in parsed:
                    kept = chosen(nodes, chance[first:first + len(nodes)])
                    first += len(nodes)
                    texts.append(" ".join(text for node, text in pieces if id(node) in kept))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, SCHEMA)
