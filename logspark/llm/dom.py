"""Block trees of HTML pages, forgiving about markup errors, with node features."""

from __future__ import annotations

import html
import re
from math import log1p

RAW = "script|style|noscript|title|textarea|iframe"       # text up to their end tag, or to the page's end without one
DROPPED = frozenset(("svg", "select", "template"))         # never text where closed, else ordinary tags
REST = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
DROPPED_START = re.compile(r"<(?:svg|select|template)[\s/>]", re.I)
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:title|style)(?=[\s/>]){REST}(?<=/)>"
    rf"|<(?P<raw>{RAW})(?=[\s/>]){REST}>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    rf"|</(?P<end>[a-z][^\s/>]*)[^>]*>|<(?P<tag>[a-z][^\s/>]*)(?P<rest>{REST})>"
    r"|<(?P<odd>[a-z][^\s/>]*)[^>]*>|<[!?/][^>]*>", re.S | re.I)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label|data-role|hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html label legend li main menu nav ol option p pre
section summary table tbody td tfoot th thead tr ul""".split())
BREAKS = frozenset(("br", "hr"))
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
             "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset(("ul", "ol", "menu", "dl", "table", "body", "html"))
KINDS = ("article", "main", "section", "div", "p", "heading", "list", "item", "table", "quote", "figure", "nav", "header",
         "footer", "aside", "form", "button", "body", "other")
KIND = {"article": 0, "main": 1, "section": 2, "div": 3, "center": 3, "p": 4, "pre": 4, "h1": 5, "h2": 5, "h3": 5, "h4": 5,
        "h5": 5, "h6": 5, "hgroup": 5, "ul": 6, "ol": 6, "dl": 6, "menu": 6, "li": 7, "dt": 7, "dd": 7, "table": 8,
        "tbody": 8, "thead": 8, "tfoot": 8, "tr": 8, "td": 8, "th": 8, "caption": 8, "blockquote": 9, "figure": 10,
        "figcaption": 10, "nav": 11, "header": 12, "footer": 13, "aside": 14, "form": 15, "fieldset": 15, "legend": 15,
        "label": 15, "option": 15, "button": 16, "dialog": 16, "body": 17, "html": 17}
# Beginnings of attribute tokens, by what they tell of a node.
TOPICS = (
    ("content", ("article", "content", "entry", "story", "main", "body", "post", "text", "prose")),
    ("menu", ("nav", "menu", "breadcrumb", "crumb", "toolbar", "pagination", "pager", "tabs", "skip")),
    ("head", ("header", "masthead", "topbar", "head", "logo", "branding")),
    ("foot", ("footer", "foot", "copyright", "legal", "colophon", "contentinfo", "imprint")),
    ("side", ("sidebar", "side", "aside", "widget", "rail", "related", "recommend", "trending", "popular",
              "complementary", "more", "teaser")),
    ("advert", ("ad", "ads", "advert", "adslot", "sponsor", "promo", "banner", "commercial", "dfp", "outbrain", "taboola")),
    ("notice", ("cookie", "consent", "notice", "gdpr", "alert", "popup", "modal", "paywall", "subscribe", "newsletter",
                "disclaimer", "overlay", "privacy", "warning", "message", "hidden")),
    ("comment", ("comment", "reply", "replies", "respond", "discussion", "disqus", "feedback", "review", "thread")),
    ("form", ("form", "search", "login", "signup", "register", "input", "contact")),
    ("social", ("share", "sharing", "social", "follow", "like", "tweet", "facebook", "tags", "rating")),
)
# A class that says in what state or setting its element is ("has-sidebar", "nav-down") does not tell what the element is.
STATES_BEFORE = frozenset(("has", "no", "not", "with", "without", "is", "show", "hide", "hides", "enable", "disable"))
STATES_AFTER = frozenset(("open", "closed", "up", "down", "on", "off", "enabled", "disabled", "visible", "layout", "active", "fixed",
                          "left", "right", "status"))
WHOLE = frozenset(("ad", "ads", "side", "more", "like", "head", "foot", "body", "text", "rail", "form", "main", "post", "legal"))
FEATURES = [*(f"tag_{k}" for k in KINDS), *(f"own_{t}" for t, _ in TOPICS), *(f"above_{t}" for t, _ in TOPICS),
            "above_article", "in_boilerplate", "depth", "text", "own_text", "blocks", "density", "link_share",
            "stop_share", "paragraphs", "items", "controls", "siblings", "place", "alike_siblings", "share_of_parent",
            "share_of_page", "page_text", "sibling_text", "own_names", "own_state", "first_text", "before",
            "after", "heading_before", "heading_inside", "same_shape", "above_same_shape", "share_of_largest", "mean_paragraph"]
STATE = 1 << len(TOPICS)
_TOPIC_CACHE: dict[str, int] = {}


def topics(name: str) -> int:
    """Bits of the topics that an attribute value tells of, and ``STATE``."""
    known = _TOPIC_CACHE.get(name)
    if known is None:
        known = 0
        for token in name.split():
            parts = [part.lower() for part in NAME_PART.findall(token)]
            if len(parts) > 1 and (parts[0] in STATES_BEFORE or parts[-1] in STATES_AFTER):
                known |= STATE
                continue
            for part in parts:
                for nr, (_, stems) in enumerate(TOPICS):
                    if any(part == s or (s not in WHOLE and part.startswith(s)) for s in stems):
                        known |= 1 << nr
        if len(_TOPIC_CACHE) > 50_000:
            _TOPIC_CACHE.clear()
        _TOPIC_CACHE[name] = known
    return known


class Node:
    __slots__ = ("tag", "topics", "parent", "children", "depth", "own", "text", "links", "stops", "blocks",
                 "paragraphs", "items", "controls", "name", "first", "before", "titled", "titles", "prose")

    def __init__(self, tag: str, own_topics: int, parent: Node | None, name: str = ""):
        self.tag, self.topics, self.parent, self.name = tag, own_topics, parent, name
        self.children: list[Node] = []
        self.depth = parent.depth + 1 if parent else 0
        self.own = self.text = self.links = self.stops = self.blocks = self.paragraphs = self.items = self.controls = 0
        self.first = self.before = self.titled = self.titles = self.prose = 0
        if parent:
            parent.children.append(self)


def dropped_parts(source: str) -> dict[int, int]:
    """Where each closed svg, select and template begins, and where it ends.

    An end tag belongs to the last open tag of its name.  A block tag ends an
    svg (but not within its foreignObject): it was never closed."""
    ends: dict[int, int] = {}
    opened: list[tuple[str, int]] = []
    count = dict.fromkeys((*DROPPED, "foreignobject"), 0)
    for token in TOKEN.finditer(source):
        name = (token["tag"] or token["odd"] or token["end"] or "").lower()
        if name in count:
            if not token["end"]:
                if name in ("select", "template") or not (token["rest"] or "").endswith("/"):
                    opened.append((name, token.start()))
                    count[name] += 1
            elif count[name]:
                last = None
                while last != name:
                    last, start = opened.pop()
                    count[last] -= 1
                ends[start] = token.end()
        elif name in BLOCKS and name != "option":
            while opened and opened[-1][0] == "svg":
                opened.pop()
                count["svg"] -= 1
    return ends


def parse(source: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """All block nodes (parents first) and the texts of the page in order, each
    with the node that holds it directly; text that no block begins or ends
    within is one piece."""
    root = Node("html", 0, None)
    nodes, pieces, current, at, in_link = [root], [], root, 0, False
    buffer: list[str] = []
    so_far = titles = 0
    ends = dropped_parts(source) if DROPPED_START.search(source) else {}

    def flush():
        nonlocal so_far
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split()) if any("&" in b for b in buffer) else " ".join("".join(buffer).split())
            if text:
                pieces.append((current, text))
                current.own += len(text)
                current.stops += sum(text.count(c) for c in ".!?,;")
                so_far += len(text)
                node = current
                while node is not None and not node.first:
                    node.first = len(text)
                    node = node.parent
            buffer.clear()

    for token in TOKEN.finditer(source):
        start = token.start()
        if start < at:                                    # inside a dropped part
            continue
        if start > at:
            text = source[at:start]
            buffer.append(text)
            if in_link:
                current.links += len(text)
        at = token.end()
        tag = token.lastgroup
        if tag is None:
            continue
        if tag == "end":
            name = token["end"].lower()
            if name in BLOCKS:
                in_link = False
                node = current
                while node is not None and node.tag != name:
                    node = node.parent
                if node is not None and node.parent is not None:
                    flush()
                    current = node.parent
            elif name == "a":
                in_link = False
            elif name in BREAKS:
                buffer.append(" ")
            continue
        if tag == "raw":
            if token["raw"].lower() == "textarea":
                current.controls += 1
            continue
        name = (token["tag"] or token["odd"]).lower()
        if name in BLOCKS:
            if name in ("html", "body") and current.parent is None and name == "html":
                continue
            flush()
            in_link = False
            while current.tag == "p" or current.tag in ("h1", "h2", "h3", "h4", "h5", "h6") and name[0] == "h" and name[1:].isdigit():
                current = current.parent
            if name in CLOSED_BY:
                node = current
                while node is not None and node.tag not in SCOPES:
                    if node.tag in CLOSED_BY[name]:
                        current = node.parent
                        if name != "tr" or node.tag == "tr":
                            break
                    node = node.parent
            rest, told, label = token["rest"] or "", 0, ""
            if "=" in rest:
                for found in ATTRIBUTE.finditer(rest):
                    value = found[2] or found[3] or found[4] or ""
                    told |= topics(value)
                    label += value
            current = Node(name, told, current, f"{name} {label}")
            current.before, current.titled = so_far, titles
            if name == "h1":
                titles += 1
                current.titles = 1
            nodes.append(current)
        elif name == "a":
            in_link = True
        elif name in BREAKS:
            buffer.append(" ")
        elif name in ("input", "select"):
            current.controls += 1
        if name in DROPPED:
            at = ends.get(start, at)
    if at < len(source):
        buffer.append(source[at:])
    flush()
    return nodes, pieces


def shape(node: Node) -> tuple:
    """What siblings written by one template have in common."""
    return (node.tag, *(c.tag for c in node.children[:3]))


def features(nodes: list[Node]) -> list[list[float]]:
    """One row for each node (``FEATURES``)."""
    for node in reversed(nodes):                          # children stand behind their parents
        node.text += node.own
        node.blocks += 1
        parent = node.parent
        if parent is not None:
            parent.text += node.text
            parent.links += node.links
            parent.stops += node.stops
            parent.blocks += node.blocks
            parent.controls += node.controls
            parent.paragraphs += node.paragraphs + (node.tag == "p" and node.text > 60)
            parent.prose += node.prose + (node.text if node.tag == "p" and node.text > 60 else 0)
            parent.titles += node.titles
            parent.items += node.items + (node.tag == "li")
    page = nodes[0].text + 1.0
    above: dict[int, tuple[int, bool, bool, int]] = {}
    groups: dict[int, tuple[int, dict[str, int], dict[int, int], dict[tuple, int], int]] = {}
    rows, width, topic_count = [], len(KINDS), len(TOPICS)
    bits = range(topic_count)
    for node in nodes:
        parent = node.parent
        kind = KIND.get(node.tag, 18)
        if parent is None:
            seen, in_article, in_other, repeated = 0, False, False, 0
            siblings, place, alike, share, near, same, largest = 1, 0.0, 0.0, 1.0, 0.0, 1, node.text
        else:
            own_key = id(parent)
            seen, in_article, in_other, repeated = above[own_key]
            if own_key not in groups:
                alike_counts: dict[str, int] = {}
                shapes: dict[tuple, int] = {}
                for child in parent.children:
                    alike_counts[child.name] = alike_counts.get(child.name, 0) + 1
                    shapes[shape(child)] = shapes.get(shape(child), 0) + 1
                groups[own_key] = (len(parent.children), alike_counts, {id(c): i for i, c in enumerate(parent.children)},
                                   shapes, max(c.text for c in parent.children))
            siblings, alike_counts, order, shapes, largest = groups[own_key]
            same = shapes[shape(node)]
            place = order[id(node)] / siblings
            alike = alike_counts[node.name] / siblings
            share = node.text / (parent.text + 1.0)
            near = (parent.text - node.text) / siblings
        above[id(node)] = (seen | node.topics, in_article or kind in (0, 1), in_other or kind in (11, 12, 13, 14, 15),
                           max(repeated, same if node.children and kind != 8 else 0))
        row = [0.0] * width
        row[kind] = 1.0
        told = node.topics
        row += [float(told >> b & 1) for b in bits]
        row += [float(seen >> b & 1) for b in bits]
        text = node.text
        row += [float(in_article), float(in_other or kind in (11, 13, 14, 15)), float(node.depth), log1p(text), log1p(node.own), log1p(node.blocks),
                text / node.blocks, node.links / (text + 1.0), 100.0 * node.stops / (text + 20.0), float(node.paragraphs),
                float(node.items), float(node.controls), float(siblings), place, alike, share, text / page, log1p(page),
                log1p(near), float((told & (STATE - 1)).bit_count()), float(told >= STATE), log1p(node.first), node.before / page,
                1.0 - (node.before + text) / page, float(node.titled > 0), float(node.titles > 0), float(same), float(repeated),
                text / (largest + 1.0), log1p(node.prose / (node.paragraphs or 1))]
        rows.append(row)
    return rows
