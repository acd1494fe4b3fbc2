"""Main text of HTML pages by a tree-structured graphical model over DOM nodes.

Every block element of a page is a node that is content or not. A node's own potential is log-linear in
its tag, class words, text and links; an edge's potential ties a node to its parent, by the parent's
kind. Sum-product messages up and down the tree give each node's exact content marginal. Weights are
fitted by likelihood to labelled pages, which :func:`labelled_pages` writes from page layouts. The text of
nodes with a marginal over one half is the main text.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>""", re.S)
#: For pages with an odd quote in a tag: where the strict pattern does not match, a tag ends at the next >.
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
#: A tag that the page's end cuts off.
CUT = re.compile(r"<[/!a-zA-Z][^>]*\Z")
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: Content that is not markup; the first group is never shown.
HIDDEN = frozenset(("script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "head"))
RAW = frozenset(("script", "style", "template", "textarea", "title", "iframe", "noscript", "svg"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: What an opening tag ends implicitly, and where looking for it stops.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
SCOPES = frozenset("article aside body div dl footer form header html main nav ol section table ul".split())
#: Words of class, id and role by what they hint at.
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc skip",
    "top": "header masthead banner topbar hero branding logo",
    "bottom": "footer foot copyright legal imprint colophon contentinfo",
    "side": "sidebar aside side related recommended complementary widget rail trending popular",
    "advert": "ad ads advert adverts advertisement adslot adbox sponsor sponsored promo promotion commercial banner-ad",
    "notice": "cookie cookies consent notice alert popup modal overlay newsletter subscribe signup gdpr message disclaimer warning",
    "form": "form login search share social sharing contact feedback button buttons dialog rating",
    "comment": "comment comments reply replies respond discussion disqus thread reactions",
    "main": "content article post entry main story body text page prose articlebody",
}
#: What short blocks apart from the article say, by kind.
CUES = {
    "legal": re.compile(r"©|\(c\)\s*(?:19|20)\d\d|\b(?:copyright|all rights reserved|privacy policy|terms of (?:use|service)|imprint|impressum|mentions légales|aviso legal)\b", re.I),
    "notice": re.compile(r"\b(?:cookies?|newsletter|subscribe|sign up|log in|sign in|accept|advertisement|sponsored|abonnieren|werbung|publicité|publicidad)\b", re.I),
    "more": re.compile(r"^\W*(?:share|tweet|related|read more|read next|see also|more from|popular|comments?|\d+ comments?|leave a reply|skip to|back to top|home|menu)\b", re.I),
}
#: Words up to which a block is looked at for cues.
CUE_WORDS = 40
HINT_OF = {word: kind for kind, words in HINTS.items() for word in words.split()}
CONTAINERS = ("body", "article", "main", "section", "div", "nav", "aside", "footer", "header", "form", "ul", "ol", "table", "td", "li", "blockquote")


@lru_cache(len(RAW))
def raw_end(tag: str) -> re.Pattern:
    return re.compile(f"</{tag}", re.I | re.A)


class Page:
    """Block elements of a page in document order, and its pieces of text with the element they belong to."""

    def __init__(self, source: str):
        self.tags, self.parents, self.hints = ["html"], [-1], [()]
        self.hidden = [False]
        self.pieces: list[tuple[int, str, bool]] = []  # element, text, whether a link
        stack, links, at = [0], 0, 0
        text = self._text
        while True:
            m = TOKEN.search(source, at)
            if m is None or source.find("<", at, m.start()) >= 0:
                m = LOOSE.search(source, at, len(source) if m is None else m.start()) or m
            if m is None:
                break
            if m.start() > at:
                text(stack[-1], source[at : m.start()], links > 0)
            at = m.end()
            if m.lastindex is None or m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag in INLINE:
                    links -= tag == "a" and links > 0
                elif tag in VOID:
                    text(stack[-1], None, False)
                else:
                    self._close(stack, tag)
                    text(stack[-1], None, False)
                    links = 0
                continue
            if tag in RAW and not m[3].endswith("/"):
                end = raw_end(tag).search(source, at)
                close = source.find(">", end.start()) if end else -1
                at = close + 1 if close >= 0 else len(source)
                continue
            if tag in INLINE:
                links += tag == "a"
                continue
            text(stack[-1], None, False)
            if tag in VOID or tag == "html":
                continue
            self._implied(stack, tag)
            self.tags.append(tag)
            self.parents.append(stack[-1])
            self.hints.append(hints(m[3]) if m[3] else ())
            self.hidden.append(self.hidden[stack[-1]] or tag in HIDDEN)
            if not m[3].endswith("/"):
                stack.append(len(self.tags) - 1)
            links = 0
        if at < len(source):
            text(stack[-1], CUT.sub("", source[at:]), links > 0)

    def _text(self, element: int, raw: str | None, link: bool) -> None:
        """A piece of text, or with None a block's bound."""
        self.pieces.append((element, "" if raw is None else html.unescape(raw) if "&" in raw else raw, link) if raw is not None else (-1, "", False))

    def _close(self, stack: list[int], tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tags[stack[k]] == tag:
                del stack[k:]
                return

    def _implied(self, stack: list[int], tag: str) -> None:
        """Ends what the opening ``tag`` ends: a paragraph before any block, items before the next one."""
        if len(stack) > 1 and self.tags[stack[-1]] == "p":
            stack.pop()
        ends = ENDS.get(tag)
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                name = self.tags[stack[k]]
                if name in ends:
                    del stack[k:]
                    return
                if name in SCOPES:
                    return


def hints(attributes: str) -> tuple[str, ...]:
    found = {HINT_OF.get(w) for _, value in ATTRIBUTE.findall(attributes) for word in [value.lower(), *re.split(r"[\s\"']+", value.lower())] for w in (word, *re.split(r"[^a-z]+", re.sub(r"[0-9]+", "", word)))}
    return tuple(sorted(found - {None}))


def features(page: Page) -> list[list[str]]:
    """Names of the features of each element."""
    n = len(page.tags)
    own, linked, said = [0] * n, [0] * n, [""] * n
    for element, text, link in page.pieces:
        if element >= 0:
            size = len(text.split())
            own[element] += size
            linked[element] += size * link
            if size and own[element] <= CUE_WORDS:
                said[element] += text
    whole, links = own[:], linked[:]
    for i in range(n - 1, 0, -1):
        whole[page.parents[i]] += whole[i]
        links[page.parents[i]] += links[i]
    found = []
    for i, tag in enumerate(page.tags):
        share = links[i] / whole[i] if whole[i] else 0
        cues = [f"cue {k} {own[i].bit_length()}" for k, p in CUES.items() if p.search(said[i])] if 0 < own[i] <= CUE_WORDS else ()
        found.append(["bias", *cues, f"tag {tag}", *(f"hint {h}" for h in page.hints[i]), f"own {min(own[i], 40).bit_length()}", f"links {0 if not links[i] else 1 if share < 0.5 else 2}"])
    return found


def kind(page: Page, i: int) -> str:
    """Of a parent, for the potential of its edges."""
    tag = page.tags[i]
    if any(h != "main" for h in page.hints[i]):
        return "apart"
    return tag if tag in CONTAINERS else "other"


class Model:
    """Weights of features (for content) and of edges (by the parent's kind and the four pairs of labels)."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = defaultdict(float)
        self.edges: dict[tuple[str, int, int], float] = defaultdict(float)

    def marginals(self, page: Page, names: list[list[str]] | None = None) -> tuple[list[float], list[tuple[float, ...]]]:
        """Content marginals of the elements, and of each edge (by child) the joint with the parent, as (00, 01, 10, 11)."""
        names = features(page) if names is None else names
        n, parents, get = len(page.tags), page.parents, self.weights.get
        own = [sum(get(f, 0.0) for f in names[i]) for i in range(n)]
        tie = [()] * n
        for i in range(1, n):
            k = kind(page, parents[i])
            tie[i] = tuple(self.edges.get((k, a, b), 0.0) for a in (0, 1) for b in (0, 1))
        # log odds of a node from itself and below, then of the message to its parent
        below, up = own[:], [0.0] * n
        for i in range(n - 1, 0, -1):
            t00, t01, t10, t11 = tie[i]
            up[i] = soft(t10, t11 + below[i]) - soft(t00, t01 + below[i])
            below[parents[i]] += up[i]
        total, joint = below[:], [()] * n
        for i in range(1, n):
            t00, t01, t10, t11 = tie[i]
            above = total[parents[i]] - up[i]
            total[i] = below[i] + soft(t01, t11 + above) - soft(t00, t10 + above)
            scores = (t00, t01 + below[i], t10 + above, t11 + above + below[i])
            top = max(scores)
            parts = [exp(s - top) for s in scores]
            z = sum(parts)
            joint[i] = tuple(x / z for x in parts)
        return [1 / (1 + exp(-max(-500.0, min(500.0, t)))) for t in total], joint


def soft(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return max(a, b) + log1p(exp(-abs(a - b)))


def train(pages: list[tuple[str, list[int]]], rounds: int = 6, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """Model fitted to pages given as source and the label of each element, by likelihood (AdaGrad)."""
    model, seen = Model(), defaultdict(lambda: 1e-6)
    made = [(page := Page(source), features(page), labels) for source, labels in pages]
    order = np.random.default_rng(1)
    for _ in range(rounds):
        for k in order.permutation(len(made)):
            page, names, labels = made[k]
            found, joint = model.marginals(page, names)
            slope: dict = defaultdict(float)
            for i, label in enumerate(labels):
                for f in names[i]:
                    slope[f] += label - found[i]
                if i:
                    parent = kind(page, page.parents[i])
                    for pair, p in enumerate(joint[i]):
                        slope[parent, pair >> 1, pair & 1] += (pair == 2 * labels[page.parents[i]] + label) - p
            for f, g in slope.items():
                table = model.weights if isinstance(f, str) else model.edges
                g -= decay * table[f]
                seen[f] += g * g
                table[f] += rate * g / seen[f] ** 0.5
    return model


def labelled_pages(n: int = 320, seed: int = 3) -> list[tuple[str, list[int]]]:
    """Pages written from common layouts, with the label of each element: the article's are 1, all else 0."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    maybe = lambda p: rng.random() < p

    def words(low: int, high: int) -> str:
        return " ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(2, 9)))) for _ in range(int(rng.integers(low, high + 1)))) + pick(".", "", "!")

    def element(tag: str, label: int, *inner, attributes: str = "") -> tuple:
        return tag, attributes, label, inner

    def named(*names: str) -> str:
        return f' {pick("class", "class", "id")}="{pick("", "site-", "page-", "main-", "c-")}{pick(*names)}{pick("", "-wrap", " box", "-1")}"'

    def link() -> str:
        return f'<a href="/{words(1, 1)}">{words(1, 3)}</a>'

    def menu(label: int = 0, attributes: str = "") -> tuple:
        items = [element("li", label, link()) for _ in range(int(rng.integers(2, 7)))]
        return element("nav", label, element("ul", label, *items), attributes=attributes) if maybe(0.6) else element("div", label, element("ul", label, *items), attributes=named("nav", "menu", "breadcrumb", "pagination"))

    def paragraph(label: int = 1) -> tuple:
        if maybe(0.1):
            return element("blockquote", label, element("p", label, words(3, 40)))
        if maybe(0.1):
            return element(pick("ul", "ol"), label, *(element("li", label, words(1, 15), *([link()] if maybe(0.3) else [])) for _ in range(int(rng.integers(1, 5)))))
        if maybe(0.05):
            return element("table", label, element("tr", label, element("td", label, words(1, 4)), element("td", label, words(1, 4))))
        if maybe(0.05):
            return element("pre", label, words(3, 20))
        if maybe(0.1):
            return element("div", label, element("p", label, words(3, 40)))
        inner = [words(1, pick(3, 20, 90))]
        inner += [link(), words(1, 20)] if maybe(0.2) else []
        inner += ["<br>", words(1, 20)] if maybe(0.1) else []
        return element("p", label, *inner)

    def plain() -> tuple:
        """A short block apart that only its words tell from the article."""
        year, end = str(int(rng.integers(1990, 2031))), pick("", ".", " " + words(1, 6))
        said = pick(
            f"Copyright {year} {words(1, 3)}{end}", f"&copy; {year} {words(1, 4)}{end}", f"© {words(1, 3)} All rights reserved.", f"{words(1, 3)} Privacy Policy {words(0, 2)}", f"We use cookies {words(2, 12)}",
            f"Subscribe to our newsletter{end}", f"Sign up {words(1, 6)}", f"Share this {words(0, 3)}", f"Related {words(1, 8)}", f"Read more{end}", f"Advertisement{end}", f"{int(rng.integers(2, 50))} comments", f"Home {words(1, 4)}", f"Back to top{end}",
        )
        return element("div", 0, element("p", 0, said)) if maybe(0.3) else element(pick("div", "p", "p", "span-box"), 0, said)

    def apart() -> tuple:
        """Something that is not the article."""
        which = int(rng.integers(9))
        if which == 8:
            return plain()
        if which == 0:
            return element("div", 0, *([words(2, 20)] if maybe(0.6) else [element("p", 0, words(2, 20))]), attributes=named("ad", "ads", "advert", "sponsored", "promo", "advertisement"))
        if which == 1:
            return element(pick("aside", "aside", "div"), 0, element("h3", 0, words(1, 3)), element("ul", 0, *(element("li", 0, link()) for _ in range(3))), *([element("p", 0, words(2, 30))] if maybe(0.5) else []), attributes=named("sidebar", "related", "widget", "popular"))
        if which == 2:
            return element("div", 0, element("p", 0, words(4, 25)), *([element("button", 0, words(1, 2))] if maybe(0.5) else []), attributes=named("cookie", "notice", "newsletter", "consent", "alert", "popup"))
        if which == 3:
            return element("form", 0, *([element("p", 0, words(1, 8))] if maybe(0.5) else []), f'<label>{words(1, 2)}</label><input name="q">', element("button", 0, words(1, 1)), attributes=pick("", ' action="/s"', named("search", "login")))
        if which == 4:
            return element(pick("section", "div"), 0, element("h2", 0, words(1, 3)), *(element(pick("div", "article", "li"), 0, *([element("p", 0, words(1, 4))] if maybe(0.5) else []), element("p", 0, words(3, 50)), attributes=named("comment", "reply")) for _ in range(int(rng.integers(1, 4)))), attributes=named("comments", "discussion", "respond"))
        if which == 5:
            return menu()
        if which == 6:
            return element("div", 0, link(), link(), attributes=named("share", "social"))
        return element("aside", 0, element("p", 0, words(3, 30)))

    def page() -> list:
        title = element(pick("h1", "h1", "h2"), 1, words(2, 9))
        if maybe(0.2):
            title = element("header", 1, title)
        body = [title]
        for _ in range(int(rng.integers(1, 9))):
            body.append(paragraph())
            if maybe(0.12):
                body.append(element(pick("h2", "h3"), 1, words(1, 6)))
            if maybe(0.1):
                body.append(apart())
        if maybe(0.15):
            body.append(element("footer", 0, element("p", 0, words(1, 10))))
        shape = int(rng.integers(6))
        if shape < 3:
            story = element("article", 1, *body, attributes=pick("", "", named("post", "entry", "article")))
            if maybe(0.3):
                story = element(pick("main", "div"), 1, story, attributes=named("content", "main"))
        elif shape == 3:
            story = element("main", 1, *body, attributes=pick("", named("content")))
        elif shape == 4:
            story = element("div", 1, *body, attributes=named("content", "article", "post", "entry", "story"))
        parts = body if shape == 5 else [story]
        if maybe(0.25):  # a page of plain blocks
            parts = [element("div", 1, *body)] if maybe(0.5) else body
            parts = [plain() for _ in range(int(rng.integers(0, 3)))] + parts + [plain() for _ in range(int(rng.integers(0, 3)))]
            return [element("div", 0, *parts)] if maybe(0.3) else parts
        top = [menu()] if maybe(0.8) else []
        if maybe(0.4):
            top.insert(0, element("header", 0, *([element("h1", 0, link())] if maybe(0.4) else [element("p", 0, words(1, 6))]), *([menu()] if maybe(0.5) else [])))
        parts = [*top, *(apart() for _ in range(int(rng.integers(0, 3)))), *parts, *(apart() for _ in range(int(rng.integers(0, 3))))]
        if maybe(0.85):
            parts.append(element("footer", 0, *(["&copy; " + words(2, 20)] if maybe(0.5) else [element("p", 0, words(2, 20), link())])) if maybe(0.8) else element("div", 0, words(2, 20), attributes=named("footer", "copyright")))
        if maybe(0.2):
            parts = [element("div", 0, *parts, attributes=named("wrapper", "container", "layout"))]
        return parts

    def render(node, labels: list[int]) -> str:
        if isinstance(node, str):
            return node
        tag, attributes, label, inner = node
        labels.append(label)
        return f"<{tag}{attributes}>" + "".join(render(x, labels) for x in inner) + f"</{tag}>"

    pages = []
    for _ in range(n):
        labels = [0, 0, 0]  # html, head, body
        source = "".join(render(x, labels) for x in page())
        pages.append((f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title></head><body>{source}</body></html>", labels))
    return pages


@lru_cache(1)
def default_model() -> Model:
    return train(labelled_pages())


def extract(source: str | None, model: Model) -> str:
    """Main text of a page."""
    if not source:
        return ""
    page = Page(source)
    content, _ = model.marginals(page)
    parts, open_block = [], False
    for element, text, _ in page.pieces:
        if element < 0 or page.hidden[element] or content[element] <= 0.5:
            open_block = False
            continue
        parts.append(text if open_block else " " + text)
        open_block = True
    return " ".join("".join(parts).split())


def main_text(pages: DataFrame, model: Model | None = None, keep: tuple[str, ...] = ("page_id", "url"), column: str = "html") -> DataFrame:
    """``keep``, ``text`` (empty if none) and ``n_chars`` (its code points) of every page.

    Character references are decoded, white space within a block becomes one space, blocks are joined
    by one space in page order. A null or empty page has an empty text; broken markup is read as far
    as it goes. Pages are read whole; repeated rows get equal texts; an empty table gives an empty one;
    no other column is read.
    """
    sent = pages.sparkSession.sparkContext.broadcast(default_model() if model is None else model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value

        def rows(sources: list) -> dict[str, pa.Array]:
            texts = [extract(s, m) for s in sources]
            return {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

        return common.per_document(batches, column, rows, keep)

    kinds = dict(pages.dtypes)
    return pages.select(*dict.fromkeys((*keep, column))).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", text string, n_chars bigint")
