"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is parsed once into leaf blocks, the pieces of text between the bounds of block elements,
each with its ancestors. Features of ancestors (tags, words of class, id and role) and of the text
(length, links, punctuation, place) give a block's scores for content and boilerplate; transition
weights make neighbours agree; Viterbi decodes the page. The weights are fitted by gradient ascent
on the exact conditional likelihood of labelled pages, see `training_pages`.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML elements by how they lay out text.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li "
    "main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th "
    "thead tr ul".split()
)
SILENT = frozenset(
    "script style head title template noscript noframes iframe object svg math canvas audio video "
    "textarea datalist select".split()
)
# elements that leave an open head open; any other start tag ends it
HEAD = frozenset(
    "base basefont bgsound link meta title noscript noframes style script template head".split()
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
# Elements inside lines of text that tell blocks apart.
NAMED = BLOCKS | frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark meter output picture progress "
    "q rp rt ruby s samp slot small span strike strong sub sup time tt u var".split()
)
# Words of class, id and role by what they mark.
MARKS = {
    "content": "article content post entry story body main text prose copy abstract chapter",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs tabs toc pagination pager "
    "paging skip links toolbar",
    "header": "header masthead topbar top branding logo banner hero tagline",
    "footer": "footer foot bottom copyright colophon legal imprint credits",
    "side": "sidebar side aside rail related recommended widget widgets popular trending more "
    "teaser teasers complementary secondary",
    "notice": "notice alert cookie cookies consent gdpr warning popup modal overlay toast "
    "disclaimer paywall announcement message",
    "advert": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion "
    "banner-ad adbox adslot affiliate",
    "form": "form login signin signup search subscribe newsletter register contact poll survey",
    "comment": "comment comments respond reply replies discussion disqus reader readers thread "
    "reactions feedback",
    "share": "share sharing social follow like tweet tools print tags tag",
}
_MARK_OF = {word: kind for kind, words in MARKS.items() for word in words.split()}
_TAG_MARK = {
    "nav": "menu", "menu": "menu", "footer": "footer", "aside": "side", "form": "form",
    "button": "form", "label": "form", "fieldset": "form", "legend": "form", "option": "form",
    "dialog": "notice", "article": "content", "main": "content", "header": "header",
}
_CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_OPEN_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
_END = tuple(".!?:;…\"')»”。！？")


class Element(NamedTuple):
    tag: str
    mark: str
    hidden: bool


class Path(NamedTuple):
    """What the features read of an element and all its ancestors; of bounded size at any depth."""

    #: the element itself; None above the root
    element: Element | None = None
    tags: frozenset[str] = frozenset()
    marks: frozenset[str] = frozenset()
    inner: str = "none"
    outer: str = "none"
    leaf: str = "none"
    #: block elements
    depth: int = 0
    hidden: bool = False

    def child(self, element: Element) -> Path:
        tag, mark, hidden = element
        block = tag in BLOCKS and tag not in ("html", "body")
        # tags that no standard names have no weights, and would have no bound
        named = tag in NAMED and tag not in self.tags
        return Path(
            element,
            self.tags | {tag} if named else self.tags,
            self.marks | {mark} if mark and mark not in self.marks else self.marks,
            mark or self.inner,
            mark if mark and self.outer == "none" else self.outer,
            tag if block else self.leaf,
            self.depth + block,
            self.hidden or hidden,
        )


class Block(NamedTuple):
    text: str
    path: Path
    links: int
    breaks: int


class _Parser(HTMLParser):
    """Blocks in order. Each tag costs the same at any depth: the places of open tags and blocks
    are known, and an element keeps what its ancestors add up to, not their list."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[Path] = []
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.block_places: list[int] = []
        self.silent = 0
        self.links = 0
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = self.breaks = 0

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            path = self.stack[-1] if self.stack else Path()
            self.blocks.append(Block(text, path, self.linked, self.breaks))
        self.parts, self.linked, self.breaks = [], 0, 0

    def push(self, element: Element) -> None:
        tag, place = element.tag, len(self.stack)
        self.stack.append((self.stack[-1] if self.stack else Path()).child(element))
        self.places[tag].append(place)
        if tag in BLOCKS:
            self.block_places.append(place)
        self.silent += tag in SILENT
        self.links += tag == "a"

    def pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            tag = self.stack.pop().element.tag
            self.places[tag].pop()
            if tag in BLOCKS:
                self.block_places.pop()
            self.silent -= tag in SILENT
            self.links -= tag == "a"

    def last(self, tags: set[str]) -> int:
        """The place of the innermost open element of these tags, or -1."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def close_open(self, tags: set[str], within: set[str]) -> None:
        place = self.last(tags)
        if place > self.last(within):
            self.pop_to(place)

    def leave_head(self) -> None:
        """Both </head> and <body> may be left out."""
        while self.stack and self.stack[-1].element.tag == "head":
            self.pop_to(len(self.stack) - 1)

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD:
            self.leave_head()
        if tag in BLOCKS:
            self.flush()
            if tag not in ("option", "optgroup", "label", "button"):
                self.close_open({"p"}, {"td", "th", "button", "caption", "table", "body"})
        if tag == "body":
            self.close_open({"head"}, set())
        if tag in _CLOSED_BY:
            self.close_open(*_CLOSED_BY[tag])
        if tag == "br":
            self.parts.append(" ")
            self.breaks += 1
        if tag in VOID:
            return
        self.push(_element(tag, attrs))

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            if tag not in BLOCKS:
                self.handle_endtag(tag)

    def handle_endtag(self, tag):
        place = self.last({tag})
        if place >= 0:
            # an inline end tag does not close the block it stands in
            across = bool(self.block_places) and self.block_places[-1] > place
            if tag in BLOCKS or tag in SILENT or not across:
                if tag in BLOCKS:
                    self.flush()
                self.pop_to(place)
            return
        if tag == "p":
            self.flush()

    def handle_data(self, data):
        if self.silent and self.stack[-1].element.tag == "head" and data.strip():
            self.leave_head()
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


@cache
def _mark(tag: str, names: str) -> str:
    for word in _WORD.findall(names.lower()):
        kind = _MARK_OF.get(word)
        if kind:
            return kind
    return _TAG_MARK.get(tag, "")


def _element(tag: str, attrs) -> Element:
    names, hidden = [], False
    for name, value in attrs:
        if name in ("class", "id", "role"):
            names.append(value or "")
        hidden = hidden or name == "hidden" or (name == "style" and "display:none" in (value or "").replace(" ", ""))
    if _mark.cache_info().currsize > 50_000:
        _mark.cache_clear()
    joined = " ".join(names)
    # long values are read whole, but not kept
    mark = _mark if len(joined) <= 300 else _mark.__wrapped__
    return Element(tag, mark(tag, joined), hidden)


def blocks_of(html: str | None) -> list[Block]:
    parser = _Parser()
    parser.feed(_OPEN_TAG.sub("", html or ""))
    parser.close()
    parser.flush()
    return parser.blocks


def _bin(value: float, bounds: tuple) -> int:
    return sum(value >= b for b in bounds)


def features(block: Block, place: int, count: int) -> list[str]:
    """Names of the features that hold, the labels' evidence but for the transitions."""
    path = block.path
    leaf, inner, outer = path.leaf, path.inner, path.outer
    words = block.text.count(" ") + 1
    size = _bin(words, (3, 6, 12, 25, 60))
    links = _bin(block.links / max(len(block.text), 1), (0.05, 0.35, 0.75))
    ends = block.text.endswith(_END)
    found = [
        "bias", f"leaf={leaf}", f"inner={inner}", f"outer={outer}", f"size={size}", f"links={links}",
        f"ends={ends}", f"inner={inner},leaf={leaf}", f"inner={inner},size={size}",
        f"leaf={leaf},size={size},links={links}", f"size={size},ends={ends}",
        f"place={_bin(place / max(count - 1, 1), (0.05, 0.15, 0.85, 0.95))}",
        f"depth={min(path.depth, 8)}",
    ]
    found += [f"has={m}" for m in path.marks]
    found += [f"tag={t}" for t in path.tags if t not in ("html", "body")]
    if path.hidden:
        found.append("hidden")
    if "©" in block.text or "all rights reserved" in block.text.lower():
        found.append("rights")
    if block.text.count("|") + block.text.count("·") + block.text.count("»") > 1:
        found.append("separators")
    if sum(map(str.isdigit, block.text)) * 4 > len(block.text):
        found.append("digits")
    return found


class Field(NamedTuple):
    """Scores of the label content against boilerplate by feature, and of each pair of labels."""

    weights: dict[str, float]
    moves: np.ndarray
    start: np.ndarray


def _scores(field: Field, blocks: list[Block]) -> list[float]:
    known = field.weights
    count = len(blocks)
    return [
        sum(known.get(f, 0.0) for f in features(b, k, count)) for k, b in enumerate(blocks)
    ]


def decode(field: Field, blocks: list[Block]) -> list[bool]:
    """The most likely labels, by Viterbi."""
    scores = _scores(field, blocks)
    if not scores:
        return []
    moves, back = field.moves.tolist(), []
    off, on = float(field.start[0]), float(field.start[1]) + scores[0]
    for value in scores[1:]:
        to_off = (off + moves[0][0], on + moves[1][0])
        to_on = (off + moves[0][1], on + moves[1][1])
        back.append((to_off[1] > to_off[0], to_on[1] > to_on[0]))
        off, on = max(to_off), max(to_on) + value
    label = on > off
    labels = [label]
    for step in reversed(back):
        label = step[label]
        labels.append(label)
    return labels[::-1]


def train(pages: list[tuple[list[Block], list[bool]]], rounds: int = 150, decay: float = 0.02) -> Field:
    """Weights of greatest likelihood less `decay` times their squares, by Adam on all pages."""
    names: dict[str, int] = {}
    rows, columns, labels, first = [], [], [], [0]
    for blocks, truth in pages:
        if not blocks:
            continue
        for k, block in enumerate(blocks):
            for name in features(block, k, len(blocks)):
                rows.append(first[-1] + k)
                columns.append(names.setdefault(name, len(names)))
        labels += truth
        first.append(first[-1] + len(blocks))
    rows, columns = np.array(rows), np.array(columns)
    gold = np.array(labels, float)
    begin, size = np.array(first[:-1]), np.diff(first)
    order = np.argsort(-size)
    begin, size = begin[order], size[order]
    alive = [int((size > t).sum()) for t in range(size[0])]
    pair_gold, start_gold = np.zeros((2, 2)), np.zeros(2)
    for b, n in zip(begin, size):
        own = gold[b : b + n].astype(int)
        start_gold[own[0]] += 1
        np.add.at(pair_gold, (own[:-1], own[1:]), 1)
    weight = np.zeros(len(names) + 6)
    mean, square = np.zeros_like(weight), np.zeros_like(weight)
    total = len(gold)
    for turn in range(1, rounds + 1):
        score = np.bincount(rows, weight[columns], minlength=total)
        moves, start = weight[-6:-2].reshape(2, 2), weight[-2:]
        emit = np.stack([np.zeros(total), score], 1)
        ahead, back = np.zeros((total, 2)), np.zeros((total, 2))
        ahead[begin] = start + emit[begin]
        for t in range(1, size[0]):
            at = begin[: alive[t]] + t
            ahead[at] = np.logaddexp.reduce(ahead[at - 1][:, :, None] + moves, 1) + emit[at]
        for t in range(size[0] - 1, 0, -1):
            at = begin[: alive[t]] + t
            back[at - 1] = np.logaddexp.reduce(moves + (emit[at] + back[at])[:, None, :], 2)
        norm = np.empty(total)
        norm[begin] = np.logaddexp.reduce(ahead[begin] + back[begin], 1)
        page = np.repeat(np.arange(len(begin)), size)
        places = np.repeat(begin, size) + np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        norm[places] = norm[begin][page]
        on = np.exp(ahead[:, 1] + back[:, 1] - norm)
        later = np.setdiff1d(np.arange(total), begin)
        pair = np.exp(
            ahead[later - 1][:, :, None] + moves + (emit[later] + back[later])[:, None, :]
            - norm[later][:, None, None]
        ).sum(0)
        gradient = np.concatenate(
            [
                np.bincount(columns, (gold - on)[rows], minlength=len(names)),
                (pair_gold - pair).ravel(),
                start_gold - np.array([(1 - on)[begin].sum(), on[begin].sum()]),
            ]
        ) - 2 * decay * weight
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        weight += 0.1 * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)
    known = {name: float(weight[k]) for name, k in names.items()}
    return Field(known, weight[-6:-2].reshape(2, 2).copy(), weight[-2:].copy())


def _page(rng: random.Random) -> tuple[str, list[str]]:
    """A labelled page: its html and the texts of its content blocks, in one of many layouts."""
    pick, chance = rng.choice, rng.random
    syllables = "an be cor de el fa gri ho in jo ka lu men no or pa que ri sa ti un ver xo yl zu ß é".split()
    word = lambda: "".join(pick(syllables) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: words(4, 18).capitalize() + pick(".....!?")
    prose = lambda a=1, b=6: " ".join(sentence() for _ in range(rng.randint(a, b)))
    title = lambda: words(1, 9).capitalize() + pick(["", "", "."])
    link = lambda t: f'<a href="/{word()}">{t}</a>'
    soup = chance() < 0.25
    content: list[str] = []

    def named(tag, *names):
        """A marked element, or a plain one on pages that mark nothing."""
        name = pick(names)
        attribute = "" if soup or not name else f' {pick(["class", "id", "class"])}="{name}"'
        return f"<{tag}{attribute}>", f"</{tag}>"

    def inside(pair, body):
        return pair[0] + body + pair[1]

    def keep(text):
        content.append(text)
        return text

    def listed(n, tag="ul"):
        items = "".join(f"<li>{link(words(1, 3))}" + pick(["</li>", ""]) for _ in range(n))
        return f"<{tag}>{items}</{tag}>"

    def menu():
        body = listed(rng.randint(2, 9)) if chance() < 0.8 else " | ".join(link(word()) for _ in range(5))
        return inside(named(pick(["nav", "div"]) if not soup else "div", "nav", "menu", "breadcrumbs", "main-nav", "pagination"), body)

    def header():
        body = pick([f"<h1>{link(title())}</h1>", f"<div>{title()}</div>", f"<p>{words(2, 6)}</p>"])
        return inside(named(pick(["header", "div"]) if not soup else "div", "header", "site-header", "masthead", "topbar"), body + pick(["", menu()]))

    def footer():
        body = pick(["", listed(4)]) + f"<p>&copy; {rng.randint(1999, 2030)} {words(1, 4)} &middot; {words(2, 9)}{pick(['.', ''])}</p>"
        if chance() < 0.4:
            body = f"&copy; {word()}.example &middot; {words(2, 9).capitalize()}."
        return inside(named(pick(["footer", "footer", "div"]) if not soup else "div", "footer", "site-footer", "page-footer"), body)

    def side():
        body = f"<h3>{title()}</h3>" + pick([listed(rng.randint(3, 8)), "".join(f"<p>{words(3, 12)}</p>" for _ in range(3))])
        return inside(named(pick(["aside", "div"]) if not soup else "div", "sidebar", "widget", "related", "popular-posts"), body)

    def advert():
        body = pick([prose(1, 2), link(words(3, 8)), f"<p>{prose(1, 3)}</p>"])
        return inside(named(pick(["div", "div", "aside", "section", "p"]), "ad", "ads", "advert", "sponsored", "promo-box"), body)

    def notice():
        body = f"<p>{prose(1, 3)}</p>" + pick(["", f"<button>{word()}</button>", link(word())])
        return inside(named(pick(["div", "section", "div"]), "cookie-notice", "alert", "notice", "consent-banner", "newsletter-popup"), body)

    def form():
        body = f'<label>{words(1, 3)}</label><input name="q"><button>{word()}</button>' + pick(["", f"<p>{sentence()}</p>"])
        return f'<form action="/x">{body}</form>'

    def comments():
        one = lambda: inside(named(pick(["div", "li", "article"]), "comment", "comment-body", "reply"), f"<b>{word()}</b> <p>{prose(1, 4)}</p>")
        body = f"<h3>{words(1, 3)}</h3>" + "".join(one() for _ in range(rng.randint(1, 5))) + pick(["", form()])
        name = "comments" if soup else pick(["comments", "reader-comments", "discussion", "respond"])
        return f'<{(t := pick(["section", "div", "ol"]))} {pick(["id", "class"])}="{name}">{body}</{t}>'

    def paragraph():
        text = prose()
        shown = text
        if chance() < 0.3:
            first, _, rest = text.partition(" ")
            shown = f"<b>{first}</b> {rest}" if rest else f"<em>{first}</em>"
        if chance() < 0.2:
            first, _, rest = shown.rpartition(" ")
            shown = f"{first} {link(rest)}" if first else shown
        keep(text)
        opened = chance()
        if opened < 0.15:
            return f"<p><b>{text}<br>"
        return f"<p>{shown}" + pick(["</p>", "</p>", "</p>\n", ""])

    def piece():
        draw = chance()
        if draw < 0.72:
            return paragraph()
        if draw < 0.8:
            return f"<h{(n := rng.randint(2, 4))}>{keep(title())}</h{n}>"
        if draw < 0.86:
            return "<ul>" + "".join(f"<li>{keep(words(2, 14))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if draw < 0.9:
            return f"<blockquote><p>{keep(prose(1, 2))}</p></blockquote>"
        if draw < 0.93:
            return f"<figure><img src='i.png'><figcaption>{keep(words(3, 10))}</figcaption></figure>"
        if draw < 0.96:
            return "<table>" + "".join(f"<tr><td>{keep(words(1, 3))}</td><td>{keep(str(rng.randint(1, 9999)))}</td></tr>" for _ in range(3)) + "</table>"
        return f"<pre>{keep(words(4, 12))}</pre>"

    def article():
        parts = [f"<h1>{keep(title())}</h1>"] if chance() < 0.85 else []
        if parts and chance() < 0.15:
            parts = [f"<header>{parts[0]}</header>"]
        for _ in range(rng.randint(1, 14)):
            parts.append(piece())
            if chance() < 0.06:
                parts.append(pick([advert, side, form, notice, menu])())
        if chance() < 0.15:
            parts.append(inside(named("div", "share", "social", "tags"), listed(3)))
        body = "".join(parts)
        layout = chance()
        if soup:
            return f"<div>{body}</div>" if layout < 0.6 else f"<table><tr><td>{body}</td></tr></table>"
        if layout < 0.55:
            return f"<article>{body}</article>"
        if layout < 0.7:
            return f"<main>{body}</main>"
        return inside(named(pick(["div", "section", "div"]), "content", "post-body", "entry-content", "story", "article-text", "main"), body)

    before = [f() for f in (header, menu, notice, advert, form, side) if chance() < 0.4]
    rng.shuffle(before)
    main = article()
    after = [f() for f in (comments, side, advert, menu, notice, form) if chance() < 0.3]
    last = [footer()] if chance() < 0.85 else []
    body = "".join(before + [main] + after + last)
    return (
        f"<!DOCTYPE html><html><head><title>{title()}</title><style>p{{}}</style></head><body>"
        f"<script>var a='</p>';</script>{body}" + pick(["</body></html>", ""]),
        content,
    )


def training_pages(count: int = 700, seed: int = 3) -> list[tuple[list[Block], list[bool]]]:
    """Labelled pages from a generator of layouts, since the tables hold no labels."""
    rng = random.Random(seed)
    pages = []
    for _ in range(count):
        html, content = _page(rng)
        blocks = blocks_of(html)
        waiting = [" ".join(c.split()) for c in content]
        labels = []
        for block in blocks:
            mine = bool(waiting) and block.text == waiting[0]
            if mine:
                waiting.pop(0)
            labels.append(mine)
        # a page whose parts cannot be told apart teaches nothing
        if not waiting:
            pages.append((blocks, labels))
    return pages


def main_text(field: Field, html: str | None) -> str:
    blocks = blocks_of(html)
    return "\n".join(b.text for b, kept in zip(blocks, decode(field, blocks)) if kept)


def _extractor(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(shared.value, html.as_py()) for html in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[1:],
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                [*batch.schema.names[1:], "text", "n_chars"],
            )

    return run


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) per row of `pages` (page_id, url, html).

    text is the content blocks in page order, one line each, white space inside a block turned
    into single blanks; n_chars its code points. Null and empty pages, and pages without content,
    have an empty text; broken markup is read as far as it goes.
    """
    shared = pages.sparkSession.sparkContext.broadcast(field or train(training_pages()))
    kinds = ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in pages.select("page_id", "url").schema.fields
    )
    return pages.select(F.col("html"), "page_id", "url").mapInArrow(
        _extractor(shared), f"{kinds}, text string, n_chars long"
    )
