"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks, the runs of text between block-level tags. A small logistic model, fitted
to the blocks of a few labelled pages, gives every block its odds of being content; they become the
capacities from the source or to the sink. Blocks that follow each other and blocks under one parent
are tied by smoothness edges that weaken with their distance in the tree and between a main part and
the page's frame; their strength is the one with the fewest errors on pages left out of the fit. The
minimum cut separates content from boilerplate. Blocks whose odds outweigh all their edges keep their own label
in every minimum cut, so they are settled first and only the doubtful rest needs a maximum flow.
"""

from __future__ import annotations

import functools
import html
import re
from collections import defaultdict, deque
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# HTML element names by their role.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot"
    " th thead tr ul".split()
)
DROPPED_TAGS = frozenset("script style noscript template title textarea iframe svg select button".split())
RAW_TAGS = frozenset("script style title textarea iframe noscript".split())
#: Dropped elements that hold none of their kind: a further one ends the open one.
LONE_TAGS = frozenset(("select", "button"))
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening the tag ends an open element of these kinds, up to the next of the fences.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
FENCES = frozenset("ul ol dl table menu".split())
MAIN_TAGS = frozenset(("article", "main"))
PAGE_TAGS = frozenset(("nav", "footer", "aside", "form", "menu", "dialog", "search"))
HEADLINE_TAGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
QUOTE_HINTS = frozenset("pullquote pull quote".split())
MAIN_HINTS = frozenset("article content entry main post story text body".split())
PAGE_HINTS = frozenset(
    "ad ads advert advertisement adverts alert author banner bar breadcrumb breadcrumbs comment comments consent cookie cookies"
    " copyright discussion disqus foot footer gdpr head header hidden legal login masthead menu meta modal nav navbar navigation"
    " newsletter notice pager pagination popup promo promoted promotion reader reactions recommend recommended related replies"
    " reply search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split()
)
#: Words of the page's frame that begin ordinary names too: they count only beside words of this and the other lists.
VAGUE_HINTS = frozenset("alert author bar foot head header legal menu meta reader search share sharing social tags".split())
FRAME_WORDS = frozenset(
    "area bio block bottom box button buttons card container content count counts danger data entry follow footer form global group icon"
    " icons info inner input item items left line link links list main media on outer page panel post primary right row secondary section"
    " side site story strip success text this toggle tool tools top us via warning wrap wrapper".split()
)
PAGE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HINT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>|</{tag}\s*\Z", re.IGNORECASE) for tag in RAW_TAGS}
_DROPPED_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in DROPPED_TAGS}

FEATURES = ("in_main", "in_page", "main_hint", "page_hint", "link_share", "long", "sentence", "heading", "list_item")
_PROSE = "They followed the river for three days before the valley opened and the first houses came into view."
_MORE = "Nobody could say afterwards who had carried the lamp, or why it was still burning in the morning."
_ASIDE = "We publish a digest of our best writing every week and never pass your address on to anyone else."
_NAV = "<nav><ul><li><a>Home</a><li><a>World</a><li><a>Sport</a></ul></nav>"
#: Pages the model and the smoothness are learnt from; a block that begins with + is content.
LABELLED = (
    f"<header><div>The Gazette</div>{_NAV}</header><main><article><h1>+A walk</h1><p>+{_PROSE}<p>+At night.<p>+{_MORE}</article></main>"
    f"<aside><h3>Newsletter</h3><p>{_ASIDE}</aside><footer><p>All rights reserved</footer>",
    f"{_NAV}<div class=ad>Buy two, pay one.</div><article><h1>+On lamps</h1><p>+{_PROSE}<ul><li>+oil<li>+<a>a wick</a><li>+glass</ul><p>+{_MORE}"
    f"<p>+<a>More on wicks</a><section class=comments><h3>Comments</h3><p>{_ASIDE}<p>Agreed!</section></article><footer>&copy; Gazette</footer>",
    f"<div class=menu><a>Home</a></div><div class=content><h2>+A report</h2><p>+{_PROSE}<p>+Day two<p>+{_MORE}<div class=share><a>Send</a></div></div>"
    f"<div class=sidebar><h3>Popular</h3><ul><li><a>First</a><li><a>Second</a></ul><p>{_ASIDE}</div><div class=footer>Imprint</div>",
    f"<div><a>Home</a> <a>News</a></div><div><h2>+Plain</h2><p>+{_PROSE}<p>+Two notes<p>+{_MORE}<p>+In short<p>+{_PROSE}</div>"
    "<div><ul><li><a>About</a><li><a>Terms</a><li>Version 4<li><a>Contact</a></ul></div>",
    f"<ul><li><a>Start</a><li>Today<li><a>Archive</a><li><a>People</a></ul><div><h1>+The valley</h1><p>+{_PROSE}<p>+12 May<p>+{_MORE}<p>+Map below"
    f"<p>+{_MORE}</div><ul><li><a>Next</a><li>Page 2<li><a>Last</a></ul>",
    f"<div><p><a>Log in</a><p>Guest<p><a>Help</a></div><div><p>+{_PROSE}<p>+Then silence<p>+{_MORE}<p>+And rain<p>+{_PROSE}</div>",
    f"<div class=cookie-notice><p>{_ASIDE}<p>Fine.</div><div class=post-body><h1>+A post</h1><p>+{_PROSE}<ol><li>+Boil it.<li>+Wait<li>+Serve.</ol></div>"
    f"<div class=related><h3>Read on</h3><ul><li><a>Stew</a><li><a>Soup</a></ul></div><form><p>Search the site</form>",
    f"<article><header><h1>+Letters</h1></header><p>+{_MORE}<blockquote>+{_PROSE}</blockquote><p>+Signed by all<div class=newsletter><h3>Stay</h3><p>{_ASIDE}</div>"
    f"<nav><a>Older</a></nav><footer><p>Filed under letters.</footer></article><aside><p>{_ASIDE}<p>Adverts</aside>",
    f"<div><h3>Sections</h3><ul><li><a>City</a><li><a>Coast</a></ul></div><div><h2>+Tides</h2><table><tr><td>+High<td>+6.10<tr><td>+Low<td>+12.20</table>"
    f"<p>+{_PROSE}<p>+{_MORE}</div><div><p><a>Top</a><p>2019<p><a>Feed</a></div>",
    f"<div id=wrap><div><a>Shop</a></div><div><p>+{_MORE}<p>+<a>the full list</a><p>+{_PROSE}<h3>+Afterwards</h3><p>+{_MORE}</div>"
    "<div><a>One</a></div><div>Reach us<div><a>Two</a></div></div></div>",
    f"<div class=entry><h1>+Bread</h1><div>+{_PROSE}</div><div>+Serves four</div><div>+{_MORE}</div></div><div class=promo><div>{_ASIDE}</div>"
    "<div>From 9.99</div></div><div class=comments><div>Lovely, thanks.</div><div>So good!</div></div>",
    f"<article class=post><h1>+Wool</h1><div class=entry-content><p>+{_PROSE}<p>+Spun twice<p>+{_MORE}</div><aside><h4>From our shop</h4><p>{_ASIDE}"
    f"</aside><section class=post-comments><h3>Replies</h3><article class=comment><p>{_MORE}<p>Me too</article><article><p>{_ASIDE}</article></section></article>",
    f"<main class=content><div class=notice><p>{_ASIDE}</div><h1>+Salt</h1><p>+{_PROSE}<p>+{_MORE}<form class=entry-form><p>{_ASIDE}<p>Your name</form>"
    f"<div class=story-promo><p>{_ASIDE}<p>From 9.99</div></main><div class=page-footer><p>{_ASIDE}</div>",
    f"<main><h1>+Notice board</h1><p>+{_PROSE}<ul><li>+<a>Form A</a><li>+<a>Form B</a> for guests.</ul><div class=alert>Closed on Friday.</div></main>"
    f"<nav><p>{_ASIDE}<ul><li><a>Staff</a></ul></nav>",
)
RIDGE = 0.3
#: Candidate strengths of the tie between neighbours under one parent; a step further apart in the tree halves it.
TIES = (0.0, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0)
#: What remains of a tie between blocks of which one alone lies in a main part, or one alone in a part of the page's frame.
ACROSS = 0.2


def _fit(pages: tuple[tuple[list[Block], list[bool]], ...]) -> np.ndarray:
    """Weights of the logistic model (bias last), by Newton steps with a ridge that keeps the costs moderate."""
    rows = np.array([(*block.row, 1) for blocks, _ in pages for block in blocks], float)
    labels = np.array([label for _, marked in pages for label in marked], float)
    weights, ridge = np.zeros(rows.shape[1]), np.diag([RIDGE] * (rows.shape[1] - 1) + [1e-6])
    for _ in range(40):
        chance = 1 / (1 + np.exp(-rows @ weights))
        bend = rows.T @ (rows * (chance * (1 - chance))[:, None]) + ridge
        weights += np.linalg.solve(bend, rows.T @ (labels - chance) - ridge @ weights)
    return weights


@functools.cache
def labelled_pages() -> tuple[tuple[list[Block], list[bool]], ...]:
    """Blocks of the labelled pages, and which of them are content."""
    cut = [blocks_of(page) for page in LABELLED]
    return tuple(([b._replace(text=b.text.removeprefix("+")) for b in blocks], [b.text.startswith("+") for b in blocks]) for blocks in cut)


@functools.cache
def held_out_errors(tie: float) -> int:
    """Blocks labelled wrongly when every page is judged by a model of the other pages."""
    pages = labelled_pages()
    return sum(
        got != label
        for k, (blocks, marked) in enumerate(pages)
        for got, label in zip(label_blocks(blocks, _fit(pages[:k] + pages[k + 1:]), tie), marked)
    )


@functools.cache
def classifier() -> tuple[np.ndarray, float]:
    """The model of all labelled pages, and the smoothness of the fewest held-out errors (the middle one of several)."""
    errors = [held_out_errors(tie) for tie in TIES]
    best = [tie for tie, wrong in zip(TIES, errors) if wrong == min(errors)]
    return _fit(labelled_pages()), best[len(best) // 2]


class Block(NamedTuple):
    text: str
    path: tuple[int, ...]  #: numbers of the open elements, root first
    row: tuple[float, ...]


class _Open(NamedTuple):
    tag: str
    number: int
    in_main: bool
    in_page: bool
    main_hint: bool
    page_hint: bool


def _names_frame(words: set[str], tag: str, parent: _Open) -> bool:
    """Whether one class name of an element speaks of the page's frame.

    The head of an article belongs to it, and a vague word counts only if no other word narrows it
    down: share-bar is a toolbar, share-price is not.
    """
    hints = words & PAGE_HINTS
    if parent.in_main and (tag in HEADLINE_TAGS or tag == "header"):
        hints -= {"head", "header"}
    return bool(hints - VAGUE_HINTS) or bool(hints) and words <= PAGE_HINTS | FRAME_WORDS


def _element(tag: str, number: int, attributes: str, parent: _Open) -> _Open:
    main, page = tag in MAIN_TAGS, tag in PAGE_TAGS or (tag == "header" and not parent.in_main)
    liked = disliked = False
    if attributes:
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name in ("class", "id"):
                for token in value.split():
                    words = {word.lower() for word in _HINT.findall(token)}
                    framed = _names_frame(words, tag, parent)
                    liked, disliked = liked or (bool(words & MAIN_HINTS) and not framed), disliked or framed
                    page = page and not (tag == "aside" and parent.in_main and words & QUOTE_HINTS)
            elif name == "role":
                main, page = main or value.lower() in ("main", "article"), page or value.lower() in PAGE_ROLES
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                page = True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
                page = True
    if tag in ("html", "body"):  # a hint on the whole page says nothing about its parts
        liked = disliked = False
    inside = not (page or disliked)  # a part of the frame inside the article is no longer the article
    return _Open(
        tag, number, main or (parent.in_main and inside), parent.in_page or page, liked or (parent.main_hint and inside),
        parent.page_hint or disliked,
    )


def blocks_of(page: str) -> list[Block]:
    """The page's non-empty blocks in order, with what the classifier looks at.

    A dropped element ends with its end tag or with a block around it; without an end tag it ends at
    the next block, and an article or main part begins outside of it.
    """
    stack = [_Open("", 0, False, False, False, False)]
    out: list[Block] = []
    pieces: list[str] = []
    last_end: dict[str, int] = {}
    linked, in_link, skip, number, at = 0, 0, [], 0, 0  # skip: dropped elements that are open, with the depth they lie at

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not skip:
            pieces.append(piece)
            linked += len(piece) * bool(in_link)

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            top = stack[-1]
            share = min(1.0, linked / max(1, sum(map(len, pieces))))
            tags = {level.tag for level in stack[-3:]}
            out.append(Block(text, tuple(level.number for level in stack), (
                top.in_main, top.in_page, top.main_hint, top.page_hint, share, len(text) >= 80,
                text[-1] in ".!?…\"»”", top.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), bool(tags & {"li", "td", "th"}),
            )))
        pieces.clear()
        linked = 0

    def close_to(depth: int) -> None:
        flush()
        del stack[depth:]
        while skip and skip[-1][1] > depth:
            skip.pop()

    def find(kinds: set[str], fences: frozenset[str], floor: int = 1) -> int:
        for depth in range(len(stack) - 1, floor - 1, -1):
            if stack[depth].tag in kinds:
                return depth
            if stack[depth].tag in fences:
                break
        return 0

    def ends_later(tag: str) -> bool:
        if tag not in last_end:
            last_end[tag] = max((found.start() for found in _DROPPED_END[tag].finditer(page)), default=-1)
        return last_end[tag] >= at

    while match := _TOKEN.search(page, at):
        add(page[at:match.start()])
        at = match.end()
        name = match[2] or match[5]
        if not name:
            continue
        tag, closing, attributes = name.lower(), bool(match[1] or match[4]), match[3] or match[6] or ""
        if tag in RAW_TAGS and not closing:
            end = _END[tag].search(page, at)
            at = end.end() if end else len(page)
            add(" ")
        elif tag in DROPPED_TAGS:
            if not closing and not attributes.endswith("/"):
                if tag in LONE_TAGS:
                    skip[:] = skip[: next((k for k, entry in enumerate(skip) if entry[0] == tag), len(skip))]
                skip.append((tag, len(stack)))
            elif closing:
                for place in range(len(skip) - 1, -1, -1):
                    if skip[place][0] == tag:
                        del skip[place:]
                        break
        elif tag == "br":
            add("\n")
        elif tag == "a":
            in_link = 0 if closing else 1
        elif tag in BLOCK_TAGS:
            while skip and (not ends_later(skip[-1][0]) or (tag in MAIN_TAGS and not closing and skip[-1][0] != "template")):
                skip.pop()
            if closing:
                depth = find({tag}, frozenset())
                close_to(depth) if depth else flush()
            else:
                depth = find({"p"}, frozenset(), skip[-1][1] if skip else 1)
                if not depth:
                    depth = find(CLOSES.get(tag, set()), FENCES)
                close_to(depth) if depth else flush()
                if tag not in VOID_TAGS:
                    number += 1
                    stack.append(_element(tag, number, attributes, stack[-1]))
    add(page[at:])
    flush()
    return out


def _tree_distance(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    shared = 0
    for x, y in zip(a, b):
        if x != y:
            break
        shared += 1
    return len(a) + len(b) - 2 * shared


def _edges(blocks: list[Block], tie: float) -> dict[int, dict[int, float]]:
    """Smoothness: each block with its follower, and with the next block under the same parent."""
    ties: dict[int, dict[int, float]] = defaultdict(dict)
    last_under: dict[int, int] = {}
    for k, block in enumerate(blocks):
        parent = block.path[-2] if len(block.path) > 1 else 0
        for other in {k - 1, last_under.get(parent, k - 1)} - {-1}:
            near = 0.5 ** max(0, _tree_distance(blocks[other].path, block.path) - 2)
            ties[k][other] = ties[other][k] = tie * near * (1 if blocks[other].row[:2] == block.row[:2] else ACROSS)
        last_under[parent] = k
    return ties


def _settle(odds: list[float], ties: dict[int, dict[int, float]]) -> dict[int, bool]:
    """Labels that every minimum cut shares; ``odds`` and ``ties`` keep what is left undecided."""
    decided: dict[int, bool] = {}
    queue = deque(range(len(odds)))
    while queue:
        k = queue.popleft()
        if k in decided or abs(odds[k]) <= sum(ties[k].values()):
            continue
        decided[k] = odds[k] > 0
        for other, tie in ties.pop(k).items():
            odds[other] += tie if decided[k] else -tie
            del ties[other][k]
            queue.append(other)
    return decided


def _cut(odds: dict[int, float], ties: dict[int, dict[int, float]]) -> set[int]:
    """Nodes on the source side of the minimum cut, by blocking flows over shortest paths."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = defaultdict(dict)
    for k, odd in odds.items():
        a, b = (source, k) if odd > 0 else (k, sink)
        room[a][b], room[b][a] = abs(odd), 0.0
        for other, tie in ties[k].items():
            room[k][other] = tie
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            k = queue.popleft()
            for other, left in room[k].items():
                if left > 1e-12 and other not in level:
                    level[other] = level[k] + 1
                    queue.append(other)
        if sink not in level:
            return {k for k in level if k >= 0}
        todo = {k: list(room[k]) for k in level}
        path = [source]
        while path:
            k = path[-1]
            if k == sink:
                flow = min(room[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    room[a][b] -= flow
                    room[b][a] = room[b].get(a, 0.0) + flow
                path = [source]
                continue
            while todo[k] and not (room[k][todo[k][-1]] > 1e-12 and level.get(todo[k][-1]) == level[k] + 1):
                todo[k].pop()
            if todo[k]:
                path.append(todo[k][-1])
            else:
                path.pop()
                if path:
                    todo[path[-1]].pop()


def label_blocks(blocks: list[Block], weights: np.ndarray | None = None, tie: float | None = None) -> list[bool]:
    """Whether each block is content, by the minimum cut; model and smoothness are the learnt ones if not given."""
    if not blocks:
        return []
    if weights is None or tie is None:
        weights, tie = classifier()
    odds = list(np.array([block.row for block in blocks], float) @ weights[:-1] + weights[-1])
    ties = _edges(blocks, tie)
    decided = _settle(odds, ties)
    open_nodes = {k: odds[k] for k in range(len(blocks)) if k not in decided}
    content = _cut(open_nodes, ties) if open_nodes else set()
    return [decided.get(k, k in content) for k in range(len(blocks))]


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    return "\n\n".join(block.text for block, content in zip(blocks, label_blocks(blocks)) if content)


@F.arrow_udf(T.StringType())
def main_texts(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(page.as_py() or "") for page in pages], pa.string())


def extract_text(pages: DataFrame, *, page: str = "html") -> DataFrame:
    """``pages`` with text, the content blocks joined by an empty line, and n_chars, its code points.

    A null or empty page, and one without content, gives an empty text. Rows are handled one by
    one; columns named like a result are replaced.
    """
    return pages.withColumn("text", main_texts(page)).withColumn("n_chars", F.length("text").cast("bigint"))
