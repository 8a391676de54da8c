"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from maskframe.llm.frames import table
from maskframe.llm.registry import query

#: Elements without an end tag, elements whose content is no markup, and elements never read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIPPED = frozenset(
    "head script style noscript template iframe object svg math canvas audio video nav footer aside form button "
    "select option textarea label fieldset dialog menu title noembed noframes xmp".split()
)
#: Elements that stand in a line of text; any other tag ends a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
#: What an opening tag closes without an end tag.
_PARAGRAPH_ENDS = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_ARTICLE = frozenset({"article", "main"})
#: Classes, ids and roles that name what is no part of an article.
_ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar "
    "navigation navigations breadcrumb breadcrumbs cookie cookies consent notice notices alert popup modal overlay newsletter "
    "subscribe signup comment comments respond reply replies disqus share sharing social related recommended "
    "footer masthead header widget toolbar pagination pager login search contentinfo complementary".split()
)
#: Words that say of a compound name only where or how its element stands: cookie-bar, left-sidebar, share_buttons.
_PLACE_WORDS = frozenset(
    "area bar block bottom box button buttons container form global icon icons inner item items left link links list "
    "outer panel post posts primary right secondary section site top wrap wrapper".split()
)
#: Words that also head an article; they count alone, outside of articles, and on no heading.
_HEAD_WORDS = frozenset({"header", "masthead", "banner"})
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_WORD = re.compile(r"[a-z]+")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Quantifiers keep what they took, so a tag that never ends is given up after one pass.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?>[^>"']+|"[^"]*"|'[^']*'|["'])*+)>"""
    r"""|<[!?/][^>]*+(?:>|\Z)""",
    re.S,
)
_TAG_START = re.compile(r"<[a-zA-Z/!?]")
_PUNCTUATION = re.compile(r"[^\w\s]")

#: Blocks on either side whose ratios are averaged, with these weights from the middle out.
_SMOOTHING = (0.5, 0.25)
#: A path is content from this share of the best fused ratio of the page.
_THRESHOLD = 0.1


@dataclass
class Block:
    """Text between two block tags: its tag path, the open elements, its text, its linked characters."""

    path: str
    elements: tuple[int, ...]
    text: str
    linked: int


def _names_aside(token: str) -> bool:
    """Whether a whole class, id or role names an aside: by a listed word, or by nothing but listed and place words."""
    if token in _ASIDE_WORDS:
        return True
    words = [w for w in _WORD.findall(token) if w not in _PLACE_WORDS]
    return bool(words) and all(w in _ASIDE_WORDS and w not in _HEAD_WORDS for w in words)


def _skips(attributes: str, heads: bool = False) -> tuple[bool, bool]:
    """Whether the attributes hide an element, and whether they name it an aside.

    With ``heads`` the element may head an article, so names of headers count for nothing.
    """
    named = False
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return False, False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True, named
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True, named
        elif name in ("class", "id", "role") and not named:
            named = any(_names_aside(t) for t in value.split() if not (heads and t in _HEAD_WORDS))
    return False, named


def _less_asides(blocks: list[Block], tags: list[str], asides: set[int]) -> list[Block]:
    """The blocks outside of the elements that are asides by name.

    A name alone drops no element that holds main, the only articles or (unless it is inline)
    most of the unlinked text of a page; where an article stands elsewhere, long text under
    such a name stays out. If nothing else is left, the aside with the most text of its own stays.
    """
    if not asides:
        return blocks
    mass: Counter[int] = Counter()
    own: Counter[int] = Counter()  # less what stands in further asides inside
    parents: dict[int, list[int]] = {}
    holds: dict[int, set[str]] = {}
    outside = False  # an article outside of all asides
    for b in blocks:
        above: list[int] = []
        for e in b.elements:
            if e in asides:
                above.append(e)
            elif tags[e] in _ARTICLE:
                for a in above:
                    holds.setdefault(a, set()).add(tags[e])
                outside |= tags[e] == "article" and asides.isdisjoint(b.elements)
        for e in [0, *above]:
            mass[e] += len(b.text) - b.linked
        if above:
            own[above[-1]] += len(b.text) - b.linked
            parents[above[-1]] = above

    def stays(e: int) -> bool:
        held = holds.get(e, ())
        return "main" in held or not outside and ("article" in held or tags[e] not in INLINE and 2 * mass[e] > mass[0])

    gone = {e for e in asides if not stays(e)}
    rest = [b for b in blocks if gone.isdisjoint(b.elements)]
    if own and not rest:
        gone.difference_update(parents[max(own, key=lambda e: (own[e], -e))])
        rest = [b for b in blocks if gone.isdisjoint(b.elements)]
    return rest


def parse(page: str) -> tuple[list[Block], list[str]]:
    """Text blocks of a page in order, less what is skipped by name, and the tag of each element."""
    blocks: list[Block] = []
    tags: list[str] = ["#page"]
    stack: list[tuple[str, int]] = [("#page", 0)]  # tag and number of every open block element
    is_open: Counter[str] = Counter()  # how many of each tag are on the stack
    asides: set[int] = set()  # elements that are asides by name
    nested: Counter[int] = Counter()  # elements of the same tag open inside an inline element on the stack
    links = skipped = 0
    skip_depth: list[bool] = [False]
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(pieces)).split()) if pieces else ""
        if text:
            path = "/".join(t for t, _ in stack[1:])
            blocks.append(Block(path, tuple(n for _, n in stack), text, linked))
        pieces.clear()
        linked = 0

    def close(at: int) -> None:
        nonlocal skipped
        flush()
        while len(stack) > at:
            is_open[stack.pop()[0]] -= 1
            skipped -= skip_depth.pop()

    def say(text: str) -> None:
        nonlocal linked
        if text and not skipped:
            pieces.append(text)
            if links:
                linked += len(text)

    at, n = 0, len(page)
    whole = page.rfind(">") + 1  # behind it no tag is complete
    while at < n:
        m = _TOKEN.search(page, at, whole)
        if m is None:
            # A tag that the page ends in is no text.
            cut = _TAG_START.search(page, max(at, whole))
            say(page[at:cut.start()] if cut else page[at:])
            break
        say(page[at:m.start()])
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):
            break  # a comment that is not closed hides the rest
        if not m["name"]:
            continue
        name = m["name"].lower()
        if name in INLINE:
            if name == "br":
                say(" ")
            elif name == "a":
                links = 0 if m["close"] else 1
            elif name in VOID:
                pass
            elif m["close"]:
                # Its own end tag ends an inline element on the stack, but not from inside a later block.
                for i in range(len(stack) - 1, 0, -1) if is_open[name] else ():
                    if stack[i][0] not in INLINE:
                        break
                    if stack[i][0] == name:
                        if nested[stack[i][1]]:
                            nested[stack[i][1]] -= 1
                        else:
                            close(i)
                        break
            elif not m["rest"].endswith("/"):
                if is_open[name]:
                    nested[next(e for t, e in reversed(stack) if t == name)] += 1
                elif any(skips := _skips(m["rest"])):
                    # Shown apart from the text: it is skipped until its own end or that of the block around it.
                    flush()
                    tags.append(name)
                    stack.append((name, len(tags) - 1))
                    is_open[name] += 1
                    skip_depth.append(skips[0])
                    skipped += skips[0]
                    if not skips[0]:
                        asides.add(len(tags) - 1)
            continue
        if m["close"]:
            if is_open[name]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name))
            else:
                flush()
            links = 0
            continue
        flush()
        if name in _PARAGRAPH_ENDS and is_open["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in ("td", "th", "button", "object"):
                    break
        if name in _SIBLINGS:
            ended, scope = _SIBLINGS[name]
            for i in range(len(stack) - 1, 0, -1) if any(is_open[t] for t in ended) else ():
                if stack[i][0] in scope:
                    break
                if stack[i][0] in ended:
                    close(i)
                    break
        if name in VOID:
            continue
        if name == "body":
            close(1)  # whatever the head left open
        inside = any(is_open[t] for t in _ARTICLE)
        gone = name in SKIPPED or name == "header" and not inside
        tags.append(name)
        if not gone and name not in ("html", "body", *_ARTICLE):
            gone, named = _skips(m["rest"], inside or name in _HEADINGS)
            if named and not gone:
                asides.add(len(tags) - 1)
        stack.append((name, len(tags) - 1))
        is_open[name] += 1
        skip_depth.append(gone)
        skipped += gone
        links = 0
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            if end is None:
                at = n
            else:
                at = end.end()
                close(len(stack) - 1)
    flush()
    return _less_asides(blocks, tags, asides), tags


def path_ratios(blocks: list[Block]) -> np.ndarray:
    """Fused ratio of every block: text and punctuation per block of its tag path, smoothed.

    Characters in links count for nothing, so lists of links have small ratios whatever their
    length.
    """
    totals: dict[str, list[float]] = {}
    for b in blocks:
        of = totals.setdefault(b.path, [0.0, 0.0, 0.0])
        of[0] += max(0, len(b.text) - b.linked)
        of[1] += len(_PUNCTUATION.findall(b.text)) if not b.linked else 0
        of[2] += 1
    ratios = np.array([[totals[b.path][0] / totals[b.path][2], totals[b.path][1] / totals[b.path][2]] for b in blocks])
    weights = np.array([*reversed(_SMOOTHING[1:]), *_SMOOTHING])
    side = len(_SMOOTHING) - 1
    padded = np.pad(ratios, ((side, side), (0, 0)), mode="edge")
    smooth = sum(w * padded[i:i + len(ratios)] for i, w in enumerate(weights))
    return smooth[:, 0] * (1 + smooth[:, 1])


def main_text(page: str) -> str:
    """The article of a page; empty if there is none.

    Blocks whose path reaches the threshold are content nodes. If article or main elements
    hold some, the article is all that stands in these (in a main element only if it holds
    content outside of its articles). Otherwise it is the content nodes, the blocks between
    them, and the blocks in their lowest common element that are headings or not mere links;
    all of the deepest element that has most of their text belongs to it, links included.
    """
    blocks, tags = parse(page)
    if not blocks:
        return ""
    fused = path_ratios(blocks)
    content = fused >= _THRESHOLD * fused.max()
    mass = np.array([len(b.text) - b.linked for b in blocks]) * content
    if not mass.any():
        mass = np.array([len(b.text) for b in blocks])
    weight: Counter[int] = Counter()
    own: set[int] = set()  # article and main elements with content of which they are the innermost
    for b, w in zip(blocks, mass.tolist(), strict=True):
        if w:
            weight.update(dict.fromkeys(b.elements, w))
            own.update([e for e in b.elements if tags[e] in _ARTICLE][-1:])
    if own:
        return " ".join(b.text for b in blocks if not own.isdisjoint(b.elements))
    voted = np.flatnonzero(mass)
    first, last = voted[0], voted[-1]
    common = max(e for e, w in weight.items() if w == weight[0])
    chosen = max(e for e, w in weight.items() if 2 * w > weight[0])
    while tags[chosen] in ("p", "li", "ul", "ol", "blockquote", "pre", *_HEADINGS):
        chosen = next(b.elements[b.elements.index(chosen) - 1] for b in blocks if chosen in b.elements)

    def belongs(i: int, b: Block) -> bool:
        if first <= i <= last or chosen in b.elements:
            return True
        return common in b.elements and (b.linked < len(b.text) or any(tags[e] in _HEADINGS for e in b.elements))

    return " ".join(b.text for i, b in enumerate(blocks) if belongs(i, b))


def extract_text(pages: DataFrame, html_column: str = "html", out: str = "main_text") -> DataFrame:
    """``pages`` with the string column ``out``: the main text of each page, never null.

    A null or empty page, or one without text outside of what is skipped, has an empty text.
    Whole pages are read, whatever their length; pages are independent, so repeated rows give
    repeated results, an empty table an empty one, and the other columns come through as they
    are. A column already called ``out`` is refused; choose another name.
    """
    if out in pages.columns:
        raise ValueError(f"there is a column {out} already")
    at = pages.columns.index(html_column)
    schema = T.StructType([*pages.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py() or "") for x in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, out])

    return pages.mapInArrow(run, schema)


@query("op8_html_extraction")
def op8_html_extraction(spark, sf_dir):
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages, out="text").selectExpr("page_id", "url", "text", "cast(length(text) AS long) AS n_chars")
