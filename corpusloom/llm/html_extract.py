"""HTML main text by two-pass block rules.

First pass: each block of text is judged alone, by its place (menus, footers, adverts, comments and
the like are out), link density, length and stop-word density, as good, bad or
undecided; short blocks without links stay undecided. Second pass: undecided blocks
take the label of the nearest decided neighbours. Article elements are a prior: if they hold
half of the good text or more, what stands outside them is bad, and blocks inside without a decided neighbour are good.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Common words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their there they this to was were
    which who will with you der die das den dem des ein eine einen und oder nicht ist sind war mit von zu auf für im sich als auch an bei nach aus
    le la les un une de du et est dans que qui ne pas pour par sur au aux ce se il elle avec sont plus el los las una y en es por con no se su para
    del al lo como más o pero sus""".split()
)
SHORT, LONG = 60, 180
LOW_STOPS, HIGH_STOPS = 0.08, 0.2
#: The ranges of characters of scripts without spaces between words, of which one says as much as three letters.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]")
MANY_LINKS = 0.4
#: The article's elements are believed if they hold this share of the good text at least.
ARTICLE_SHARE = 0.5

#: Attributes end at ">" or "<" outside quotes, so broken markup is never scanned twice.
_ATTRIBUTES = r"""(?:[^<>"']|"[^"]*"|'[^']*')*+"""
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|textarea|select|option|title)\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)"""
    rf"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({_ATTRIBUTES})>|<[!?][^<>]*+>""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(?:class|id|role)\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_SPACE = re.compile(r"\s+")
_BREAKS = re.compile(r"(?:<br\b[^<>]*+>\s*+){2,}", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header
    hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks of running text: what stands within a line of it belongs to the line, whatever its name.
RUNNING = frozenset("p pre li dd dt td th h1 h2 h3 h4 h5 h6 blockquote caption figcaption summary address".split())
OUTSIDE = frozenset("nav footer aside form dialog menu button label fieldset head".split())
#: Names (class, id or role) that tell a block apart from the article, alone or put together with each other and PLACE_NAMES.
OUTSIDE_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars nav navbar navigation menu menus breadcrumb
    breadcrumbs cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related
    recommended comment comments disqus reply replies respond footer masthead pagination pager widget toolbar copyright disclaimer complementary
    contentinfo search dialog siteheader topbar""".split()
)
#: Words that only say where or what kind of box a name is for.
PLACE_NAMES = frozenset(
    """area bar block body bottom box button card center col column container content footer group header home inner item items left lg link links list main md
    middle mobile module outer page panel primary right row secondary section site slot sm text title top unit user wrap wrapper""".split()
)
#: What a new block of these kinds closes, if it stands in one.
_CLOSES = {"li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "tr": {"p", "tr", "td", "th"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"}}
_ROWS = 128


@dataclass
class Block:
    text: str
    link_chars: int
    inside: bool
    outside: bool
    heading: bool
    good: bool | None = None

    @property
    def size(self) -> int:
        """Its length, in letters of scripts with spaces."""
        return len(self.text) + 2 * len(_UNSPACED.findall(self.text))


@dataclass
class _Open:
    tag: str
    inside: bool
    outside: bool
    heading: bool
    header: bool
    link: bool
    aside: bool = False  # an element within a line that its name or tag would put out


def _outside_name(name: str) -> bool:
    """Whether a class name, id or role is one of OUTSIDE_NAMES, or made of them and words for places only: "cookie-banner", not "notice-board"."""
    parts = [x for x in re.split(r"[^a-z]+", name) if x]
    return re.sub("[-_]", "", name) in OUTSIDE_NAMES or any(x in OUTSIDE_NAMES for x in parts) and all(x in OUTSIDE_NAMES or x in PLACE_NAMES for x in parts)


def _traits(tag: str, attributes: str, over: _Open, running: bool) -> _Open:
    """What an element and those above it are. ``running``: it is no block, and stands in running text, so it alone puts nothing out."""
    names: list[str] = []
    if "=" in attributes:
        for value in _ATTRIBUTE.findall(attributes):
            names += value.strip("\"'").lower().split()
    article = tag in ("article", "main") or "main" in names
    outside = tag in OUTSIDE or (tag not in ("html", "body", "main") and any(map(_outside_name, names)))
    header = tag == "header" or tag not in HEADINGS and any(x in ("header", "site-header", "page-header") for x in names)
    return _Open(
        tag,
        over.inside or article,
        over.outside or not running and (outside or header and not over.inside),
        over.heading or tag in HEADINGS,
        over.header or header,
        over.link or tag == "a",
        over.aside and tag not in BLOCKS or running and outside,
    )


class _Stack(list):
    """Open elements. How many of a tag are open is known, so an end tag without a beginning costs nothing and others what they close."""

    def __init__(self) -> None:
        super().__init__([_Open("", False, False, False, False, False)])
        self.blocks: list[_Open] = []
        self.open_blocks: Counter[str] = Counter()
        self.inline: list[Counter[str]] = [Counter()]  # by the block they stand in

    def open(self, element: _Open) -> None:
        self.append(element)
        if element.tag in BLOCKS:
            self.blocks.append(element)
            self.open_blocks[element.tag] += 1
            self.inline.append(Counter())
        else:
            self.inline[-1][element.tag] += 1

    def has(self, tag: str) -> bool:
        return (self.open_blocks if tag in BLOCKS else self.inline[-1])[tag] > 0

    def close(self, tag: str) -> None:
        """Close elements up to the last ``tag``, which is open."""
        while True:
            last = self.pop()
            if last.tag in BLOCKS:
                self.blocks.pop()
                self.open_blocks[last.tag] -= 1
                self.inline.pop()
            else:
                self.inline[-1][last.tag] -= 1
            if last.tag == tag:
                return


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of text in order, with white space as single spaces and character references decoded."""
    page = _BREAKS.sub("<p>", page)
    stack = _Stack()
    blocks: list[Block] = []
    parts: list[str] = []
    links, blank, own = 0, True, False
    holder = stack[0]

    def end() -> None:
        nonlocal links, blank, own
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            # A line that is all in a button, a label or an element with such a name is one; a line with text of its own keeps them.
            put_out = holder.outside or holder.header and not holder.heading or not own and not stack.has("pre")
            blocks.append(Block(text, links, holder.inside, put_out, holder.heading))
        parts.clear()
        links, blank, own = 0, True, False

    def add(raw: str) -> None:
        nonlocal links, holder, blank, own
        if not raw:
            return
        top = stack[-1]
        text = html_lib.unescape(raw) if "&" in raw else raw
        if blank:
            holder = top
            blank = text.isspace()
        parts.append(text)
        own = own or not top.aside and not text.isspace()
        if top.link:
            links += len(text.strip())

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            if m[1]:  # what stands around a script or the like is still one block
                parts.append("" if m[1].lower() not in ("title", "option", "select", "textarea") else " ")
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCKS:
            end()
        if m[2]:
            if stack.has(tag):
                if tag not in BLOCKS and stack[-1].tag == tag and stack[-1].outside != stack[-2].outside:
                    end()
                stack.close(tag)
        elif tag not in VOID and not m[4].endswith("/"):
            if tag in BLOCKS and stack.blocks and stack.blocks[-1].tag in _CLOSES.get(tag, {"p"}):
                stack.close(stack.blocks[-1].tag)
            new = _traits(tag, m[4], stack[-1], tag not in BLOCKS and bool(stack.blocks) and stack.blocks[-1].tag in RUNNING)
            if tag not in BLOCKS and new.outside != stack[-1].outside:
                end()
            stack.open(new)
    add(page[at:])
    end()
    return blocks


def _stop_shares(blocks: list[Block]) -> list[float]:
    """The share of stop words of each block. Where the page's longer blocks show that it is in none of the lists' languages, length alone tells: long blocks count as full of them, others as undecided."""
    counts = []
    for b in blocks:
        words = re.findall(r"\w+", b.text.lower())
        counts.append((sum(w in STOP_WORDS for w in words), len(words)))
    long = [c for b, c in zip(blocks, counts, strict=True) if not b.outside and not b.heading and b.size >= SHORT and b.link_chars <= MANY_LINKS * len(b.text)]
    if long and sum(s for s, _ in long) < LOW_STOPS * sum(n for _, n in long):
        return [HIGH_STOPS if b.size > LONG else LOW_STOPS for b in blocks]
    return [s / max(n, 1) for s, n in counts]


def judge(blocks: list[Block]) -> None:
    """Both passes: sets ``good`` of every block. Inside an article's element only place makes a block bad at once; links and few stop words leave it undecided."""
    for b, stops in zip(blocks, _stop_shares(blocks), strict=True):
        density = b.link_chars / max(len(b.text), 1)
        if b.outside or density > MANY_LINKS and not b.inside:
            b.good = False
        elif b.heading or b.size < SHORT or density > MANY_LINKS:
            b.good = None
        elif stops >= HIGH_STOPS or b.inside and stops >= LOW_STOPS:
            b.good = True
        elif b.size > LONG and stops >= LOW_STOPS:
            b.good = True
        elif stops < LOW_STOPS and not b.inside:
            b.good = False
    # The article's element is believed unless it holds little of what the first pass found good.
    inside = sum(len(b.text) for b in blocks if b.good and b.inside)
    found = sum(len(b.text) for b in blocks if b.good)
    if any(b.inside and not b.outside for b in blocks) and inside >= ARTICLE_SHARE * found:
        for b in blocks:
            if not b.inside:
                b.good = False
        # What was put out of the article is no neighbour.
        _settle([b for b in blocks if b.inside and not b.outside], True)
    else:
        _settle(blocks, False)


def _settle(blocks: list[Block], prior: bool) -> None:
    """The second pass: undecided blocks take the label of decided neighbours, ``prior`` if there are none or, in an article, if they differ at the same distance."""
    labels = [b.good for b in blocks]
    decided = [i for i, x in enumerate(labels) if x is not None]
    for i, b in enumerate(blocks):
        if labels[i] is not None:
            continue
        k = bisect(decided, i)
        before, after = decided[k - 1] if k else None, decided[k] if k < len(decided) else None
        if before is None and after is None:
            b.good = prior
        elif after is None or before is None:
            b.good = bool(labels[before if after is None else after])
        elif b.heading:  # a heading goes with what it stands over
            b.good = bool(labels[after])
        elif i - before == after - i:
            b.good = bool(labels[before]) or prior and bool(labels[after])
        else:
            b.good = bool(labels[before if i - before < after - i else after])


def main_text(page: str | None) -> str:
    """The article's blocks, joined by blank lines; empty if there are none."""
    blocks = blocks_of(page or "")
    judge(blocks)
    return "\n\n".join(b.text for b in blocks if b.good)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each row; n_chars counts code points. One pass, no shuffle.

    Null and empty html give an empty text and 0; broken markup is read as far as it
    goes; repeated rows, null ids and null urls are kept row by row; an empty table gives no rows;
    other columns aren't read.
    Text that a style or attribute hides is kept: it is the article's as well.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                texts = [main_text(h.as_py()) for h in part.column(2)]
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.record_batch(columns, names=["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(work, "id long, url string, text string, n_chars long").withColumnRenamed("id", id_col)
