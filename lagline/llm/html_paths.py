"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its root-to-leaf tag path. Menus, headers, footers, sidebars, notices,
adverts, forms and reader comments are told by their elements, roles and class names, and do not count. A name is a whole class
(``sidebar``, ``cookie-notice``, ``topnav``), not any part of one (``has-sidebar``, ``share-price``). Headings are never told by their names, nor sections
of an article by their id. Such an element counts after all if it holds the page's ``<main>`` or the ``<article>`` with over half of the page's
sentences, and a form, widget or search area also if it holds over half of all sentences itself. Over the other blocks, length of the text outside links and punctuation are aggregated per path of tags
and classes and divided by the path's number of blocks; the two ratios are fused (geometric mean), then fused again with their mean over neighbouring blocks, and
blocks whose score is above zero and reaches a share of its standard deviation are content nodes. Paths of short, unpunctuated labels and of links fall out, paths of prose stay.
The article is the ``<article>`` with over half of the content text. Elsewhere it grows from the smallest container that holds nearly all content text to all that stands around it, up to
the ``<main>`` part if that holds as much: to the smallest container around it with all headings, paragraphs, sentences and content. Everything there
that is not boilerplate is kept, short lines too, but for blocks that are no content nodes and whose path is mostly links (menus, tag lists, teasers under any
name; headings and plain paragraphs are none). Beside the first container, parts that are mostly links are boilerplate as well. A page whose blocks are all links keeps them.

Character references are decoded, white space inside a block becomes one space, blocks are joined by a line feed. ``<br>`` is white space.
Unclosed and misnested tags, cut-off pages and raw text elements are handled like browsers do, in short. Null or empty html
gives an empty text, and so does a page without content. Repeated rows and null ids or urls are kept as they are; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagline.llm.scratch import bound_batches

# Share of the standard deviation that a block's smoothed score must reach.
THRESHOLD = 0.5
# Share of the content text that the container must hold from which the article grows.
HELD = 0.9
# Characters from which a content block is no label.
LABEL = 40

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
      | <(script|style|noscript|template|textarea|title|iframe|svg|xmp)\b(?:[^>"']|"[^"]*"|'[^']*')*+>.*?(?:</\1[^>]*>|\Z)
      | <(/?)([a-z][a-z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)
      | <[!?/][^>]*(?:>|\Z)
      | <(/?)([a-z][a-z0-9:-]*)([^>]*)(?:>|\Z)""", re.S | re.I | re.X)
_MARKS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_PUNCTUATION = re.compile(r"""[,.;:!?'"()、。，！？；：…-]""")

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
_DROPPED = set("nav header footer aside form button select option menu dialog fieldset canvas object audio video map".split())
_CONTAINERS = set("html body main article section div td center".split())
_NEUTRAL = set("html body main article".split())
_CLOSED_BY = {"p": set("p".split()), "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CLOSES_P = set("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())
_BOUNDS = set("ul ol dl table body html article section div td th blockquote".split())

_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
_PROSE = _HEADINGS | set("p pre blockquote figcaption".split())
_SENTENCE = re.compile("[.,;!?。，、！？；…]")

# Class, id and role words of parts that are not the article.
_BOILERPLATE = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies "
    "dialog discussion disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination popup "
    "promo promotion related replies reply search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe toolbar widget widgets".split())


# Words that may stand beside those in the name of such a part.
_BESIDE = set(
    "area article articles bar block bottom box button buttons by col column container content entry foot form global google group head icons info inner item items law left level "
    "link links list lists main mobile nested outer page panel policy post posts primary respond right secondary section site slot stories story sub text thread title tools top trail "
    "unit wrap wrapper".split())
# Words before the name of a part that make it a trait of what holds the part.
_TRAITS = set("has hide is no not show with without".split())
# A name in one piece, such as ``topnav``.
_COMPOUND = re.compile(f"(?:{'|'.join(sorted(_BOILERPLATE | _BESIDE, key=len, reverse=True))})+")
# Ids of sections outside the article. Within it, and for other words, an id is an anchor of prose.
_SECTION_IDS = set("comments disqus sidebar footer header nav navigation navbar menu cookies".split())
# Parts that are reader comments or consent, where an <article> is one of theirs.
_REPLIES = set("comment comments consent cookie cookies discussion disqus reply replies".split())
# Parts that may well wrap the article, and those that show nothing of what is in them.
_WRAPPING = set("form fieldset login notice notices search signup toolbar widget widgets".split())
_UNSEEN = set("button select option canvas object audio video map".split())


def _pieces(word: str) -> list[str]:
    """The known words that make up ``word``, else the word itself."""
    if word in _BOILERPLATE or word in _BESIDE or not _COMPOUND.fullmatch(word):
        return [word]
    cuts: dict[int, list[str]] = {0: []}
    for stop in range(1, len(word) + 1):
        for start in [c for c in cuts if word[c:stop] in _BOILERPLATE or word[c:stop] in _BESIDE]:
            cuts.setdefault(stop, [*cuts[start], word[start:stop]])
    return cuts[len(word)]


def _named(name: str) -> set[str]:
    """The boilerplate words of one class name or id, if it names such a part: as its last word, or beside words of layout only."""
    words = [piece for w in _WORDS.findall(name) for piece in _pieces(w.lower())]
    own = set(words) & _BOILERPLATE
    if not own or _TRAITS.intersection(words):
        return set()
    return own if words[-1] in own or all(w in _BESIDE or w.isdigit() for w in words if w not in own) else set()


def _barred(tag: str, attributes: str, inside: bool) -> set[str]:
    """What tells the element as boilerplate; ``inside``: within an article or main part."""
    why = {tag} & _DROPPED
    if tag in _NEUTRAL or tag in _HEADINGS or "=" not in attributes:
        return why
    marks = [(m[1].lower(), (m[2] or m[3] or m[4] or "").split()) for m in _MARKS.finditer(attributes)]
    section = tag == "section" or any(kind == "class" and "section" in names for kind, names in marks)
    for kind, names in marks:
        for name in names:
            if kind == "id" and section:
                why |= {name.lower()} & _SECTION_IDS if not inside else set()
            else:
                why |= _named(name)
    return why


def _classes(attributes: str) -> str:
    """Class names for the tag path; those of numbered elements are one."""
    found = next((m for m in _MARKS.finditer(attributes) if m[1].lower() == "class"), None) if "=" in attributes else None
    names = sorted((found[2] or found[3] or found[4] or "").split()) if found else []
    return "".join("." + re.sub(r"[\d/.]+", "0", name) for name in names)


class _Page:
    """Blocks of one page: text, path, chain of container numbers; beside them, the numbers of the barred elements around each."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, str, tuple[int, ...]]] = []
        self.within: list[tuple[int, ...]] = []
        self.stack: list[tuple[str, bool, str]] = []  # tag, barred, tag and classes
        self.chain: list[int] = []
        self.containers: list[str] = []
        self.around: list[tuple[int, ...]] = []  # barred elements around each container
        self.bars: list[set[str]] = []  # what tells each barred element
        self.barred: tuple[int, ...] = ()
        self.parts: dict[tuple[int, ...], list[str]] = {}
        self.linked: list[int] = []  # characters of each block in links
        self.links = 0
        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                self.text(source[at : m.start()])
            at = m.end()
            tag = (m[3] or m[6] or "").lower()
            if m[1]:
                self.flush() if m[1].lower() not in _INLINE else None
            elif tag and tag != "head":  # what shows in a head is in the body already
                (self.end if m[2] or m[5] else self.begin)(tag, m[4] or m[7] or "")
        self.text(source[at:])
        self.flush()
        self.open()

    def text(self, raw: str) -> None:
        self.parts.setdefault(self.barred, []).append(raw)
        if any(tag == "a" for tag, *_ in self.stack[-4:]):
            self.links += len(raw.strip())

    def flush(self) -> None:
        for bars, parts in self.parts.items():
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                self.blocks.append((text, "/".join(label for t, _, label in self.stack if t not in _INLINE), tuple(self.chain)))
                self.within.append(bars)
                self.linked.append(min(self.links, len(text)))
        self.parts, self.links = {}, 0

    def open(self) -> None:
        """Keep the blocks that no barred element holds, once those around the article count no more."""
        if self.bars:
            opened = self.opened()
            kept = [i for i, bars in enumerate(self.within) if opened.issuperset(bars)]
            self.blocks, self.linked = [self.blocks[i] for i in kept], [self.linked[i] for i in kept]

    def opened(self) -> set[int]:
        """Barred elements that hold the article."""
        seen = [i for i, bars in enumerate(self.within) if not any(self.bars[b] & _UNSEEN for b in bars)]
        size = {i: len(self.blocks[i][0]) * bool(_SENTENCE.search(self.blocks[i][0])) for i in seen}
        ours = [i for i in seen if not any(self.bars[b] & _REPLIES for b in self.within[i])]
        mass, filled = [0] * len(self.containers), set()
        for i in ours:
            for c in self.blocks[i][2]:
                mass[c] += size[i]
        for i in seen:
            filled.update(self.blocks[i][2])
        total, out = sum(size[i] for i in ours), set()
        for c, tag in enumerate(self.containers):
            if tag == "main" and c in filled or tag == "article" and 2 * mass[c] > total:
                out.update(self.around[c])
        wraps = {b for b, why in enumerate(self.bars) if why <= _WRAPPING} - out
        held, total = dict.fromkeys(wraps, 0), 0
        for i in ours:
            if all(b in out or b in wraps for b in self.within[i]):
                total += size[i]
                for b in wraps.intersection(self.within[i]):
                    held[b] += size[i]
        return out | {b for b, n in held.items() if 2 * n > total}

    def pop(self) -> None:
        tag, barred, _ = self.stack.pop()
        if barred:
            self.barred = self.barred[:-1]
        if tag in _CONTAINERS:
            self.chain.pop()

    def close(self, tags: set[str]) -> None:
        """End an open element of ``tags``, unless a boundary lies between."""
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] in tags:
                while len(self.stack) > depth:
                    self.pop()
                return
            if self.stack[depth][0] in _BOUNDS:
                return

    def begin(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.text(" ")
            return
        if tag not in _INLINE:
            self.flush()
        if tag in _CLOSES_P:
            self.close({"p"})
        if tag in _CLOSED_BY:
            self.close(_CLOSED_BY[tag])
        if tag in _VOID or attributes.endswith("/") and tag not in _CONTAINERS:
            return
        why = _barred(tag, attributes, any(self.containers[c] in ("article", "main") for c in self.chain))
        self.stack.append((tag, bool(why), tag + _classes(attributes) if tag not in _INLINE else tag))
        if why:
            self.barred += (len(self.bars),)
            self.bars.append(why)
        if tag in _CONTAINERS:
            self.containers.append(tag)
            self.around.append(self.barred)
            self.chain.append(len(self.containers) - 1)

    def end(self, tag: str, _: str) -> None:
        if tag not in _INLINE:
            self.flush()
        if any(t == tag for t, *_ in self.stack):
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop()


def block_scores(blocks: list[tuple[str, str, tuple[int, ...]]], linked: list[int]) -> np.ndarray:
    """Fused and smoothed path ratio of every block; ``linked``: characters of each block in links."""
    totals: dict[str, list[int]] = {}
    for (text, path, _), links in zip(blocks, linked):
        t = totals.setdefault(path, [0, 0, 0])
        t[0], t[1], t[2] = t[0] + 1, t[1] + len(text) - links, t[2] + len(_PUNCTUATION.findall(text))
    ratio = {path: ((length / n) * (1 + marks / n)) ** 0.5 for path, (n, length, marks) in totals.items()}
    raw = np.array([ratio[path] for _, path, _ in blocks])
    kernel = np.array([1.0, 2.0, 4.0, 2.0, 1.0])
    weights = np.convolve(np.ones(len(raw)), kernel)[2:-2]
    return np.sqrt(raw * np.convolve(raw, kernel)[2:-2] / weights)


def _links(page: _Page, content: np.ndarray) -> np.ndarray:
    """Blocks that are no content nodes and whose path is mostly links."""
    totals: dict[str, list[int]] = {}
    for (text, path, _), links in zip(page.blocks, page.linked):
        t = totals.setdefault(path, [0, 0])
        t[0], t[1] = t[0] + len(text), t[1] + links
    mostly = {path for path, (length, links) in totals.items() if 2 * links > length}
    plain = lambda leaf: leaf in _PROSE or leaf.partition(".")[0] in _HEADINGS
    return np.array([path in mostly and not plain(path.rpartition("/")[2]) for _, path, _ in page.blocks]) & ~content


def main_text(source: str | None) -> str:
    """The article of one page."""
    page = _Page(source or "")
    if not page.blocks:
        return ""
    scores = block_scores(page.blocks, page.linked)
    content = (scores > 0) & (scores >= THRESHOLD * scores.std())
    links = _links(page, content)
    if not content.any():
        content[:], links[:] = True, False
    mass = np.zeros(len(page.containers) + 1)
    total = 0
    for (text, _, chain), good in zip(page.blocks, content):
        if good:
            total += len(text)
            for c in chain:
                mass[c] += len(text)
    articles = [c for c, tag in enumerate(page.containers) if tag == "article" and 2 * mass[c] > total]
    held = articles[-1:] or [c for c in range(len(page.containers)) if mass[c] >= HELD * total][-1:]
    if not held:
        return "\n".join(text for text, _, _ in page.blocks)
    kept = [held[0] in chain for _, _, chain in page.blocks]
    if not articles:
        _grow(page, content, held[0], [c for c, tag in enumerate(page.containers) if tag == "main" and mass[c] >= HELD * total], kept)
    return "\n".join(text for (text, _, _), keep, link in zip(page.blocks, kept, links) if keep and not link)


def _grow(page: _Page, content: np.ndarray, held: int, mains: list[int], kept: list[bool]) -> None:
    """Mark as ``kept`` what stands around the container ``held``, as far as anything there reads as text, but for parts of links."""
    chain = next(chain for _, _, chain in page.blocks if held in chain)
    above = chain[: chain.index(held)]
    if mains:
        above = above[above.index(mains[-1]) :] if mains[-1] in above else ()
    # a part: a container beside those around ``held``, or the blocks of one path right inside one of these
    parts: dict[tuple, list[int]] = {}
    for i, (_, path, own) in enumerate(page.blocks):
        if not kept[i] and (not mains or above and above[0] in own):
            shared = next((d for d, (x, y) in enumerate(zip(own, chain)) if x != y), min(len(own), len(chain)))
            parts.setdefault((shared, own[: shared + 1], "" if len(own) > shared else path), []).append(i)
    told = {key: part for key, part in parts.items() if 2 * sum(page.linked[i] for i in part) < sum(len(page.blocks[i][0]) for i in part)}
    reach = min((key[0] for key, part in told.items() if any(_reads(page.blocks[i], content[i]) for i in part)), default=len(chain))
    for key, part in told.items():
        if key[0] >= reach:
            for i in part:
                kept[i] = True


def _reads(block: tuple[str, str, tuple[int, ...]], content: bool) -> bool:
    """A heading, a paragraph, a sentence or long content, unlike a label."""
    text, path, _ = block
    return path.rpartition("/")[2].partition(".")[0] in _PROSE or bool(_SENTENCE.search(text)) or content and len(text) >= LABEL


def _extract(batches):
    for batch in batches:
        texts = [main_text(source) for source in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract_articles(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``."""
    bound_batches(pages.sparkSession)
    plain = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return plain.mapInArrow(_extract, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
