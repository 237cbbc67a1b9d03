"""HTML extraction by the maximum-scoring subsequence.

A page is a sequence of words and tags. A word in running text scores positive, a word in a link or in a container that
is no article (menus, footers, forms, adverts, comments ...) and a tag score negative, with weights that a logistic
regression learns from labelled pages. One linear scan finds the contiguous region with the highest sum. The region is
widened to the innermost container that holds all of it, below the body, and to the article around that, so that a short first
or last block is not cut.

A container can be marked by its tag or as hidden, or only by a name (class, id, role). A name is a hint: it does not hold for
headings, for the first article of a page, nor beside a name of content; inside an article, a name of little weight (``related``,
``more`` ...) does not hold for text that scores like running text; and where the text under a name outweighs all other text by
far, the name is passed over. All passes over a page take time in proportion to its length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import labelled_pages
from .common import small_batches

#: Element names by their part in a page. What is in a RAW element is no markup, up to the end of the page if it is never closed.
RAW = "script style textarea title"
#: Dropped with all they hold where they are closed; svg can close itself.
DROPPED = frozenset("template noscript iframe object svg select canvas audio video annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mrow mtext msub msup msubsup mfrac msqrt mroot mover munder munderover mspace mstyle semantics".split())
BOILER_TAGS = frozenset("nav footer aside button dialog menu head fieldset input datalist".split())
#: Words of class, id or role that name a container without article text.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adv banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar side aside widget widgets rail "
    "footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay comment comments commentlist reply replies respond disqus discussion share sharing social "
    "related recommended recommendations more newsletter subscribe subscription signup login search form skip copyright legal disclaimer meta tags byline contentinfo complementary teaser".split()
)
#: Those of them that sections of an article bear too.
WEAK_WORDS = frozenset("alert copyright discussion legal meta more notice notices recommended recommendations related share sharing side skip social tags".split())
#: A name that ends in one of these, without a word of BOILER_WORDS, is content; a name that begins with a modifier says what is beside or absent.
CONTENT_WORDS = frozenset("article body content entry hentry main post story".split())
MODIFIERS = frozenset("with without no not has is".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks of text, which hold no other part of a page.
TEXT_BLOCKS = HEADINGS | INLINE | frozenset("p li ul ol dl dt dd blockquote pre figure figcaption".split())
#: Names of what readers say, which can be longer than the article.
TALK_WORDS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
#: Text under a name is the article if it scores so many times what the best other region does, after so much for the name itself; more if readers speak.
NAME_FACTOR, TALK_FACTOR, NAME_COST = 4, 32, 16
#: Tags that never end may be searched for so often; after that, any > ends a tag.
OPEN_TAGS = 16
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{'|'.join(RAW.split())})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_PLAIN_TAG = re.compile(r"(?P<raw>(?!))?<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>]*+)>|<[!?/][^>]*(?:>|\Z)")
ATTR = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_ELEMENT = r"<!--.*?-->|<(script|style|textarea)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?<!/)>.*?</\1\s*>"
TOP = ("", "html", "body")
KINDS = ("word", "link_word", "boiler_word", "block_tag", "inline_tag", "boiler_tag")
WORD, LINK, BOILER, BLOCK_TAG, INLINE_TAG, BOILER_TAG = range(len(KINDS))


@lru_cache(maxsize=4096)
def _marks(attrs: str) -> tuple[bool, bool, bool, bool]:
    """Whether attributes hide an element, whether they name it as one without article text, whether only by names of little weight, and whether readers speak there."""
    named = content = strong = talk = False
    for name, a, b, c in ATTR.findall(attrs):
        value, name = a or b or c, name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True, False, False, False
        if name in ("class", "id", "role"):
            for part in value.split():
                words = [p.lower() for p in PARTS.findall(part)]
                if len(words) > 1 and words[0] in MODIFIERS:
                    continue
                if len(words) > 1 and words[0] in CONTENT_WORDS and words[-1] in ("head", "header"):
                    content = True  # the head of an article, not of the page
                elif not BOILER_WORDS.isdisjoint(words):
                    named = True
                    talk = talk or not TALK_WORDS.isdisjoint(words)
                    strong = strong or not BOILER_WORDS.isdisjoint(set(words) - WEAK_WORDS)
                elif words and words[-1] in CONTENT_WORDS:
                    content = True
    return False, named and not content, not strong, talk


def _closed(page: str, name: str) -> dict[int, int]:
    """End of the closing tag by the end of the opening tag, for the elements of a name that are closed."""
    ends, opened = {}, []
    for m in re.finditer(rf"{_RAW_ELEMENT}|<(/?){name}(?=[\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", page[: page.rfind(">") + 1], re.S | re.I):
        if m[2] == "" and not (name in ("svg", "math") and m[3].endswith("/")):
            opened.append(m.end())
        elif m[2] and opened:
            ends[opened.pop()] = m.end()
    return ends


class Tree:
    """A page's elements in the order in which they open; element 0 is the page, and those below an element follow it."""

    def __init__(self):
        self.parent, self.name, self.last = [-1], [""], [0]
        #: In a container by its tag, or hidden; the innermost element around, or itself, that is marked by a name (0 for none); in a link; in an article.
        self.hard, self.named, self.link, self.article = [False], [0], [False], [False]
        #: Named elements inside an article whose names are of little weight.
        self.weak: set[int] = set()
        #: Elements in which readers speak.
        self.talk: set[int] = set()

    def add(self, parent: int, name: str, hard: bool, named: int) -> int:
        e = len(self.parent)
        for row, value in ((self.parent, parent), (self.name, name), (self.last, e), (self.hard, hard), (self.named, named), (self.link, self.link[parent] or name == "a"), (self.article, self.article[parent] or name in ("article", "main"))):
            row.append(value)
        return e

    def close(self) -> None:
        """Settle the last element below each, and let the page, html and body have no parent."""
        for e in range(len(self.parent) - 1, 0, -1):
            p = self.parent[e]
            self.last[p] = max(self.last[p], self.last[e])
        self.parent = [-1 if n in TOP else p for n, p in zip(self.name, self.parent, strict=True)]


def tokens(page: str) -> Iterator[tuple[str, re.Match | None]]:
    """The texts between tags, and the tag (or comment, or raw element) behind each; None behind the last text.

    ``send`` a place in the page to go on from there.
    """
    at = look = opened = 0
    final = page.rfind(">")
    while (i := page.find("<", look)) >= 0:
        m = (_PLAIN_TAG if opened > OPEN_TAGS else TOKEN).match(page, i) if i < final or page.startswith(("<!", "<?", "</"), i) else None
        if m is None:  # a sign, or a tag that never ends
            opened += page[i + 1 : i + 2].isalpha()
            look = i + 1
            continue
        jump = yield page[at:i], m
        at = look = m.end() if jump is None else jump
        if jump is not None:
            yield "", None
    yield page[at:], None


def parse(page: str, spared: frozenset[int] = frozenset(), under: dict[int, list[tuple[int, int]]] | None = None) -> tuple[list[tuple[int, int, int, str]], Tree]:
    """Events (kind, words, element, text) in page order, and the tree of elements.

    A tag has no words; its text is a blank if it parts blocks. Tags that are never closed end with what holds them.
    Names of the elements in ``spared`` are passed over. ``under`` takes, by the innermost named element, the (kind, words)
    that its words and tags would have without any name.
    """
    events: list[tuple[int, int, int, str]] = []
    tree, stack, open_names, articles = Tree(), [0], Counter(), 0
    closed: dict[str, dict[int, int]] = {}
    found = tokens(page)
    for text, m in found:
        here = stack[-1]
        if text:
            text = html.unescape(text)
            kind, n = LINK if tree.link[here] else WORD, len(text.split())
            events.append((BOILER if tree.hard[here] or tree.named[here] else kind, n, here, text))
            if under is not None and tree.named[here] and not tree.hard[here]:
                under.setdefault(tree.named[here], []).append((kind, n))
        if m is None or not m["name"]:
            continue
        name, attrs = m["name"].lower(), m["attrs"]
        # A formula belongs to the text around it; one that stands by itself in the body is no article.
        if (name in DROPPED or name == "math" and tree.name[here] in TOP) and not m["close"]:
            if name not in closed:
                closed[name] = _closed(page, name)
            if m.end() in closed[name] or name in ("svg", "math") and attrs.endswith("/"):
                found.send(closed[name].get(m.end(), m.end()))
                continue
        inline = name in INLINE
        if m["close"]:
            if open_names[name]:
                while True:
                    gone = tree.name[stack.pop()]
                    open_names[gone] -= 1
                    if gone == name:
                        break
            bad, mark = tree.hard[here], tree.named[here]
        else:
            new = len(tree.parent)
            hides, names_it, weak, talk = _marks(attrs) if attrs and name not in ("html", "body", "main") else (False, False, False, False)
            # A form can hold a page, as some servers wrap all of it in one; so it is a mark like a name, which an article inside lifts.
            names_it = names_it or name == "form"
            bad = tree.hard[here] or name in BOILER_TAGS or hides or name == "header" and not tree.article[here]
            mark = tree.named[here]
            if mark and tree.name[mark] == "form" and name in ("article", "main") and not names_it:
                mark = 0
            if names_it and name not in HEADINGS and new not in spared and (name != "article" or articles):
                mark = new
            articles += name == "article" and not mark and not bad
            if name not in VOID and not attrs.rstrip().endswith("/"):
                tree.add(here, name, bad, mark)
                if mark == new and talk:
                    tree.talk.add(new)
                if mark == new and weak and name != "form" and tree.article[here]:
                    tree.weak.add(new)
                stack.append(new)
                open_names[name] += 1
        kind = INLINE_TAG if inline else BLOCK_TAG
        events.append((BOILER_TAG if bad or mark else kind, 0, stack[-1], "" if inline else " " if name == "br" else "\n"))
        if under is not None and mark and not bad and mark < len(tree.parent):
            under.setdefault(mark, []).append((kind, 0))
    tree.close()
    return events, tree


@lru_cache(maxsize=1)
def weights() -> tuple[float, ...]:
    """Learned from the labelled pages: a logistic regression on the kind of each word and tag; no kind but plain words scores above zero."""
    kinds, inside = [], []
    for page in labelled_pages.pages():
        for label, part in page:
            for kind, n, _, _ in parse(part)[0]:
                kinds += [kind] * max(n, kind >= BLOCK_TAG)
                inside += [label] * max(n, kind >= BLOCK_TAG)
    x, y = np.eye(len(KINDS))[kinds], np.array(inside, float)
    w = np.zeros(len(KINDS))
    for _ in range(300):
        p = 1 / (1 + np.exp(-x @ w))
        w += 2.0 * (x.T @ (y - p) / np.maximum(x.sum(0), 1) - 0.01 * w)
    score = w / max(w[WORD], 0.1)
    score[WORD] = 1.0
    score[LINK], score[BOILER] = min(score[LINK], -0.2), min(score[BOILER], -0.5)
    # Two tags stand around a block; a block of one word has to pay for both.
    score[BLOCK_TAG], score[INLINE_TAG], score[BOILER_TAG] = -min(max(abs(score[BLOCK_TAG]), 0.1), 0.4), -min(max(abs(score[INLINE_TAG]), 0.05), 0.1), min(score[BOILER_TAG], -0.5)
    return tuple(score.tolist())


def _best(score: tuple[float, ...], steps: Iterable[tuple[int, int]]) -> tuple[float, int, int]:
    """The highest sum of a contiguous region of (kind, words), and its ends."""
    best, low, high, total, start = 0.0, 0, 0, 0.0, 0
    for i, (kind, n) in enumerate(steps):
        total += score[kind] * (n if kind < BLOCK_TAG else 1)
        if total > best:
            best, low, high = total, start, i + 1
        elif total <= 0:
            total, start = 0.0, i + 1
    return best, low, high


def main_text(page: str | None, score: tuple[float, ...] | None = None) -> str:
    """The article's text; empty for an empty or null page, or one without a word outside other containers. Of equal regions the first counts."""
    if not page:
        return ""
    score = score or weights()
    spared: frozenset[int] = frozenset()
    while True:
        under: dict[int, list[tuple[int, int]]] = {}
        events, tree = parse(page, spared, under)
        parents = tree.parent
        # What scores like running text inside an article is part of it, if only a name of little weight speaks against it.
        running = {e for e in tree.weak if _best(score, under.get(e, ()))[0] >= NAME_COST}
        if running:
            spared |= running
            continue
        best, low, high = _best(score, (e[:2] for e in events))
        rivals = ((_best(score, steps)[0] - NAME_COST, TALK_FACTOR if e in tree.talk else NAME_FACTOR, e) for e, steps in under.items())
        _, e = max(((s, e) for s, factor, e in rivals if s > factor * best), default=(0.0, 0))
        if not e:
            break
        # Names of the elements around it, too; each round spares one more at least.
        around = set()
        while e > 0:
            around.add(e)
            e = parents[e]
        spared |= around
    if not high:
        return ""

    holder = None  # the innermost element that holds the whole region
    for kind, n, e, _ in events[low:high]:
        if kind == WORD and n:
            holder = e if holder is None else holder
            while holder >= 0 and not holder <= e <= tree.last[holder]:
                holder = parents[holder]
    below = holder is not None and holder >= 0 and parents[holder] >= 0
    while below and parents[parents[holder]] >= 0 and (tree.name[holder] in TEXT_BLOCKS or tree.article[parents[holder]] and tree.name[holder] not in ("article", "main")):
        holder = parents[holder]
    if below:
        inside = [holder <= e <= tree.last[holder] for _, _, e, _ in events]
    else:
        inside = [low <= i < high for i in range(len(events))]
    blocks, block = [], []
    for (kind, _, _, text), keep in zip(events, inside, strict=True):
        if text == "\n" and kind >= BLOCK_TAG:
            blocks.append("".join(block))
            block = []
        elif keep and kind not in (BOILER, BOILER_TAG):
            block.append(text)
    blocks.append("".join(block))
    return " ".join(t for t in (" ".join(b.split()) for b in blocks) if t)


def _extract(score: tuple[float, ...], batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p, score) for p in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names[:2], "text", "n_chars"])


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each page row, without a shuffle; the whole html is read.

    Null and empty html give an empty text; malformed html is read as far as tags can be told. Repeated rows, null ids and
    urls give a row each; other columns, and their names, do not matter; an empty table gives an empty result.
    """
    small_batches(pages.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    score = weights()
    return pages.select(id_col, url_col, html_col).mapInArrow(lambda b: _extract(score, b), f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
