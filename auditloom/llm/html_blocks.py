"""Main text of web pages from flat text blocks.

A page is cut into flat blocks; each has its word count, its link density, and those
of the blocks before and after it.  A decision tree trained on the small table of
labelled pages below says which blocks belong to the article.  Its upper levels
look at word counts and link densities only; what its surroundings say of a block
(inside an article, inside a marked part, a heading) may settle only what these
levels leave mixed.

Tags are read in one pass, in time linear in the page, with quotes, comments and
raw-text elements as the HTML standard has them (so what follows a quoted value,
comment or script that never ends belongs to it).

Defined cases: null and empty html give an empty text, and so does an empty table an
empty result; pages of any length are read whole; unclosed and stray tags are
repaired (a block tag ends an open paragraph, an unknown end tag is ignored); rows
that repeat are extracted each by itself; a block whose leaf is tied between both
labels is kept.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Word counts and link densities come first, hints of tags and class names after them.
DENSITIES = ("words", "link_density", "prev_words", "prev_link_density", "next_words", "next_link_density")
HINTS = ("article", "beside", "page_has_article", "heading")
FEATURES = DENSITIES + HINTS

# Labelled pages.  A number stands for so many words of text; the first number of a
# block carries the label: + for article text, - for anything else.
LABELLED_PAGES = (
    # pages of the common kind: menu, advert, article, footer
    "<nav><ul><li><a>-1</a><li><a>-1</a><li><a>-1</a><li><a>-1</a></ul></nav><div class=ad>-8</div><article><h1>+8</h1><p>+8<br><p>+28<p>+41<p>+3<p>+71<p>+9<br><p>+1<p>+30</article><footer>-9</footer>",
    "<nav><ul><li><a>-1</a><li><a>-1</a><li><a>-1</a></ul></nav><div class=ad>-12</div><article><h1>+12</h1><p>+31<br><p>+22<p>+96<p>+64</article><footer>-7</footer>",
    "<nav><a>-1</a><a>1</a><a>1</a></nav><div class=ad>-5</div><article><h1>+5</h1><p>+5<br><p>+1<p>+2<p>+1<p>+160<p>+4</article><footer>-13</footer>",
    "<nav><ul><li><a>-2</a><li><a>-1</a></ul></nav><div class=ad>-19</div><article><h1>+2</h1><p>+2<br><p>+12<p>+1</article><footer>-10</footer>",
    "<nav><ul><li><a>-1</a><li><a>-1</a></ul></nav><div class=ad>-7</div><article><h1>+1</h1><p>+1</article><footer>-6</footer>",
    # a magazine: teasers, share bar, pull quote, related stories, comments, newsletter
    "<header><a>-3</a><ul><li><a>-1</a><li><a>-2</a><li><a>-1</a></ul></header><div class=cookie-consent><p>-34<button>-2</button></div><main><article class='post has-sidebar'><h1>+9</h1><div class=byline>+4</div><p>+62<p>+48 <a>4</a> 20"
    "<div class=share-buttons><a>-1</a><a>1</a></div><h2>+4</h2><p>+85<blockquote>+14</blockquote><ul><li>+6<li>+9<li>+5</ul><figure><figcaption>+8</figcaption></figure><p>+57<aside class=related><h3>-3</h3><ul><li><a>-8</a><li><a>-7</a></ul></aside>"
    "<p>+33<form class=newsletter><label>-6</label><button>-1</button></form></article><section id=comments><h3>-2</h3><article class=comment><p>-31</article><article class=comment><p>-64</article><article class=comment><p>-9</article></section></main>"
    "<aside><h3>-2</h3><p>-22<ul><li><a>-6</a><li><a>-5</a></ul></aside><footer><p>-18<a>-2</a><a>2</a></footer>",
    # a blog of plain divisions
    "<div id=header><a>-4</a></div><div id=menu><a>-1</a> <a>1</a> <a>1</a></div><div class=post><h2>+6</h2><p>+44<p>+71<p>+5<pre>+22</pre><p>+38 <a>2</a> 9</div><div class=sidebar><h4>-2</h4><p>-27<a>-3</a><br><a>-2</a></div><div class=comments><p>-41<p>-18</div><div id=footer>-12</div>",
    "<div class=navbar><ul><li><a>-1</a><li><a>-1</a><li><a>-1</a></ul></div><div class=entry><h1>+7</h1><p>+52<p>+61<p><a>+7</a><p>+45<table><tr><td>+2<td>+1<tr><td>+3<td>+1</table><p>+28</div><div class=advert>-25</div><div class=copyright>-9</div>",
    # pages without any mark: word counts and links alone
    "<div><a>-1</a> <a>1</a> <a>2</a> <a>1</a></div><div><h1>+6</h1><p>+55<p>+42<p>+3<p>+67</div><div><a>-3</a> <a>2</a></div><div>-6</div>",
    "<table><tr><td><a>-2</a><br><a>-1</a><br><a>-3</a><td><b>+5</b><p>+80<p>+36<p>+51<p>+12<p>+44</table><p><a>-2</a> <a>2</a><p>-5",
    "<p><a>-2</a> | <a>1</a><p>+24<p>+31<p>+18<p>+66<p><a>-1</a> <a>2</a>",
    "<div>-3</div><div><a>-5</a></div><div><a>-6</a></div><div><a>-4</a></div><div>+38</div><div>+49</div><div><a>-5</a></div><div>-4</div><div><a>-2</a></div>",
    "<p>+70", "<p>+19<p>+26", "<p>+34<p>+2<p>+47<p><a>-1</a>",
    "<h1>+3</h1><p>+47<p>+5<p>+58<hr><p>-4 <a>3</a>",
    # a page of links: nothing to keep
    "<ul><li><a>-4</a><li><a>-6</a><li><a>-3</a><li><a>-9</a></ul><p>-3<p><a>-12</a><p><a>-15</a> 2<p>-2",
    # wrappers whose names mislead
    "<div class=content-with-sidebar><article><h1>+5</h1><p>+39<p>+2<p>+56</article></div><div class=sidebar><p>-21<a>-4</a></div><footer>-8</footer>",
    "<main class='page comments-open'><p>+8<p>+46<p>+35<p>+3</main><footer>-6 <a>1</a></footer>",
    "<form><div class=menu><a>-1</a><a>1</a></div><main><h1>+4</h1><p>+29<p>+73<p>+6</main><div>-7</div></form>",
    "<div class=page-header><h1>-3</h1></div><nav><a>-1</a><a>2</a></nav><main><h2>+5</h2><p>+66<div class=notice><p>-24</div><p>+41<div class='ad sponsored'><p>-30<a>-3</a></div><p>+52</main><footer><p>-40<p>-15</footer>",
    # questions, steps, recipes: many short blocks in an article
    "<header>-2</header><article><h1>+6</h1><p>+21<h2>+1</h2><ul><li>+3<li>+2<li>+4<li>+2</ul><h2>+1</h2><ol><li>+11<li>+9<li>+14</ol><p>+7</article><div class=social><a>-1</a> <a>1</a></div><div>-11</div>",
    "<article><h1>+4</h1><dl><dt>+5<dd>+33<dt>+6<dd>+27<dt>+4<dd>+41</dl><p><a>+9</a><p>+15 <a>8</a></article><aside><p>-55<p>-35</aside><footer>-16</footer>",
    # very short and very long ones
    "<article><p>+3</article>", "<main><p>+4</main>", "<article><h1>+2</h1></article><footer>-4</footer>", "<div class=post><p>+2<p>+3</div>", "<article><p>+1<p>+1<p>+2</article><aside>-2</aside>",
    "<article><h1>+3</h1><p>+400<p>+900</article><footer><p>-120<p>-80</footer>", "<nav><a>-1</a></nav><article>+6</article><div class=comments><p>-150<p>-220</div>", "<div class=cookie>-60</div><article>+4</article>",
    "<article><p>+11<p><a>+6</a><p><a>+3</a> 4<p>+25</article>", "<article><h2><a>+7</a></h2><p>+31<p>+17 <a>12</a></article><nav><a>-9</a><a>7</a></nav>", "<p>-2", "<p>+17", "<p>+33", "<div class=post>+30</div>", "<div class=entry>+9</div>", "<nav><a>-3</a></nav><p>-3", "<footer><p>-33</footer>", "<form><p>-16<p>-4</form>",
    # what is no article text at the end of an article
    "<article><p>+4<div class=share>-1</div><section id=comments><p>-9</section></article>", "<article><h1>+3</h1><p>+40<aside>-12</aside></article>", "<main><p>+25<p>+31<div class=comments><p>-20<p>-44</div></main>",
    "<article><p>+18<form class=newsletter>-7</form></article>", "<article><p>+60<p>+35<div class=share><a>-1</a> <a>1</a></div></article>", "<div class=entry><p>+41<p>+12<div class=related><a>-6</a></div></div>",
    # a long notice and a long advert beside a short article
    "<div class=gdpr><p>-85<p>-40</div><article><h1>+3</h1><p>+14<p>+22</article><div class=promo><h3>-4</h3><p>-60</div><div class=subscribe><p>-28</div><footer>-30</footer>",
)


class Tree:
    """Binary decision tree by Gini impurity; the first ``density_levels`` levels split by DENSITIES only, the next ones by all features, until the labels are told apart or ``depth`` is reached."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, depth: int = 9, density_levels: int = 3, least: int = 1):
        share = labels.mean() if len(labels) else 0.0
        self.value, self.split = bool(share >= 0.5), None
        if depth == 0 or len(labels) < 2 * least or share in (0.0, 1.0):
            return
        best = None
        for j in range(len(DENSITIES) if density_levels > 0 else rows.shape[1]):
            order = np.argsort(rows[:, j], kind="stable")
            x, y = rows[order, j], labels[order]
            left, n = np.cumsum(y)[:-1], len(y)
            k = np.arange(1, n)
            impurity = 2 * (left * (1 - left / k) + (y.sum() - left) * (1 - (y.sum() - left) / (n - k)))
            cuts = np.flatnonzero((x[1:] > x[:-1]) & (k >= least) & (n - k >= least))
            if len(cuts) and (best is None or impurity[cuts].min() < best[0] - 1e-12):
                at = cuts[np.argmin(impurity[cuts])]
                best = (impurity[at], j, (x[at] + x[at + 1]) / 2)
        if best is None:
            return
        _, j, at = best
        below = rows[:, j] <= at
        self.split = (j, at, *[Tree(rows[side], labels[side], depth - 1, density_levels - 1, least) for side in (below, ~below)])

    def predict(self, rows: np.ndarray) -> np.ndarray:
        if self.split is None:
            return np.full(len(rows), self.value)
        j, at, left, right = self.split
        below = rows[:, j] <= at
        out = np.empty(len(rows), dtype=bool)
        out[below], out[~below] = left.predict(rows[below]), right.predict(rows[~below])
        return out

    def by_densities(self, rows: np.ndarray) -> np.ndarray:
        """Which rows are decided without a look at a hint."""
        if self.split is None:
            return np.full(len(rows), True)
        j, at, left, right = self.split
        if j >= len(DENSITIES):
            return np.full(len(rows), False)
        below = rows[:, j] <= at
        out = np.empty(len(rows), dtype=bool)
        out[below], out[~below] = left.by_densities(rows[below]), right.by_densities(rows[~below])
        return out


def labelled_blocks(page: str) -> tuple[list[Block], bool, np.ndarray]:
    """Blocks of a labelled page written out, whether it marks an article, and the label of each block."""
    first = {"+": "kept", "-": "left", "": "w"}
    written = re.sub(r"(?<![\w<])([+-]?)(\d+)(?!\w)", lambda m: first[m[1]] + " w" * (int(m[2]) - 1), page)
    found, has_article = blocks(written)
    return found, has_article, np.array([b.text[0].startswith("kept") for b in found], dtype=np.float64)


#: Each labelled page is also read so many times with other lengths; by how much (as powers of e) they vary with and without marked parts.
VARIANTS, VARY_MARKED, VARY_BARE = 12, 1.2, 0.25


def varied(page: str, rng: np.random.Generator) -> str:
    """A labelled page with all lengths changed at random."""
    most = VARY_MARKED if re.search(r"<(article|main|nav|footer|form)|class=|id=", page) else VARY_BARE
    return re.sub(r"(?<![\w<])\d+(?!\w)", lambda m: str(max(1, round(int(m[0]) * float(np.exp(rng.uniform(-most, most)))))), page)


@lru_cache
def trained() -> Tree:
    """The tree of the labelled pages and their variants."""
    rng = np.random.default_rng(5)
    pages = [labelled_blocks(page) for page in LABELLED_PAGES]
    pages += [labelled_blocks(varied(page, rng)) for _ in range(VARIANTS) for page in LABELLED_PAGES]
    return Tree(np.concatenate([features(f, a) for f, a, _ in pages]), np.concatenate([y for _, _, y in pages]))


# ---------------------------------------------------------------------------
# Tags.

_NAME = r"(?:=[^\s/>=]*+|[^\s/>=]++)"
_VALUE = r"""(?>"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+|)"""
#: A comment, a declaration, or a tag with its attributes; every form ends at the end of the page at the latest, so no place is read twice.
_TOKEN = re.compile(rf"<!--(?:-?>|(?s:.*?)(?:--!?>|\Z))|<[!?][^>]*+>?|</(?![a-zA-Z])[^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?>[\s/]++|{_NAME}(?:\s*+=\s*+{_VALUE})?+)*+)(?:>|\Z)")
_ATTR = re.compile(rf"([^\s/>=]++|=[^\s/>=]*+)(?:\s*+=\s*+({_VALUE}))?+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_END_OF = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>?", re.I) for t in _RAW}
#: Elements whose text is not part of the page; those of the second set end at the next block tag.
_SILENT = frozenset("noscript template object canvas audio video svg math select".split())
_FRAGILE = frozenset("svg math select".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_LIMITS = frozenset("ul ol dl table div section article main body td th".split())

# ---------------------------------------------------------------------------
# Hints.

_BESIDE_TAGS = frozenset("nav footer aside menu dialog button head search".split())
_BESIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Words of class and id names (fixed values): parts that never hold the article, parts
# that may stand round it, parts that are the article, and words that tell a state.
_STRONG_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted nav navbar navigation menu breadcrumb breadcrumbs crumbs footer foot cookie cookies consent gdpr newsletter subscribe subscription related recommended recommendations trending popular comment comments commentlist disqus reply replies respond discussion teaser outbrain taboola".split()
)
_WEAK_WORDS = frozenset(
    "banner sidebar sidebars side rail masthead topbar notice notices notification alert popup modal overlay signup login share sharing social widget widgets toolbar pagination pager copyright legal disclaimer skip search form paywall".split()
)
_HEADER_WORDS = frozenset(("header", "head"))
_ARTICLE_WORDS = frozenset("article articlebody post entry story content maincontent main".split())
#: Words that name a part of something (fixed values): beside a word of the first kind they leave its meaning as it is.
_PART_WORDS = frozenset("area aside bar block body box button card container content count data footer form group head header heading i icon inner input item items label link links list main meta module nav num outer panel part pane post posts row section small text thread title top wrap wrapper".split())
_STATE_WORDS = frozenset("has have with no without not is are open opened closed enabled disabled allow allows layout wrapper wrap container".split())


@dataclass
class Block:
    """A run of text without a block tag inside, and what its surroundings say."""

    text: list[str] = field(default_factory=list)
    link_words: int = 0
    article: int = 0
    beside: int = 0
    heading: bool = False


def _marks(tag: str, attrs: str, in_article: bool) -> tuple[int, int, bool]:
    """How far an element says to stand beside the article (2: never holds it, 1: may stand round it), or to be the article (2: by tag, 1: by name); whether it is hidden."""
    beside = 2 if tag in _BESIDE_TAGS else 1 if tag in ("form", "fieldset") or (tag == "header" and not in_article) else 0
    article, hidden = 2 if tag in ("article", "main") else 0, False
    if attrs and not attrs.isspace():
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'") if value[:1] in "\"'" else value
            if name in ("class", "id", "itemprop"):
                for token in value.split():
                    words = {w.lower() for w in _PART.findall(token)}
                    if words & _STATE_WORDS:
                        words -= _STRONG_WORDS | _WEAK_WORDS | _HEADER_WORDS
                    # an article, or a part of one, may be about comments or promotion: there a name has to speak of nothing else
                    whole = tag == "article" or (tag == "section" and in_article)
                    if words & _STRONG_WORDS and not (whole and words - _STRONG_WORDS - (_PART_WORDS - {"post"} if tag == "article" else _PART_WORDS)):
                        beside = 2
                    elif words & _WEAK_WORDS or (words & _HEADER_WORDS and not in_article and tag not in _HEADINGS and not words & _ARTICLE_WORDS):
                        beside = max(beside, 1)
                    elif tag in ("div", "section") and words & _ARTICLE_WORDS:
                        article = max(article, 1)
            elif name == "role":
                beside = max(beside, 2 * (value.lower() in _BESIDE_ROLES))
                article = max(article, 2 * (value.lower() in ("main", "article")))
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                hidden = True
    if tag in ("html", "body"):
        return 0, 0, False
    return beside, article, hidden


def _inside(around: tuple[int, int], tag: str, attrs: str) -> tuple[int, int]:
    """(article, beside) inside an element, from those around it."""
    article, beside = around
    own, says, hidden = _marks(tag, attrs, article > 0)
    if hidden:
        return 0, 3
    if says and beside < 3 and (tag == "main" or (not own and (beside < 2 if says == 2 else beside < 1))):
        return max(article, says), 0
    if tag == "article" and own == 1:  # its name speaks of what else it holds
        return (2, 0) if beside < 2 else around
    return article, max(beside, own)


def blocks(page: str) -> tuple[list[Block], bool]:
    """Flat blocks with text, in page order, and whether the page marks an article."""
    found: list[Block] = []
    current = Block()
    stack: list[tuple[str, tuple[int, int]]] = []  # open elements, and (article, beside) inside each
    places: dict[str, list[int]] = defaultdict(list)  # where the open elements of a name stand in the stack
    around, silent, has_article = (0, 0), 0, False

    def flush() -> None:
        nonlocal current
        if current.text:
            text = " ".join(html_lib.unescape("".join(current.text)).split())
            if text:
                current.text = [text]
                found.append(current)
            current = Block()

    def text(raw: str) -> None:
        if raw and not silent:
            if not current.text:
                (current.article, current.beside), current.heading = around, any(places[h] for h in _HEADINGS)
            current.text.append(raw)
            if places["a"]:
                current.link_words += len(raw.split())

    def close(upto: int) -> None:
        nonlocal around, silent
        while len(stack) > upto:
            tag, _ = stack.pop()
            places[tag].pop()
            silent -= tag in _SILENT
        around = stack[-1][1] if stack else (0, 0)

    def last(names: Iterable[str]) -> int:
        """Where the innermost open element of these names stands; -1 if none is open."""
        return max((places[n][-1] for n in names if places[n]), default=-1)

    at = 0
    while (m := _TOKEN.search(page, at)) is not None:
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or (at == len(page) and page[-1] != ">"):  # a tag that never ends is no tag, and takes the rest of the page with it
            continue
        if tag in _BLOCK:
            flush()
        if m[1]:
            if places[tag]:
                close(places[tag][-1])
            continue
        if tag in _RAW:
            end = _END_OF[tag].search(page, at)
            at = end.end() if end else len(page)
            text(" ")
            continue
        if tag in _BLOCK and silent and tag not in ("option", "optgroup"):
            while (place := last(_FRAGILE)) >= 0:
                close(place)
        if tag in _VOID:
            continue
        if tag in _BLOCK:
            ends = _CLOSED_BY.get(tag, ())
            # a hidden part does not end the paragraph it stands in
            place = max(last(ends), -1 if silent else last(("p",)), last(_HEADINGS) if tag in _HEADINGS else -1)
            if place >= 0 and place >= last(_LIMITS):
                close(place)
        elif tag == "a" and places["a"]:
            close(places["a"][-1])
        elif tag not in _SILENT and tag != "a" and not m[3]:
            continue  # plain inline elements say nothing
        if m[3].endswith("/") and tag not in _BLOCK:
            continue
        around = _inside(around, tag, m[3])
        has_article |= around[0] > 0 and around[1] == 0
        places[tag].append(len(stack))
        stack.append((tag, around))
        silent += tag in _SILENT
    text(page[at:])
    flush()
    return found, has_article


def features(found: list[Block], has_article: bool) -> np.ndarray:
    """The features of each block of a page."""
    words = np.array([len(b.text[0].split()) for b in found], dtype=np.float64)
    density = np.minimum(1.0, np.array([b.link_words for b in found], dtype=np.float64) / np.maximum(words, 1))
    out = np.zeros((len(found), len(FEATURES)))
    out[:, 0], out[:, 1] = words, density
    out[1:, 2], out[1:, 3] = words[:-1], density[:-1]
    out[:-1, 4], out[:-1, 5] = words[1:], density[1:]
    out[:, 6], out[:, 7], out[:, 8], out[:, 9] = [b.article for b in found], [b.beside for b in found], has_article, [b.heading for b in found]
    return out


def main_text(page: str, tree: Tree) -> str:
    """Text of the blocks that the tree calls article text, joined by one space."""
    found, has_article = blocks(page)
    if not found:
        return ""
    return " ".join(b.text[0] for b, keep in zip(found, tree.predict(features(found, has_article)), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars - one row per page."""
    tree = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page or "", tree) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(batch.column(1).to_pylist(), pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.col("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
