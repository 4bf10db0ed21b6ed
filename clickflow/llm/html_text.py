"""Main text of web pages from flat text blocks and a decision tree.

A page is flattened into text blocks, cut wherever a block-level element
begins or ends. A block is described by its number of words and its link
density, the same of the block before and after it, and by whether an element
around it says what it is (a navigation, an advert, an article ...). A small
decision tree, trained here with Spark ML on a labelled table of blocks,
tells main text from the rest. Pages are parsed and classified in one pass
without a shuffle; only the tree (a few nodes) travels to the tasks.

End tags that pages leave out are supplied: an open head ends at the body or at
the first thing that cannot stand in one, open options, selects and buttons at
the next element that cannot; a textarea without an end tag is skipped, not its
page. Names of classes and ids only guess: an article
or main element inside clears the chrome they set outside of it, unless its own
names say chrome, and names that only tell what else there is (has-sidebar) are
skipped. Forms, too, only guess, since whole pages stand in one. A form or named
wrapper that holds most of a page's words while there is little text outside of
any is taken for neither.

Open elements are counted by name, so an end tag without a start costs nothing and
a page is read in time in proportion to its length, however deep it is nested.

Defined cases: null, empty or text-free html gives an empty text; a page cut
off anywhere is read to its end; repeated rows and null ids are ordinary rows;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickflow.llm.common import id_type

FEATURES = ("words", "density", "before_words", "before_density", "after_words", "after_density", "chrome", "main", "heading")

#: Fixed element names. Inline elements do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt "
                   "ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style noscript template svg math iframe object select option textarea button canvas "
                   "audio video map title".split())
#: Elements that do not end an open head, a select or an option, and ones that end a button.
IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
IN_SELECT = INLINE | frozenset("option optgroup hr script style template noscript button img svg".split())
NOT_IN_BUTTON = frozenset("button p h1 h2 h3 h4 h5 h6 article main section header footer nav aside form fieldset ul ol dl "
                          "table blockquote pre figure body".split())
CHROME = frozenset("nav aside footer menu dialog fieldset".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Fixed words of class and id names.
CHROME_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies copyright discussion disqus footer header login menu menubar modal nav navbar navigation "
    "newsletter notice notices overlay pager pagination popup promo promoted promotion related recommended replies "
    "reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription tags teaser "
    "toolbar topbar widget widgets".split())
MAIN_NAMES = frozenset("article articlebody body content entry main post story text".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu".split())
MAIN_ROLES = frozenset("main article".split())
_NAME = re.compile(r"[a-z0-9]+")
_TEXTAREA_END = re.compile(r"</textarea", re.I)
#: A name that begins so tells what the page has elsewhere.
ELSEWHERE = frozenset("has have with without no".split())
#: How an element is known as chrome: by class or id names or as a form, by its own kind or role.
NAMED, CERTAIN = 1, 2
#: A guess is dropped for an element with this share of the words that are not certain chrome, if
#: what stands outside of any chrome is less than this share of the element's.
MOST_WORDS, LITTLE_ELSE = 0.5, 0.25


class _Blocks(HTMLParser):
    """Collects a page's blocks as [text, words in links, mark, main, heading]; ``marks`` are the elements known as chrome."""

    def __init__(self, textarea_ends: int = 0):
        super().__init__(convert_charrefs=True)
        self.textarea_ends = textarea_ends  # end tags to come
        self.blocks: list[list] = []
        self.stack: list[tuple[str, int, bool]] = []  # element, innermost mark (0: none), main
        self.marks: list[tuple[int, int]] = [(0, 0)]  # mark around it, how it and they are known at best
        self.open: Counter = Counter()
        self.parts: list[str] = []
        self.linked = self.links = self.unseen = 0
        self.heading = False

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, mark, main = self.stack[-1] if self.stack else ("", 0, False)
            self.blocks.append([text, self.linked, mark, main, self.heading])
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs) -> None:
        self._supply_ends(tag)
        if tag == "br" or tag == "img":
            self.parts.append(" ")
        if tag not in INLINE:
            self._flush()
            self._close_links()
        if tag in VOID or tag == "textarea" and not self.textarea_ends:
            return
        if tag == "p" or tag == "li":  # these end an open one of their kind
            self._end_open(tag)
        if tag == "a" and self.links:
            self._pop("a")
        _, mark, main = self.stack[-1] if self.stack else ("", 0, False)
        chrome = self.marks[mark][1]
        names, role = set(), ""
        for name, value in attrs:
            if value and name in ("class", "id"):
                for one in value.lower().split():
                    words = _NAME.findall(one)
                    if words and words[0] not in ELSEWHERE:
                        names.update(words)
            elif value and name == "role":
                role = value.lower()
        if tag not in ("html", "body"):
            if tag in MAIN or role in MAIN_ROLES:
                if chrome == NAMED and not main and not names & CHROME_NAMES:
                    mark = chrome = 0
                main = main or not chrome
            elif tag in CHROME or role in CHROME_ROLES or tag == "header" and not main:
                mark = self._marked(mark, CERTAIN)
            elif tag == "form" or role == "form" or names & CHROME_NAMES:
                mark = self._marked(mark, NAMED)
            elif names & MAIN_NAMES:
                main = main or not chrome
        self.stack.append((tag, mark, main))
        self.open[tag] += 1
        self.links += tag == "a"
        self.unseen += tag in UNSEEN
        self.heading = self.heading or tag in HEADINGS

    def _marked(self, around: int, level: int) -> int:
        self.marks.append((around, max(level, self.marks[around][1])))
        return len(self.marks) - 1

    def handle_endtag(self, tag) -> None:
        if tag not in INLINE:
            self._flush()
        self.textarea_ends -= tag == "textarea"
        self._pop(tag)

    def handle_data(self, data) -> None:
        if self.unseen and self.stack[-1][0] == "head" and data.strip():
            self._pop("head")
        if not self.unseen:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.split())

    def _pop(self, tag) -> None:
        if self.open[tag]:
            gone = ""
            while gone != tag:
                gone = self.stack.pop()[0]
                self._ended(gone)

    def _ended(self, tag) -> None:
        self.open[tag] -= 1
        self.links -= tag == "a"
        self.unseen -= tag in UNSEEN
        self.heading = self.heading and (tag not in HEADINGS or any(self.open[h] for h in HEADINGS))

    def _supply_ends(self, tag) -> None:
        """End open elements that ``tag`` cannot stand in."""
        if not self.unseen:
            return
        if tag == "body" or tag not in IN_HEAD and self.stack[-1][0] == "head":
            self._pop("head")
        if tag not in IN_SELECT:
            self._drop("option", "select")
        elif tag in ("option", "optgroup"):
            self._drop("option")
        if tag in NOT_IN_BUTTON:
            self._drop("button")

    def _drop(self, *tags) -> None:
        """End the open elements of these names, but none that was opened inside them."""
        left = sum(self.open[tag] for tag in tags)
        i = len(self.stack)
        while left:
            i -= 1
            if self.stack[i][0] in tags:
                self._ended(self.stack.pop(i)[0])
                left -= 1

    def _end_open(self, tag) -> None:
        if not self.open[tag]:
            return
        for name, _, _ in reversed(self.stack):
            if name == tag:
                self._pop(tag)
                return
            if name not in INLINE and name != "p":
                return

    def _close_links(self) -> None:
        """An anchor left open does not reach past its block."""
        while self.links and self.stack and self.stack[-1][0] == "a":
            self._pop("a")


def page_blocks(html: str | None) -> list[list]:
    """``[text, linked words, chrome, main, heading]`` of each block in page order."""
    parser = _Blocks(len(_TEXTAREA_END.findall(html)) if html else 0)
    if html:
        parser.feed(html)
        parser.close()
        parser._flush()
    chrome = _is_chrome(parser)
    return [[text, linked, chrome[mark], main, heading] for text, linked, mark, main, heading in parser.blocks]


def _is_chrome(parser: _Blocks) -> list[bool]:
    """For every mark whether it stands, or one around it."""
    inside = [0] * len(parser.marks)
    for text, _, mark, _, _ in parser.blocks:
        if parser.marks[mark][1] < CERTAIN:
            inside[mark] += len(text.split())
    outside, total = inside[0], sum(inside)
    for mark in range(len(inside) - 1, 0, -1):  # marks come after those around them
        if parser.marks[mark][1] < CERTAIN:
            inside[parser.marks[mark][0]] += inside[mark]
    chrome = [False]
    for mark, (around, level) in enumerate(parser.marks[1:], 1):
        wraps = level == NAMED and inside[mark] >= MOST_WORDS * total and outside < LITTLE_ELSE * inside[mark]
        chrome.append(chrome[around] or not wraps)
    return chrome


def features(blocks: list[tuple[int, int, bool, bool, bool]]) -> list[list[float]]:
    """A row of ``FEATURES`` for each block (words, linked words, chrome, main, heading)."""
    own = [(float(w), min(1.0, linked / w) if w else 0.0) for w, linked, *_ in blocks]
    edge = [(0.0, 0.0)]
    return [[*a, *b, *c, float(x[2]), float(x[3]), float(x[4])]
            for a, b, c, x in zip(own, edge + own[:-1], own[1:] + edge, blocks)]


# Fixed labelled pages: blocks as (words, linked words, marks, is it main text). Marks name what an
# element around the block says: c chrome, m main, h heading.
LABELLED_PAGES = (
    ((1, 1, "c", 0), (2, 2, "c", 0), (1, 1, "c", 0), (14, 0, "c", 0), (12, 0, "mh", 1), (80, 0, "m", 1), (45, 2, "m", 1),
     (3, 0, "m", 1), (60, 0, "m", 1), (9, 1, "c", 0)),
    ((2, 2, "", 0), (1, 1, "", 0), (3, 3, "", 0), (9, 0, "h", 1), (70, 1, "", 1), (55, 0, "", 1), (30, 0, "", 1),
     (4, 4, "", 0), (3, 3, "", 0), (6, 2, "", 0)),
    ((3, 3, "c", 0), (40, 0, "c", 0), (8, 0, "mh", 1), (25, 0, "m", 1), (2, 0, "m", 1), (1, 0, "m", 1), (90, 3, "m", 1),
     (30, 0, "c", 0), (50, 0, "c", 0), (35, 1, "c", 0)),
    ((5, 5, "", 0), (6, 6, "", 0), (65, 0, "", 1), (7, 0, "", 1), (48, 2, "", 1), (60, 30, "", 0), (5, 5, "", 0)),
    ((22, 0, "c", 0), (1, 1, "c", 0), (1, 1, "c", 0), (6, 0, "mh", 1), (1, 0, "m", 1), (120, 10, "m", 1), (15, 15, "mc", 0),
     (33, 0, "mc", 0), (18, 0, "m", 1), (12, 12, "c", 0)),
    ((4, 2, "", 0), (3, 3, "", 0), (5, 0, "h", 1), (33, 0, "", 1), (100, 4, "", 1), (28, 0, "", 1), (2, 2, "", 0)),
    ((70, 0, "c", 0), (10, 10, "c", 0), (4, 0, "m", 1), (2, 0, "m", 1), (5, 5, "m", 1), (40, 0, "m", 1), (60, 0, "c", 0)),
    ((3, 3, "", 0), (8, 8, "", 0), (2, 0, "", 0), (3, 3, "", 0), (90, 1, "", 1), (85, 0, "", 1), (4, 3, "", 0), (9, 9, "", 0)),
    ((11, 0, "mh", 1), (1, 0, "m", 1), (10, 0, "c", 0), (1, 1, "c", 0), (28, 28, "m", 1), (16, 0, "m", 1), (20, 0, "mc", 0)),
    ((30, 0, "", 1), (26, 0, "", 1), (44, 0, "c", 0), (52, 0, "c", 0), (19, 0, "c", 0), (6, 0, "c", 0)),
)


def labelled_blocks(spark: SparkSession) -> DataFrame:
    """The labelled table: ``features`` and ``label``, one row per block."""
    from pyspark.ml.linalg import Vectors

    rows = []
    for page in LABELLED_PAGES:
        blocks = [(w, linked, "c" in marks, "m" in marks, "h" in marks) for w, linked, marks, _ in page]
        rows += [(Vectors.dense(f), float(block[3])) for f, block in zip(features(blocks), page)]
    return spark.createDataFrame(rows, ["features", "label"])


def train_tree(labelled: DataFrame, max_depth: int = 6):
    """A decision tree as nested tuples: (feature, threshold, left, right), or whether it is main text."""
    from pyspark.ml.classification import DecisionTreeClassifier

    model = DecisionTreeClassifier(maxDepth=max_depth, minInstancesPerNode=1, seed=1).fit(labelled)

    def node(n):
        if n.subtreeDepth() == 0:
            return n.prediction() > 0.5
        return n.split().featureIndex(), n.split().threshold(), node(n.leftChild()), node(n.rightChild())

    return node(model._call_java("rootNode"))


def is_main(tree, row: list[float]) -> bool:
    while not isinstance(tree, bool):
        feature, threshold, left, right = tree
        tree = left if row[feature] <= threshold else right
    return tree


def main_text(html: str | None, tree) -> str:
    """The blocks that the tree takes for main text, one a line."""
    blocks = page_blocks(html)
    rows = features([(len(b[0].split()), *b[1:]) for b in blocks])
    return "\n".join(b[0] for b, row in zip(blocks, rows) if is_main(tree, row))


def extract_text(pages: DataFrame, tree=None, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: id, url, ``text`` (main text), ``n_chars`` (its code points)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    tree = train_tree(labelled_blocks(pages.sparkSession)) if tree is None else tree
    schema = T.StructType([T.StructField(id_col, id_type(pages, id_col)), T.StructField(url_col, id_type(pages, url_col)),
                           T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(html, tree) for html in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(arrow.field(0).type), batch.column(1).cast(arrow.field(1).type),
                pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=arrow)

    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col)).mapInArrow(run, schema)
