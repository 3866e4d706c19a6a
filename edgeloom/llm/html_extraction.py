"""Main text of web pages by minimum-cut labelling of their blocks.

1. A page is read into blocks: the runs of text between the starts and ends of block elements. Scripts, styles, comments and
   controls hold no text. Each block knows what it stands in, the share of its text in links, and its signs and words.
2. A logistic regression says how much a block looks like main text. It is trained here, on the blocks of at most
   `train_pages` different pages, chosen by a hash. Labels come from the markup: inside `article` or `main`, main text;
   inside `nav`, `aside`, `footer`, `form` or an element whose class, id or role names such a part, boilerplate; other
   blocks give no label. Every labelled block is learnt twice, once without what the markup says about it, so that
   blocks of pages with bare markup are judged by their text.
3. The costs of the two labels become the terminal capacities of a flow network, one node per block. Edges of smoothness
   join a block to the next one, the weaker the farther they are apart in the tree, and to the last block of the same parent.
   The minimum cut separates main text from boilerplate.

The main text is the kept blocks in page order, joined by two line feeds. In a block, character references are decoded, all
white space becomes one space, and the ends are trimmed. Nothing else is dropped or cut.

Defined results: a null or empty page, and one without a block of main text, has an empty text and n_chars 0; a line break
element is white space; what a page leaves open ends with the page; repeated pages are read each; equally cheap cuts keep
fewer blocks; without pages the result is empty; if the chosen pages have labels of one kind only, `PRIOR` takes the place
of the regression. Columns of the page stay, but for those named like the results. A page is read by one task, in time and
memory that grow with its length.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import column
from edgeloom.llm.min_cut import min_cut
from edgeloom.llm.words import sliced

# Elements of HTML by what they do to text, and names that sites give to parts beside the main text.
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
NO_TEXT = "button iframe math noembed noframes noscript object script select style svg template textarea title".split()
VOID = {"hr"}
MAIN_ELEMENTS, OTHER_ELEMENTS = {"article", "main"}, {"nav", "aside", "footer", "form", "menu", "dialog", "search"}
MAIN_ROLES = {"main", "article"}
OTHER_NAMES = set(
    "ad ads advert advertisement advertising adverts alert alerts banner breadcrumb breadcrumbs comment comments complementary "
    "consent contentinfo cookie cookies copyright dialog discussion disqus footer form gdpr header login masthead menu modal nav "
    "navbar navigation newsletter notice notices notification pager pagination popup popular promo promoted promotion recommended "
    "related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar "
    "topbar trending widget widgets".split()
)

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[a-zA-Z/!?][^>]*\Z""",
    re.DOTALL,
)
_NO_TEXT_END = {name: re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE) for name in NO_TEXT}
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
_PART = re.compile(r"[-_\s]+|(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    tag: str = ""
    side: int = 0  # 1 in main text, -1 beside it, as the markup says
    parent: int = 0
    climb: int = 0  # steps in the tree from the block before

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _names_other(tag: str, attributes: str) -> int:
    """-1 if the names of an element say that it stands beside the main text, 1 if its role says main text."""
    if _HIDDEN.search(attributes):
        return -1
    for kind, *values in _NAMES.findall(attributes):
        for name in "".join(values).split():
            words = [w.lower() for w in _PART.split(name) if w]
            if kind.lower() == "role" and name.lower() in MAIN_ROLES:
                return 1
            if words and (words[0] in OTHER_NAMES or (tag not in MAIN_ELEMENTS and words[-1] in OTHER_NAMES and words[0] not in {"has", "no", "with"})):
                return -1
    return 0


def _side(tag: str, attributes: str, above: int) -> int:
    if above < 0 or tag in {"html", "body"}:
        return above
    named = _names_other(tag, attributes) if attributes else 0
    if named < 0 or tag in OTHER_ELEMENTS or (tag == "header" and above <= 0):
        return -1
    return 1 if named > 0 or tag in MAIN_ELEMENTS else above


class _Page:
    """Blocks of one page, built from its tags and texts in order."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, number, side
        self.open: Counter[str] = Counter()
        self.numbers, self.links, self.lowest, self.depth_before = 0, 0, 1, 1
        self.block = Block()

    def write(self, text: str) -> None:
        if text:
            text = references.unescape(text) if "&" in text else text
            self.block.parts.append(text)
            if self.links:
                self.block.linked += len(text.split())

    def end_block(self) -> None:
        if any(part and not part.isspace() for part in self.block.parts):
            tag, number, side = self.stack[-1]
            depth = len(self.stack)
            self.block.tag, self.block.side, self.block.parent = tag, side, number
            self.block.climb = (self.depth_before - self.lowest) + (depth - self.lowest) if self.blocks else 0
            self.blocks.append(self.block)
            self.depth_before = self.lowest = depth
        self.block = Block()

    def _pop(self) -> None:
        self.open[self.stack.pop()[0]] -= 1
        self.lowest = min(self.lowest, len(self.stack))

    def start(self, tag: str, attributes: str) -> None:
        self.end_block()
        if tag in VOID:
            return
        for closed in {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}.get(tag, ()):
            if self.stack[-1][0] == closed:
                self._pop()
        if self.stack[-1][0] == "p":
            self._pop()
            if tag == "li" and self.stack[-1][0] == "li":
                self._pop()
        self.numbers += 1
        self.stack.append((tag, self.numbers, _side(tag, attributes, self.stack[-1][2])))
        self.open[tag] += 1

    def end(self, tag: str) -> None:
        self.end_block()
        if self.open[tag]:
            while self.stack[-1][0] != tag:
                self._pop()
            self._pop()


def blocks_of(page: str | None) -> list[Block]:
    """The blocks of a page that hold more than white space."""
    out, at, page = _Page(), 0, page or ""
    while match := _TOKEN.search(page, at):
        out.write(page[at : match.start()])
        at = match.end()
        tag = (match[2] or match[5] or "").lower()
        closes, attributes = match[1] or match[4], match[3] or match[6] or ""
        if tag in _NO_TEXT_END and not closes and not attributes.endswith("/"):
            ends = _NO_TEXT_END[tag].search(page, at)
            at = ends.end() if ends else len(page)
        elif tag in BLOCK:
            out.end(tag) if closes else out.start(tag, attributes)
        elif tag == "a":
            out.links = not closes
        elif tag == "br":
            out.write(" ")
    out.write(page[at:])
    out.end_block()
    return out.blocks


FEATURES = ["in_main", "beside_main", "paragraph", "heading", "item", "log_words", "links", "stops", "commas", "ends", "digits", "copyright"]

#: Used where the markup of no page can teach: log-odds of the features, then the constant.
PRIOR = np.array([5.0, -5.0, 1.0, 0.5, -1.5, 0.8, -4.0, 2.0, 1.0, 1.0, -3.0, -4.0, -2.0])


def features(block: Block) -> list[float]:
    text = block.text
    words = max(1, text.count(" ") + 1)
    return [
        float(block.side > 0),
        float(block.side < 0),
        float(block.tag in {"p", "blockquote", "pre"}),
        float(len(block.tag) == 2 and block.tag[0] == "h" and block.tag[1].isdigit()),
        float(block.tag in {"li", "td", "th", "dd", "dt"}),
        float(np.log1p(words)),
        min(1.0, block.linked / words),
        min(1.0, sum(map(text.count, ".!?…。")) / words),
        min(1.0, sum(map(text.count, ",;:،、")) / words),
        float(text.endswith((".", "!", "?", "…", "。", '"', "”", "»"))),
        sum(map(str.isdigit, text)) / len(text),
        float("©" in text),
    ]


@dataclass(frozen=True)
class ExtractionSettings:
    """`train_pages` bounds the pages the regression learns from. `next_block` and `same_parent` are smoothness in log-odds."""

    train_pages: int = 2000
    next_block: float = 1.0
    same_parent: float = 0.4
    scale: int = 1000
    seed: int = 23


def main_blocks(blocks: list[Block], weights: np.ndarray, settings: ExtractionSettings) -> list[bool]:
    """The cut: whether each block is main text."""
    if not blocks:
        return []
    odds = np.clip(np.array([features(b) for b in blocks]) @ weights[:-1] + weights[-1], -12, 12)
    edges, last = [], {}
    for i, block in enumerate(blocks):
        if i:
            edges.append((i - 1, i, round(settings.scale * settings.next_block / (1 + block.climb))))
        if block.parent in last:
            edges.append((last[block.parent], i, round(settings.scale * settings.same_parent)))
        last[block.parent] = i
    return min_cut([round(settings.scale * float(x)) for x in odds], edges)


def main_text(page: str | None, weights: np.ndarray, settings: ExtractionSettings = ExtractionSettings()) -> str:
    blocks = blocks_of(page)
    return "\n\n".join(b.text for b, kept in zip(blocks, main_blocks(blocks, weights, settings), strict=True) if kept)


def labelled_blocks(pages: DataFrame, settings: ExtractionSettings = ExtractionSettings()) -> DataFrame:
    """`features` and `label` of the blocks whose place the markup names, in at most `train_pages` different pages."""
    hashed = pages.select(F.xxhash64(F.lit(settings.seed), "html").alias("h"), "html").filter(F.length("html") > 0)
    chosen = hashed.select("h").distinct().orderBy("h").limit(settings.train_pages)  # one long per page, and so small
    once = hashed.join(F.broadcast(chosen), "h").groupBy("h").agg(F.first("html").alias("html")).select("html")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 64):
            found = [(features(b), float(b.side > 0)) for page in batch.column("html") for b in blocks_of(page.as_py()) if b.side]
            rows = [f for f, _ in found] + [[0.0, 0.0, *f[2:]] for f, _ in found]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array([y for _, y in found] * 2, pa.float64())], ["features", "label"])

    return once.mapInArrow(read, "features array<double>, label double")


def fit_weights(pages: DataFrame, settings: ExtractionSettings = ExtractionSettings()) -> np.ndarray:
    """Weights of the features and the constant, learnt from pages with a column `html`."""
    train = labelled_blocks(pages, settings).select(array_to_vector("features").alias("features"), "label").cache()
    try:
        if train.select("label").distinct().count() < 2:
            return PRIOR
        model = LogisticRegression(maxIter=60, regParam=0.001).fit(train)
        return np.array([*model.coefficients, model.intercept])
    finally:
        train.unpersist()


def extract_main_text(pages: DataFrame, html: str = "html", weights: np.ndarray | None = None, settings: ExtractionSettings = ExtractionSettings()) -> DataFrame:
    """The rows of `pages` without the html, with `text` and `n_chars` in place of columns of these names."""
    clash = {html, "text", "n_chars"}
    page = column(pages, html).cast("string")
    learnt = fit_weights(pages.select(page.alias("html")), settings) if weights is None else weights
    rest = [column(pages, c).alias(c) for c in pages.columns if c not in clash]
    # The row itself travels as one column, so its names clash with none of the results.
    narrow = pages.select(F.struct(*rest or [F.lit(0).alias("_")]).alias("row"), page.alias("html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 64):
            texts = [main_text(p.as_py(), learnt, settings) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["row", "text", "n_chars"])

    schema = narrow.select("row").schema.add("text", "string", False).add("n_chars", "long", False)
    found = narrow.mapInArrow(extract, schema)
    return found.select(*(["row.*"] if rest else []), "text", "n_chars")
