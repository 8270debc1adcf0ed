"""Main text of web pages by gradient-boosted trees over DOM nodes.

Each page becomes a tree of block nodes. Boosted trees (Spark's own) judge every node by
its subtree's text, links and punctuation, its tag, depth and siblings, and the words of
class, id and role attributes on it and above it. The choice of nodes is then decoded
for the whole page: a node can be kept only together with all its ancestors, and the
most probable choice of that kind is taken, so no descendant contradicts an ancestor.

The trees are fitted on LAYOUTS pages of known layout, drawn from a rule, and on at most
SAMPLE pages of the table itself that mark their main text with an article or main
element. Both are also learned with these elements and attributes taken away, so that
structure counts and not only names.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabgauge.functions.checkpoints import settled
from tabgauge.llm.html_dom import MEANINGS, Forest, Page, log_chances
from tabgauge.llm.html_layouts import Layouts

LAYOUTS = 300
SAMPLE = 150
#: Sampled pages longer than this (characters) are not learned from.
SAMPLE_CHARS = 200_000
TREES = 20
DEPTH = 5
SEED = 11

#: The title that an article starts with.
_TITLE = re.compile(r"(<(?:article|main)[^>]*>\s*)(<h1[^>]*>.*?</h1>)", re.S)

#: Pages whose nodes are judged together.
_TOGETHER = 128

_OUTSIDE = ("nav", "aside", "footer", "form")
#: What in an article may be something else than its text; no example is made of it.
_COMMENT = list(MEANINGS).index("comment")
_UNSURE = frozenset(k for k, m in enumerate(MEANINGS) if m in ("comment", "advert", "notice", "share", "side", "form"))


class Trees:
    """A fitted ensemble as arrays, to judge many nodes at once in a task."""

    def __init__(self, model: GBTClassificationModel) -> None:
        size = (1 << (DEPTH + 1)) - 1
        shape = (len(model.treeWeights), size)
        self.feature = np.zeros(shape, np.int32)
        self.threshold = np.full(shape, np.inf, np.float64)
        self.value = np.zeros(shape, np.float64)
        for t, (tree, weight) in enumerate(zip(model.trees, model.treeWeights)):
            self._take(tree._java_obj.rootNode(), t, 0, weight)

    def _take(self, node, tree: int, at: int, weight: float) -> None:
        if node.getClass().getSimpleName() == "LeafNode":
            # what lies below a leaf is never told apart: all goes left, to its value
            while at < self.value.shape[1]:
                self.value[tree, at] = weight * node.prediction()
                at = 2 * at + 1
            return
        self.feature[tree, at] = node.split().featureIndex()
        self.threshold[tree, at] = node.split().threshold()
        self._take(node.leftChild(), tree, 2 * at + 1, weight)
        self._take(node.rightChild(), tree, 2 * at + 2, weight)

    def margin(self, features: np.ndarray) -> np.ndarray:
        rows = np.arange(len(features))
        total = np.zeros(len(features))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(features), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (features[rows, feature[at]] > threshold[at])
            total += value[at]
        return total


def _labels(page: Page, kept: np.ndarray) -> np.ndarray:
    """Nodes that hold kept text, from the flags of text blocks."""
    labels = kept.copy()
    for k in range(len(labels) - 1, 0, -1):
        labels[page.parents[k]] |= labels[k]
    return labels


def _marked(page: Page) -> tuple[np.ndarray, np.ndarray] | None:
    """Text blocks in an article or main element, if the page has one, and which nodes are sure.

    What stands in an article under a name for comments, adverts, notices, shares, side
    matter or forms is neither called main text nor anything else. An article's own header
    is part of it; an article among comments that stand apart is not one.
    """
    size = len(page.tags)
    inside, unsure, apart = np.zeros(size, bool), np.zeros(size, bool), np.zeros(size, bool)
    for k in range(1, size):
        tag, up = page.tags[k], page.parents[k]
        unsure[k] = unsure[up] or (inside[up] and bool(page.meanings[k] & _UNSURE))
        apart[k] = apart[up] or (not inside[up] and tag not in ("article", "main") and _COMMENT in page.meanings[k])
        inside[k] = (inside[up] or tag in ("article", "main")) and tag not in _OUTSIDE and not apart[k]
    kept = inside & ~unsure & np.array([t is not None for t in page.texts])
    return (kept, ~unsure) if kept.any() else None


def _plain(page: Page, rng: random.Random) -> None:
    """Take telling tags, and sometimes attributes, away from a page."""
    page.tags = ["div" if t in ("article", "main", "section", "nav", "aside", "footer", "header") else t for t in page.tags]
    content = list(MEANINGS).index("content")
    if rng.random() < 0.5:
        page.meanings = [m - {content} for m in page.meanings]


def _examples(pages: list[tuple[Page, np.ndarray, np.ndarray]], rng: random.Random):
    for page, kept, sure in pages:
        labels = _labels(page, kept)[sure]
        yield Forest([page]).features()[sure], labels
        if any(page.meanings):
            _plain(page, rng)
            yield Forest([page]).features()[sure], labels


def _layout_pages() -> list[tuple[Page, np.ndarray, np.ndarray]]:
    layouts = Layouts(SEED)
    pages = []
    for _ in range(LAYOUTS):
        html, main = layouts.page()
        page, wanted = Page(html), list(main)
        kept = np.zeros(len(page.tags), bool)
        for k, text in enumerate(page.texts):
            if wanted and text == wanted[0]:
                kept[k] = True
                wanted.pop(0)
        if not wanted:
            pages.append((page, kept, np.ones(len(kept), bool)))
    return pages


def _sampled_pages(pages: DataFrame) -> list[tuple[Page, np.ndarray, np.ndarray]]:
    marked = pages.where(F.length("html") <= SAMPLE_CHARS).where(
        F.lower("html").contains("<article") | F.lower("html").contains("<main")
    )
    hashed = marked.select(F.xxhash64("html").alias("place"))
    places = [r.place for r in hashed.distinct().orderBy("place").limit(SAMPLE).collect()]
    rows = marked.where(F.xxhash64("html").isin(places)) if places else marked.limit(0)
    texts = sorted({r.html for r in rows.select("html").distinct().collect()})
    found, layouts = [], Layouts(SEED + 1)
    for k, html in enumerate(texts):
        # a table may show few kinds of pages: parts of the sample get comments, and a header for the title
        if k % 2:
            html = html.replace("</article>", f"</article>{layouts.comments()}", 1)
        if k % 4 > 1:
            html = _TITLE.sub(r"\1<header>\2</header>", html, count=1)
        page = Page(html)
        marks = _marked(page)
        if marks is not None:
            found.append((page, *marks))
    return found


def fitted(spark: SparkSession, pages: DataFrame) -> Trees:
    """Boosted trees for the pages of a table (html)."""
    # one part of a bounded sample, so that the trees do not depend on the number of cores
    table = settled(_learned_from(spark, pages)).coalesce(1)
    table = table.select(array_to_vector("features").alias("features"), "label")
    boosted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED, maxBins=64)
    return Trees(boosted.fit(table))


def _learned_from(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """features and label of each node to learn from, in one part.

    These are rows of the driver, which would go out again with every task of the fit;
    it reads them from the shared folder instead.
    """
    rng = random.Random(SEED)
    examples = list(_examples(_layout_pages() + _sampled_pages(pages), rng))
    features = np.concatenate([f for f, _ in examples])
    columns = {
        "features": pa.FixedSizeListArray.from_arrays(pa.array(features.ravel()), features.shape[1]).cast(pa.list_(pa.float32())),
        "label": pa.array(np.concatenate([labels for _, labels in examples]).astype(np.float64)),
    }
    return spark.createDataFrame(pa.table(columns)).coalesce(1)


_EXTRACTED = "page_id long, url string, text string, n_chars long"


def main_texts(htmls: list[str | None], trees: Trees) -> list[str]:
    """The main text of each page; empty where there is none."""
    found = [""] * len(htmls)
    filled = [k for k, html in enumerate(htmls) if html]
    for start in range(0, len(filled), _TOGETHER):
        some = filled[start : start + _TOGETHER]
        forest = Forest([Page(htmls[k]) for k in some])
        chosen = forest.decoded(*log_chances(trees.margin(forest.features())))
        for k, (first, last) in zip(some, forest.bounds):
            kept = zip(forest.texts[first:last], chosen[first:last].tolist())
            found[k] = "\n\n".join(t for t, yes in kept if yes and t is not None)
    return found


def _extracted(trees):
    """A function for mapInArrow from (page_id, url, html) to main texts."""

    def extracted(batches):
        for batch in batches:
            texts = main_texts(batch.column("html").to_pylist(), trees.value)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    return extracted


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html).

    * Blocks are joined by empty lines, in page order; white space in a block is one space.
    * Null and empty pages, and pages without main text, have an empty text.
    * Repeated rows and null ids keep their rows; other columns are not looked at; an
      empty table gives no rows.
    """
    spark = pages.sparkSession
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    trees = spark.sparkContext.broadcast(fitted(spark, own))
    return own.mapInArrow(_extracted(trees), _EXTRACTED)
