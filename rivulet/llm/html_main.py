"""Main text of web pages: flat text blocks, judged by a decision tree on their own and their neighbours' word counts and link densities."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import with_columns_by
from rivulet.llm.html_blocks import Block, text_blocks
from rivulet.llm.html_examples import PAGES

#: Depth of the tree and least number of labelled blocks on either side of a split.
DEPTH, LEAF = 6, 1

FIELDS = (T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()))

Node = tuple  # (feature, threshold, node at or below it, node above it) or (share of the article's blocks,)


def features(blocks: Sequence[Block]) -> list[tuple[float, ...]]:
    """Per block: word count and link density of the block before, of itself and of the one after; then what its elements say."""
    density = [(b.words, b.linked / b.words) for b in blocks]
    around = [(0, 0.0), *density, (0, 0.0)]
    return [(*around[i + 1], *around[i], *around[i + 2], b.noise, b.main, b.header, b.heading) for i, b in enumerate(blocks)]


def labelled_table(pages: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks whose element, or one around it, has a data-label."""
    x, y = [], []
    for page in pages:
        blocks = text_blocks(page)
        for row, block in zip(features(blocks), blocks):
            if block.label is not None:
                x.append(row)
                y.append(int(block.label))
    return np.array(x, dtype=np.float64), np.array(y)


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH, leaf: int = LEAF) -> Node:
    """Decision tree by Gini impurity. Thresholds lie half way between neighbouring values; of equally good splits the first feature's lowest wins."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return (share,)
    best = (len(y) * share * (1 - share) - 1e-9, None, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        values, ones = x[order, f], np.cumsum(y[order])
        for i in np.flatnonzero(values[:-1] < values[1:]):
            n = int(i) + 1
            if leaf <= n <= len(y) - leaf:
                left, right = ones[i], ones[-1] - ones[i]
                impurity = left * (1 - left / n) + right * (1 - right / (len(y) - n))
                if impurity < best[0] - 1e-9:
                    best = (impurity, f, (values[i] + values[i + 1]) / 2)
    _, f, threshold = best
    if f is None:
        return (share,)
    low = x[:, f] <= threshold
    return (f, float(threshold), grow(x[low], y[low], depth - 1, leaf), grow(x[~low], y[~low], depth - 1, leaf))


def judge(tree: Node, row: Sequence[float]) -> bool:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0] >= 0.5


@functools.lru_cache(maxsize=1)
def default_tree() -> Node:
    return grow(*labelled_table(PAGES))


def main_text(page: str | None, tree: Node) -> str:
    """The blocks that the tree takes for the article, in page order, joined by one space."""
    blocks = text_blocks(page)
    return " ".join(b.text for b, row in zip(blocks, features(blocks)) if judge(tree, row))


def extract(pages: DataFrame, html: str = "html", tree: Node | None = None) -> DataFrame:
    """Add `text`, the main text of the whole page, and `n_chars`, its code points.

    Null and empty pages, and pages without a block of the article, have the empty text and 0. All rows stay, repeated ones too, each judged by itself; an
    empty table stays empty. Other columns pass unchanged; columns named like the two are replaced, whatever their case. A page is read once from start to
    end, so a very long one needs memory in proportion to its length and is never cut. Broken markup is read as browsers do: what follows an
    unclosed comment or script is lost. One step over the rows, without a shuffle.
    """
    tree = tree or default_tree()
    source = pages.withColumn(html, F.col(html).cast("string"))

    def make() -> Callable[[list], list[list]]:
        def run(rows: list[str | None]) -> list[list]:
            texts = [main_text(page, tree) for page in rows]
            return [texts, [len(t) for t in texts]]

        return run

    return with_columns_by(source, [html], make, FIELDS)
