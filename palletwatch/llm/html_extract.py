"""Main text of web pages: flat blocks, each judged by a small decision tree.

A block is described by its words and link density, those of its neighbours, and
whether it stands inside an article or inside something named as not part of one, and whether it is a heading or a paragraph
(item, quotation, cell), in which links are text, while a bare row of links leads elsewhere. The tree is
grown on the labelled table below, whose rows are cut from the pages of ``tests/llm/labelled_pages.py``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from palletwatch.llm.html_blocks import Block, blocks
from palletwatch.llm.rows import with_columns

FEATURES = (
    "words", "density", "words before", "density before", "words after", "density after", "aside", "main", "heading",
    "paragraph",
)
# Labelled blocks: the features in the order above, then 1 for text of the article.
# fmt: off
LABELLED = (
    (3, 0.33, 0, 0.0, 1, 1.0, 1, 0, 0, 0, 0), (1, 1.0, 3, 0.33, 2, 1.0, 1, 0, 0, 1, 0), (2, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 1, 0),
    (1, 1.0, 2, 1.0, 30, 0.0, 1, 0, 0, 1, 0), (30, 0.0, 1, 1.0, 5, 0.0, 1, 0, 0, 0, 0), (5, 0.0, 30, 0.0, 60, 0.0, 0, 1, 1, 0, 1),
    (60, 0.0, 5, 0.0, 3, 0.0, 0, 1, 0, 1, 1), (3, 0.0, 60, 0.0, 12, 0.0, 0, 1, 0, 1, 1),
    (12, 0.0, 3, 0.0, 25, 0.0, 1, 1, 0, 0, 0), (25, 0.0, 12, 0.0, 8, 0.0, 0, 1, 0, 1, 1),
    (8, 0.0, 25, 0.0, 45, 0.0, 0, 1, 0, 1, 1), (45, 0.0, 8, 0.0, 1, 0.0, 1, 1, 0, 0, 0),
    (1, 0.0, 45, 0.0, 140, 0.0, 0, 1, 0, 1, 1), (140, 0.0, 1, 0.0, 4, 0.0, 0, 1, 0, 1, 1),
    (4, 0.0, 140, 0.0, 90, 0.0, 1, 0, 0, 1, 0), (90, 0.0, 4, 0.0, 6, 0.0, 1, 0, 0, 1, 0),
    (6, 0.0, 90, 0.0, 0, 0.0, 1, 0, 0, 0, 0), (4, 1.0, 0, 0.0, 10, 1.0, 0, 1, 1, 0, 1),
    (10, 1.0, 4, 1.0, 21, 0.43, 0, 1, 0, 1, 1), (21, 0.43, 10, 1.0, 1, 0.0, 0, 1, 0, 1, 1),
    (1, 0.0, 21, 0.43, 5, 1.0, 0, 1, 1, 0, 1), (5, 1.0, 1, 0.0, 9, 1.0, 0, 1, 0, 1, 1), (9, 1.0, 5, 1.0, 7, 1.0, 0, 1, 0, 1, 1),
    (7, 1.0, 9, 1.0, 1, 1.0, 0, 1, 0, 1, 1), (1, 1.0, 7, 1.0, 6, 0.0, 0, 1, 0, 1, 1), (6, 0.0, 1, 1.0, 17, 0.82, 0, 1, 0, 1, 1),
    (17, 0.82, 6, 0.0, 20, 1.0, 0, 1, 0, 1, 1), (20, 1.0, 17, 0.82, 3, 1.0, 0, 1, 0, 1, 1),
    (3, 1.0, 20, 1.0, 6, 1.0, 0, 1, 0, 0, 0), (6, 1.0, 3, 1.0, 7, 1.0, 0, 1, 0, 0, 0), (7, 1.0, 6, 1.0, 0, 0.0, 1, 0, 0, 0, 0),
    (1, 0.0, 0, 0.0, 4, 1.0, 0, 1, 1, 0, 1), (4, 1.0, 1, 0.0, 2, 0.5, 0, 1, 0, 1, 1), (2, 0.5, 4, 1.0, 5, 0.6, 0, 1, 0, 1, 1),
    (5, 0.6, 2, 0.5, 2, 1.0, 0, 1, 0, 1, 1), (2, 1.0, 5, 0.6, 0, 0.0, 0, 1, 0, 1, 1), (30, 0.0, 0, 0.0, 10, 0.5, 0, 1, 0, 1, 1),
    (10, 0.5, 30, 0.0, 7, 0.86, 0, 1, 0, 1, 1), (7, 0.86, 10, 0.5, 0, 0.0, 0, 1, 0, 1, 1),
    (3, 0.0, 0, 0.0, 2, 1.0, 0, 1, 0, 1, 1), (2, 1.0, 3, 0.0, 0, 0.0, 0, 1, 0, 0, 0), (20, 0.0, 0, 0.0, 9, 0.0, 0, 1, 0, 1, 1),
    (9, 0.0, 20, 0.0, 3, 1.0, 0, 1, 0, 1, 1), (3, 1.0, 9, 0.0, 0, 0.0, 0, 1, 0, 0, 0), (2, 1.0, 0, 0.0, 50, 0.0, 0, 1, 0, 0, 0),
    (50, 0.0, 2, 1.0, 1, 1.0, 0, 1, 0, 1, 1), (1, 1.0, 50, 0.0, 0, 0.0, 0, 1, 0, 0, 0), (40, 0.0, 0, 0.0, 12, 1.0, 0, 1, 0, 1, 1),
    (12, 1.0, 40, 0.0, 60, 0.0, 0, 1, 0, 1, 1), (60, 0.0, 12, 1.0, 15, 0.6, 0, 1, 0, 1, 1),
    (15, 0.6, 60, 0.0, 30, 0.0, 0, 1, 0, 1, 1), (30, 0.0, 15, 0.6, 30, 0.67, 0, 1, 0, 1, 1),
    (30, 0.67, 30, 0.0, 2, 1.0, 0, 1, 0, 1, 1), (2, 1.0, 30, 0.67, 5, 0.0, 0, 1, 0, 1, 1),
    (5, 0.0, 2, 1.0, 9, 0.56, 0, 1, 0, 1, 1), (9, 0.56, 5, 0.0, 90, 0.0, 0, 1, 0, 1, 1),
    (90, 0.0, 9, 0.56, 14, 1.0, 0, 1, 0, 1, 1), (14, 1.0, 90, 0.0, 3, 1.0, 0, 1, 0, 1, 1),
    (3, 1.0, 14, 1.0, 7, 0.0, 0, 1, 0, 1, 1), (7, 0.0, 3, 1.0, 0, 0.0, 0, 1, 0, 1, 1), (60, 0.0, 0, 0.0, 14, 0.64, 0, 1, 0, 1, 1),
    (14, 0.64, 60, 0.0, 70, 0.0, 0, 1, 0, 1, 1), (70, 0.0, 14, 0.64, 11, 0.45, 0, 1, 0, 1, 1),
    (11, 0.45, 70, 0.0, 55, 0.0, 0, 1, 0, 1, 1), (55, 0.0, 11, 0.45, 11, 0.73, 0, 1, 0, 1, 1),
    (11, 0.73, 55, 0.0, 80, 0.0, 0, 1, 0, 1, 1), (80, 0.0, 11, 0.73, 27, 0.63, 0, 1, 0, 1, 1),
    (27, 0.63, 80, 0.0, 3, 0.0, 0, 1, 0, 1, 1), (3, 0.0, 27, 0.63, 0, 0.0, 0, 1, 0, 1, 1),
    (30, 0.0, 0, 0.0, 14, 0.64, 0, 1, 0, 0, 1), (14, 0.64, 30, 0.0, 44, 0.0, 0, 1, 0, 0, 1),
    (44, 0.0, 14, 0.64, 23, 0.48, 0, 1, 0, 0, 1), (23, 0.48, 44, 0.0, 0, 0.0, 0, 1, 0, 0, 1),
    (25, 0.0, 0, 0.0, 30, 0.0, 0, 1, 0, 1, 1), (30, 0.0, 25, 0.0, 4, 1.0, 1, 1, 0, 1, 0),
    (4, 1.0, 30, 0.0, 10, 1.0, 1, 1, 0, 1, 0), (10, 1.0, 4, 1.0, 2, 1.0, 1, 1, 0, 1, 0),
    (2, 1.0, 10, 1.0, 33, 0.0, 1, 1, 0, 0, 0), (33, 0.0, 2, 1.0, 2, 1.0, 0, 1, 0, 1, 1), (2, 1.0, 33, 0.0, 1, 1.0, 1, 1, 0, 1, 0),
    (1, 1.0, 2, 1.0, 0, 0.0, 1, 1, 0, 1, 0), (45, 0.0, 0, 0.0, 60, 0.0, 0, 0, 0, 0, 1),
    (60, 0.0, 45, 0.0, 14, 0.64, 0, 0, 0, 0, 1), (14, 0.64, 60, 0.0, 5, 0.6, 0, 0, 0, 0, 0),
    (5, 0.6, 14, 0.64, 2, 1.0, 0, 0, 0, 0, 0), (2, 1.0, 5, 0.6, 0, 0.0, 0, 0, 0, 0, 0), (45, 0.0, 0, 0.0, 60, 0.0, 0, 0, 0, 1, 1),
    (60, 0.0, 45, 0.0, 11, 0.73, 0, 0, 0, 1, 1), (11, 0.73, 60, 0.0, 6, 0.83, 0, 0, 0, 1, 0),
    (6, 0.83, 11, 0.73, 2, 1.0, 0, 0, 0, 1, 0), (2, 1.0, 6, 0.83, 0, 0.0, 0, 0, 0, 1, 0), (2, 0.0, 0, 0.0, 4, 0.0, 0, 1, 1, 0, 1),
    (4, 0.0, 2, 0.0, 2, 0.0, 0, 1, 0, 1, 1), (2, 0.0, 4, 0.0, 1, 0.0, 0, 1, 0, 1, 1), (1, 0.0, 2, 0.0, 0, 0.0, 0, 1, 0, 1, 1),
    (3, 0.0, 0, 0.0, 3, 1.0, 0, 1, 0, 0, 1), (3, 1.0, 3, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (2, 1.0, 0, 0.0, 18, 0.0, 0, 0, 0, 0, 0),
    (18, 0.0, 2, 1.0, 1, 1.0, 0, 1, 0, 1, 1), (1, 1.0, 18, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (1, 0.0, 0, 0.0, 1, 0.0, 0, 1, 0, 1, 1),
    (1, 0.0, 1, 0.0, 2, 0.0, 0, 1, 0, 1, 1), (2, 0.0, 1, 0.0, 9, 0.0, 0, 1, 0, 1, 1), (9, 0.0, 2, 0.0, 0, 0.0, 0, 1, 0, 0, 1),
    (50, 0.0, 0, 0.0, 9, 0.22, 0, 1, 0, 0, 1), (9, 0.22, 50, 0.0, 2, 0.0, 0, 1, 0, 0, 1),
    (2, 0.0, 9, 0.22, 1, 1.0, 0, 1, 0, 1, 1), (1, 1.0, 2, 0.0, 0, 0.0, 0, 1, 0, 1, 1), (35, 0.0, 0, 0.0, 70, 0.0, 0, 1, 0, 1, 1),
    (70, 0.0, 35, 0.0, 20, 0.0, 1, 1, 0, 1, 0), (20, 0.0, 70, 0.0, 8, 1.0, 1, 1, 0, 1, 0),
    (8, 1.0, 20, 0.0, 40, 0.0, 1, 1, 0, 1, 0), (40, 0.0, 8, 1.0, 25, 0.0, 0, 1, 0, 1, 1),
    (25, 0.0, 40, 0.0, 0, 0.0, 1, 0, 0, 0, 0), (2, 0.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0, 0), (1, 1.0, 2, 0.0, 1, 1.0, 0, 0, 0, 0, 0),
    (1, 1.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0, 0), (2, 1.0, 1, 1.0, 6, 0.0, 0, 0, 0, 0, 0), (6, 0.0, 2, 1.0, 45, 0.0, 0, 0, 1, 0, 1),
    (45, 0.0, 6, 0.0, 30, 0.0, 0, 0, 0, 1, 1), (30, 0.0, 45, 0.0, 9, 0.0, 0, 0, 0, 1, 1),
    (9, 0.0, 30, 0.0, 60, 0.0, 0, 0, 0, 1, 1), (60, 0.0, 9, 0.0, 2, 1.0, 0, 0, 0, 1, 1), (2, 1.0, 60, 0.0, 3, 1.0, 0, 0, 0, 0, 0),
    (3, 1.0, 2, 1.0, 7, 0.0, 0, 0, 0, 0, 0), (7, 0.0, 3, 1.0, 1, 1.0, 0, 0, 0, 0, 0), (1, 1.0, 7, 0.0, 0, 0.0, 0, 0, 0, 0, 0),
    (3, 0.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0, 0), (1, 1.0, 3, 0.0, 2, 1.0, 0, 0, 0, 1, 0), (2, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 1, 0),
    (1, 1.0, 2, 1.0, 4, 1.0, 0, 0, 0, 1, 0), (4, 1.0, 1, 1.0, 80, 0.0, 0, 0, 0, 1, 0), (80, 0.0, 4, 1.0, 27, 0.19, 0, 0, 0, 0, 1),
    (27, 0.19, 80, 0.0, 55, 0.0, 0, 0, 0, 0, 1), (55, 0.0, 27, 0.19, 2, 0.0, 0, 0, 0, 0, 1),
    (2, 0.0, 55, 0.0, 6, 1.0, 0, 0, 1, 0, 0), (6, 1.0, 2, 0.0, 8, 1.0, 0, 0, 0, 1, 0), (8, 1.0, 6, 1.0, 5, 1.0, 0, 0, 0, 1, 0),
    (5, 1.0, 8, 1.0, 11, 1.0, 0, 0, 0, 1, 0), (11, 1.0, 5, 1.0, 9, 0.0, 0, 0, 0, 1, 0), (9, 0.0, 11, 1.0, 1, 1.0, 0, 0, 0, 0, 0),
    (1, 1.0, 9, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (1, 1.0, 0, 0.0, 3, 1.0, 0, 0, 0, 1, 0), (3, 1.0, 1, 1.0, 150, 0.0, 0, 0, 0, 1, 0),
    (150, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 1, 1), (2, 1.0, 150, 0.0, 4, 0.0, 0, 0, 0, 1, 0), (4, 0.0, 2, 1.0, 1, 1.0, 0, 0, 0, 1, 0),
    (1, 1.0, 4, 0.0, 12, 1.0, 0, 0, 0, 1, 0), (12, 1.0, 1, 1.0, 0, 0.0, 0, 0, 0, 1, 0), (3, 1.0, 0, 0.0, 25, 1.0, 0, 0, 0, 1, 0),
    (25, 1.0, 3, 1.0, 4, 0.0, 0, 0, 0, 1, 0), (4, 0.0, 25, 1.0, 35, 0.0, 0, 0, 1, 0, 1),
    (35, 0.0, 4, 0.0, 14, 0.0, 0, 0, 0, 1, 1), (14, 0.0, 35, 0.0, 40, 0.0, 0, 0, 0, 1, 1),
    (40, 0.0, 14, 0.0, 5, 0.0, 0, 0, 0, 1, 1), (5, 0.0, 40, 0.0, 70, 0.0, 0, 0, 0, 1, 1),
    (70, 0.0, 5, 0.0, 9, 1.0, 0, 0, 0, 1, 1), (9, 1.0, 70, 0.0, 11, 0.45, 0, 0, 0, 1, 0),
    (11, 0.45, 9, 1.0, 0, 0.0, 0, 0, 0, 1, 0), (4, 1.0, 0, 0.0, 25, 0.0, 0, 0, 0, 0, 0),
    (25, 0.0, 4, 1.0, 20, 0.0, 0, 0, 0, 0, 1), (20, 0.0, 25, 0.0, 2, 1.0, 0, 0, 0, 0, 1),
    (2, 1.0, 20, 0.0, 10, 0.0, 0, 0, 0, 0, 0), (10, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 0), (3, 1.0, 10, 0.0, 0, 0.0, 0, 0, 0, 0, 0),
    (7, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (1, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (3, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (40, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (12, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (5, 0.0, 0, 0.0, 6, 0.0, 0, 0, 0, 1, 1),
    (6, 0.0, 5, 0.0, 0, 0.0, 0, 0, 0, 1, 1), (2, 0.0, 0, 0.0, 3, 0.0, 0, 0, 0, 1, 1), (3, 0.0, 2, 0.0, 4, 0.0, 0, 0, 0, 1, 1),
    (4, 0.0, 3, 0.0, 0, 0.0, 0, 0, 0, 1, 1), (16, 0.0, 0, 0.0, 11, 0.0, 0, 0, 0, 0, 1), (11, 0.0, 16, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (2, 1.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (3, 1.0, 0, 0.0, 4, 1.0, 0, 0, 0, 1, 0), (4, 1.0, 3, 1.0, 0, 0.0, 0, 0, 0, 1, 0),
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 1, 0), (1, 1.0, 1, 1.0, 0, 0.0, 0, 0, 0, 1, 0),
)
# fmt: on
DEPTH = 8


@dataclass
class Node:
    """A question about one feature, or an answer."""

    answer: int
    feature: int = -1
    most: float = 0.0
    below: Node | None = None
    above: Node | None = None


def _impurity(y: np.ndarray) -> float:
    share = y.mean() if len(y) else 0.0
    return 2 * share * (1 - share) * len(y)


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH) -> Node:
    """Splits by least Gini impurity, at the middle between neighbouring values; first of equals."""
    node = Node(int(2 * y.sum() >= len(y)))
    best = _impurity(y) - 1e-9
    if depth:
        for feature in range(x.shape[1]):
            values = np.unique(x[:, feature])
            for most in (values[1:] + values[:-1]) / 2:
                low = x[:, feature] <= most
                left = _impurity(y[low]) + _impurity(y[~low])
                if left < best:
                    best, node.feature, node.most = left, feature, float(most)
    if node.feature >= 0:
        low = x[:, node.feature] <= node.most
        node.below, node.above = grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)
    return node


@lru_cache(1)
def tree() -> Node:
    table = np.array(LABELLED, np.float64)
    return grow(table[:, :-1], table[:, -1])


def describe(found: Sequence[Block]) -> list[tuple[float, ...]]:
    """The features of each block; beyond the first and last there are no words."""
    shape = [(0, 0.0), *((b.words, b.linked / b.words) for b in found), (0, 0.0)]
    return [
        (*shape[i + 1], *shape[i], *shape[i + 2], b.aside, b.main, b.heading, b.paragraph) for i, b in enumerate(found)
    ]


def main_text(page: str) -> str:
    """The blocks that the tree takes for the article, joined by line feeds."""
    found, top, kept = blocks(page), tree(), []
    for block, features in zip(found, describe(found), strict=True):
        node = top
        while node.below:
            node = node.below if features[node.feature] <= node.most else node.above
        if node.answer:
            kept.append(block.text)
    return "\n".join(kept)


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` in place of ``html``: the article, empty where there is none or the page is null.

    Repeated rows are each given out. A column called ``text`` gives way to the new one.
    """
    return with_columns(
        pages, "text string", lambda: lambda found: [[main_text((p or b"").decode()) for p in found]], text=html, drop=(html,)
    )
