"""Main text of HTML pages by a linear-chain conditional random field over their leaf blocks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattgrid.llm.html_blocks import Block, leaf_blocks
from wattgrid.llm.labelled_pages import labelled_pages

#: Pages that the field is trained on, the bound of what training holds; the fewest of them that a feature counts from.
TRAINING_PAGES, STEPS, RIDGE, FEWEST = 900, 200, 4e-4, 3


def text_features(block: Block) -> list[str]:
    n = len(block.text)
    words = block.text.count(" ") + 1
    found = [f"words={min(8, words.bit_length())}", f"linked={round(4 * block.linked / n)}", f"end={'stop' if block.text[-1] in '.!?:;' else 'open'}"]
    found += [f"share={block.share}", f"over={block.over}", f"share={block.share},words={min(3, words.bit_length() // 2)}"]
    if "©" in block.text or "opyright" in block.text:
        found.append("copyright")
    return found


@dataclass(frozen=True)
class Field:
    """weights: how much each feature speaks for label 1 over label 0; step[a][b]: of label b after a; start: of label 1 at the top."""

    weights: dict[str, float]
    step: tuple[tuple[float, float], tuple[float, float]]
    start: float

    def scores(self, blocks: list[Block]) -> list[float]:
        weight = lambda features: sum(self.weights.get(f, 0.0) for f in features)
        above: dict[frozenset[str], float] = {}
        for b in blocks:
            if b.above not in above:
                above[b.above] = weight(sorted(b.above))
        return [above[b.above] + weight(text_features(b)) for b in blocks]

    def viterbi(self, scores: list[float]) -> list[int]:
        """The most likely labels; of equal ones label 0."""
        if not scores:
            return []
        (s00, s01), (s10, s11) = self.step
        a, b, back = 0.0, scores[0] + self.start, []
        for s in scores[1:]:
            from0, from1 = (a + s00 >= b + s10), (a + s01 >= b + s11)
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = (a + s00 if from0 else b + s10), (a + s01 if from1 else b + s11) + s
        labels = [1 if b > a else 0]
        for pair in reversed(back):
            labels.append(pair[labels[-1]])
        return labels[::-1]


def likelihood(w: np.ndarray, x: np.ndarray, y: np.ndarray, there: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood of the labels y (pages by blocks) given the features x, and its slope in w (features, four steps, start); there: blocks that a page has."""
    n_pages, longest, n_features = x.shape
    flat, both = x.reshape(-1, n_features), there[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
    s = (flat @ w[:-5].astype(x.dtype)).reshape(n_pages, longest).astype(float)
    step, emit = w[-5:-1].reshape(2, 2), np.zeros((n_pages, longest, 2))
    emit[:, :, 1] = np.where(there, s, 0)
    emit[:, 0, 1] += w[-1]
    alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
    alpha[:, 0] = emit[:, 0]
    for t in range(1, longest):
        alpha[:, t] = np.where(there[:, t, None], np.logaddexp.reduce(alpha[:, t - 1, :, None] + step, axis=1) + emit[:, t], alpha[:, t - 1])
    for t in range(longest - 2, -1, -1):
        beta[:, t] = np.where(there[:, t + 1, None], np.logaddexp.reduce(step[None] + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2), 0)
    z = np.logaddexp.reduce(alpha[:, -1], axis=1)
    p1 = np.where(there, np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None]), 0)
    pair = np.exp(alpha[:, :-1, :, None] + step + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[:, :, None, None]
    slope = [flat.T @ (np.where(there, y, 0) - p1).reshape(-1).astype(x.dtype), (seen - pair.sum((0, 1))).ravel(), [(y[:, 0] - p1[:, 0]).sum()]]
    own = (emit[:, :, 1] * np.where(there, y, 0)).sum() + (seen * step).sum()
    return float(own - z.sum()), np.concatenate(slope)


def train(pages: list[tuple[str, list[int]]], steps: int = STEPS, ridge: float = RIDGE) -> Field:
    """Maximises the likelihood of the labels given the blocks, by Adam over all pages at once; forward and backward sums run for all pages in step."""
    found = [(leaf_blocks(html), labels) for html, labels in pages]
    found = [(b, y) for b, y in found if b and len(b) == len(y)]
    said = [[sorted(b.above) + text_features(b) for b in blocks] for blocks, _ in found]
    pages_with = Counter(f for blocks in said for f in {f for fs in blocks for f in fs})
    index = {f: i for i, f in enumerate(sorted(f for f, n in pages_with.items() if n >= min(FEWEST, len(found))))}
    features = [[[index[f] for f in fs if f in index] for fs in blocks] for blocks in said]
    n_pages, longest = len(found), max(len(b) for b, _ in found)
    x = np.zeros((n_pages, longest, len(index)), np.float32)
    y, there = np.zeros((n_pages, longest), int), np.zeros((n_pages, longest), bool)
    for p, (rows, (_, labels)) in enumerate(zip(features, found)):
        for t, fs in enumerate(rows):
            x[p, t, fs] = 1
        y[p, : len(labels)], there[p, : len(labels)] = labels, True
    w = np.zeros(len(index) + 5)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        slope = likelihood(w, x, y, there)[1] / n_pages - ridge * w
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        w += 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
    step = tuple(tuple(float(a) for a in row) for row in w[-5:-1].reshape(2, 2))
    return Field({f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-4}, step, float(w[-1]))


def main_text(page: str, field: Field) -> str:
    blocks = leaf_blocks(page, field.weights)
    return " ".join(b.text for b, label in zip(blocks, field.viterbi(field.scores(blocks))) if label)


@lru_cache(1)
def default_field() -> Field:
    return train(labelled_pages(TRAINING_PAGES))


def extract_text(pages: DataFrame, field: Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars. The field is trained on the labelled pages unless one is given.

    Ids are numbers. Null and empty html have an empty text, as have pages without a block that the field takes for main text. Null or
    repeated ids and urls are passed on; other columns are ignored; an empty table gives an empty result.
    """
    model = field or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                texts = [main_text(h or "", model) for h in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
