"""Toxicity by a classifier chain.

Categories are predicted one after the other, each by a logistic model on indicators of words and their beginnings, and on the probabilities of the
categories before it. For training, those probabilities are out-of-fold predictions, so that a later model learns from
earlier ones as they will be on texts not seen before. Features of a category are those whose share differs most
between its classes; all models are fitted on a bounded sample of labelled rows, and every whole text is scored.

The labels at hand name one category, ``toxic``. Two finer ones are derived from the sample itself, with no word list: the words
that mark toxic rows are found, ``abusive`` is a toxic row with at least one of them, ``severe`` one with at least three. The
chain runs from ``abusive`` over ``severe`` to ``toxic``, whose probability is the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tidepool.llm.bytestext import LOWER, flat, prefix_sums, runs, slices, small_batches, span_hashes, spans_of, utf8
from tidepool.llm.columns import taken
from tidepool.llm.linear import Rows, logistic, rows_of, sigmoid
from tidepool.llm.quality import collected, sampled

WIDTH = 1 << 22
#: Bytes of the beginnings of words that are features beside whole words, for families of inflected words.
BEGINNINGS = (5, 6, 7, 9)
#: Labelled rows that the chain is fitted on, at most: those first in the order of a hash of their id.
SAMPLE = 6000
#: Features of each model, at most.
FEATURES = 2000
#: How much a feature must tell to be used, and to mark a row as abusive.
TELLS, MARKS = 4.0, 5.0
CHAIN = ("abusive", "severe", "toxic")
THRESHOLD = 0.25
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def word_features(buffer: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None, width: int = WIDTH) -> list[np.ndarray]:
    """For each text the sorted numbers of its features: lower-cased words (runs of letters) and their beginnings.

    A feature that occurs in at least 2, and in at least 4, places of a text gives a further number each. With ``wanted`` (true by
    number) other features are left out before they are counted.
    """
    own = offsets - offsets[0]
    part = buffer[offsets[0] : offsets[-1]]
    starts, ends = runs(_LETTER[part], own[:-1])
    sums = prefix_sums(LOWER[part])
    text_of = (np.searchsorted(own, starts, "right") - 1).astype(np.uint64)
    found = []
    for bytes_read in (*BEGINNINGS, None):
        rows = np.arange(len(starts)) if bytes_read is None else np.flatnonzero(ends - starts > bytes_read)
        numbers = span_hashes(sums, starts[rows], ends[rows] if bytes_read is None else starts[rows] + bytes_read)
        numbers = (numbers + np.uint64(bytes_read or 0)) % np.uint64(width // 4)
        if wanted is not None:
            known = wanted[numbers]
            rows, numbers = rows[known], numbers[known]
        found.append(text_of[rows] * np.uint64(width) + numbers)
    both, times = np.unique(np.concatenate(found), return_counts=True)
    quarter = np.uint64(width // 4)
    both = np.sort(np.concatenate([both, both[times >= 2] + quarter, both[times >= 4] + quarter * np.uint64(2)]))
    cuts = np.searchsorted(both, np.arange(1, len(own)).astype(np.uint64) * np.uint64(width))
    return np.split((both % np.uint64(width)).astype(np.int64), cuts[:-1])


def features_of(array: pa.Array, wanted: np.ndarray | None = None) -> Iterator[list[np.ndarray]]:
    buffer, offsets = flat(array)
    for i, j in spans_of(offsets):
        yield word_features(buffer, offsets[i : j + 1], wanted)


def telling_words(rows: Rows, labels: np.ndarray, least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(features, how much each tells of the label) of features in at least ``least`` rows: the signed root of its log-likelihood ratio, about a normal deviate if it tells nothing.

    Rows are counted, not places in them.
    """
    inside, outside = (rows.counts(own, WIDTH).astype(np.int32) for own in (labels, ~labels))
    used = np.flatnonzero(inside + outside >= least)
    inside, outside = inside[used].astype(float), outside[used].astype(float)
    n1, n0 = float(labels.sum()), float((~labels).sum())
    seen, missing = inside + outside, n1 + n0 - inside - outside
    ratio = np.zeros(len(used))
    for found, share in ((inside, seen * n1), (outside, seen * n0), (n1 - inside, missing * n1), (n0 - outside, missing * n0)):
        some = found > 0
        ratio[some] += 2 * found[some] * np.log(found[some] * (n1 + n0) / share[some])
    sign = np.where(inside * n0 >= outside * n1, 1.0, -1.0)
    return used, sign * np.sqrt(np.maximum(ratio, 0))


@dataclass
class Link:
    """One model of the chain: its features (sorted), and weights for them, for the earlier categories and the bias."""

    features: np.ndarray
    weights: np.ndarray

    def probability(self, rows: Rows, before: np.ndarray) -> np.ndarray:
        width = len(self.features)
        margin = rows.keep(self.features).dot(self.weights[:width])
        return sigmoid(margin + before @ self.weights[width:-1] + self.weights[-1])


@dataclass
class Chain:
    links: list[Link]

    def wanted(self) -> np.ndarray:
        """The features, by number of their first occurrence, that any model of the chain looks at."""
        used = np.zeros(WIDTH // 4, bool)
        for link in self.links:
            used[link.features % (WIDTH // 4)] = True
        return used

    def probabilities(self, rows: Rows) -> np.ndarray:
        out = np.zeros((len(rows), 0))
        for link in self.links:
            out = np.column_stack([out, link.probability(rows, out)])
        return out


def _fit_link(rows: Rows, before: np.ndarray, labels: np.ndarray, ridge: float) -> Link:
    if not len(rows) or labels.all() or not labels.any():
        p = (labels.sum() + 1) / (len(labels) + 2)
        return Link(np.zeros(0, np.int64), np.concatenate([np.zeros(before.shape[1]), [np.log(p / (1 - p))]]))
    used, z = telling_words(rows, labels)
    first = np.argsort(-np.abs(z), kind="stable")[:FEATURES]
    best = np.sort(used[first[np.abs(z[first]) >= TELLS]])
    return Link(best, logistic(rows.keep(best), before, labels, len(best), ridge))


def derived(rows: Rows, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """The categories of these rows: which of them hold words that mark toxic ones among them."""
    used, z = telling_words(rows, toxic)
    hits = np.diff(rows.keep(used[z >= MARKS]).start)
    return {"abusive": toxic & (hits >= 1), "severe": toxic & (hits >= 3), "toxic": toxic}


def fit_rows(rows: Rows, toxic: np.ndarray, folds: int = 3, ridge: float = 0.3) -> Chain:
    """The chain of these rows, each link trained on out-of-fold probabilities of the ones before.

    The words that define the finer categories are found inside each training fold anew, so nothing of the rows outside takes part in their predictions.
    """
    whole, fold = derived(rows, toxic), np.arange(len(rows)) % folds
    parts = [(inside, outside, derived(rows.pick(inside), toxic[inside])) for inside, outside in ((np.flatnonzero(fold != k), np.flatnonzero(fold == k)) for k in range(folds))]
    before, links = np.zeros((len(rows), 0)), []
    for name in CHAIN:
        out = np.zeros(len(rows))
        for inside, outside, own in parts if name != CHAIN[-1] else ():
            part = _fit_link(rows.pick(inside), before[inside], own[name], ridge)
            out[outside] = part.probability(rows.pick(outside), before[outside])
        links.append(_fit_link(rows, before, whole[name], ridge))
        before = np.column_stack([before, out])
    return Chain(links)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> Chain:
    """A chain from labelled documents (``labels``: id and 0/1), of which at most ``sample`` are read.

    Rows with a null label or id are left out. Only the text is an input of the models.
    """
    return fit_rows(*collected(sampled(docs, labels, text, id_column, label, sample, 13), features_of))


def score(docs: DataFrame, chain: Chain, text: str = "text", id_column: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: its id, ``score`` (probability of ``toxic``), ``predicted`` (1 from the threshold on) and one column ``p_...`` per category.

    Null and empty texts get what the models say of a text without words. Texts of any length are read whole, an empty table gives an empty table. Repeated
    rows stay; other columns are neither read nor returned, whatever their names.
    """
    names = [f"p_{c}" for c in CHAIN]

    wanted = chain.wanted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = [chain.probabilities(rows_of(lists)) for lists in features_of(batch.column(1), wanted)]
            p = np.concatenate(found) if found else np.zeros((0, len(CHAIN)))
            columns = [pa.array(p[:, -1]), pa.array((p[:, -1] >= threshold).astype(np.int32)), *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(len(CHAIN)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_column, "score", "predicted", *names])

    own = taken(docs, id=id_column, text=text)
    schema = StructType([StructField(id_column, own.schema["id"].dataType), StructField("score", DoubleType()), StructField("predicted", IntegerType()), *(StructField(n, DoubleType()) for n in names)])
    return small_batches(own).select("id", utf8("text").alias("text")).mapInArrow(run, schema)
