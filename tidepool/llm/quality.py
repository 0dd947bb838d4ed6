"""Quality classifier: naive Bayes support vectors on n-grams of word shapes.

A word's shape is its sequence of character classes, repeats collapsed: ``Word,`` is ``Aa,`` and ``WORD!!`` is ``A!``. A word that
repeats the one before has a mark of its own. Features are indicators of the 1- to 3-grams of shapes, hashed. Each indicator
is scaled by its class log-count ratio, a linear hinge-loss model is fitted by dual coordinate descent, and its margin is turned
into a probability by cross-fitted calibration.

The model is fitted on a bounded sample of labelled rows (``sample``, a parameter); every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tidepool.llm.bytestext import LOWER, SPACE, filled, flat, mix, prefix_sums, runs, slices, small_batches, span_hashes, spans_of, utf8
from tidepool.llm.columns import kept, numbered, place, taken
from tidepool.llm.linear import Rows, calibrate, dual_coordinate_descent, log_count_ratio, rows_of, sigmoid

WIDTH = 1 << 16
#: Labelled rows that a model is fitted on, at most: those first in the order of a hash of their id.
SAMPLE = 6000
#: A document is of quality from this score on.
THRESHOLD = 0.7


def _classes() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[48:58], out[65:91], out[97:123], out[128:] = ord("0"), ord("A"), ord("a"), ord("a")
    return out


_CLASS = _classes()


def shape_features(buffer: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """For each text the sorted numbers of its features; the first feature, 0, marks a text without words."""
    own = offsets - offsets[0]
    part = buffer[offsets[0] : offsets[-1]]
    starts, ends = runs(~SPACE[part], own[:-1])
    kinds = _CLASS[part]
    keep = np.ones(len(part), bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[starts] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    shapes = span_hashes(prefix_sums(kinds[keep]), place[starts], place[ends])
    words = span_hashes(prefix_sums(LOWER[part]), starts, ends)
    text_of = np.searchsorted(own, starts, "right") - 1
    same = np.zeros(len(starts), bool)
    same[1:] = (words[1:] == words[:-1]) & (text_of[1:] == text_of[:-1])
    shapes = np.where(same, np.uint64(0x5BD1E995), shapes)
    grams, owners = [shapes], [text_of]
    gram = shapes
    for n in (2, 3):
        gram = mix(gram[:-1] * np.uint64(0x2545F4914F6CDD1D) + shapes[n - 1 :]) if len(shapes) >= n else shapes[:0]
        whole = text_of[n - 1 :] == text_of[: len(text_of) - n + 1]
        grams.append(gram[whole])
        owners.append(text_of[n - 1 :][whole])
    number = np.concatenate(grams) % np.uint64(width - 1) + np.uint64(1)
    both = np.unique(np.concatenate(owners).astype(np.uint64) * np.uint64(width) + number)
    cuts = np.searchsorted(both, np.arange(1, len(own)).astype(np.uint64) * np.uint64(width))
    lists = np.split((both % np.uint64(width)).astype(np.int64), cuts[:-1])
    return [x if len(x) else np.zeros(1, np.int64) for x in lists]


def features_of(array: pa.Array) -> Iterator[list[np.ndarray]]:
    buffer, offsets = flat(array)
    for i, j in spans_of(offsets):
        yield shape_features(buffer, offsets[i : j + 1])


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, rows: Rows) -> np.ndarray:
        return sigmoid(self.slope * (rows.dot(self.weights) + self.bias) + self.offset)


def fit_rows(rows: Rows, labels: np.ndarray, folds: int = 3, cost: float = 0.1) -> Model:
    """The model of these rows; a sample of one class gives that class's share everywhere."""
    if not len(rows) or labels.all() or not labels.any():
        p = float((labels.sum() + 1) / (len(labels) + 2))
        return Model(np.zeros(WIDTH), 0.0, 0.0, float(np.log(p / (1 - p))))

    def fitted(chosen: np.ndarray) -> tuple[np.ndarray, float]:
        own = rows.pick(chosen)
        ratio = log_count_ratio(own, labels[chosen], WIDTH)
        size = np.sqrt(np.maximum(np.diff(own.start), 1)).mean()
        weights, bias = dual_coordinate_descent(own, ratio / size, labels[chosen], cost)
        return weights * ratio / size, bias

    margins, fold = np.zeros(len(rows)), np.arange(len(rows)) % folds
    for k in range(folds):
        inside, outside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if labels[inside].all() or not labels[inside].any():
            continue
        weights, bias = fitted(inside)
        margins[outside] = rows.pick(outside).dot(weights) + bias
    weights, bias = fitted(np.arange(len(rows)))
    return Model(weights, bias, *calibrate(margins, labels))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from labelled documents (``labels``: id and 0/1), of which at most ``sample`` are read.

    Only the text is an input of the model. Rows with a null label or id are left out; repeated equal labels count once.
    """
    return fit_rows(*collected(sampled(docs, labels, text, id_column, label, sample, 11), features_of))


def sampled(docs: DataFrame, labels: DataFrame, text: str, id_column: str, label: str, sample: int, seed: int) -> DataFrame:
    """(_id, label, _order, text): at most ``sample`` labelled rows, those first by a hash of their id, with their texts."""
    order = F.xxhash64(F.col("_id").cast("string"), F.lit(seed))
    known = taken(labels, _id=id_column, label=label).where("label is not null and _id is not null")
    chosen = known.select("_id", F.col("label").cast("int").alias("label"), order.alias("_order")).orderBy("_order", "_id").limit(sample)
    # bounded by ``sample``: ids and labels only
    own = taken(docs, id=id_column, text=text).select("id", utf8("text").alias("text"))
    return own.join(F.broadcast(chosen), F.col("id") == F.col("_id")).select("_id", "label", "_order", "text")


def collected(frame: DataFrame, features) -> tuple[Rows, np.ndarray]:
    """Features and labels of a table (_id, label, _order, text), in an order that does not depend on its partitions.

    Of rows with one id the least text is taken, so what is gathered is bounded by the labelled ids.
    """
    frame = small_batches(frame).groupBy("_id", "label", "_order").agg(F.min("text").alias("text")).select("label", "_order", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            lists = [x.astype(np.int32).tobytes() for part in features(batch.column(2)) for x in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.binary())], names=["label", "place", "features"])

    found = sorted(((r.place, bytes(r.features), r.label) for r in frame.mapInArrow(run, "label int, place long, features binary").collect()))
    return rows_of([np.frombuffer(x, np.int32) for _, x, _ in found]), np.array([y == 1 for _, _, y in found], bool)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on). Null texts count as empty and are scored too, as are texts of any length.

    Repeated rows stay, an empty table gives an empty table. Columns of ``docs`` with exactly those names are replaced; all others stay, whatever their names.
    """
    weights = model.weights.astype(np.float32)
    small = Model(weights, model.bias, model.slope, model.offset)
    old = [c for c in docs.columns if c not in names]
    own = small_batches(numbered(docs).select(*[c for c, name in zip(kept(docs), docs.columns, strict=True) if name not in names]))
    where = old.index(docs.columns[place(docs, text)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, where):
            scores = [small.probability(rows_of(lists)) for lists in features_of(filled(batch.column(where)))]
            values = np.concatenate(scores) if scores else np.zeros(0)
            columns = [*batch.columns, pa.array(values), pa.array((values >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "score", "predicted"])

    made = own.mapInArrow(run, StructType([*own.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))
    return made.toDF(*old, *names)


def training_rows(labels: DataFrame, id_column: str = "doc_id", parts: int = 4, held: int = 2) -> DataFrame:
    """Labels of the rows that may be learned from: those whose id's CRC-32 does not leave the held-out remainder."""
    own = numbered(labels)
    return own.where(~is_held_out(f"c{place(labels, id_column)}", parts, held)).toDF(*labels.columns)


def is_held_out(id_column: str = "doc_id", parts: int = 4, held: int = 2):
    text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(parts)) == held


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected, with their own columns, whatever their names. Null and empty texts are scored like others."""
    model = fit(docs, training_rows(labels, id_column), text, id_column)
    own = numbered(docs)
    marked = score(own, model, f"c{place(docs, text)}", threshold)
    return marked.where("predicted = 1").select(*kept(docs)).toDF(*docs.columns)
