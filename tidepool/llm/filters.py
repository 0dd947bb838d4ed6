"""What filters do to one another: for every order in which they can be applied, what each removes and what it costs.

A document's failures are a mask with a bit for each filter. Spark counts masks for each part of the corpus, so at most 2^n counts a part leave
the tables. The number of documents that a set of filters removes is a multilinear polynomial in one variable a filter, made from
those counts: at the corner where the variables of a set are 1 it is what that set removes. Differences of corners give what a filter
removes after others. Its partial derivative, integrated along the diagonal with exact rationals, is the filter's Shapley
value; times n! it is what the filter removes, summed over all orders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from fractions import Fraction
from functools import reduce
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.bytestext import utf8
from tidepool.llm.columns import taken
from tidepool.llm.scratch import cut

#: A maximal run of anything but space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
Test = Callable[[Column, Column], Column]

#: For each filter that looks at a text alone, whether it fails: functions of the text and of its words.
TEXT_FILTERS: dict[str, Test] = {
    "A": lambda text, words: F.size(words) < 200,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
    "C": lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}
#: The filter that a document fails if its text is that of a document with a smaller id.
COPIES = "E"

OUTPUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def removal_polynomial(counts: Mapping[int, int], n: int) -> list[int]:
    """Coefficients, by the set of variables as a mask, of the polynomial whose corners are the number of documents removed.

    A document with mask m is removed unless all filters in m are off: it adds 1 - prod(1 - x_i for i in m), whose coefficient of
    each set T within m, but the empty one, is 1 for an odd number of variables and -1 for an even one.
    """
    out = [0] * (1 << n)
    for variables in range(1, 1 << n):
        holding = sum(many for mask, many in counts.items() if mask & variables == variables)
        out[variables] = holding if variables.bit_count() % 2 else -holding
    return out


def corner(polynomial: list[int], chosen: int) -> int:
    """The polynomial where the variables of ``chosen`` are 1 and all others 0."""
    return sum(c for variables, c in enumerate(polynomial) if variables & chosen == variables)


def shapley(polynomial: list[int], variable: int) -> Fraction:
    """The partial derivative by a variable (its bit), integrated where all variables equal t, for t from 0 to 1."""
    by_degree: dict[int, int] = {}
    for variables, c in enumerate(polynomial):
        if variables & variable:
            degree = variables.bit_count() - 1
            by_degree[degree] = by_degree.get(degree, 0) + c
    return sum((Fraction(c, degree + 1) for degree, c in by_degree.items()), Fraction(0))


def effects(letters: str, counts: Mapping[int, tuple[int, int, int]]) -> Iterator[tuple]:
    """For masks with their numbers of documents, good ones and toxic ones: a row for each order and step, as ``OUTPUT`` after ``part``."""
    n, bit = len(letters), {letter: 1 << k for k, letter in enumerate(letters)}
    every, good, toxic = (removal_polynomial({m: c[k] for m, c in counts.items()}, n) for k in range(3))
    documents, whole = sum(c[0] for c in counts.values()), (1 << n) - 1
    at = {name: [corner(p, s) for s in range(1 << n)] for name, p in (("every", every), ("good", good), ("toxic", toxic))}
    shares = {letter: int(shapley(every, b) * factorial(n)) for letter, b in bit.items()}
    for order in permutations(letters):
        before = 0
        for step, letter in enumerate(order, 1):
            after = before | bit[letter]
            removed = at["every"][after] - at["every"][before]
            yield (
                "".join(order),
                step,
                documents - at["every"][after],
                removed,
                at["every"][bit[letter]] - removed,
                at["every"][whole] - at["every"][whole ^ bit[letter]],
                at["good"][after] - at["good"][before],
                at["toxic"][after] - at["toxic"][before],
                shares[letter],
            )
            before = after


def failures(docs: DataFrame, filters: Mapping[str, Test] = TEXT_FILTERS, copies: str | None = COPIES, text: str = "text", id_column: str = "doc_id", part: str = "source") -> DataFrame:
    """(doc_id, part, mask) for each row: bit k is set if the text fails the k-th filter by letter; a null part is the empty string.

    Null texts count as empty. A row without an id is never a copy, and makes none of others; of rows with equal ids none is a copy of the other.
    Texts of any length are read whole. An empty table gives an empty table.
    """
    letters = sorted([*filters, *([copies] if copies else [])])
    own = taken(docs, doc_id=id_column, text=text, part=part)
    own = own.select("doc_id", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    bits = [F.when(test(F.col("text"), F.col("words")), 1 << letters.index(letter)).otherwise(0) for letter, test in filters.items()]
    mask = reduce(Column.bitwiseOR, bits, F.lit(0)).alias("mask")
    if not copies:
        return own.select("doc_id", "part", mask)
    rows = cut(own.select("doc_id", "part", mask, F.sha2(utf8("text"), 256).alias("digest")), "failures")
    known, unknown = rows.where(F.col("doc_id").isNotNull()), rows.where(F.col("doc_id").isNull())
    # joined by digest and id together, so that the copies of one text are not one key
    firsts = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(0))
    told = known.join(firsts, ["digest", "doc_id"], "left")
    copy = F.coalesce("first", F.lit(1 << letters.index(copies)))
    return told.select("doc_id", "part", F.col("mask").bitwiseOR(copy).alias("mask")).unionByName(unknown.select("doc_id", "part", "mask"))


def mask_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask, and those labelled so. A document is good, or toxic, if any row of ``labels`` says 1 of its id."""
    own = taken(labels, doc_id="doc_id", quality="quality", toxic="toxic").where(F.col("doc_id").isNotNull())
    marks = own.groupBy("doc_id").agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c) for c in ("quality", "toxic")]).where("quality + toxic > 0")
    known, unknown = failed.where(F.col("doc_id").isNotNull()), failed.where(F.col("doc_id").isNull())
    marked = known.join(marks, "doc_id", "left").unionByName(unknown, allowMissingColumns=True)
    sums = [F.coalesce(F.sum(c).cast("long"), F.lit(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    return marked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *sums)


def _effects(letters: str):
    names = [c.split()[0] for c in OUTPUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(effects(letters, {c["mask"]: (c["n"], c["good"], c["toxic"]) for c in counts}))
                columns = [pa.array([part] * len(rows), pa.string()), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.string(), pa.int32(), *[pa.int64()] * 7], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Test] = TEXT_FILTERS, copies: str | None = COPIES) -> DataFrame:
    """For each part, each order of the filters and each step: what is kept, removed, redundant, failed by this filter alone, lost, and the filter's share.

    ``filters`` are tests by letter, ``copies`` the letter of the filter for copies (None: no such filter). Counts are of rows, so repeated rows count each.
    Columns are taken by place, so others may have any names. Empty tables of documents give no rows; without labels nothing good or toxic is lost.
    """
    letters = "".join(sorted([*filters, *([copies] if copies else [])]))
    counts = mask_counts(failures(docs, filters, copies), labels)
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    return parts.mapInArrow(_effects(letters), OUTPUT)
