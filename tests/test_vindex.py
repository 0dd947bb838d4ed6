"""The vector index against all distances, its recall, and what it reads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import vector, vindex


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    points = centres[rng.choice(12, 1500, p=[0.4, *[0.6 / 11] * 11])] + rng.normal(size=(1500, 16)) * 0.35
    points[7] = 0
    points[20] = points[21]
    return points.round(4)


@pytest.fixture(scope="module")
def index(spark, table, tmp_path_factory):
    rows = [(k, v.tolist()) for k, v in enumerate(table)] + [(9999, None)]
    return vindex.build(spark.createDataFrame(rows, "id long, embedding array<double>").repartition(5), str(tmp_path_factory.mktemp("vectors")))


def slow(table, asked, k=10):
    points = vindex.unit(table)
    out = []
    for q, v in asked:
        far = np.maximum(0, 1 - points @ vindex.unit(np.array([v]))[0]).round(6)
        order = sorted((d, i) for i, d in enumerate(far) if i != q)[:k]
        out += [(q, rank, i, d) for rank, (d, i) in enumerate(order, 1)]
    return out


@pytest.fixture(scope="module")
def queries(spark, table):
    rows = [(k, table[k].tolist()) for k in range(0, 1500, 50)] + [(7, table[7].tolist()), (-1, [1.0] * 16)]
    return rows, spark.createDataFrame(rows, "query_id long, v array<double>")


def test_exact(index, table, queries):
    rows, frame = queries
    got = sorted((r.query_id, r["rank"], r.distance, r.id) for r in index.search(frame, exact=True).where("query_id <> 7").collect())
    want = sorted((q, rank, float(d), i) for q, rank, i, d in slow(table, [r for r in rows if r[0] != 7]))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=2e-6)
    assert sum(a[3] == b[3] for a, b in zip(got, want)) >= 0.99 * len(want)  # sums in another order may part ties
    alone = index.search(frame.where("query_id = 7"), exact=True).collect()
    assert [(r.id, r.distance) for r in sorted(alone, key=lambda r: r["rank"])] == [(k, 1.0) for k in range(10) if k != 7] + [(10, 1.0)]


def test_recall(index, table, queries):
    rows, frame = queries
    found, want = index.search(frame), {(q, i) for q, _, i, _ in slow(table, rows) if q != 7}
    got = {(r.query_id, r.id) for r in found.collect()}
    assert len(got & want) >= 0.9 * len(want)
    told = vindex.recall(found, index.search(frame, exact=True)).where("query_id <> 7").agg(F.sum("hits").alias("h"), F.sum("of").alias("o")).first()
    assert told.h >= 0.9 * told.o and told.o == 10 * (len(rows) - 1)


def test_every_row_is_filed_once_and_only_probed_cells_are_read(index):
    ids = [i for r in index.blocks().collect() for i in r.ids]
    assert sorted(ids) == list(range(1500))
    assert index.probes < len(index.cells) and sum(index.sizes) == 1500
    few = index.blocks([int(index.cells[0]), int(index.cells[1])])
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    assert {f.split("cell=")[1].split("/")[0] for r in few.select(F.input_file_name().alias("f")).collect() for f in [r.f]} == {str(index.cells[0]), str(index.cells[1])}


def test_bounds_hold():
    rng = np.random.default_rng(1)
    points, query = vindex.unit(rng.normal(size=(500, 8))), vindex.unit(rng.normal(size=(1, 8)))
    for _ in range(20):
        centre = vindex.unit(rng.normal(size=(1, 8)))
        near = points[(points @ centre[0]) > 0.5]
        if len(near):
            assert (near @ query[0]).max() <= vindex.reach((centre @ query[0]), (near @ centre[0]).min())[0]


def test_refusals_and_empty_tables(spark, index, tmp_path):
    with pytest.raises(Exception, match="components"):
        index.search(spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, v array<double>")).collect()
    with pytest.raises(ValueError, match="components"):
        vindex.build(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, embedding array<double>"), str(tmp_path / "odd"))
    mixed = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id long, embedding array<double>")
    with pytest.raises(Exception, match="a vector of 1 components"):
        vector.nearest(mixed, [1.0, 0.0], 2).collect()
    assert [r.id for r in vector.nearest(mixed.where("id <> 2"), [1.0, 0.0], 2).collect()] == [1]
    none = vindex.build(spark.createDataFrame([(1, None)], "id long, embedding array<double>"), str(tmp_path / "none"))
    assert none.search(spark.createDataFrame([(1, [1.0])], "query_id long, v array<double>")).count() == 0
    one = vindex.build(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "id long, embedding array<float>"), str(tmp_path / "one"))
    got = one.search(spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, v array<double>"), exact=True).collect()
    assert [(r.id, r.distance) for r in got] == [(2, 0.0)]


def test_fit_holds_few_cosines():
    import tracemalloc

    rng = np.random.default_rng(3)
    points = vindex.unit(rng.normal(size=(20_000, 8)))
    centroids = points[::100]
    tracemalloc.start()
    probes = vindex.probes_for(points, centroids)
    assert len(vindex.nearest_cells(points, centroids, 1)) == len(points) and 1 <= probes <= len(centroids)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 120e6  # 240 MB where all cosines are held


def test_sample_leaves_the_driver_few_rows(spark, monkeypatch):
    monkeypatch.setattr(vindex, "SAMPLE", 300)
    frame = spark.range(6000).repartition(12).select("id", F.array(F.col("id").cast("float"), F.lit(1).cast("float")).alias("v"))
    want = [float(r.id) for r in frame.orderBy(F.xxhash64("id"), "id").limit(300).collect()]
    assert vindex.sampled(frame, 6000)[:, 0].tolist() == want
    same = frame.select(F.lit(5).cast("long").alias("id"), "v")
    assert vindex.sampled(same, 6000).shape == (300, 2)
    assert vindex.sampled(frame.where("id < 0"), 0).shape == (0, 0)
    with pytest.raises(ValueError):
        vindex.sampled(frame.withColumn("v", F.when(F.col("id") % 2 == 0, F.array(F.lit(1.0))).otherwise(F.col("v").cast("array<double>"))), 6000)


def test_twice_is_both(index, queries):
    frame, key = queries[1], lambda r: (r.query_id, r["rank"])
    loose, exact = index.search_twice(frame)
    assert sorted(loose.collect(), key=key) == sorted(index.search(frame).collect(), key=key)
    assert sorted(exact.collect(), key=key) == sorted(index.search(frame, exact=True).collect(), key=key)


def test_no_queries_or_blocks_are_broadcast(index, queries):
    """Packs of queries are small in files, which hold repeated vectors once, and large in the driver."""
    frame = queries[1]
    plan = lambda rows: rows._jdf.queryExecution().executedPlan().toString()
    floors = frame.select("query_id", F.lit(0.5).alias("floor"))
    first, second = index._probing(frame, 3, None), index._probing(frame, 3, floors)
    assert "BroadcastExchange" not in plan(second)
    assert "BroadcastExchange" not in plan(index._scored(first, 10, len(queries[0]), 1e-6))
    assert "BroadcastExchange" not in plan(index.search(frame, exact=True))


def test_found_rows_are_not_broadcast(index, queries):
    found, exact = index.search_twice(queries[1])
    told = vindex.recall(found, exact)
    assert "BroadcastExchange" not in told._jdf.queryExecution().executedPlan().toString()
    pairs = {(r.query_id, r.id) for r in found.collect()}
    want = {}
    for r in exact.collect():
        hits, of = want.get(r.query_id, (0, 0))
        want[r.query_id] = hits + ((r.query_id, r.id) in pairs), of + 1
    assert {r.query_id: (r.hits, r.of) for r in told.collect()} == want
