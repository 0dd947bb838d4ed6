"""Rows move to tiles of several cells, and ids of any kind are compared in order."""

import random

import numpy as np
import pyarrow as pa

from tidepool.operators import vector


def test_cells_share_tiles():
    tiles = vector.tiles_of({0: 3, 1: 3, 2: 9, 5: 1, 6: 6}, 7)
    assert tiles == {0: 0, 1: 0, 2: 1, 5: 2, 6: 2}
    told = np.array([tiles.get(c, -1) for c in range(7)], np.int32)
    rows = pa.RecordBatch.from_arrays([pa.array([[0, 1, 2], [1, 5, 6], [2]], pa.list_(pa.int32()))], names=["cells"])
    assert next(vector._tiles_visited([rows], told)).to_pylist() == [{"tile": 0, "n": 2}, {"tile": 1, "n": 2}, {"tile": 2, "n": 1}]


def test_text_ids_and_several_tiles(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(f"r{rng.randrange(10**6)}-{k}", [rng.gauss(0, 1) for _ in range(4)]) for k in range(80)]
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    want = {i: min(near) for i in unit if (near := [j for j in unit if j < i and 1 - unit[i] @ unit[j] < 0.5])}
    monkeypatch.setattr(vector, "LEAST", 1)
    frame = spark.createDataFrame(rows, "id string, embedding array<double>")
    got = {r.id: r.parent for r in vector.lowest_neighbours(frame, 0.5, cells=9, block=20).collect()}
    assert got == want and len(want) > 40
