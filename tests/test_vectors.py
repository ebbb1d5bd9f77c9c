"""The index of vectors: the answers of a scan, from a part of the lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.engine import Engine
from corpuslens.operators import search, vectors

DIM = 8


@pytest.fixture(scope="module")
def points():
    """Twenty groups, one point that a third of all rows repeat, and ties."""
    rng = np.random.default_rng(2)
    out = np.concatenate([rng.normal(rng.normal(0, 10, DIM), 1.0, (60, DIM)) for _ in range(20)] + [np.tile(rng.normal(0, 10, DIM), (600, 1))])
    out[5] = out[7] = out[11]
    return out.astype(np.float32)


@pytest.fixture(scope="module")
def rows(spark, points):
    odd = [("null", "w0", None), ("short", "w0", [1.0]), ("holed", "w0", [None] * DIM)]
    return spark.createDataFrame([(f"c{k:05d}", f"w{k % 3}", p.tolist()) for k, p in enumerate(points)] + odd, "chunk_id string, workspace_id string, embedding array<float>").cache()


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    centres, at = vectors.fit(rows), str(tmp_path_factory.mktemp("index"))
    vectors.placed(rows, centres).sort("cell", "away").write.mode("overwrite").parquet(at)
    stored = spark.read.parquet(at)
    return stored, centres, vectors.lists(stored)


def test_lists_hold_every_vector_once(rows, index, points):
    stored, centres, known = index
    assert centres.shape == (round(len(points) ** 0.5), DIM) or len(centres) <= round(len(points) ** 0.5)
    assert stored.filter("cell IS NULL").count() == 3 and sum(n for n, _, _ in known.values()) == len(points)
    for r in stored.filter("cell IS NOT NULL").limit(200).collect():
        d = np.sqrt(((centres - np.array(r.embedding)) ** 2).sum(1))
        assert r.away == pytest.approx(d.min(), abs=1e-6) and d[r.cell] == pytest.approx(d.min(), abs=1e-6)


@pytest.mark.parametrize("limit", [1, 7, 700, 5000])
def test_nearest_is_that_of_a_scan(rows, index, points, limit):
    stored, centres, known = index
    clean = rows.filter(~F.exists(F.coalesce("embedding", F.array()), lambda x: x.isNull()))
    for target in (points[3].tolist(), points[-1].tolist(), [0.0] * DIM, (points[40] + 50).tolist())[: 4 if limit == 7 else 1]:
        for where in (None, F.col("workspace_id") == "w1", F.col("workspace_id") == "none"):
            want = search.nearest(clean, target, limit, where=where).collect()
            got = vectors.nearest(stored, centres, known, target, limit, where=where).collect()
            assert [r.chunk_id for r in got] == [r.chunk_id for r in want] and np.allclose([r.distance for r in got], [r.distance for r in want])
            if limit > 7:
                break
    assert vectors.nearest(stored, centres, known, [1.0], 5).count() == 0


def test_nearest_of_many_queries_is_that_of_scans(rows, index, points):
    stored, centres, known = index
    queries = rows.filter(F.substring("chunk_id", 2, 5).try_cast("int") % 50 == 0).select(F.col("chunk_id").alias("query"), F.col("embedding").alias("target"))
    got = vectors.nearest_all(stored, centres, known, queries, 6).cache()
    assert got.count() == 6 * queries.count()
    wide = points.astype(np.float64)
    for r in got.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id"))).alias("a")).collect():
        d = np.sqrt(((wide - wide[int(r.query[1:])]) ** 2).sum(1))
        assert [x.chunk_id for x in r.a] == [f"c{k:05d}" for k in sorted(range(len(d)), key=lambda k: (d[k], k))[:6]]
    assert vectors.share_read(stored, centres, known, queries.limit(8), got) < 0.4
    assert vectors.nearest_all(stored, centres, known, queries.filter("false"), 6).count() == 0
    other = stored.unionByName(stored.limit(9).withColumn("embedding", F.slice("embedding", 1, 3)))  # left from an index of another dimension
    assert [r.distance for r in vectors.nearest(other, centres, known, points[0].tolist(), 3).collect()][0] == 0


def test_bounds_reach_the_scan(index, points):
    stored, centres, known = index
    plan = vectors.nearest(stored, centres, known, points[3].tolist(), 5)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "away" in plan.split("PushedFilters", 1)[1].split("\n")[0]


def test_no_vectors_give_an_empty_index(spark):
    none = spark.createDataFrame([("a", None)], "chunk_id string, embedding array<float>")
    for rows in (none, none.filter("false")):
        centres = vectors.fit(rows)
        assert len(centres) == 0
        assert vectors.nearest(rows.withColumns({"cell": F.lit(None).cast("int"), "away": F.lit(None).cast("double")}), centres, {}, [1.0], 3).count() == 0


def test_another_dimension_begins_a_new_index(spark, tmp_path):
    (tmp_path / "w").mkdir()
    for k in range(6):
        (tmp_path / "w" / f"{k}.txt").write_text("a" * (k + 1) + " b" * (6 - k))
    count = lambda letters: lambda texts: [[float(t.count(x)) for x in letters] for t in texts]
    engine = Engine(spark, f"file://{tmp_path}/s", embedder=count("ab"))
    ws = engine.add_workspace(str(tmp_path / "w"), enable_vector_search=True)
    engine.index(ws)
    assert engine.centres().shape[1] == 2 and engine.vector_count() == 6
    found = [r.name for r in engine.search("aaaaaa b", [ws], mode="semantic", limit=2).collect()]
    assert found[0] == "5.txt"
    engine.embedder = count("abc")
    engine.index(ws, force=True)
    assert engine.centres().shape[1] == 3 and engine.store.read("vectors").filter("cell IS NULL").count() == 0
    assert engine.rebuild_vectors() == len(engine.centres()) and engine.vector_count(ws) == 6
    assert [r.name for r in engine.search("aaaaaa b", [ws], mode="semantic", limit=2).collect()] == found


def test_queries_meet_lists_in_bounded_blocks(rows, index, points, monkeypatch):
    """No group holds more vectors than a block, not even of a point that a third of all rows repeat, and the answers are those of one block."""
    stored, centres, known = index
    queries = rows.filter("embedding IS NOT NULL AND size(embedding) = 8 AND NOT exists(embedding, x -> x IS NULL)").select(F.col("chunk_id").alias("query"), F.col("embedding").alias("target"))
    queries = queries.filter(F.substring("query", 2, 5).cast("int") % 31 == 0)
    whole = sorted(map(tuple, vectors.nearest_all(stored, centres, known, queries, 6).collect()))
    dealt = vectors.blocks(known, centres, 50)
    assert sorted(c for cells, _ in dealt for c in cells) == sorted(known)
    assert all(sum(known[c][0] for c in cells) <= 50 * parts for cells, parts in dealt) and max(parts for _, parts in dealt) >= 600 // 50
    monkeypatch.setattr(vectors, "BLOCK", 20)
    monkeypatch.setattr(vectors, "PRODUCTS", 100)
    monkeypatch.setattr(vectors.blocks, "__defaults__", (50,))
    assert sorted(map(tuple, vectors.nearest_all(stored, centres, known, queries, 6).collect())) == whole
