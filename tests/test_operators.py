"""Properties of the operators and equality with DuckDB."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.functions import scalar
from cloudloom.operators import bounds, clouds, kmeans, morton, neighbors, quantize, tree
from cloudloom.plans import adapters, catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_duckdb(spark, duck, sf_dir, name):
    ours, theirs = catalog.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(catalog.SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns) and len(ours) == len(theirs)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (ours, theirs))
    for c in columns:
        assert (a[c] == b[c]).all(), c


def test_quantizer_golden(spark):
    values = spark.createDataFrame([(float(v),) for v in (0, 0, 1, 1, 1, 10, 10, 11)], "value double")
    assert quantize.codebook(values, 2) == pytest.approx([0.5505102, 10.414213], abs=1e-5)
    assert quantize.codebook(values, 8) == pytest.approx([0, 1, 10, 11, 11, 11, 11, 11])
    same = spark.createDataFrame([(2.0,), (2.0,)], "value double")
    assert quantize.codebook(same, 4) == [2.0] * 4
    assert quantize.codebook(same.where("false"), 4) == [0.0] * 4
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (1.0,), (3.0,)], "value double")
    assert quantize.codebook(odd, 2) == [1.0, 3.0]


def test_labels_are_the_nearest_codes(spark):
    book = [float(v * v) for v in range(40)]
    df = spark.range(2000).select("id", F.when(F.col("id") == 7, float("nan")).when(F.col("id") > 7, F.col("id") / 1.3).alias("v"))
    out = quantize.labelled(df, ["v"], book).select("label_v", scalar.nearest_code(F.col("v"), book).alias("want")).collect()
    assert all(r.label_v == r.want for r in out) and {r.label_v for r in quantize.labelled(df, ["v"], [1.0] * 3).collect()} == {0}


def test_packing_golden(spark):
    def pack(counts):
        rows = spark.createDataFrame([(8 + k, 3, 0, n) for k, n in enumerate(counts)], "node long, depth int, lod int, n long")
        return [(r.file_index, r.offset) for r in sorted(tree.pack_chunks(rows, 10).collect(), key=lambda r: r.node)]

    assert pack([5, 4, 3, 12, 1]) == [(0, 0), (0, 5), (1, 0), (2, 0), (3, 0)]
    assert pack([9, 9]) == [(0, 0), (1, 0)]


def test_tree_is_the_same_when_ranked_over_tasks(spark, sf_dir):
    p = adapters.points(spark, sf_dir)
    one, many = (tree.build(p, 1, 16.0, local_rows=n).select("gid", "node").toPandas().set_index("gid").sort_index() for n in (10**9, 0))
    assert (one == many).all().all()
    assert one.groupby("node").size().max() <= 1024


def test_orders_do_not_depend_on_partitions(spark, sf_dir):
    p = adapters.points(spark, sf_dir)
    a, b = (morton.ordered(p.repartition(n)).select("gid", "pos").toPandas().sort_values("gid")["pos"].tolist() for n in (1, 7))
    assert a == b and sorted(a) == list(range(len(a)))


def test_kmeans(spark):
    r = np.random.default_rng(0)
    rows = [(int(i), [float(v) for v in r.normal(10 * (i % 3), 0.1, 4)]) for i in range(90)]
    points = spark.createDataFrame(rows, "id long, vec array<double>")
    centroids, out = kmeans.kmeans(points, 3, 3, start=[rows[0][1], rows[1][1], rows[2][1]])
    assert [round(c[0], 0) for c in centroids] == [0, 10, 20]
    assert all(x.cid == x.id % 3 for x in out.collect())
    assert {x.cid for x in kmeans.kmeans(points, 3, 0)[1].collect()} == {0}


def test_clouds(spark):
    a = spark.createDataFrame([(0, [1.0] * 9)], "gid long, f_rest array<float>")
    b = spark.createDataFrame([(0, [2.0] * 24), (1, [])], "gid long, f_rest array<float>")
    out = {r.gid: r.f_rest for r in clouds.union([(a, 0), (b, 3)]).collect()}
    assert out[0] == ([1.0] * 3 + [0.0] * 5) * 3 and out[1 << 40] == [2.0] * 24 and out[(1 << 40) + 1] == [0.0] * 24
    assert clouds.filter_harmonics(b.where("gid = 0"), 0).first().f_rest == []
    assert len(clouds.filter_harmonics(a, 2).first().f_rest) == 9
    with pytest.raises(ValueError):
        clouds.union([(a, 256)])


def test_finite_rows_only_count_for_bounds(spark):
    nan = float("nan")
    rows = spark.createDataFrame([(1, 0, 0, 1.0, 2.0, 3.0), (2, 0, 0, nan, 0.0, 0.0), (3, 0, 0, float("inf"), 9.0, 9.0)], "gid long, node long, depth int, x double, y double, z double")
    r = tree.leaf_bounds(rows).first()
    assert (r.min_x, r.max_y, r.n) == (1.0, 2.0, 3)
    assert rows.where(bounds.finite("x")).count() == 1


def test_dynamic_index(spark, tmp_path):
    mk = lambda rows: spark.createDataFrame(rows, "id long, vec array<double>")
    index = neighbors.DynamicIndex(mk([(1, [0.0]), (2, [1.0])]))
    index.add(mk([(3, [0.1])]))
    index.remove(mk([(1, [0.0])]))
    q = spark.createDataFrame([(0, [0.0])], "qid long, vec array<double>")
    assert [r.id for r in index.search(q, 2).orderBy("rank").collect()] == [3, 2]
    index.save(str(tmp_path / "index"))
    assert neighbors.DynamicIndex.load(spark, str(tmp_path / "index")).current().count() == 2
    assert neighbors.knn(index.current(), q.where("false"), 1).count() == 0
    assert neighbors.radius_search(index.current(), q, 0.5, "l1").where(F.col("id") == 3).count() == 1


def with_odd(spark, n=20):
    """Points on a line, and with them rows whose positions are not finite."""
    rows = [(k, 0, float(k), 2.0 * k, -1.0 * k) for k in range(n)]
    odd = [(n, 0, float("nan"), 1.0, 1.0), (n + 1, 0, float("inf"), 1.0, 1.0), (n + 2, 0, 1.0, float("-inf"), None)]
    make = lambda r: spark.createDataFrame(r, "gid long, lod smallint, x float, y float, z float")
    return make(rows), make(rows + odd)


def test_odd_positions_change_no_other_row(spark):
    from cloudloom.operators import textures

    clean, odd = with_odd(spark)
    a, b = ({r.gid: r.code for r in morton.encode(p).collect()} for p in (clean, odd))
    assert len(set(a.values())) > 15 and {k: b[k] for k in a} == a and all(v is not None for v in b.values())
    a, b = (textures.means(p.withColumn("pos", F.col("gid")), p.count()) for p in (clean, odd))
    assert a[1] == b[1]
    for name in ("means_l", "means_u"):
        x, y = ({r.ti: tuple(r)[3:] for r in t[0][name].collect()} for t in (a, b))
        assert all(x[k] == y[k] for k in range(20)) and all(v is not None for p in y.values() for v in p)
    tree_rows = tree.build(odd, 1, 16.0).collect()
    assert sorted(r.gid for r in tree_rows) == list(range(23))


@pytest.mark.parametrize("local_rows", [0, 300, 10**9])
def test_tree_splits_at_the_median_of_its_longest_axis(spark, local_rows):
    """Against a plain recursion, with ties, odd positions and nodes of all points alike."""
    r = np.random.default_rng(3)
    xyz = r.integers(0, 40, (1500, 3)).astype(np.float32)
    xyz[:5, 0], xyz[5:8, 1], xyz[700:] = np.nan, np.inf, xyz[700]
    points = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(xyz)], "gid long, x float, y float, z float")
    want, todo = {}, [(1, 0, list(range(len(xyz))))]
    while todo:
        node, depth, rows = todo.pop()
        ext = []
        for a in range(3):
            v = [xyz[k, a] for k in rows if np.isfinite(xyz[k]).all()]
            ext.append(float(max(v)) - float(min(v)) if v else 0.0)
        if len(rows) <= 256 or len(rows) <= 1024 and max(ext) <= 16:
            want |= {k: (node, depth) for k in rows}
            continue
        axis = 1 if ext[1] > ext[0] and ext[1] > ext[2] else 2 if ext[2] > ext[0] and ext[2] > ext[1] else 0
        rows.sort(key=lambda k: (np.isnan(xyz[k, axis]), 0 if np.isnan(xyz[k, axis]) else xyz[k, axis], k))
        todo += [(2 * node, depth + 1, rows[: len(rows) // 2]), (2 * node + 1, depth + 1, rows[len(rows) // 2 :])]
    got = {x.gid: (x.node, x.depth) for x in tree.build(points, 1, 16.0, local_rows).collect()}
    assert got == want


def test_codebooks_are_optimal():
    """Against all ways to cut the bins."""
    import itertools

    r = np.random.default_rng(1)
    for _ in range(60):
        n, k = int(r.integers(2, 10)), int(r.integers(1, 6))
        weight, centre = r.choice([0.0, 1.0, 2.0, 5.5], n), np.sort(r.normal(size=n))
        if not weight.any():
            continue
        error = lambda codes: sum(w * min((c - v) ** 2 for v in codes) for w, c in zip(weight, centre, strict=True) if w)  # noqa: E731,B023
        best = np.inf
        for cuts in itertools.combinations(range(1, n), min(k, n) - 1):
            parts = [range(a, b) for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
            best = min(best, error([sum(weight[i] * centre[i] for i in p) / sum(weight[i] for i in p) for p in parts if sum(weight[i] for i in p)]))
        got = quantize.solve(weight, centre, k)
        assert len(got) == k and got == sorted(got) and error(got) <= best + 1e-5


@pytest.mark.parametrize("metric", ["l2", "l1"])
def test_searches_against_brute_force(spark, metric):
    """More index rows than a block, equal distances, and a query of the index."""
    r = np.random.default_rng(2)
    x, q = r.integers(0, 6, (1300, 3)).astype(float), r.integers(0, 6, (40, 3)).astype(float)
    index = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vec array<double>").repartition(3)
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(q)], "qid long, vec array<double>")
    d = neighbors.distances(x, q, metric)
    got = {(row.qid, row["rank"]): (row.id, row.distance) for row in neighbors.knn(index, queries, 7, metric).collect()}
    assert got == {(j, k + 1): (i, d[i, j]) for j in range(40) for k, i in enumerate(np.lexsort((np.arange(1300), d[:, j]))[:7])}
    found = {(row.qid, row.id) for row in neighbors.radius_search(index, queries, 3.0, metric).collect()}
    assert found == {(j, i) for i, j in zip(*np.nonzero(d < 3.0), strict=True)}

    def longest(batches):
        for batch in batches:
            yield batch.filter(pc.greater(batch.column(2), 1.0))

    import pyarrow.compute as pc

    seen = {(row.qid, row.id) for row in neighbors.radius_visit(index, queries, 3.0, longest, "qid long, id long, distance double", metric).collect()}
    assert seen == {(j, i) for i, j in zip(*np.nonzero((d < 3.0) & (d > 1.0)), strict=True)}


def test_nearest_centroid_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "CENTROIDS", 7)
    r = np.random.default_rng(5)
    x, c = r.integers(0, 5, (200, 2)).astype(float), r.integers(0, 5, (30, 2)).astype(float)
    for metric in ("l2", "l1"):
        best, d = neighbors.nearest_of(x, c, metric)
        every = neighbors.distances(x, c, metric)
        assert (best == every.argmin(1)).all() and np.allclose(d, every.min(1))
