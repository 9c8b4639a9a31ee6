"""One query for each operator over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloudloom.functions import scalar
from cloudloom.operators import bounds, clouds, kmeans, morton, neighbors, quantize, textures, tree
from cloudloom.plans import adapters as ad
from cloudloom.plans import encode
from cloudloom.schema import BASE, COLOURS, ROTATION, SCALES
from cloudloom.shared import new_path, written
from cloudloom.sources import ply

#: A codebook of 16 values for lineitem prices, k centroids and query ids for embeddings.
BOOK = [float(900 + 6500 * k) for k in range(16)]
K, EVERY = 16, 20
LEVELS = 14
BOX = ((100.0, 200.0, 300.0), (300.0, 900.0, 1500.0))

AXES = "xyz"
D = lambda c: F.col(c).cast("double")

POINTS = """points AS (SELECT o_orderkey AS gid, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS lod, CAST(CAST(o_totalprice / 1000 AS FLOAT) AS DOUBLE) AS x,
  CAST(CAST(o_custkey AS FLOAT) AS DOUBLE) AS y, CAST(CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS FLOAT) AS DOUBLE) AS z FROM orders)"""


def _spread(v: str) -> str:
    return "(" + " + ".join(f"((({v}) >> {i}) & 1) * {8**i}" for i in range(10)) + ")"


def _cell(a: str, over: str = "") -> str:
    lo, hi = (f"({f}({a}){over} {s} 0.01::DOUBLE)" for f, s in (("min", "-"), ("max", "+")))
    return f"CAST(floor(least(greatest(({a} - {lo}) / ({hi} - {lo}), 0), 1) * 1023) AS BIGINT)"


def _codes(over: str) -> str:
    return f"""cells AS (SELECT *, {', '.join(f'{_cell(a, over)} AS c{a}' for a in AXES)} FROM points),
codes AS (SELECT *, 4 * {_spread('cx')} + 2 * {_spread('cy')} + {_spread('cz')} AS code FROM cells)"""


def _tree_sql() -> str:
    """All levels unrolled: each row carries its node; rows of finished nodes keep theirs."""
    out = [f"WITH {POINTS}, l0 AS MATERIALIZED (SELECT gid, lod, x, y, z, CAST(1 AS BIGINT) AS node, 0 AS depth, false AS done FROM points)"]
    for k in range(LEVELS):
        out.append(f"""b{k} AS MATERIALIZED (SELECT *, count(*) OVER w AS n, max(x) OVER w - min(x) OVER w AS ex, max(y) OVER w - min(y) OVER w AS ey, max(z) OVER w - min(z) OVER w AS ez
  FROM l{k} WHERE NOT done WINDOW w AS (PARTITION BY node)),
c{k} AS MATERIALIZED (SELECT *, (n <= 256 OR (n <= 1024 AND greatest(ex, ey, ez) <= 16)) AS leaf, CASE WHEN ey > ex AND ey > ez THEN y WHEN ez > ex AND ez > ey THEN z ELSE x END AS v FROM b{k}),
l{k + 1} AS MATERIALIZED (SELECT gid, lod, x, y, z, node, depth, done FROM l{k} WHERE done UNION ALL SELECT gid, lod, x, y, z, node, depth, true FROM c{k} WHERE leaf
  UNION ALL SELECT gid, lod, x, y, z, 2 * node + CASE WHEN row_number() OVER (PARTITION BY node ORDER BY v, gid) <= n // 2 THEN 0 ELSE 1 END, {k + 1}, false FROM c{k} WHERE NOT leaf)""")
    return ",\n".join(out) + f",\ntree AS MATERIALIZED (SELECT * FROM l{LEVELS})"


TREE = _tree_sql()
BINS = TREE + ", bins AS MATERIALIZED (SELECT node, depth, lod, count(*) AS n, node << (60 - depth) AS pos FROM tree GROUP BY node, depth, lod)"
CHUNKS = (
    BINS.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, seq AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lod ORDER BY pos) AS k FROM bins),
fold AS (SELECT node, depth, lod, n, pos, k, 0 AS file_index, CAST(0 AS BIGINT) AS "offset" FROM seq WHERE k = 1
  UNION ALL SELECT s.node, s.depth, s.lod, s.n, s.pos, s.k, f.file_index + CASE WHEN f."offset" + f.n + s.n > 1024 THEN 1 ELSE 0 END,
    CASE WHEN f."offset" + f.n + s.n > 1024 THEN 0 ELSE f."offset" + f.n END FROM fold f JOIN seq s ON s.lod = f.lod AND s.k = f.k + 1)"""
)
QUAT = "q AS (SELECT vec_id AS gid, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS q{k}" for k in range(4)) + ", " + ", ".join(f"CAST(embedding[{k + 5}] AS DOUBLE) AS s{k}" for k in range(3)) + ", " + ", ".join(f"CAST(embedding[{k + 8}] AS DOUBLE) AS {a}" for k, a in enumerate(AXES)) + " FROM embeddings), n AS (SELECT *, sqrt(q0*q0+q1*q1+q2*q2+q3*q3) AS len FROM q), u AS (SELECT gid, s0, s1, s2, x, y, z, CASE WHEN len > 0 THEN q0/len ELSE q0 END AS a, CASE WHEN len > 0 THEN q1/len ELSE q1 END AS b, CASE WHEN len > 0 THEN q2/len ELSE q2 END AS c, CASE WHEN len > 0 THEN q3/len ELSE q3 END AS d FROM n)"
_R = [["1-2*(c*c+d*d)", "2*(b*c-a*d)", "2*(b*d+a*c)"], ["2*(b*c+a*d)", "1-2*(b*b+d*d)", "2*(c*d-a*b)"], ["2*(b*d-a*c)", "2*(c*d+a*b)", "1-2*(b*b+c*c)"]]
ROTATED = QUAT + ", r AS (SELECT *, " + ", ".join(f"{_R[i][j]} AS r{i}{j}" for i in range(3) for j in range(3)) + " FROM u)"
CENTROIDS = f"c0 AS (SELECT vec_id AS cid, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings WHERE vec_id < {K}), v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"


def _assign(c: str, out: str) -> str:
    return f"""{out} AS MATERIALIZED (SELECT id, any_value(vec) AS vec, arg_min(cid, struct_pack(d := d, cid := cid)) AS cid FROM (
  SELECT v.id, v.vec, c.cid, list_sum(list_transform(range(1, len(v.vec) + 1), lambda i: (v.vec[i] - c.vec[i]) * (v.vec[i] - c.vec[i]))) AS d FROM v, {c} c) GROUP BY id)"""


def _update(a: str, c: str, out: str) -> str:
    return f"""{out} AS MATERIALIZED (SELECT c.cid, coalesce(m.vec, c.vec) AS vec FROM {c} c LEFT JOIN (SELECT cid, list(mean ORDER BY place) AS vec FROM (
  SELECT cid, place, avg(vec[place]) AS mean FROM {a}, (SELECT unnest(range(1, 65)) AS place) GROUP BY cid, place) GROUP BY cid) m ON m.cid = c.cid)"""


def _start(spark, d):
    rows = ad.vectors(spark, d).where(F.col("id") < K).select("id", F.col("vec").cast("array<double>").alias("vec")).collect()
    return [list(r.vec) for r in sorted(rows, key=lambda r: r.id)]


def _queries(spark, d):
    return ad.vectors(spark, d).where(F.col("id") % EVERY == 0).select(F.col("id").alias("qid"), "vec")


def _tree(spark, d):
    return written(tree.build(ad.points(spark, d), 1, 16.0), "tree")


def _numbered(df):
    """df with pos, the place of its gid."""
    return bounds.ranked(df.withColumn("__all", F.lit(0)), "__all", ["gid"], "pos").withColumn("pos", F.col("pos") - 1).drop("__all")


def _bytes(df, *keep):
    """Pixels with their bytes as whole numbers of one width."""
    return df.select(*keep, "ti", "px", "py", *[F.col(c).cast("int") for c in "rgba"])


def _prices(spark, d):
    return ad.table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("value"))


def _chunks(spark, d):
    return tree.pack_chunks(tree.leaf_lod_bins(_tree(spark, d)), tree.TO_ROWS)


def _rounded(df, places=6):
    """Doubles to some places, so that the order of sums does not show."""
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def morton_encode(s, d):
    return morton.encode(ad.points(s, d)).select("gid", "code")


def morton_order(s, d):
    return morton.ordered(ad.points(s, d)).select("gid", "code", "pos")


def morton_order_local(s, d):
    return morton.ordered_within(_tree(s, d), "node", "lod").select("gid", "node", F.col("lod").cast("int"), "code", "pos")


def log_transform(s, d):
    return _rounded(ad.table(s, d, "events").select("event_id", scalar.log_transform(F.col("value")).alias("v")))


def opacity_byte(s, d):
    return ad.table(s, d, "events").select("event_id", scalar.opacity_byte(F.col("value") / 100).cast("int").alias("b"))


def encode_means(s, d):
    p = ad.points(s, d)
    made = textures.means(_numbered(p), p.count())[0]
    return _bytes(made["means_l"].select(F.lit("means_l").alias("texture"), "*").unionByName(made["means_u"].select(F.lit("means_u").alias("texture"), "*")), "texture")


def quat_smallest_three(s, d):
    b = scalar.smallest_three([D(c) for c in ROTATION])
    return ad.quaternions(s, d).select("gid", b.alias("t")).select("gid", *[F.col(f"t.{n}").cast("int").alias(n) for n in ("b0", "b1", "b2", "alpha")])


def encode_quats(s, d):
    rows = ad.quaternions(s, d).withColumn("pos", F.col("gid"))
    return textures.quats(rows, rows.count())[0]["quats"].select("ti", "px", "py", *[F.col(c).cast("int") for c in "rgba"])


def covariance(s, d):
    c = scalar.covariance([D(x) for x in ROTATION], [D(x) for x in SCALES])
    return _rounded(ad.quaternions(s, d).select("gid", *[v.alias(f"m{k}") for k, v in enumerate(c)]))


def oriented_bounds(s, d):
    return _rounded(bounds.oriented_bounds(ad.quaternions(s, d)).select("gid", *[f"{e}_{a}" for e in ("lo", "hi") for a in AXES]))


def aabb(s, d):
    return bounds.aabb(ad.points(s, d))


def histogram_1024(s, d):
    return quantize.histogram(_prices(s, d)).select("bin", "n", F.round("total", 2).alias("total"))


def histogram_prefix(s, d):
    p = _prices(s, d)
    lo, hi = quantize.value_range(p)
    return quantize.prefixes(quantize.histogram(p), lo, hi).select("bin", "n", F.round("w", 3).alias("w"), F.round(F.col("wx") / 1e6, 3).alias("wx"))


def codebook_assign(s, d):
    t = ad.table(s, d, "lineitem")
    return t.groupBy(scalar.nearest_code(F.col("l_extendedprice"), BOOK).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"))


def encode_scales(s, d):
    c = ad.cloud(s, d)
    return _bytes(textures.scales(morton.ordered(c), c.count())[0]["scales"])


def encode_colors(s, d):
    c = ad.cloud(s, d)
    return _bytes(textures.colours(morton.ordered(c), c.count())[0]["sh0"])


def quantize1d(s, d):
    book = quantize.codebook(_prices(s, d), 16)
    return s.createDataFrame(list(enumerate(book)), "idx int, value double")


def quantize_attributes(s, d):
    """Codebooks of 256 values of the scales and of the colours."""
    c, out = ad.cloud(s, d), []
    for name, columns in (("scales", SCALES), ("sh0", COLOURS)):
        out += [(name, k, v) for k, v in enumerate(quantize.codebook(quantize.unpivot(c.select(*columns), *columns), 256))]
    return s.createDataFrame(out, "texture string, idx int, value double")


def nearest_centroid(s, d):
    return neighbors.nearest_centroid(ad.vectors(s, d), _start(s, d)).select("id", "cid", F.round("distance", 4).alias("distance"))


def kmeans_update(s, d):
    a = neighbors.nearest_centroid(ad.vectors(s, d), _start(s, d))
    return kmeans.sums(a).select("cid", "place", F.round("mean", 6).alias("mean"), "n")


def kmeans_2iter(s, d):
    return kmeans.kmeans(ad.vectors(s, d), K, 2, _start(s, d))[1].select("id", "cid")


def knn(s, d):
    return neighbors.knn(ad.vectors(s, d), _queries(s, d), 5).select("qid", "id", "rank")


def knn_l1(s, d):
    return neighbors.knn(ad.vectors(s, d), _queries(s, d), 5, "l1").select("qid", "id", "rank")


def rknn(s, d):
    return neighbors.knn(ad.vectors(s, d), _queries(s, d), 5, radius=1.2).select("qid", "id", "rank")


def radius_search(s, d):
    return neighbors.radius_search(ad.vectors(s, d), _queries(s, d), 1.4).select("qid", "id")


def radius_search_points(s, d):
    p = ad.points(s, d)
    return neighbors.radius_search_points(p, p.where(F.col("gid") % EVERY == 0).withColumnRenamed("gid", "qid"), 60.0).select("qid", "gid")


def radius_worst(s, d):
    return neighbors.worst(neighbors.radius_search(ad.vectors(s, d), _queries(s, d), 1.4)).select("qid", "id")


def box_search(s, d):
    return neighbors.box_search(ad.points(s, d), *BOX).select("gid")


def angle_so2(s, d):
    q = ad.vectors(s, d)
    first = q.where(F.col("id") == 0).select(F.col("vec").alias("origin"))
    return q.crossJoin(F.broadcast(first)).select("id", F.round(neighbors.metric_column("so2")("origin", "vec"), 6).alias("angle"))


def kd_partition(s, d):
    return _tree(s, d).select("gid", "node", "depth")


def leaf_lod_bins(s, d):
    return tree.leaf_lod_bins(_tree(s, d)).select("node", "depth", F.col("lod").cast("int"), "n")


def node_bounds(s, d):
    return tree.node_bounds(_tree(s, d)).select("node", "depth", F.col("n").cast("bigint"), "is_leaf", *[f"{e}_{a}" for e in ("min", "max") for a in AXES])


def pack_chunks(s, d):
    return _chunks(s, d)


def file_catalog(s, d):
    return tree.file_catalog(_chunks(s, d)).select("filename", "file_no", F.col("n").cast("bigint"))


def union_lods(s, d):
    p = ad.points(s, d)
    return clouds.union([(p.where(F.col("lod") == k), k) for k in range(5)]).select((F.col("gid") % (1 << 40)).alias("gid"), F.shiftright("gid", 40).cast("int").alias("file_no"), F.col("lod").cast("int"), D("x").alias("x"))


def scan_ply(s, d):
    """The whole cloud of orders written as a PLY file of each level of detail, and read as tagged files."""
    inputs, folder = [], new_path(s, "ply")
    for k in range(5):
        path = f"{folder}/{k}.ply"
        ply.export_ply(_numbered(ad.cloud(s, d).where(F.col("lod") == k)), path)
        inputs.append((path, k))
    out = ply.read_many(s, inputs)
    return out.select((F.col("gid") % (1 << 40)).alias("pos"), F.col("lod").cast("int"), *[D(c).alias(c) for c in BASE])


def covariance_view(s, d):
    rows = clouds.with_covariance(ad.quaternions(s, d))
    return _rounded(rows.select("gid", *[F.element_at("covariance", k + 1).cast("double").alias(f"m{k}") for k in range(9)]), 4)


def widen_harmonics(s, d):
    """Clouds of 3 and of 8 coefficients united at the wider width."""
    a, b = (ad.vectors(s, d, n).select(F.col("id").alias("gid"), F.lit(0).cast("smallint").alias("lod"), F.col("vec").alias("f_rest")) for n in (9, 24))
    both = clouds.union([(a.where("gid % 2 = 0"), 0), (b.where("gid % 2 = 1"), 1)])
    return both.select((F.col("gid") % (1 << 40)).alias("id"), F.size("f_rest").cast("bigint").alias("n"), *[F.element_at("f_rest", k + 1).cast("double").alias(f"f{k}") for k in range(24)])


def filter_harmonics(s, d):
    v = ad.vectors(s, d, 45).withColumnRenamed("vec", "f_rest")
    kept = clouds.filter_harmonics(v, 1)
    return kept.select("id", F.size("f_rest").cast("bigint").alias("n"), *[F.element_at("f_rest", k + 1).cast("double").alias(f"f{k}") for k in range(9)])


def subset(s, d):
    p = ad.points(s, d)
    picked = p.where(F.col("gid") % 7 == 3).select("gid", (F.col("gid") * 3).alias("pos"))
    return clouds.subset(p, picked).select("gid", "pos", D("x").alias("x"))


SIZES = [1, 16, 17, 100, 1000, 1024, 6000, 60000, 600000]


def texture_dims(s, d):
    n = ad.table(s, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    w, h = scalar.texture_size(F.col("n"))
    return n.select("l_suppkey", "n", w.alias("w"), h.alias("h"))


def palette_size(s, d):
    sizes = [*SIZES, ad.table(s, d, "lineitem").count()]
    return s.createDataFrame([(n, scalar.palette_size(n)) for n in sizes], "n bigint, palette bigint")


def harmonic_bands(s, d):
    t = ad.table(s, d, "part").select("p_partkey", F.col("p_size").alias("n"))
    return t.select("p_partkey", scalar.sh_bands(F.col("n")).alias("bands"))


def quantize_16_bits(s, d):
    t = ad.table(s, d, "events").select("event_id", "value")
    r = t.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    v = scalar.quantize16(F.col("value"), F.col("lo"), F.col("hi"))
    return t.crossJoin(F.broadcast(r)).select("event_id", v.alias("v"), scalar.low_byte(v).cast("int").alias("lo"), scalar.high_byte(v).cast("int").alias("hi"))


def sh_labels(s, d):
    a = ad.table(s, d, "embeddings").select(F.col("vec_id").alias("pos"), (F.col("label") * 300).alias("cid"))
    return textures.sh_label_pixels(a, a.count()).select("ti", *[F.col(c).cast("int") for c in "rgba"])


def sh_centroid_layout(s, d):
    rows = ad.table(s, d, "embeddings").select(F.col("vec_id").cast("int").alias("cid"), F.transform(F.slice("embedding", 1, 9), lambda v: F.floor(F.abs(v) * 200).cast("int") % 256).alias("label"))
    return textures.centroid_layout(rows, 3, 192, -(-rows.count() // 64)).select("ti", "px", "py", *[F.col(c).cast("int") for c in "rgba"])


def project_finite(s, d):
    e = ad.table(s, d, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"), "props")
    return e.where(bounds.finite("value")).select("event_id", "value")


def unpivot_attributes(s, d):
    return quantize.unpivot(ad.points(s, d).select("gid", "x", "y", "z"), "x", "y", "z").select("gid", "k", "value")


def texture_padding(s, d):
    p = ad.points(s, d)
    return _bytes(textures.pixels(_numbered(p.select("gid")), [F.lit(1), F.lit(2), F.lit(3), F.lit(4)], p.count(), (0, 0, 0, 255)))


def oriented_leaf_bounds(s, d):
    """The bounds of all nodes of a tree over the whole cloud, from the oriented boxes of its splats."""
    t = tree.build(ad.cloud(s, d), 1, 16.0)
    return _rounded(tree.node_bounds(t).select("node", "depth", F.col("n").cast("bigint"), "is_leaf", *[f"{e}_{a}" for e in ("min", "max") for a in AXES]), 4)


def harmonics_2iter(s, d):
    """Both textures of the harmonics of embeddings, three coefficients, after two iterations from the first vectors."""
    rows = ad.vectors(s, d, 9).select(F.col("id").alias("gid"), F.col("id").alias("pos"), F.col("vec").alias("f_rest"))
    n = rows.count()
    start = [list(r.vec) for r in rows.where(F.col("gid") < min(scalar.palette_size(n), n)).orderBy("gid").select(F.col("f_rest").cast("array<double>").alias("vec")).collect()]
    made, _ = textures.harmonics(rows, n, 2, start)
    out = [_bytes(rows.select(F.lit(name).alias("texture"), "*"), "texture") for name, rows in sorted(made.items())]
    return out[0].unionByName(out[1])


def full_encode(s, d):
    return _bytes(encode.encoded_rows(ad.cloud(s, d)), "texture")


QUERIES = {f.__name__: f for f in (
    morton_encode, morton_order, morton_order_local, log_transform, opacity_byte, encode_means, quat_smallest_three, encode_quats, covariance, oriented_bounds,
    aabb, histogram_1024, histogram_prefix, codebook_assign, encode_scales, encode_colors, quantize1d, nearest_centroid, kmeans_update, kmeans_2iter, knn, knn_l1, rknn,
    radius_search, radius_search_points, radius_worst, box_search, angle_so2, kd_partition, leaf_lod_bins, node_bounds, pack_chunks, file_catalog, union_lods, filter_harmonics,
    subset, texture_dims, palette_size, sh_labels, sh_centroid_layout, project_finite, unpivot_attributes, texture_padding, full_encode,
    quantize_attributes, quantize_16_bits, scan_ply, covariance_view, widen_harmonics, harmonic_bands, oriented_leaf_bounds, harmonics_2iter)}

_LOG = "CASE WHEN {0} < 0 THEN -1 ELSE 1 END * ln(abs({0}) + 1)"
_COV = {f"m{3 * i + j}": " + ".join(f"r{i}{k}*r{j}{k}*s{k}*s{k}" for k in range(3)) for i in range(3) for j in range(3)}
_RAD = [" + ".join(f"abs(r{i}{k})*exp(s{k})" for k in range(3)) for i in range(3)]
_WIDTH = "(SELECT (max(l_extendedprice) - min(l_extendedprice)) / 1024 FROM lineitem)"
HIST = f"h AS (SELECT CAST(least(floor((l_extendedprice - (SELECT min(l_extendedprice) FROM lineitem)) / {_WIDTH}), 1023) AS INT) AS bin, count(*) AS n, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1)"
_THREE = f"""{QUAT}, w AS (SELECT *, greatest(abs(a), abs(b), abs(c), abs(d)) AS big FROM u),
m AS (SELECT *, CASE WHEN abs(a) = big THEN 0 WHEN abs(b) = big THEN 1 WHEN abs(c) = big THEN 2 ELSE 3 END AS i FROM w),
g AS (SELECT gid, i, CASE WHEN [a, b, c, d][i + 1] < 0 THEN -1 ELSE 1 END AS sign, CASE i WHEN 0 THEN [b, c, d] WHEN 1 THEN [a, c, d] WHEN 2 THEN [a, b, d] ELSE [a, b, c] END AS rest FROM m),
t AS (SELECT gid, """ + ", ".join(f"CAST(floor(255 * (sign * rest[{k + 1}] * sqrt(2.0::DOUBLE) * 0.5 + 0.5)) AS INT) AS b{k}" for k in range(3)) + ", 252 + i AS alpha FROM g)"  # fmt: skip
_DIST = "list_sum(list_transform(range(1, 65), lambda i: {0}))"
_L2 = _DIST.format("(CAST(a.embedding[i] AS DOUBLE) - b.embedding[i]) * (CAST(a.embedding[i] AS DOUBLE) - b.embedding[i])")
_L1 = _DIST.format("abs(CAST(a.embedding[i] AS DOUBLE) - b.embedding[i])")
_NEAR = f"near AS (SELECT a.vec_id AS qid, b.vec_id AS id, {{0}} AS d FROM embeddings a, embeddings b WHERE a.vec_id % {EVERY} = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM near)"
_W = "greatest(4, 4 * CAST(ceil(ceil(sqrt(n)) / 4) AS BIGINT))"
_PAD = "(SELECT count(*) AS n FROM orders)"



def _pixels(own, pad):
    """The pixels of a texture, padding included, from the CTE `own` of ti, r, g, b, a."""
    return f"""SELECT CAST(ti AS BIGINT) AS ti, CAST(ti % w AS INT) AS px, CAST(ti // w AS INT) AS py, CAST(r AS INT) AS r, CAST(g AS INT) AS g, CAST(b AS INT) AS b, CAST(a AS INT) AS a
  FROM (SELECT ti, r, g, b, a FROM {own} UNION ALL SELECT unnest(range(n, w * h)), {', '.join(map(str, pad))} FROM (
    SELECT n, w, greatest(4, 4 * CAST(ceil(n / (w * 4.0)) AS BIGINT)) AS h FROM (SELECT n, {_W} AS w FROM (SELECT count(*) AS n FROM {own})))),
  (SELECT {_W} AS w FROM (SELECT count(*) AS n FROM {own}))"""


def _codebook(values, k, p):
    """CTEs, ending in {p}book (idx, value): the optimal codebook of `values` (v) by dynamic programming over the bins that hold any."""
    return f"""{p}e AS MATERIALIZED (SELECT min(v) AS lo, (max(v) - min(v)) / 1024 AS width FROM {values}),
{p}f AS MATERIALIZED (SELECT least(floor((v - lo) / width), 1023) AS bin, sqrt(count(*)) AS weight, sum(v) / count(*) AS centre FROM {values}, {p}e GROUP BY 1),
{p}g AS MATERIALIZED (SELECT row_number() OVER o - 1 AS i, sum(weight) OVER o AS w, sum(weight * centre) OVER o AS wx, sum(weight * centre * centre) OVER o AS wx2 FROM {p}f WINDOW o AS (ORDER BY bin ROWS UNBOUNDED PRECEDING)),
{p}h AS MATERIALIZED (SELECT *, lag(w, 1, 0) OVER o AS w0, lag(wx, 1, 0) OVER o AS wx0, lag(wx2, 1, 0) OVER o AS wx20 FROM {p}g WINDOW o AS (ORDER BY i)),
{p}c AS MATERIALIZED (SELECT a.i AS i, b.i AS j, greatest(0, b.wx2 - a.wx20 - (b.wx - a.wx0) * (b.wx - a.wx0) / (b.w - a.w0)) AS cost, CAST((b.wx - a.wx0) / (b.w - a.w0) AS FLOAT) AS mean FROM {p}h a JOIN {p}h b ON b.i >= a.i),
{p}k AS (SELECT least({k}, count(*)) AS used FROM {p}h),
{p}dp AS (SELECT 1 AS k, j, cost AS best, CAST(0 AS BIGINT) AS came FROM {p}c WHERE i = 0
  UNION ALL SELECT d.k + 1, c.j, min(d.best + c.cost), arg_min(c.i, d.best + c.cost) FROM {p}dp d JOIN {p}c c ON c.i = d.j + 1 WHERE d.k < (SELECT used FROM {p}k) GROUP BY d.k, c.j),
{p}way AS (SELECT k, j, came FROM {p}dp WHERE k = (SELECT used FROM {p}k) AND j = (SELECT max(i) FROM {p}h)
  UNION ALL SELECT d.k, d.j, d.came FROM {p}way y JOIN {p}dp d ON d.k = y.k - 1 AND d.j = y.came - 1),
{p}found AS (SELECT row_number() OVER (ORDER BY mean) - 1 AS idx, mean FROM {p}way JOIN {p}c ON i = came AND {p}c.j = {p}way.j),
{p}book AS MATERIALIZED (SELECT CAST(t.idx AS INT) AS idx, CAST(coalesce(mean, (SELECT max(mean) FROM {p}found)) AS DOUBLE) AS value FROM (SELECT unnest(range({k})) AS idx) t LEFT JOIN {p}found f ON f.idx = t.idx)"""


def _labels(p, columns):
    """CTEs {p}mids and expressions of the labels of columns."""
    return f"{p}mids AS MATERIALIZED (SELECT list(mid ORDER BY mid) AS mids FROM (SELECT (value + lead(value) OVER (ORDER BY idx)) / 2 AS mid FROM {p}book) WHERE mid IS NOT NULL)", [f"len(list_filter(mids, lambda m: {c} >= m))" for c in columns]


def _float(e):
    return f"CAST(CAST({e} AS FLOAT) AS DOUBLE)"


_CLOUD = "cloud AS (SELECT *, " + ", ".join(
    [f"{_float(f'((x * {k + 3}) % 97) / 97.0::DOUBLE * -4 - {k / 10}::DOUBLE')} AS scale_{k}" for k in range(3)] + [f"{_float(f'((gid * {2 * k + 5}) % 101) / 50.0::DOUBLE - 1')} AS rot_{k}" for k in range(4)]
    + [f"{_float('x / 100 - 2')} AS opacity"] + [f"{_float(f'((x * {k + 7}) % 89) / 44.0::DOUBLE - 1')} AS f_dc_{k}" for k in range(3)]) + " FROM points)"
_ORDERED = f"{POINTS}, {_CLOUD}, {_codes(' OVER ()').replace('FROM points', 'FROM cloud')}, ordered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY code, gid) - 1 AS ti FROM codes)"


def _values(columns, source):
    return " UNION ALL ".join(f"SELECT {c} AS v FROM {source}" for c in columns)


_SCALE_BOOK = f"sv AS ({_values(SCALES, 'ordered')}), {_codebook('sv', 256, 's')}"
_COLOUR_BOOK = f"qv AS ({_values(COLOURS, 'ordered')}), {_codebook('qv', 256, 'q')}"
_SCALE_OWN = f"{_labels('s', SCALES)[0]}, so AS MATERIALIZED (SELECT ti, {', '.join(f'{e} AS {c}' for e, c in zip(_labels('s', SCALES)[1], 'rgb', strict=True))}, 255 AS a FROM ordered, smids)"
_COLOUR_OWN = f"{_labels('q', COLOURS)[0]}, qo AS MATERIALIZED (SELECT ti, {', '.join(f'{e} AS {c}' for e, c in zip(_labels('q', COLOURS)[1], 'rgb', strict=True))}, floor(least(greatest(255 / (1 + exp(-opacity)), 0), 255)) AS a FROM ordered, qmids)"
_LOGS = ", ".join(f"{_float(_LOG.format(a))} AS {a}" for a in AXES)
_MEANS = "mq AS MATERIALIZED (SELECT ti, " + ", ".join(f"CAST(floor(65535 * ({a} - min({a}) OVER ()) / (max({a}) OVER () - min({a}) OVER ())) AS INT) AS {a}" for a in AXES) + " FROM ml), ll AS (SELECT ti, x & 255 AS r, y & 255 AS g, z & 255 AS b, 255 AS a FROM mq), lu AS (SELECT ti, (x >> 8) & 255 AS r, (y >> 8) & 255 AS g, (z >> 8) & 255 AS b, 255 AS a FROM mq)"
_QUATS = f"""u AS (SELECT ti, {', '.join(f'CASE WHEN len > 0 THEN rot_{k} / len ELSE rot_{k} END AS {c}' for k, c in enumerate('abcd'))} FROM (SELECT *, sqrt(rot_0*rot_0+rot_1*rot_1+rot_2*rot_2+rot_3*rot_3) AS len FROM ordered)),
w AS (SELECT *, greatest(abs(a), abs(b), abs(c), abs(d)) AS big FROM u), m AS (SELECT *, CASE WHEN abs(a) = big THEN 0 WHEN abs(b) = big THEN 1 WHEN abs(c) = big THEN 2 ELSE 3 END AS i FROM w),
v AS (SELECT ti, i, CASE WHEN [a, b, c, d][i + 1] < 0 THEN -1 ELSE 1 END AS sign, CASE i WHEN 0 THEN [b, c, d] WHEN 1 THEN [a, c, d] WHEN 2 THEN [a, b, d] ELSE [a, b, c] END AS rest FROM m),
uo AS MATERIALIZED (SELECT ti, {', '.join(f'least(greatest(floor(255 * (sign * rest[{k + 1}] * sqrt(2.0::DOUBLE) * 0.5 + 0.5)), 0), 255) AS {c}' for k, c in enumerate('rgb'))}, 252 + i AS a FROM v)"""


def _tagged(**parts):
    return " UNION ALL ".join(f"SELECT '{name}' AS texture, * FROM ({sql})" for name, sql in parts.items())


_H, _NH = 9, 256
_HBINS = f"""h0 AS (SELECT vec_id AS cid, CAST(embedding[1:{_H}] AS DOUBLE[]) AS vec FROM embeddings WHERE vec_id < (SELECT least(count(*), CASE WHEN count(*) < 1024 THEN 256 ELSE 1024 END) FROM embeddings)),
v AS (SELECT vec_id AS id, CAST(embedding[1:{_H}] AS DOUBLE[]) AS vec FROM embeddings)"""
_HARMONICS = f"""WITH RECURSIVE {_HBINS}, {_assign('h0', 'ha')}, {_update('ha', 'h0', 'h1').replace('range(1, 65)', f'range(1, {_H + 1})')}, {_assign('h1', 'hb')}, {_update('hb', 'h1', 'h2').replace('range(1, 65)', f'range(1, {_H + 1})')},
cv AS MATERIALIZED (SELECT cid, place, vec[place] AS v FROM h2, (SELECT unnest(range(1, {_H + 1})) AS place)), {_codebook('cv', 256, 'c')}, {_labels('c', ['v'])[0]},
cl AS MATERIALIZED (SELECT cid, list(len(list_filter(mids, lambda m: v >= m)) ORDER BY place) AS label FROM cv, cmids GROUP BY cid),
cp AS (SELECT (cid // 64) * 192 + (cid % 64) * 3 + j AS ti, label[j + 1] AS r, label[j + 4] AS g, label[j + 7] AS b FROM cl, (SELECT unnest(range(3)) AS j)),
lp AS (SELECT id AS ti, cid & 255 AS r, (cid >> 8) & 255 AS g, 0 AS b, 255 AS a FROM hb)
SELECT 'shN_centroids' AS texture, t.ti, CAST(t.ti % 192 AS INT) AS px, CAST(t.ti // 192 AS INT) AS py, CAST(coalesce(r, 0) AS INT) AS r, CAST(coalesce(g, 0) AS INT) AS g, CAST(coalesce(b, 0) AS INT) AS b, CASE WHEN r IS NULL THEN 0 ELSE 255 END AS a
  FROM (SELECT unnest(range(192 * CAST(ceil((SELECT count(*) FROM h2) / 64.0) AS BIGINT))) AS ti) t LEFT JOIN cp ON cp.ti = t.ti
UNION ALL SELECT 'shN_labels' AS texture, * FROM ({_pixels('lp', (0, 0, 0, 0))})"""
_ORIENTED = "wide AS (SELECT t.node, t.depth, t.gid, " + ", ".join(f"c.{a} AS {a}" for a in [*AXES, *SCALES, *ROTATION]) + " FROM tree t JOIN cloud c ON c.gid = t.gid)"


SQL = {
    "morton_encode": f"WITH {POINTS}, {_codes(' OVER ()')} SELECT gid, code FROM codes",
    "morton_order": f"WITH {POINTS}, {_codes(' OVER ()')} SELECT gid, code, row_number() OVER (ORDER BY code, gid) - 1 AS pos FROM codes",
    "morton_order_local": f"{TREE}, {_codes(' OVER (PARTITION BY node, lod)').replace('FROM points', 'FROM tree')} SELECT gid, node, lod, code, row_number() OVER (PARTITION BY node, lod ORDER BY code, gid) - 1 AS pos FROM codes",
    "log_transform": f"SELECT event_id, round({_LOG.format('value')}, 6) + 0 AS v FROM events",
    "opacity_byte": "SELECT event_id, CAST(floor(least(greatest(255 / (1 + exp(-value / 100)), 0), 255)) AS INT) AS b FROM events",
    "encode_means": f"WITH {POINTS}, ml AS (SELECT row_number() OVER (ORDER BY gid) - 1 AS ti, {_LOGS} FROM points), {_MEANS} {_tagged(means_l=_pixels('ll', (0, 0, 0, 255)), means_u=_pixels('lu', (0, 0, 0, 255)))}",
    "quat_smallest_three": f"WITH {_THREE} SELECT * FROM t",
    "encode_quats": f"WITH {_THREE}, s AS (SELECT count(*) AS n FROM t), z AS (SELECT n, {_W} AS w FROM s), z2 AS (SELECT n, w, greatest(4, 4 * CAST(ceil(n / (w * 4.0)) AS BIGINT)) AS h FROM z), p AS (SELECT gid AS ti, b0, b1, b2, alpha FROM t UNION ALL SELECT i, 0, 0, 0, 0 FROM z2, (SELECT unnest(range(n, w * h)) AS i FROM z2)) SELECT ti, CAST(ti % w AS INT) AS px, CAST(ti // w AS INT) AS py, b0 AS r, b1 AS g, b2 AS b, alpha AS a FROM p, z2",
    "covariance": f"WITH {ROTATED} SELECT gid, {', '.join(f'round({e}, 6) + 0 AS {n}' for n, e in _COV.items())} FROM r",
    "oriented_bounds": f"WITH {ROTATED} SELECT gid, {', '.join(f'round({a} {s} ({_RAD[k]}), 6) + 0 AS {e}_{a}' for e, s in (('lo', '-'), ('hi', '+')) for k, a in enumerate(AXES))} FROM r",
    "aabb": f"WITH {POINTS} SELECT {', '.join(f'{e}({a}) AS {e}_{a}' for e in ('min', 'max') for a in AXES)} FROM points",
    "histogram_1024": f"WITH {HIST} SELECT bin, n, round(total, 2) AS total FROM h",
    "histogram_prefix": f"WITH {HIST}, e AS (SELECT CAST(i AS INT) AS bin, coalesce(n, 0) AS n, coalesce(sqrt(n), 0) AS wt, coalesce(total / n, (SELECT min(l_extendedprice) FROM lineitem) + (i + 0.5) * {_WIDTH}) AS c FROM (SELECT unnest(range(1024)) AS i) LEFT JOIN h ON bin = i) SELECT bin, n, round(sum(wt) OVER w, 3) AS w, round(sum(wt * c) OVER w / 1e6, 3) AS wx FROM e WINDOW w AS (ORDER BY bin ROWS UNBOUNDED PRECEDING)",
    "codebook_assign": f"SELECT CAST(len(list_filter([{', '.join(f'{(a + b) / 2}::DOUBLE' for a, b in zip(BOOK, BOOK[1:], strict=False))}], lambda m: l_extendedprice >= m)) AS INT) AS label, count(*) AS n, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem GROUP BY 1",
    "nearest_centroid": f"WITH {CENTROIDS}, {_assign('c0', 'a1')} SELECT a1.id, CAST(a1.cid AS INT) AS cid, round(list_sum(list_transform(range(1, 65), lambda i: (a1.vec[i] - c0.vec[i]) * (a1.vec[i] - c0.vec[i]))), 4) AS distance FROM a1 JOIN c0 ON a1.cid = c0.cid",
    "kmeans_update": f"WITH {CENTROIDS}, {_assign('c0', 'a1')} SELECT CAST(cid AS INT) AS cid, CAST(place - 1 AS INT) AS place, round(avg(vec[place]), 6) AS mean, count(*) AS n FROM a1, (SELECT unnest(range(1, 65)) AS place) GROUP BY cid, place",
    "kmeans_2iter": f"WITH {CENTROIDS}, {_assign('c0', 'a1')}, {_update('a1', 'c0', 'c1')}, {_assign('c1', 'a2')} SELECT id, CAST(cid AS INT) AS cid FROM a2",
    "knn": f"WITH {_NEAR.format(_L2)} SELECT qid, id, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5",
    "knn_l1": f"WITH {_NEAR.format(_L1)} SELECT qid, id, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5",
    "rknn": f"WITH {_NEAR.format(_L2)} SELECT qid, id, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5 AND d < 1.2",
    "radius_search": f"WITH {_NEAR.format(_L2)} SELECT qid, id FROM near WHERE d < 1.4",
    "radius_search_points": f"WITH {POINTS} SELECT a.gid AS qid, b.gid FROM points a, points b WHERE a.gid % {EVERY} = 0 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 3600",
    "radius_worst": f"WITH {_NEAR.format(_L2)} SELECT qid, arg_max(id, struct_pack(d := d, i := -id)) AS id FROM near WHERE d < 1.4 GROUP BY qid",
    "box_search": f"WITH {POINTS} SELECT gid FROM points WHERE {' AND '.join(f'{a} BETWEEN {lo} AND {hi}' for a, lo, hi in zip(AXES, *BOX, strict=True))}",
    "angle_so2": "WITH o AS (SELECT CAST(embedding[64] AS DOUBLE) AS o FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id AS id, embedding[64] - o AS d FROM embeddings, o) SELECT id, round(CASE WHEN d > pi() THEN d - 2 * pi() WHEN d < -pi() THEN d + 2 * pi() ELSE d END, 6) AS angle FROM e",
    "kd_partition": f"{TREE} SELECT gid, node, depth FROM tree",
    "leaf_lod_bins": f"{BINS} SELECT node, depth, lod, n FROM bins",
    "node_bounds": f"{TREE}, up AS (SELECT node >> u AS node, CAST(depth - u AS INT) AS depth, u, x, y, z FROM (SELECT *, unnest(range(0, depth + 1)) AS u FROM tree)) SELECT node, depth, count(*) AS n, max(u) = 0 AS is_leaf, {', '.join(f'{e}({a}) AS {e}_{a}' for e in ('min', 'max') for a in AXES)} FROM up GROUP BY node, depth",
    "pack_chunks": f'{CHUNKS} SELECT node, depth, lod, n, file_index, "offset" FROM fold',
    "file_catalog": f"{CHUNKS}, met AS (SELECT lod, file_index, min(pos) AS pos, sum(n) AS n FROM fold GROUP BY lod, file_index) SELECT lod || '_' || file_index || '/meta.json' AS filename, row_number() OVER (ORDER BY pos, lod) - 1 AS file_no, CAST(n AS BIGINT) AS n FROM met",
    "union_lods": f"WITH {POINTS} SELECT gid, lod AS file_no, lod, x FROM points",
    "filter_harmonics": "SELECT vec_id AS id, CAST(9 AS BIGINT) AS n, " + ", ".join(f"CAST(embedding[{15 * p + j + 1}] AS DOUBLE) AS f{3 * p + j}" for p in range(3) for j in range(3)) + " FROM embeddings",
    "subset": f"WITH {POINTS} SELECT gid, gid * 3 AS pos, x FROM points WHERE gid % 7 = 3",
    "texture_dims": f"WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), z AS (SELECT *, {_W} AS w FROM c) SELECT l_suppkey, n, w, greatest(4, 4 * CAST(ceil(n / (w * 4.0)) AS BIGINT)) AS h FROM z",
    "palette_size": f"WITH t AS (SELECT unnest([{', '.join(map(str, SIZES))}, (SELECT count(*) FROM lineitem)]) AS n) SELECT n, CAST(CASE WHEN n < 1024 THEN 256 ELSE least(64, pow(2, floor(log2(n / 1024)))) * 1024 END AS BIGINT) AS palette FROM t",
    "sh_labels": f"WITH s AS (SELECT count(*) AS n FROM embeddings), z AS (SELECT n, {_W} AS w FROM s), z2 AS (SELECT n, w, greatest(4, 4 * CAST(ceil(n / (w * 4.0)) AS BIGINT)) AS h FROM z) SELECT vec_id AS ti, (label * 300) & 255 AS r, ((label * 300) >> 8) & 255 AS g, 0 AS b, 255 AS a FROM embeddings UNION ALL SELECT unnest(range(n, w * h)), 0, 0, 0, 0 FROM z2",
    "sh_centroid_layout": "WITH c AS (SELECT vec_id AS cid, list_transform(embedding[1:9], lambda v: CAST(floor(abs(v) * 200) AS INT) % 256) AS label FROM embeddings), p AS (SELECT (cid // 64) * 192 + (cid % 64) * 3 + j AS ti, label[j + 1] AS r, label[j + 4] AS g, label[j + 7] AS b FROM c, (SELECT unnest(range(3)) AS j)) SELECT t.ti, CAST(t.ti % 192 AS INT) AS px, CAST(t.ti // 192 AS INT) AS py, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, CASE WHEN r IS NULL THEN 0 ELSE 255 END AS a FROM (SELECT unnest(range(192 * CAST(ceil((SELECT count(*) FROM c) / 64.0) AS BIGINT))) AS ti) t LEFT JOIN p ON p.ti = t.ti",
    "project_finite": "SELECT event_id, value FROM events WHERE event_id % 10 <> 0 AND value IS NOT NULL",
    "unpivot_attributes": f"WITH {POINTS} SELECT gid, k, CASE k WHEN 0 THEN x WHEN 1 THEN y ELSE z END AS value FROM points, (SELECT CAST(unnest(range(3)) AS INT) AS k)",
    "texture_padding": f"WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS ti, 1 AS r, 2 AS g, 3 AS b, 4 AS a FROM orders) {_pixels('o', (0, 0, 0, 255))}",
    "quantize1d": f"WITH RECURSIVE pv AS (SELECT l_extendedprice AS v FROM lineitem), {_codebook('pv', 16, 'p')} SELECT idx, value FROM pbook",
    "quantize_attributes": f"WITH RECURSIVE {_ORDERED}, {_SCALE_BOOK}, {_COLOUR_BOOK} SELECT 'scales' AS texture, idx, value FROM sbook UNION ALL SELECT 'sh0', idx, value FROM qbook",
    "encode_scales": f"WITH RECURSIVE {_ORDERED}, {_SCALE_BOOK}, {_SCALE_OWN} {_pixels('so', (0, 0, 0, 255))}",
    "encode_colors": f"WITH RECURSIVE {_ORDERED}, {_COLOUR_BOOK}, {_COLOUR_OWN} {_pixels('qo', (0, 0, 0, 0))}",
    "full_encode": f"WITH RECURSIVE {_ORDERED}, {_SCALE_BOOK}, {_SCALE_OWN}, {_COLOUR_BOOK}, {_COLOUR_OWN}, ml AS (SELECT ti, {_LOGS} FROM ordered), {_MEANS}, {_QUATS} "
    + _tagged(means_l=_pixels("ll", (0, 0, 0, 255)), means_u=_pixels("lu", (0, 0, 0, 255)), quats=_pixels("uo", (0, 0, 0, 0)), scales=_pixels("so", (0, 0, 0, 255)), sh0=_pixels("qo", (0, 0, 0, 0))),
    "quantize_16_bits": "WITH q AS (SELECT event_id, CAST(floor(65535.0::DOUBLE * (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ())) AS INT) AS v FROM events) SELECT event_id, v, v & 255 AS lo, (v >> 8) & 255 AS hi FROM q",
    "scan_ply": f"WITH {POINTS}, {_CLOUD} SELECT row_number() OVER (PARTITION BY lod ORDER BY gid) - 1 AS pos, lod, {', '.join(BASE)} FROM cloud",
    "covariance_view": f"WITH {ROTATED} SELECT gid, {', '.join(f'round(CAST(CAST({e} AS FLOAT) AS DOUBLE), 4) + 0 AS {n}' for n, e in _COV.items())} FROM r",
    "widen_harmonics": "SELECT vec_id AS id, CAST(24 AS BIGINT) AS n, " + ", ".join(f"CASE WHEN vec_id % 2 = 1 THEN CAST(embedding[{8 * p + j + 1}] AS DOUBLE) ELSE {f'CAST(embedding[{3 * p + j + 1}] AS DOUBLE)' if j < 3 else '0.0::DOUBLE'} END AS f{8 * p + j}" for p in range(3) for j in range(8)) + " FROM embeddings",
    "harmonic_bands": "SELECT p_partkey, CASE p_size WHEN 3 THEN 1 WHEN 8 THEN 2 WHEN 15 THEN 3 ELSE 0 END AS bands FROM part",
    "oriented_leaf_bounds": f"{TREE}, {_CLOUD}, {_ORIENTED}, n AS (SELECT *, sqrt(rot_0*rot_0+rot_1*rot_1+rot_2*rot_2+rot_3*rot_3) AS len FROM wide), u AS (SELECT node, depth, x, y, z, scale_0 AS s0, scale_1 AS s1, scale_2 AS s2, {', '.join(f'CASE WHEN len > 0 THEN rot_{k} / len ELSE rot_{k} END AS {c}' for k, c in enumerate('abcd'))} FROM n), "
    + "r AS (SELECT *, " + ", ".join(f"{_R[i][j]} AS r{i}{j}" for i in range(3) for j in range(3)) + " FROM u), "
    + f"o AS (SELECT node, depth, {', '.join(f'{a} {s} ({_RAD[k]}) AS {e}_{a}' for e, s in (('min', '-'), ('max', '+')) for k, a in enumerate(AXES))} FROM r), up AS (SELECT node >> u AS node, CAST(depth - u AS INT) AS depth, u, {', '.join(f'{e}_{a}' for e in ('min', 'max') for a in AXES)} FROM (SELECT *, unnest(range(0, depth + 1)) AS u FROM o)) "
    + f"SELECT node, depth, count(*) AS n, max(u) = 0 AS is_leaf, {', '.join(f'round({e}({e}_{a}), 4) + 0 AS {e}_{a}' for e in ('min', 'max') for a in AXES)} FROM up GROUP BY node, depth",
    "harmonics_2iter": _HARMONICS,
}
