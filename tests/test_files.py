"""PLY files, images, bundles and whole encodes."""

import json

import numpy as np
import pytest

from cloudloom import cli
from cloudloom.plans import adapters, encode
from cloudloom.schema import BASE
from cloudloom.sources import images, ply, sinks


def columns(n, rest=9, seed=0):
    r = np.random.default_rng(seed)
    return {c: r.normal(size=n).astype(np.float32) for c in [*BASE, *[f"f_rest_{k}" for k in range(rest)]]}


def test_ply_round_trip(spark, tmp_path):
    c = columns(300)
    path = str(tmp_path / "a.ply")
    ply.write_ply(path, dict(reversed(c.items())), ["nx"])
    rows = ply.read_ply(spark, path, lod=2).orderBy("gid").toPandas()
    assert len(rows) == 300 and (rows.lod == 2).all()
    for name in BASE:
        assert np.array_equal(rows[name].to_numpy(), c[name])
    assert np.allclose(np.stack(rows.f_rest)[:, 4], c["f_rest_4"])


@pytest.mark.parametrize("change, message", [
    (lambda b: b[:-8], "ends after"), (lambda b: b.replace(b"property float rot_3\n", b"property float other\n"), "rot_3"), (lambda b: b.replace(b"vertex 5", b"vertex 0"), "no vertices"),
    (lambda b: b.replace(b"binary_little_endian", b"ascii"), "not supported"), (lambda b: b.replace(b"float opacity", b"double opacity"), "only float"), (lambda b: b"x" + b, "not a PLY"), (lambda b: b[:60], "no end_header")])
def test_ply_errors(spark, tmp_path, change, message):
    path = tmp_path / "b.ply"
    ply.write_ply(str(path), columns(5))
    path.write_bytes(change(path.read_bytes()))
    with pytest.raises(Exception, match=message):
        ply.read_ply(spark, str(path)).count()


def test_short_ply_is_read_when_permissive(spark, tmp_path):
    path = tmp_path / "c.ply"
    ply.write_ply(str(path), columns(5))
    path.write_bytes(path.read_bytes()[:-8])
    assert ply.read_ply(spark, str(path), mode="permissive").count() == 4


@pytest.mark.parametrize("kind", ["noise", "flat", "few"])
def test_images(kind):
    r = np.random.default_rng(1)
    a = {"noise": r.integers(0, 256, (12, 8, 4)), "flat": np.full((4, 4, 4), 7), "few": r.choice([3, 200], (8, 12, 4))}[kind].astype(np.uint8)
    assert np.array_equal(images.read_webp(images.webp(a)), a)
    assert np.array_equal(images.read_png(images.png(a)), a)


def test_encode_bundle_and_round_trip(spark, tmp_path):
    c = columns(300)
    ply.write_ply(str(tmp_path / "a.ply"), c)
    cloud = ply.read_ply(spark, str(tmp_path / "a.ply"))
    meta = encode.encode(cloud, str(tmp_path / "a.zip"), bundle=True, iterations=1, kind="png")
    files = sinks.read_zip(str(tmp_path / "a.zip"))
    assert json.loads(files["meta.json"])["count"] == 300 and meta["shN"]["bands"] == 1
    lo, hi = images.read_png(files["means_l.png"]), images.read_png(files["means_u.png"])
    v = (lo[..., 0].astype(int) + 256 * hi[..., 0].astype(int)).ravel()[:300] / 65535 * (meta["means"]["maxs"][0] - meta["means"]["mins"][0]) + meta["means"]["mins"][0]
    x = np.sign(v) * np.expm1(np.abs(v))
    assert np.abs(np.sort(x) - np.sort(c["x"])).max() < 1e-3
    with pytest.raises(FileExistsError):
        encode.encode(cloud, str(tmp_path / "a.zip"), bundle=True)
    with pytest.raises(FileExistsError):
        encode.encode(cloud, str(tmp_path))


def test_lods(spark, tmp_path, sf_dir):
    cloud = adapters.cloud(spark, sf_dir).where("gid < 1200 and lod < 2")
    meta = encode.export_lods(cloud, str(tmp_path / "out" / "lod-meta.json"), 1, 1e9, kind="png")
    assert meta["lodLevels"] == 2 and meta["filenames"]
    total = lambda n: sum(x["count"] for x in n.get("lods", {}).values()) + sum(map(total, n.get("children", [])))
    assert total(meta["tree"]) == cloud.count()
    assert (tmp_path / "out" / meta["filenames"][0]).exists()


def test_command_line():
    a = cli.parse(["a.ply", "-l", "1", "b.ply", "-l", "2", "out/lod-meta.json", "-C", "4", "--sh-iter", "3"])
    assert a.inputs == [("a.ply", 1), ("b.ply", 2)] and a.lods and a.chunk_count == 4 and a.iterations == 3
    for bad in (["a.ply"], ["a.ply", "b.ply", "o.json", "--bundle"], ["a.ply", "-l", "300", "o"], ["a.ply", "o", "--nope", "1"], ["-l", "1", "a.ply", "o"]):
        with pytest.raises(SystemExit):
            cli.parse(bad)


def test_export_of_ply(spark, tmp_path):
    c = columns(300)
    ply.write_ply(str(tmp_path / "a.ply"), c)
    cloud = ply.read_ply(spark, str(tmp_path / "a.ply")).withColumnRenamed("gid", "pos").repartition(5)
    assert ply.export_ply(cloud, f"file://{tmp_path}/out/b.ply") == 300
    assert (tmp_path / "out" / "b.ply").read_bytes() == (tmp_path / "a.ply").read_bytes()
    with pytest.raises(ply.PlyError, match="mounted"):
        ply.read_ply(spark, "s3a://bucket/a.ply")


def test_encode_with_harmonics_of_degree_three(spark, tmp_path):
    """Names in the metadata are those of the files; labels and centroids give back vectors near the harmonics."""
    c = columns(400, rest=45)
    ply.write_ply(str(tmp_path / "a.ply"), c)
    meta = encode.encode(ply.read_ply(spark, str(tmp_path / "a.ply")), str(tmp_path / "out"), iterations=2, kind="png")
    files = {f for part in meta.values() if isinstance(part, dict) for f in part.get("files", [])}
    assert files == {p.name for p in (tmp_path / "out").iterdir()} - {"meta.json"} and all(f.endswith(".png") for f in files)
    assert meta["shN"]["bands"] == 3 and meta["shN"]["count"] == 256
    labels = images.read_png((tmp_path / "out" / "shN_labels.png").read_bytes()).reshape(-1, 4)
    assert (labels[:400, 0].astype(int) + 256 * labels[:400, 1].astype(int) < 256).all() and (labels[:400, 3] == 255).all() and not labels[400:].any()
    assert images.read_png((tmp_path / "out" / "shN_centroids.png").read_bytes()).shape[:2] == (4, 64 * 15)
