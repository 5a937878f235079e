"""Sources, stores, folder inference and the stream, on temporary files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.model import ChannelModel, PrototypeModel
from tessella.operators import frames as FR
from tessella.operators import splits as SP
from tessella.plans import infer as IN
from tessella.sources import files as FS
from tessella.sources import manifests as MF
from tessella.sources import stores as ST
from tessella.streaming.presence import stream_presence, stream_table, streamed
from tests.png import png

ENC = FR.ProjectionEncoder(8, 2, 1)


@pytest.fixture()
def tree(tmp_path):
    rng = np.random.default_rng(0)
    pixels = {}
    for combo, n in (("a", 10), ("b", 5), ("a_b_take2", 5)):
        (tmp_path / "frames" / combo).mkdir(parents=True)
        for i in range(n):
            a = rng.integers(0, 255, (12, 16, 3)).astype(np.uint8)
            name = f"{i:05d}.{'PNG' if i == 1 else 'png'}"
            (tmp_path / "frames" / combo / name).write_bytes(png(a))
            pixels[f"{combo}/{name}"] = a
    (tmp_path / "frames" / "a" / "notes.txt").write_text("x")
    return tmp_path / "frames", pixels


def test_listing_and_decode(spark, tree):
    root, pixels = tree
    got = {r.path: r for r in FS.list_images(spark, str(root)).collect()}
    assert set(got) == set(pixels) and got["a/00000.png"].combo == "a"
    assert FS.list_images(spark, str(root), FS.JPEG_SUFFIXES).count() == 0
    plan = FS.list_images(spark, str(root))._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("Relation")[0]
    for r in FR.decode_frames(spark, str(root)).collect():
        key = "/".join(r.path.split("/")[-2:])
        assert np.array_equal(np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 3), pixels[key])


def test_prepare_writes_a_readable_manifest(spark, tree, tmp_path):
    root, _ = tree
    table, out = str(tmp_path / "images"), str(tmp_path / "manifest")
    summary = {(r["split"], r["combo"]): r["n"] for r in IN.prepare(spark, str(root), table, document=out).collect()}
    assert MF.read_images(spark, table).count() == 20 and MF.read_images(spark, table, "train").count() == 16
    assert summary[(None, None)] == 20 and summary[("train", "a")] == 8 and summary[("val", "b")] == 0 if ("val", "b") in summary else True
    got = MF.read_manifest(spark, out)
    assert got.count() == 20
    assert {tuple(r.label) for r in got.where("combo = 'a_b_take2'").collect()} == {(1, 1)}
    assert MF.read_manifest(spark, out, "train").count() == 16
    assert MF.manifest_classes(spark, out) == ["a", "b"]
    doc = json.loads(next((tmp_path / "manifest").glob("*.json")).read_text())
    assert doc["combo_to_label"] == {"a": [1, 0], "b": [0, 1], "a_b_take2": [1, 1]}


def write(tmp_path, name, doc):
    p = tmp_path / name
    p.write_text(json.dumps(doc, indent=1))
    return str(p)


def test_manifest_errors_and_old_key(spark, tmp_path):
    good = {"path": "x/1.jpg", "label": [1], "video": "x"}
    p = write(tmp_path, "m.json", {"class_names": ["x"], "splits": {"train": [good], "test": []}})
    assert MF.read_manifest(spark, p).first().combo == "x"
    with pytest.raises(Exception, match="split must be one of test, train; got val"):
        MF.read_manifest(spark, p, "val").collect()
    bad = write(tmp_path, "b.json", {"class_names": ["x"], "splits": {"train": [{"path": "x/1.jpg", "label": [1], "folder": "x"}]}})
    with pytest.raises(Exception, match="folder, label, path"):
        MF.read_manifest(spark, bad).collect()


def test_protocol_given_or_derived(spark, tmp_path):
    e = lambda c: {"path": f"{c}/1.jpg", "label": [1], "combo": c}
    doc = {"class_names": ["x"], "splits": {"train": [e("a"), e("b")], "val": [e("b")], "test": [e("c")]}}
    derived = {(r.combo, r.role) for r in MF.read_protocol(spark, write(tmp_path, "p.json", doc)).collect()}
    assert derived == {("a", "trained"), ("b", "trained"), ("c", "heldout")}
    doc |= {"heldout_combos": ["c", "d"]}
    given = {(r.combo, r.role) for r in MF.read_protocol(spark, write(tmp_path, "q.json", doc)).collect()}
    assert given == {("a", "trained"), ("b", "trained"), ("c", "heldout"), ("d", "heldout")}


def test_fold_document_round_trip(spark, tmp_path):
    combos = spark.createDataFrame([(c,) for c in ("a", "b", "a_b", "b_c", "a_c", "c")], "combo string")
    folds = SP.build_folds(combos, 3, 1)
    MF.write_folds(folds, combos, ["a", "b", "c"], 3, str(tmp_path / "f"))
    back = MF.read_folds(spark, str(tmp_path / "f"))
    assert {(r.combo, r.fold) for r in back.where("role = 'dev'").collect()} == {(r.combo, r.fold) for r in folds.collect()}
    assert back.where("role = 'train' and fold = 0").count() == 6 - back.where("role = 'dev' and fold = 0").count()


def test_results_of_existing_runs(spark, tmp_path):
    write(tmp_path, "r1.json", {"f1": 0.5})
    got = MF.read_results(spark, [str(tmp_path / "r1.json"), str(tmp_path / "gone.json")])
    assert got.count() == 1 and got.first().file.endswith("r1.json")


def test_export_skips_and_checks(spark, tmp_path):
    rows = [(("a/1.jpg", b"xyz"),), (("b/2.jpg", b"12345"),)]
    shards = spark.createDataFrame(rows, "image struct<path:string, bytes:binary>")
    root = str(tmp_path / "out")
    assert {r.path: r.written for r in FS.export_files(shards, root).collect()} == {"a/1.jpg": True, "b/2.jpg": True}
    assert not any(r.written for r in FS.export_files(shards, root).collect())
    (tmp_path / "out" / "b" / "2.jpg").write_bytes(b"1")
    listing = FS.list_images(spark, root)
    assert [r.path for r in FS.export_files(shards, root, listing).collect()] == ["b/2.jpg"]
    manifest = spark.createDataFrame([("a/1.jpg",), ("c/3.jpg",)], "path string")
    with pytest.raises(FileNotFoundError, match="1 files.*c/3.jpg"):
        FS.require_complete(manifest, FS.list_images(spark, root))
    with pytest.raises(Exception, match="leaves the export folder"):
        FS.export_files(spark.createDataFrame([(("../../x.jpg", b"1"),)], "image struct<path:string, bytes:binary>"), root).collect()


def test_feature_store_extracts_only_new_paths(spark, tmp_path):
    root, calls = str(tmp_path / "features"), []

    def extract(images):
        calls.append(images.count())
        return images.select("image_id", F.lit(0).alias("tile_idx"), F.array(F.col("image_id").cast("double")).alias("z"))

    images = spark.range(4).select(F.col("id").alias("image_id"), F.concat(F.lit("p"), "id").alias("path"))
    cfg = {"encoder": "e", "tile": 8}
    assert ST.feature_store(images.where("image_id < 3"), extract, root, cfg).count() == 3
    assert ST.feature_store(images, extract, root, cfg).count() == 4
    ST.feature_store(images, extract, root, {**cfg, "tile": 9})
    assert calls == [3, 1, 4]
    stored = spark.read.parquet(f"{root}/data")
    ST.assert_feature_key(ST.stored_features(spark, root, cfg), images, cfg)
    with pytest.raises(ValueError, match="another configuration"):
        ST.assert_feature_key(stored, images, cfg)
    with pytest.raises(ValueError, match="other images"):
        ST.assert_feature_key(ST.stored_features(spark, root, cfg), images.where("image_id > 0"), cfg)


def test_feature_fills_count_when_committed(spark, tmp_path):
    """Rows of a job that died are not read, a fill committed twice counts once, and of two writers the first to commit is read."""
    root, cfg = str(tmp_path / "features"), {"encoder": "e"}
    images = spark.range(3).select(F.col("id").alias("image_id"), F.concat(F.lit("p"), "id").alias("path"))
    rows = lambda who: images.select("image_id", F.lit(who).alias("who"), "path", F.lit(ST.config_hash(cfg)).alias("config_hash"), F.lit(who).alias("fill"))
    write = lambda who: rows(who).write.mode("append").partitionBy("config_hash", "fill").parquet(f"{root}/data")
    write("dead")
    assert ST.stored_features(spark, root, cfg) is None
    extract = lambda todo: todo.select("image_id", F.lit("mine").alias("who"))
    assert {r.who for r in ST.feature_store(images.where("image_id < 2"), extract, root, cfg).collect()} == {"mine"}
    write("late")
    ST.commit_fill(spark, root, cfg, "late")
    ST.commit_fill(spark, root, cfg, "late")
    got = {(r.path, r.who) for r in ST.stored_features(spark, root, cfg).collect()}
    assert got == {("p0", "mine"), ("p1", "mine"), ("p2", "late")} and ST.stored_features(spark, root, cfg).count() == 3
    assert ST.stored_features(spark, root, {"encoder": "other"}).count() == 0


def test_manifest_lines_and_limit(spark, tmp_path):
    rows = [(f"a/{i}.jpg", "a" if i % 2 else "a_b", "train" if i < 7 else "test") for i in range(10)]
    images = spark.createDataFrame(rows, "path string, combo string, split string")
    path = str(tmp_path / "lines")
    MF.export_manifest(images, ["a", "b"], path, {"seed": "1"})
    got = {(r.path, r.combo, r.split, tuple(r.label)) for r in MF.read_export(spark, path).collect()}
    assert got == {(p, c, s, (1, int(c == "a_b"))) for p, c, s in rows} and MF.read_export(spark, path, "test").count() == 3
    assert "Aggregate" not in MF.read_export(spark, path)._jdf.queryExecution().optimizedPlan().toString()
    next((tmp_path / "lines" / "entries" / "split=test").glob("*.json")).unlink()
    with pytest.raises(ValueError, match="split 'test'"):
        MF.read_export(spark, path)
    with pytest.raises(ValueError, match="too many"):
        MF.write_manifest(images, ["a", "b"], str(tmp_path / "one"), limit=9)


def test_stream_batches_are_written_once(spark, tmp_path):
    """New files only, rows as in batch; a batch that runs again adds nothing."""
    src, out, ck = tmp_path / "src", str(tmp_path / "out"), tmp_path / "ck"
    schema = spark.range(1).schema
    run = lambda: stream_table(spark, str(src), schema, lambda df: df.withColumn("twice", F.col("id") * 2), out, str(ck), 1).awaitTermination()
    for i in range(2):
        spark.range(10 * i, 10 * i + 10, 1, 2).write.mode("append").parquet(str(src))
        run()
    rows = sorted((r.id, r.twice) for r in streamed(spark, out).collect())
    assert rows == [(i, 2 * i) for i in range(20)]
    last = max((ck / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()  # the last batch was written but not recorded
    last.with_name(f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert sorted((r.id, r.twice) for r in streamed(spark, out).collect()) == rows


def test_unit_score_result_and_model_stores(spark, tmp_path):
    units = spark.range(24).select(F.lit("cls8").alias("granularity"), F.lit("train").alias("split"), (F.col("id") / 8).cast("bigint").alias("image_id"), (F.col("id") % 8).cast("int").alias("unit_pos"), F.array(F.lit(1.0)).alias("z"))
    kept = ST.unit_store(units, str(tmp_path / "u"), 8, 3, 1)
    sets = {tuple(r.p) for r in kept.groupBy("image_id").agg(F.array_sort(F.collect_list("unit_pos")).alias("p")).collect()}
    assert kept.count() == 9 and len(sets) == 1
    images = spark.range(2).withColumnRenamed("id", "image_id")
    scores = images.select("image_id", F.lit("cosine/mean").alias("key"), F.array(F.lit(0.1)).alias("scores"))
    assert ST.score_store(scores, images, str(tmp_path / "s")).count() == 2
    with pytest.raises(ValueError, match="1 scores are missing"):
        ST.score_store(scores.where("image_id = 0"), images, str(tmp_path / "s2"))
    runs = spark.createDataFrame([("e1", 1.0), ("e2", 2.0)], "encoder string, f1 double")
    assert ST.append_results(runs.limit(1), str(tmp_path / "r"), ["encoder"]) == 1
    assert ST.append_results(runs, str(tmp_path / "r"), ["encoder"]) == 1
    m = PrototypeModel(("a", "b"), np.eye(2), ("pure", "any"), np.array([1.0, 2.0]), (0.5, None), 0.3, {"size": 8})
    ST.save_model(spark, m, str(tmp_path / "m"), "run1", "match")
    back = ST.load_model(spark, str(tmp_path / "m"), "run1", ["b", "a"])
    assert back.classes == ("b", "a") and np.allclose(back.matrix, np.eye(2)[::-1]) and back.thresholds == (None, 0.5)
    assert np.allclose(back.tau, [2.0, 1.0]) and back.config == {"size": 8} and back.unknown_threshold == 0.3
    with pytest.raises(ValueError):
        ST.load_model(spark, str(tmp_path / "m"), "run1", ["a", "z"])


@pytest.fixture()
def model():
    return PrototypeModel(("a", "b"), np.random.default_rng(0).standard_normal((2, 8)), thresholds=(0.1, None), unknown_threshold=0.2)


def test_folder_inference_three_decoders(spark, tree, model, tmp_path):
    root, pixels = tree
    args = dict(size=6, n=2, sigma=2.0, downsample=2)
    got = IN.infer_folder(spark, str(root), model, ENC, **args)
    assert got.columns == ["image", "max_similarity", "unknown", "sim_a", "sim_b", "present_a", "present_b"] and got.count() == 20
    r = got.where("image like '%/b/00000.png'").first()
    x = FR.flatten_of(pixels["b/00000.png"], "divide", 2.0, 2, "zero")
    z = ENC(FR.normalize_pixels(FR.cut(x, 6, 2)))
    z = z / np.linalg.norm(z, axis=1, keepdims=True)
    p = model.matrix / np.linalg.norm(model.matrix, axis=1, keepdims=True)
    s = z @ p.T
    assert np.allclose([r.sim_a, r.sim_b], s.mean(axis=0)) and r.present_b == (s[:, 1].mean() > 0.05)
    assert r.unknown == (s.max(axis=1).mean() < 0.2)
    w = IN.infer_folder(spark, str(root), model, ENC, readout="weights", **args)
    assert w.columns[1] == "residual_norm" and abs(w.first().weight_a + w.first().weight_b - 1) < 1e-9
    c = IN.infer_folder(spark, str(root), ChannelModel(("a", "b"), np.ones((2, 4)), np.zeros(2), (0.5, 0.5)), ENC, **args)
    assert c.columns == ["image", "score_a", "score_b", "present_a", "present_b"]
    ST.write_predictions(got, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 20


def test_stream_equals_batch_and_runs_once_per_file(spark, tree, model, tmp_path):
    root, _ = tree
    live = tmp_path / "live"
    live.mkdir()
    out, ck = str(tmp_path / "decided"), str(tmp_path / "ck")
    args = dict(size=6, n=2, sigma=2.0, downsample=2)
    files = sorted(root.rglob("0000*.png"))
    for part in (files[:6], files[6:]):
        for f in part:
            (live / f"{f.parent.name}-{f.name}").write_bytes(f.read_bytes())
        q = stream_presence(spark, str(live), model, ENC, out=out, checkpoint=ck, available_now=True, files_per_trigger=4, **args)
        q.awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == len(files) == got.select("image").distinct().count()
    batch = IN.frame_decisions(FR.decode_frames(spark, str(live)), model, ENC, **args)
    a = {r.image.split("/")[-1]: (r.scores, r.pred, r.unknown) for r in got.collect()}
    b = {r.image.split("/")[-1]: (r.scores, r.pred, r.unknown) for r in batch.collect()}
    assert a == b
