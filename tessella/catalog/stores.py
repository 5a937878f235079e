"""Completeness checks and sinks as queries."""

from pyspark.sql import functions as F

from tessella.catalog.aggregates import PRED, predictions
from tessella.catalog.fixtures import CLASSES, images, sql_base, sql_protos, table, tiles
from tessella.catalog.registry import query
from tessella.catalog.splits import _FOLD
from tessella.catalog.vectors import model
from tessella.operators import splits as SP
from tessella.operators.scoring import score_tiles, score_units
from tessella.plans.infer import prepare
from tessella.session import scratch
from tessella.sources import files as FS
from tessella.sources import manifests as MF
from tessella.sources import stores as ST
from tessella.sources.files import missing_files
from tessella.sources.stores import missing_scores, wide_predictions
from tessella.streaming.presence import stream_table, streamed


@query("a6_missing_files", "doc_id:l", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def a6(spark, d):
    """Documents as the manifest, labels as the files that exist."""
    path = F.format_string("%08d", "doc_id").alias("path")
    manifest = table(spark, d, "documents").select("doc_id", path)
    return missing_files(manifest, table(spark, d, "labels").select(path))


@query("a10_missing_scores", "image_id:l key:s", f"{sql_base()} SELECT image_id, unnest(['cosine/mean', 'sparsemax/mean']) AS key FROM fx_images WHERE image_id % 7 = 0")
def a10(spark, d):
    """Scores of most images; the rest is reported per read-out."""
    t = tiles(spark, d).where("image_id % 7 <> 0")
    return missing_scores(score_units(t, model(spark, d), ("mean",)), images(spark, d))


@query("a11_wide_predictions", "image:s " + " ".join(f"score_{c}:d present_{c}:b" for c in CLASSES), f"{PRED} SELECT CAST(image_id AS VARCHAR) AS image, " + ", ".join(f"max(score) FILTER (WHERE k = {k}) AS score_{c}, bool_or(pred = 1) FILTER (WHERE k = {k}) AS present_{c}" for k, c in enumerate(CLASSES)) + " FROM pr GROUP BY image_id")
def a11(spark, d):
    p = predictions(spark, d).withColumn("image", F.col("image_id").cast("string"))
    return wide_predictions(p, CLASSES)


# ---- files -----------------------------------------------------------------------


def _exported(spark, d):
    """(folder, export report): the first bytes of every document as a file in its language's folder."""
    root = scratch(spark, "export").removeprefix("file:")
    body = F.encode(F.substring(F.coalesce("text", F.lit("")), 1, 64), "UTF-8")
    path = F.concat("lang", F.lit("/"), F.format_string("%08d.jpg", "doc_id"))
    shards = table(spark, d, "documents").select(F.struct(path.alias("path"), body.alias("bytes")).alias("image"))
    return root, FS.export_files(shards, root)


_PATH = "lang || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.jpg'"


@query("a5_export_files", "path:s written:b", f"SELECT {_PATH} AS path, true AS written FROM documents")
def a5(spark, d):
    return _exported(spark, d)[1]


@query("a1_list_images", "path:s combo:s name:s length:l", f"SELECT {_PATH} AS path, lang AS combo, lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.jpg' AS name, octet_length(encode(left(coalesce(text, ''), 64))) AS length FROM documents")
def a1(spark, d):
    root, report = _exported(spark, d)
    report.write.format("noop").mode("overwrite").save()
    return FS.list_images(spark, root)


@query("o20_prepare", "split:s combo:s n:l", """WITH p AS (SELECT lang AS combo, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents),
    c AS (SELECT combo, pos, n, least(round_even(0.8 * n, 0), n) AS a, least(round_even(0.1 * n, 0), n - least(round_even(0.8 * n, 0), n)) AS b FROM p),
    s AS (SELECT combo, CASE WHEN pos < a THEN 'train' WHEN pos < a + b THEN 'val' ELSE 'test' END AS split FROM c) SELECT split, combo, count(*) AS n FROM s GROUP BY ROLLUP (split, combo)""")
def o20(spark, d):
    """A folder listed, split by acquisition order and written as a manifest."""
    root, report = _exported(spark, d)
    report.write.format("noop").mode("overwrite").save()
    return prepare(spark, root, scratch(spark, "manifest"))


# ---- manifests and documents -------------------------------------------------------

_SPLIT = "CASE image_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END"


def _split_images(spark, d):
    r = F.col("image_id") % 5
    return images(spark, d).withColumn("split", F.when(r == 0, "test").when(r == 1, "val").otherwise("train"))


@query("a3_split_manifest", "split:s path:s combo:s label:s", f"{sql_base()} SELECT {_SPLIT} AS split, path, combo, CAST(label AS VARCHAR) AS label FROM fx_images WHERE {_SPLIT} <> 'val'")
def a3(spark, d):
    """Two splits of a manifest document, with its class order."""
    path = scratch(spark, "document")
    MF.write_manifest(_split_images(spark, d), CLASSES, path)
    rows = MF.read_manifest(spark, path, "train").unionByName(MF.read_manifest(spark, path, "test"))
    return rows.withColumn("label", F.concat(F.lit("["), F.array_join("label", ", "), F.lit("]")))


@query("a4_protocol", "combo:s role:s", f"{sql_base()} SELECT DISTINCT combo, CASE {_SPLIT} WHEN 'test' THEN 'heldout' ELSE 'trained' END AS role FROM fx_images WHERE {_SPLIT} <> 'val'")
def a4(spark, d):
    """Roles that the document does not name follow from its test and train splits."""
    path = scratch(spark, "document")
    MF.write_manifest(_split_images(spark, d), CLASSES, path)
    return MF.read_protocol(spark, path)


@query("a15_manifest_lines", "split:s path:s combo:s label:s", f"{sql_base()} SELECT {_SPLIT} AS split, path, combo, CAST(label AS VARCHAR) AS label FROM fx_images")
def a15(spark, d):
    path = scratch(spark, "lines")
    MF.export_manifest(_split_images(spark, d), CLASSES, path)
    return MF.read_export(spark, path).withColumn("label", F.concat(F.lit("["), F.array_join("label", ", "), F.lit("]")))


@query("a15_folds", "fold:l combo:s role:s", f"{sql_base()}, {_FOLD} SELECT f AS fold, combo, CASE WHEN fd.fold = f THEN 'dev' ELSE 'train' END AS role FROM (SELECT DISTINCT combo FROM fx_images) LEFT JOIN fd USING (combo), range(5) r(f)")
def a15_folds(spark, d):
    path, im = scratch(spark, "folds"), images(spark, d)
    MF.write_folds(SP.build_folds(im, 5, 1337), im, CLASSES, 5, path)
    return MF.read_folds(spark, path)


@query("a13_result_documents", "run:s n:l", "SELECT lang AS run, count(*) AS n FROM documents GROUP BY lang")
def a13(spark, d):
    """A result document for each language, read together; a run that does not exist is skipped."""
    root = scratch(spark, "runs")
    counts = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    counts.withColumn("run", F.col("lang")).repartition("lang").write.partitionBy("lang").json(root)
    names = [r[0] for r in counts.select("lang").collect()]
    return MF.read_results(spark, [f"{root}/lang={x}" for x in [*names, "none"]], "run string, n bigint")


# ---- stores ------------------------------------------------------------------------


@query("a7_feature_store", "config:s image_id:l tile_idx:l fill:l", """SELECT config, vec_id // 2 AS image_id, vec_id % 2 AS tile_idx, CASE WHEN config = 'a' AND vec_id // 2 % 2 = 0 THEN 1 ELSE 2 END AS fill FROM embeddings, (VALUES ('a'), ('b')) c(config)""")
def a7(spark, d):
    """Under configuration a, half of the images are stored first and not extracted again; b shares nothing."""
    root, t = scratch(spark, "features"), tiles(spark, d).select("image_id", "tile_idx", "z")
    listed = images(spark, d).select("image_id", "path")
    extract = lambda n: lambda todo: t.join(todo.select("image_id"), "image_id", "left_semi").withColumn("n_fill", F.lit(n))
    ST.feature_store(listed.where("image_id % 2 = 0"), extract(1), root, {"encoder": "a"})
    a = ST.feature_store(listed, extract(2), root, {"encoder": "a"}).withColumn("config", F.lit("a"))
    b = ST.feature_store(listed, extract(2), root, {"encoder": "b"}).withColumn("config", F.lit("b"))
    return a.unionByName(b).withColumnRenamed("n_fill", "fill")


@query("a8_feature_key", "what:s ok:b", "SELECT * FROM (VALUES ('same', true), ('other images', false), ('other configuration', false)) v(what, ok)")
def a8(spark, d):
    """The guard accepts the features of these images under this configuration and nothing else."""
    root, t, cfg = scratch(spark, "features"), tiles(spark, d).select("image_id", "tile_idx", "z"), {"encoder": "a"}
    listed = images(spark, d).select("image_id", "path")
    ST.feature_store(listed, lambda todo: t.join(todo.select("image_id"), "image_id", "left_semi"), root, cfg)
    stored = ST.stored_features(spark, root, cfg)

    def accepted(rows, config) -> bool:
        try:
            ST.assert_feature_key(stored, rows, config)
        except ValueError:
            return False
        return True

    cases = [("same", listed, cfg), ("other images", listed.where("image_id > 0"), cfg), ("other configuration", listed, {"encoder": "b"})]
    return spark.createDataFrame([(name, accepted(rows, config)) for name, rows, config in cases], "what string, ok boolean")


@query("a9_unit_store", "granularity:s split:s image_id:l unit_pos:l", """WITH p AS (SELECT i AS unit_pos FROM range(16) r(i) ORDER BY md5(CAST(i AS VARCHAR) || ':3') LIMIT 5)
    SELECT 'cls8' AS granularity, CASE WHEN vec_id // 16 % 4 = 0 THEN 'test' ELSE 'train' END AS split, vec_id // 16 AS image_id, vec_id % 16 AS unit_pos FROM embeddings WHERE vec_id % 16 IN (SELECT unit_pos FROM p)""")
def a9(spark, d):
    """The same five of sixteen units of every image."""
    t = tiles(spark, d, bag=16)
    units = t.select(F.lit("cls8").alias("granularity"), F.when(F.col("image_id") % 4 == 0, "test").otherwise("train").alias("split"), "image_id", F.col("tile_idx").alias("unit_pos"), "z")
    return ST.unit_store(units, scratch(spark, "units"), 16, 5, 3)


@query("a12_append_results", "user_id:l n:l stored:l", """SELECT user_id, count(*) AS n, CASE WHEN user_id % 3 = 0 THEN 1 ELSE 2 END AS stored FROM events WHERE user_id IS NOT NULL GROUP BY user_id""")
def a12(spark, d):
    """Finished runs are skipped: the second writer adds what the first did not store."""
    root = scratch(spark, "results")
    runs = table(spark, d, "events").where("user_id is not null").groupBy("user_id").agg(F.count("*").alias("n"))
    ST.append_results(runs.where("user_id % 3 = 0").withColumn("stored", F.lit(1)), root, ["user_id"])
    ST.append_results(runs.withColumn("stored", F.lit(2)), root, ["user_id"])
    ST.append_results(runs.withColumn("stored", F.lit(3)), root, ["user_id"])
    return spark.read.parquet(root)


@query("a14_model_table", "class:s d:l v:d", f"{sql_base()}, cls(k, class) AS (VALUES (0, 'c0'), (1, 'c1'), (2, 'c2'), (3, 'c3'), (4, 'c4')), {sql_protos()} SELECT class, d, p[d + 1] AS v FROM protos JOIN cls USING (k), range(64) r(d)")
def a14(spark, d):
    """Stored prototypes come back in the order of the classes asked for."""
    from tessella.operators import prototypes as P

    root, back = scratch(spark, "models"), tuple(reversed(CLASSES))
    ST.save_model(spark, P.hybrid_prototypes(tiles(spark, d), images(spark, d), CLASSES), root, "run", "match")
    m = ST.load_model(spark, root, "run", back)
    rows = [(c, [float(x) for x in m.matrix[i]]) for i, c in enumerate(m.classes)]
    return spark.createDataFrame(rows, "class string, v array<double>").select("class", F.posexplode("v").alias("d", "v"))


# ---- streaming ---------------------------------------------------------------------


@query("p1_stream_scores", "vec_id:l best:l max_sim:d", """WITH c AS (SELECT k, list(CAST((k * 7 + c * 3) % 11 - 5 AS DOUBLE) ORDER BY c) AS p FROM range(5) a(k), range(64) b(c) GROUP BY k),
    t AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT vec_id, k, list_inner_product(e, p) / sqrt(list_inner_product(e, e)) / sqrt(list_inner_product(p, p)) AS v FROM t, c)
    SELECT vec_id, arg_max(k, {'a': v, 'b': -k}) AS best, max(v) AS max_sim FROM s GROUP BY 1""")
def p1(spark, d):
    """The vectors as a stream of files, scored as they arrive, each batch written once."""
    import numpy as np

    from tessella.model import PrototypeModel

    m = PrototypeModel(CLASSES, np.array([[float((k * 7 + c * 3) % 11 - 5) for c in range(64)] for k in range(5)]))
    out, name = scratch(spark, "stream"), "embeddings"
    step = lambda rows: score_tiles(rows, m, ("best", "max_sim"), ("vec_id",), "embedding")
    q = stream_table(spark, f"{d}/{name}.parquet*", table(spark, d, name).schema, step, f"{out}/rows", f"{out}/offsets", 1)
    q.awaitTermination()
    return streamed(spark, f"{out}/rows")
