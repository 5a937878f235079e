"""Split manifests, fold documents and result documents (JSON), and their Parquet form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.labels import combo_label_document, label_vector, parse_tokens
from tessella.schema import FOLDS

# entries stay JSON text at first, so a bad one can be reported with its own keys
_DOCUMENT = (
    "class_names array<string>, seed bigint, heldout_combos array<string>, trained_combos array<string>, "
    "splits map<string, array<string>>"
)
_ENTRY = "path string, label array<int>, combo string, video string"


def _document(spark, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", _DOCUMENT).alias("d")).select("d.*")


def read_manifest(spark, path: str, split: str | None = None) -> DataFrame:
    """(split, image_id, path, combo, label): one row per image.

    `combo` may be spelled `video`; an entry with neither is an error naming its keys, and
    so is a split the document does not have. `image_id` is a hash of the path.
    """
    doc = _document(spark, path)
    if split is not None:
        message = F.concat(F.lit("split must be one of "), F.array_join(F.array_sort(F.map_keys("splits")), ", "), F.lit(f"; got {split}"))
        chosen = F.create_map(F.lit(split), F.col("splits")[split])
        doc = doc.withColumn("splits", F.when(F.map_contains_key("splits", split), chosen).otherwise(F.raise_error(message)))
    rows = doc.select(F.explode("splits").alias("split", "entries")).select("split", F.posexplode("entries").alias("i", "raw"))
    rows = rows.withColumn("e", F.from_json("raw", _ENTRY))
    keys = F.array_join(F.array_sort(F.json_object_keys("raw")), ", ")
    error = F.raise_error(F.concat(F.lit("entry "), F.col("i").cast("string"), F.lit(" has no 'combo' (nor 'video') key; found "), keys))
    combo = F.coalesce("e.combo", "e.video", error.cast("string"))
    return rows.select(
        "split", F.xxhash64("e.path").alias("image_id"), F.col("e.path").alias("path"), combo.alias("combo"), F.col("e.label").alias("label")
    )


def manifest_classes(spark, path: str) -> list[str]:
    return list(_document(spark, path).select("class_names").first()[0])


def read_protocol(spark, path: str) -> DataFrame:
    """(combo, role) with role heldout | trained, from the document or, when it does not
    say, from the combinations of its test and train splits."""
    doc = _document(spark, path)
    named = doc.select(F.explode(F.array(F.lit("heldout"), F.lit("trained"))).alias("role"), "heldout_combos", "trained_combos")
    listed = named.select("role", F.explode(F.when(F.col("role") == "heldout", F.col("heldout_combos")).otherwise(F.col("trained_combos"))).alias("combo"))
    images = read_manifest(spark, path).where(F.col("split").isin("train", "test"))
    derived = images.select(F.when(F.col("split") == "test", "heldout").otherwise("trained").alias("role"), "combo").distinct()
    have = listed.select("role").distinct()
    return listed.unionByName(derived.join(have, "role", "left_anti")).select("combo", "role")


#: Images up to which a manifest is written as one document; more are an error, see `export_manifest`.
DOCUMENT_IMAGES = 2_000_000


def write_manifest(images: DataFrame, classes: Sequence[str], path: str, extra: dict[str, str] | None = None, limit: int = DOCUMENT_IMAGES) -> None:
    """One JSON document: class_names, splits, combo_to_label and `extra` string fields.

    An export for other tools: a document is one row by definition, one task writes it, and
    more than `limit` images are refused. Jobs keep their manifests as Parquet with
    `write_images`, or as JSON lines with `export_manifest`, of any size.
    """
    n = images.count()
    if n > limit:
        raise ValueError(f"{n} images are too many for one document; use export_manifest or write_images")
    per_split = images.groupBy("split").agg(F.array_sort(F.collect_list(_entry(classes))).alias("e"))
    doc = per_split.agg(F.map_from_entries(F.collect_list(F.struct("split", "e"))).alias("splits"))
    fields = [F.array(*[F.lit(c) for c in classes]).alias("class_names"), *[F.lit(v).alias(k) for k, v in (extra or {}).items()], "splits"]
    doc.crossJoin(combo_label_document(images, classes)).select(*fields, "combo_to_label").coalesce(1).write.mode("overwrite").json(path)


def _entry(classes: Sequence[str]):
    return F.struct("path", label_vector(parse_tokens("combo"), classes).alias("label"), "combo")


def export_manifest(images: DataFrame, classes: Sequence[str], path: str, extra: dict[str, str] | None = None) -> None:
    """A manifest of any size as JSON lines: a folder of entries for each split, and one head with
    class_names, combo_to_label, `extra` and the number of entries of each split, written last."""
    rows = images.select("split", _entry(classes).alias("e")).select("split", "e.*")
    rows.write.mode("overwrite").partitionBy("split").json(f"{path}/entries")
    counts = images.groupBy("split").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "n")))).alias("counts"))
    fields = [F.array(*[F.lit(c) for c in classes]).alias("class_names"), *[F.lit(v).alias(k) for k, v in (extra or {}).items()], "counts"]
    counts.crossJoin(combo_label_document(images, classes)).select(*fields, "combo_to_label").coalesce(1).write.mode("overwrite").json(f"{path}/head")


def read_export(spark, path: str, split: str | None = None) -> DataFrame:
    """(split, image_id, path, combo, label) of an `export_manifest`; a split is pruned by folder. Fails if entries and head disagree."""
    rows = spark.read.schema("path string, label array<int>, combo string, split string").json(f"{path}/entries")
    head = spark.read.schema("counts map<string, bigint>").json(f"{path}/head").select(F.explode("counts").alias("split", "n"))
    if split is not None:
        rows, head = rows.where(F.col("split") == split), head.where(F.col("split") == split)
    odd = rows.groupBy("split").agg(F.count("*").alias("have")).join(head, "split", "full_outer").where("NOT have <=> n").first()
    if odd:
        raise ValueError(f"split {odd['split']!r} has {odd['have']} entries and its head names {odd['n']}")
    return rows.select("split", F.xxhash64("path").alias("image_id"), "path", "combo", "label")


def write_images(images: DataFrame, path: str) -> None:
    """The manifest as Parquet, one folder per split."""
    images.write.mode("overwrite").partitionBy("split").parquet(path)


def read_images(spark, path: str, split: str | None = None) -> DataFrame:
    """The manifest that `write_images` wrote; a split is pruned by folder."""
    images = spark.read.parquet(path)
    return images if split is None else images.where(F.col("split") == split)


def read_folds(spark, path: str) -> DataFrame:
    """(fold, combo, role) of a development-fold document."""
    doc = spark.read.json(path, schema=FOLDS, multiLine=True).select(F.explode("folds").alias("f"))
    both = F.array(F.struct(F.lit("dev").alias("role"), F.col("f.dev_combos").alias("c")), F.struct(F.lit("train").alias("role"), F.col("f.train_combos").alias("c")))
    rows = doc.select(F.col("f.fold").alias("fold"), F.explode(both).alias("e")).select("fold", "e.role", F.explode("e.c").alias("combo"))
    return rows.select("fold", "combo", "role")


def write_folds(folds: DataFrame, combos: DataFrame, classes: Sequence[str], n_folds: int, path: str) -> None:
    """Fold document from (combo, fold) rows and the full list of trained combinations."""
    from tessella.operators.splits import expand_folds

    rows = expand_folds(combos.select("combo").distinct(), folds, n_folds)
    pick = lambda r: F.array_sort(F.collect_list(F.when(F.col("role") == r, F.col("combo"))))
    per = rows.groupBy("fold").agg(pick("dev").alias("dev_combos"), pick("train").alias("train_combos"))
    doc = per.agg(F.array_sort(F.collect_list(F.struct("fold", "dev_combos", "train_combos"))).alias("folds"))
    doc.select(F.array(*[F.lit(c) for c in classes]).alias("class_names"), "folds").coalesce(1).write.mode("overwrite").json(path)


def read_results(spark, paths: Sequence[str], schema: str | None = None) -> DataFrame:
    """Result documents of several runs with their `file`; runs that do not exist are skipped."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def exists(p: str) -> bool:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        return hp.getFileSystem(conf).exists(hp)

    found = [p for p in paths if exists(p)]
    if not found:
        raise FileNotFoundError("no result document found")
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(found).withColumn("file", F.input_file_name())
