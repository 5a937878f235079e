"""Split, sampling and protocol queries."""

from pyspark.sql import functions as F

from tessella.catalog.fixtures import CLASSES, CLASSES4, images, sql_base, sql_classes, table, tiles
from tessella.catalog.registry import query
from tessella.functions import labels as L
from tessella.operators import ordering as O
from tessella.operators import splits as S

# sessions: documents of a source in path order; event logs of an event type
_DOCS = "WITH im AS (SELECT doc_id AS image_id, source AS combo, source || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.jpg' AS path FROM documents)"
_EV = "WITH im AS (SELECT event_id AS image_id, event_type AS combo, event_type || '/' || lpad(CAST(event_id AS VARCHAR), 9, '0') || '.jpg' AS path FROM events)"


def docs(spark, d):
    t = table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("image_id"), F.col("source").alias("combo"), F.concat("source", F.lit("/"), F.format_string("%08d.jpg", "doc_id")).alias("path"))


def events(spark, d):
    t = table(spark, d, "events")
    return t.select(F.col("event_id").alias("image_id"), F.col("event_type").alias("combo"), F.concat("event_type", F.lit("/"), F.format_string("%09d.jpg", "event_id")).alias("path"))


_TEMPORAL = """, p AS (SELECT *, row_number() OVER (PARTITION BY combo ORDER BY path) - 1 AS pos, count(*) OVER (PARTITION BY combo) AS n FROM im),
    c AS (SELECT *, least(round_even(n * 0.8::DOUBLE, 0), n) AS nt FROM p), v AS (SELECT *, least(round_even(n * 0.1::DOUBLE, 0), n - nt) AS nv FROM c)
    SELECT image_id, combo, CASE WHEN pos < nt THEN 'train' WHEN pos < nt + nv THEN 'val' ELSE 'test' END AS split FROM v"""


@query("h1_temporal_split", "image_id:l combo:s split:s", _DOCS + _TEMPORAL)
def h1(spark, d):
    return S.temporal_split(docs(spark, d))


@query("h1_temporal_split_events", "image_id:l combo:s split:s", _EV + _TEMPORAL)
def h1_events(spark, d):
    """The same rule on few, very large sessions."""
    return S.temporal_split(events(spark, d))


@query("e1_acquisition_pos", "image_id:l pos:l n:l", _EV + " SELECT image_id, row_number() OVER (PARTITION BY combo ORDER BY path) - 1 AS pos, count(*) OVER (PARTITION BY combo) AS n FROM im")
def e1(spark, d):
    return S.acquisition_position(events(spark, d))


@query("e2_cap_per_combo", "image_id:l combo:s", _EV + " SELECT image_id, combo FROM (SELECT *, row_number() OVER (PARTITION BY combo ORDER BY path) AS r FROM im) WHERE r <= 25")
def e2(spark, d):
    return S.cap_per_combo(events(spark, d), 25)


@query("e3_avg_rank", "event_type:s value:d n:l avg_rank:d", """WITH r AS (SELECT event_type, value, rank() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type, value) AS c FROM events WHERE value IS NOT NULL)
    SELECT event_type, value, max(c) AS n, max(r + (c - 1) / 2.0::DOUBLE) AS avg_rank FROM r GROUP BY 1, 2""")
def e3(spark, d):
    return O.average_rank(table(spark, d, "events"), ["event_type"], "value")


@query("e5_ntile_bins", "event_id:l bin:l", "SELECT event_id, ntile(10) OVER (PARTITION BY event_type ORDER BY floor(value / 20), event_id) - 1 AS bin FROM events WHERE value IS NOT NULL")
def e5(spark, d):
    """Coarse values, so a few ties hold most rows."""
    e = table(spark, d, "events").where("value is not null").select("event_id", "event_type", F.floor(F.col("value") / 20).cast("double").alias("v"))
    return O.equal_count_bins(e, ["event_type"], "v", "event_id")


_RS = """, r AS (SELECT image_id, row_number() OVER (ORDER BY md5(CAST(image_id AS VARCHAR) || ':{seed}'), image_id) - 1 AS pos, count(*) OVER () AS n FROM im)"""


@query("h2_random_split", "image_id:l split:s", _EV + _RS.format(seed=7) + " SELECT image_id, CASE WHEN pos < floor(n * 0.1::DOUBLE) THEN 'test' WHEN pos < floor(n * 0.1::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM r")
def h2(spark, d):
    return S.random_split(events(spark, d), 7)


@query("h3_holdout_90_10", "image_id:l split:s", _EV + _RS.format(seed=1338) + " SELECT image_id, CASE WHEN pos < floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM r")
def h3(spark, d):
    return S.holdout_90_10(events(spark, d), 1337)


def sql_heldout(counts: dict, seed: int, images: str = "fx_images", attempts: int = 50, name: str = "lco") -> str:
    """(combo, ord, role) twin of the held-out selection; needs `cls`."""
    quota = " ".join(f"WHEN {o} THEN {c}" for o, c in counts.items())
    return f"""{name}_c AS (SELECT DISTINCT combo, len(string_split(combo, '_')) AS ord, list_aggregate(list_sort(string_split(combo, '_')), 'string_agg', '_') AS lk FROM {images}),
{name}_d AS (SELECT *, row_number() OVER (PARTITION BY a, ord ORDER BY md5(combo || ':' || CAST(a + {seed} AS VARCHAR)), combo) <= (CASE ord {quota} ELSE 0 END) AS held FROM {name}_c, range({attempts + 1}) r(a)),
{name}_r AS (SELECT *, CASE WHEN held THEN 'heldout' WHEN bool_or(held) OVER (PARTITION BY a, lk) THEN 'dropped' ELSE 'trained' END AS role FROM {name}_d),
{name}_t AS (SELECT a, role, unnest(string_split(combo, '_')) AS tok FROM {name}_r),
{name}_ok AS (SELECT min(a) AS a FROM (SELECT a FROM (SELECT a, tok, max(CASE WHEN role = 'trained' THEN 1 ELSE 0 END) AS inn FROM {name}_t GROUP BY 1, 2) GROUP BY a HAVING min(inn) = 1)),
{name} AS (SELECT combo, ord, role FROM {name}_r JOIN {name}_ok USING (a))"""


@query("h4_lco", "combo:s role:s", f"{sql_base(3, 4)}, {sql_heldout({1: 1, 2: 2, 3: 1}, 1337)} SELECT combo, role FROM lco")
def h4(spark, d):
    return S.select_heldout(images(spark, d, 3, 4), {1: 1, 2: 2, 3: 1}, 1337)


# twin sessions: half of the images of a pair carry the reversed name
_TW = "tw AS (SELECT image_id, CASE WHEN image_id % 2 = 0 AND len(string_split(combo, '_')) = 2 THEN string_split(combo, '_')[2] || '_' || string_split(combo, '_')[1] ELSE combo END AS combo FROM fx_images)"


def twins(spark, d):
    t = F.split("combo", "_")
    flip = (F.col("image_id") % 2 == 0) & (F.size(t) == 2)
    return images(spark, d).withColumn("combo", F.when(flip, F.concat_ws("_", t[1], t[0])).otherwise(F.col("combo")))


@query("h4_lco_twins", "combo:s role:s", f"{sql_base()}, {_TW}, {sql_heldout({1: 1, 2: 3}, 11, 'tw')} SELECT combo, role FROM lco")
def h4_twins(spark, d):
    """`a_b` held out drops `b_a` from training."""
    return S.select_heldout(twins(spark, d), {1: 1, 2: 3}, 11)


@query("c3_label_set_anti", "image_id:l combo:s", f"{sql_base()}, {_TW} SELECT image_id, combo FROM tw WHERE list_aggregate(list_sort(string_split(combo, '_')), 'string_agg', '_') NOT IN ('c0_c1', 'c2')")
def c3(spark, d):
    held = spark.createDataFrame([("c1_c0",), ("c2",)], "combo string")
    return S.drop_label_sets(twins(spark, d), held)


@query("h5_dev_combos", "combo:s role:s", f"{sql_base(3, 4)}, {sql_heldout({1: 1, 2: 1}, 1337 * 7919, attempts=100)} SELECT combo, CASE role WHEN 'heldout' THEN 'dev' ELSE 'train' END AS role FROM lco")
def h5(spark, d):
    return S.select_dev_combos(images(spark, d, 3, 4), {1: 1, 2: 1}, 1337)


LCO = sql_heldout({1: 1, 2: 2}, 1337)
LCO_SPLIT = """tr AS (SELECT i.*, row_number() OVER (ORDER BY md5(CAST(image_id AS VARCHAR) || ':1338'), image_id) - 1 AS pos, count(*) OVER () AS n FROM fx_images i JOIN lco USING (combo) WHERE role = 'trained'),
sp AS (SELECT image_id, combo, label, CASE WHEN pos < floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM tr
  UNION ALL SELECT image_id, combo, label, 'test' AS split FROM fx_images JOIN lco USING (combo) WHERE role = 'heldout')"""


@query("h6_protocol", "image_id:l role:s in_train_full:b", f"""{sql_base()}, {LCO}, {LCO_SPLIT}, trained AS (SELECT DISTINCT combo FROM sp WHERE split <> 'test'), {sql_heldout({2: 2}, 1337 * 7919, 'trained', 100, 'dv')}
    SELECT image_id, CASE WHEN split = 'test' THEN 'test' WHEN combo IN (SELECT combo FROM dv WHERE role = 'heldout') THEN 'dev' ELSE split END AS role, split = 'train' AS in_train_full FROM sp""")
def h6(spark, d):
    im = images(spark, d)
    split = S.lco_split(im, S.select_heldout(im, {1: 1, 2: 2}, 1337))
    dev = S.select_dev_combos(split.where("split <> 'test'"), {2: 2}, 1337)
    return S.build_protocol(split, dev)


_FOLD = """fd AS (SELECT combo, (row_number() OVER (ORDER BY len(string_split(combo, '_')), md5(combo || ':1337'), combo) - 1) % 5 AS fold FROM (SELECT DISTINCT combo FROM fx_images) WHERE len(string_split(combo, '_')) > 1)"""


@query("h7_dev_folds", "combo:s fold:l", f"{sql_base()}, {_FOLD} SELECT combo, fold FROM fd")
def h7(spark, d):
    return S.build_folds(images(spark, d), 5, 1337)


@query("h7_dev_folds_singletons", "combo:s fold:l", f"""{sql_base()}, {_FOLD} SELECT combo, fold FROM fd UNION ALL
    SELECT combo, row_number() OVER (ORDER BY md5(combo || ':1337'), combo) - 1 AS fold FROM (SELECT DISTINCT combo FROM fx_images) WHERE len(string_split(combo, '_')) = 1""")
def h7s(spark, d):
    return S.build_folds(images(spark, d), 5, 1337, hold_out_singletons=True)


@query("h7_fold_coverage", "fold:l class:s n:l", f"""{sql_base()}, {_FOLD}, x AS (SELECT DISTINCT i.combo, f AS fold FROM fx_images i, range(5) r(f))
    SELECT fold, class, count(*) AS n FROM (SELECT fold, unnest(string_split(combo, '_')) AS class FROM x WHERE (combo, fold) NOT IN (SELECT combo, fold FROM fd)) GROUP BY 1, 2""")
def h7c(spark, d):
    im = images(spark, d)
    folds = S.build_folds(im, 5, 1337)
    bad = S.fold_coverage(im.select("combo").distinct(), folds, 5)
    rows = S.expand_folds(im.select("combo").distinct(), folds, 5).where("role = 'train'")
    n = rows.select("fold", F.explode(L.parse_tokens("combo")).alias("class")).groupBy("fold", "class").agg(F.count("*").alias("n"))
    return n.join(bad, ["fold", "class"], "left_anti")


@query("c8_expand_folds", "image_id:l fold:l role:s", f"{sql_base()}, {_FOLD} SELECT image_id, f AS fold, CASE WHEN fd.fold = f THEN 'dev' ELSE 'train' END AS role FROM fx_images LEFT JOIN fd USING (combo), range(5) r(f)")
def c8(spark, d):
    im = images(spark, d)
    return S.expand_folds(im, S.build_folds(im, 5, 1337), 5)


@query("c9_expand_loso", "image_id:l k_star:l k_in:l", f"{sql_base()} SELECT image_id, a AS k_star, b AS k_in FROM fx_images, range(5) r(a), range(5) q(b) WHERE a <> b")
def c9(spark, d):
    return S.expand_loso(images(spark, d), 5, inner=True)


@query("h8_loso_folds", "image_id:l k_star:l kept:b unknown:l", f"{sql_base()} SELECT image_id, k AS k_star, label[k + 1] = 0 AS kept, label[k + 1] AS unknown FROM fx_images, range(5) r(k)")
def h8(spark, d):
    return S.loso_folds(images(spark, d), CLASSES)


@query("h9_fixed_positions", "image_id:l unit_pos:l", """WITH p AS (SELECT i AS unit_pos FROM range(16) r(i) ORDER BY md5(CAST(i AS VARCHAR) || ':3') LIMIT 5)
    SELECT vec_id // 16 AS image_id, vec_id % 16 AS unit_pos FROM embeddings WHERE vec_id % 16 IN (SELECT unit_pos FROM p)""")
def h9(spark, d):
    units = tiles(spark, d, bag=16).withColumnRenamed("tile_idx", "unit_pos")
    return units.join(F.broadcast(S.fixed_positions(spark, 16, 5, 3)), "unit_pos", "left_semi").select("image_id", "unit_pos")


@query("h10_tile_subsample", "image_id:l tile_idx:l", """SELECT image_id, tile_idx FROM (SELECT vec_id // 16 AS image_id, vec_id % 16 AS tile_idx,
    row_number() OVER (PARTITION BY vec_id // 16 ORDER BY md5(CAST(vec_id // 16 AS VARCHAR) || ':' || CAST(vec_id % 16 AS VARCHAR) || ':5'), vec_id % 16) AS r FROM embeddings) WHERE r <= 4""")
def h10(spark, d):
    return S.subsample_tiles(tiles(spark, d, bag=16).drop("z"), 4, 5)


@query("h11_stratified", "image_id:l combo:s", _EV + """, r AS (SELECT *, row_number() OVER (PARTITION BY combo ORDER BY md5(CAST(image_id AS VARCHAR) || ':9'), image_id) AS r FROM im)
    SELECT image_id, combo FROM r WHERE r <= greatest(1, 120 // (SELECT count(DISTINCT combo) FROM im))""")
def h11(spark, d):
    return S.stratified(events(spark, d), 120, 9)


@query("h12_cap_units", "image_id:l tile_idx:l", """SELECT image_id, tile_idx FROM (SELECT vec_id // 2 AS image_id, vec_id % 2 AS tile_idx,
    row_number() OVER (ORDER BY md5(CAST(vec_id // 2 AS VARCHAR) || ':' || CAST(vec_id % 2 AS VARCHAR) || ':1'), vec_id) AS r FROM embeddings) WHERE r <= 100""")
def h12(spark, d):
    return S.cap_units(tiles(spark, d), 100, 1)


@query("h13_even_sample", "combo:s image_id:l new_idx:l", _EV + """, p AS (SELECT *, row_number() OVER (PARTITION BY combo ORDER BY path) - 1 AS pos, count(*) OVER (PARTITION BY combo) AS n FROM im),
    w AS (SELECT combo, i AS new_idx, CASE WHEN n <= 30 THEN i ELSE i * n // 30 END AS pos FROM (SELECT combo, any_value(n) AS n FROM p GROUP BY 1), range(30) r(i) WHERE i < n)
    SELECT combo, image_id, new_idx FROM p JOIN w USING (combo, pos)""")
def h13(spark, d):
    return S.even_sample(events(spark, d), 30, "combo", "path")


@query("d6_rollup", "split:s combo:s n:l share:d", _DOCS + _TEMPORAL.replace("SELECT image_id, combo, CASE", ", sp AS (SELECT image_id, combo, CASE") + ") SELECT split, combo, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM sp) AS share FROM sp GROUP BY ROLLUP (split, combo)")
def d6(spark, d):
    return S.split_summary(S.temporal_split(docs(spark, d)))


@query("s1_dev_union", "image_id:l", f"{sql_base()}, {LCO}, {LCO_SPLIT} SELECT image_id FROM sp WHERE split <> 'test'")
def s1(spark, d):
    im = images(spark, d)
    split = S.lco_split(im, S.select_heldout(im, {1: 1, 2: 2}, 1337))
    return S.dev_union(split.where("split = 'train'"), split.where("split = 'val'"))


@query("g1_order_combos", "rank:l combo:s", f"{sql_base(3, 4)} SELECT row_number() OVER (ORDER BY len(string_split(combo, '_')), combo) AS rank, combo FROM (SELECT DISTINCT combo FROM fx_images)")
def g1(spark, d):
    ordered = S.order_combos(images(spark, d, 3, 4).select("combo").distinct())
    listed = ordered.agg(F.collect_list(F.struct(L.combo_order("combo").alias("o"), "combo")).alias("l"))
    return listed.select(F.posexplode(F.array_sort("l")).alias("p", "e")).select((F.col("p") + 1).alias("rank"), "e.combo")


@query("b29_combo_role", "combo:s role:s", f"{sql_base()}, {LCO} SELECT DISTINCT i.combo, coalesce(role, 'unlisted') AS role FROM fx_images i LEFT JOIN (SELECT * FROM lco WHERE ord = 2) l USING (combo)")
def b29(spark, d):
    im = images(spark, d)
    roles = S.select_heldout(im, {1: 1, 2: 2}, 1337).where(F.col("order") == 2)
    return L.combo_role(im.select("combo").distinct(), roles)


@query("c10_mixup", "image_id:l tile_idx:l lam:d first:d label:s", f"""{sql_base()}, h AS (SELECT vec_id // 2 AS image_id, vec_id % 2 AS tile_idx, embedding[1]::DOUBLE AS e, md5((vec_id // 2)::VARCHAR || ':' || (vec_id % 2)::VARCHAR || ':3') AS h FROM embeddings),
    r AS (SELECT h.*, i.label, row_number() OVER (ORDER BY h, image_id, tile_idx) - 1 AS pos, count(*) OVER () AS n FROM h JOIN fx_images i USING (image_id)),
    u AS (SELECT *, (('0x' || md5(h || 'u')[1:12])::BIGINT + 0.5::DOUBLE) / (1::BIGINT << 48) AS u, (('0x' || md5(h || 'v')[1:12])::BIGINT + 0.5::DOUBLE) / (1::BIGINT << 48) AS v FROM r),
    l AS (SELECT *, pow(u, 1.0::DOUBLE / 0.4::DOUBLE) AS p, cos(2 * pi() * v) AS c FROM u), m AS (SELECT *, (1 + c / sqrt(p / greatest(1 - p, pow(2.0::DOUBLE, -53)) + c * c)) / 2 AS lam FROM l)
    SELECT m.image_id, m.tile_idx, m.lam, m.e * m.lam + o.e * (1 - m.lam) AS first, array_to_string(list_transform(list_zip(m.label, o.label), lambda x: greatest(x[1], x[2])), '') AS label FROM m JOIN m o ON o.pos = (m.pos + 1) % m.n""")
def c10(spark, d):
    t = tiles(spark, d).join(images(spark, d).select("image_id", "label"), "image_id")
    m = S.mixup(t.withColumn("z", F.transform("z", lambda x: x.cast("double"))), 3, 0.4)
    return m.select("image_id", "tile_idx", "lam", F.element_at("z", 1).alias("first"), F.array_join("label", "").alias("label"))
