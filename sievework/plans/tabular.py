"""Queries on photo lists, outliers, folds and metrics, over the driver's tables, and their SQL.

Photos are stood in for by vectors: id is vec_id, class is label, and a batch is four vectors of a
class in the order of their ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import feature_family, quarter_turns, upload_error
from ..operators import checks, folds, metrics, outliers, sampling
from ..operators.ranking import seeded, shuffled_rank
from ..schema import FAMILIES, MOISTURE_ORDER, ORIGINAL, TRANSFORMS, Settings
from ..sources.manifest import exclude, unknown_values

SETTINGS = Settings()
DIMS = 64
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None):
    """Registers a query and its SQL."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# --- photo lists -------------------------------------------------------------------------------


@query("manifest_domain_check", "SELECT DISTINCT o_orderstatus AS value FROM orders WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O')")
def manifest_domain_check(spark, d):
    return unknown_values(table(spark, d, "orders"), "o_orderstatus", ("F", "O")).select(F.col("o_orderstatus").alias("value"))


@query("exclusions_anti", "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def exclusions_anti(spark, d):
    low = table(spark, d, "labels").filter("quality = 0")
    return exclude(table(spark, d, "documents"), low, "doc_id")[0].select("doc_id", "lang", "source")


@query("exclusions_dropped", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def exclusions_dropped(spark, d):
    return exclude(table(spark, d, "documents"), table(spark, d, "labels").filter("quality = 0"), "doc_id")[1]


@query("exclusions_unknown", "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def exclusions_unknown(spark, d):
    return table(spark, d, "documents").select("doc_id").distinct().join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("batch_row_count", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) <> 4")
def batch_row_count(spark, d):
    return checks.batch_counts(table(spark, d, "lineitem"), "l_orderkey")


@query("batch_class_conflict", "SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS classes FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def batch_class_conflict(spark, d):
    return checks.class_conflicts(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag").withColumn("classes", F.array_join("classes", ","))


@query("batch_duplicate_id", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def batch_duplicate_id(spark, d):
    return checks.duplicate_ids(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("batch_issues", """
SELECT l_orderkey AS batch, 'row_count' AS reason, 'rows: ' || count(*) AS detail, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS rows FROM lineitem GROUP BY 1 HAVING count(*) <> 4
UNION ALL SELECT l_orderkey, 'class_conflict', 'classes: ' || array_to_string(list_sort(list(DISTINCT l_returnflag)), ', '), string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1
UNION ALL SELECT l_orderkey, 'duplicate_id', 'ids: ' || string_agg(l_linenumber::VARCHAR, ', ' ORDER BY l_linenumber::VARCHAR), string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1""")
def batch_issues(spark, d):
    return checks.batch_issues(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", "l_linenumber").select("batch", "reason", "detail", F.array_join("rows", ",").alias("rows"))


@query("class_batch_nunique", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
def class_batch_nunique(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("n"))


@query("value_counts", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def value_counts(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("counts_after_filter", "SELECT s.c_mktsegment, count(c.c_custkey) AS n FROM (SELECT DISTINCT c_mktsegment FROM customer) s LEFT JOIN customer c ON c.c_mktsegment = s.c_mktsegment AND c.c_acctbal > 9500 GROUP BY 1")
def counts_after_filter(spark, d):
    all_, left = table(spark, d, "customer"), table(spark, d, "customer").filter("c_acctbal > 9500")
    n = left.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return all_.select("c_mktsegment").distinct().join(n, "c_mktsegment", "left").select("c_mktsegment", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def _orders(spark, d):
    """A customer's orders of a class as a batch. The two lowest priorities are one class, which so has
    more batches than the others."""
    o = table(spark, d, "orders").withColumn("class", F.when(F.col("o_orderpriority") >= "4", "low").otherwise(F.col("o_orderpriority")))
    return o.select("o_orderkey", "class", F.concat_ws("-", "class", F.col("o_custkey").cast("string")).alias("batch_id"))


ORDERS = """
WITH o AS (SELECT o_orderkey, class, class || '-' || o_custkey AS batch_id FROM (SELECT *, CASE WHEN o_orderpriority >= '4' THEN 'low' ELSE o_orderpriority END AS class FROM orders)),
b AS (SELECT DISTINCT class, batch_id FROM o),
c AS (SELECT floor(min(n) / 0.9::DOUBLE + 1e-9) AS cap FROM (SELECT count(*) AS n FROM b GROUP BY class)),
r AS (SELECT class, batch_id, row_number() OVER (PARTITION BY class ORDER BY md5('42|' || batch_id), batch_id) > cap AS dropped FROM b, c)
"""


@query("balance_trim", ORDERS + "SELECT class, count(*) AS rows_kept, count(DISTINCT batch_id) AS batches_kept FROM o WHERE batch_id NOT IN (SELECT batch_id FROM r WHERE dropped) GROUP BY 1")
def balance_trim(spark, d):
    kept, _ = sampling.balance(_orders(spark, d), SETTINGS.min_grade_ratio, SETTINGS.balance_seed)
    return kept.groupBy("class").agg(F.count("*").alias("rows_kept"), F.count_distinct("batch_id").alias("batches_kept"))


@query("balance_dropped", ORDERS + "SELECT class, batch_id FROM r WHERE dropped")
def balance_dropped(spark, d):
    return sampling.balance(_orders(spark, d), SETTINGS.min_grade_ratio, SETTINGS.balance_seed)[1]


@query("first_rows", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 24")
def first_rows(spark, d):
    """The first rows by id, which is what the operator is for."""
    return table(spark, d, "documents").select("doc_id", "n_chars").orderBy("doc_id").limit(24)


@query("even_sample", """
WITH n AS (SELECT count(*) AS n FROM documents), k AS (SELECT range AS i FROM range(24)),
p AS (SELECT DISTINCT CASE WHEN n > 24 THEN floor(i * (n - 1) / 23.0::DOUBLE)::BIGINT ELSE i END AS place FROM k, n WHERE i < n)
SELECT doc_id, place FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents) JOIN p USING (place)""")
def even_sample(spark, d):
    """24 rows spread evenly over the order of ids: a sample by design."""
    docs = table(spark, d, "documents").select("doc_id")
    n = docs.count()
    places = sorted({int(i * (n - 1) / 23) if n > 24 else i for i in range(min(24, n))})
    return ordered_places(docs, "doc_id", places)


def ordered_places(df: DataFrame, key: str, places: list[int]) -> DataFrame:
    """The rows at the given places of the order of key. Ranges of keys are counted, and only those
    that hold a place are ordered."""
    from pyspark.sql import Window as W

    cuts = sorted(set(df.agg(F.percentile_approx(key, F.array(*[F.lit(i / 64) for i in range(1, 64)]), F.lit(2000)).alias("c")).first().c or []))
    rng = reduce(lambda a, c: a + (F.col(key) >= c).cast("int"), cuts, F.lit(0))
    ranged = df.withColumn("_r", rng)
    sizes = {r["_r"]: r.n for r in ranged.groupBy("_r").agg(F.count("*").alias("n")).collect()}
    begin, starts = 0, {}
    for r in sorted(sizes):
        starts[r], begin = begin, begin + sizes[r]
    needed = sorted({max(r for r in starts if starts[r] <= p) for p in places}) if places else []
    shift = F.create_map(*[F.lit(x) for r in needed for x in (r, starts[r])]) if needed else F.lit(None)
    rows = ranged.filter(F.col("_r").isin(needed)).withColumn("place", (F.row_number().over(W.partitionBy("_r").orderBy(key)) - 1 + (shift[F.col("_r")] if needed else 0)).cast("long"))
    return rows.filter(F.col("place").isin(places)).drop("_r")


@query("class_lookup", "SELECT n.n_nationkey, n.n_name, coalesce(r.r_name, '') AS description FROM nation n LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 3) r ON n.n_regionkey = r.r_regionkey")
def class_lookup(spark, d):
    dim = table(spark, d, "region").filter("r_regionkey <> 3")
    return table(spark, d, "nation").join(dim, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", F.coalesce("r_name", F.lit("")).alias("description"))


@query("label_set_ops", """
SELECT 'union' AS op, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'except', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'intersect', k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)""")
def label_set_ops(spark, d):
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    named = lambda op, df: df.select(F.lit(op).alias("op"), "k")
    return named("union", c.union(s).distinct()).union(named("except", c.subtract(s))).union(named("intersect", c.intersect(s)))


@query("upload_validation", """
SELECT doc_id, CASE WHEN strlen(text) = 0 THEN 'The file is empty.' WHEN strlen(text) > 26214400 THEN 'The file is larger than 25 MB.' ELSE 'The file is neither a JPEG nor a PNG image.' END AS error FROM documents
WHERE NOT (hex(encode(text)) LIKE 'FFD8FF%' OR hex(encode(text)) LIKE '89504E470D0A1A0A%')""")
def upload_validation(spark, d):
    raw = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("b"))
    return raw.select("doc_id", upload_error(F.octet_length("b"), F.col("b")).alias("error")).filter("error is not null")


NAMES = ("glcm_d1_a0_contrast", "glcm_d3_a135_entropy", "hsv_h_mean", "lab_b_std", "edge_density")


@query("feature_family", " UNION ALL ".join(f"SELECT '{n}' AS feature, '{next(v for k, v in FAMILIES.items() if n.startswith(k))}' AS family" for n in NAMES))
def feature_family_query(spark, d):
    return spark.createDataFrame([(n,) for n in NAMES], "feature string").select("feature", feature_family(F.col("feature")).alias("family"))


@query("transform_degrees", " UNION ALL ".join(f"SELECT '{t}' AS augment, {int(t.rpartition('rot')[2] or 0) if 'rot' in t else 0} AS degrees" for t in TRANSFORMS))
def transform_degrees(spark, d):
    return spark.createDataFrame([(t,) for t in TRANSFORMS], "augment string").select("augment", quarter_turns(F.col("augment")).alias("degrees"))


# --- outliers ----------------------------------------------------------------------------------


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("class"), *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(DIMS)])


VALUES = """
WITH v AS (SELECT vec_id, 'f' || i AS feature, embedding[i + 1]::DOUBLE AS value FROM embeddings, range(64) t(i)),
s AS (SELECT feature, avg(value) AS mean, stddev_pop(value) AS sd, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM v GROUP BY 1),
o AS (SELECT vec_id, feature, value, coalesce(abs((value - mean) / nullif(sd, 0)) > 3, false) OR coalesce(q3 > q1 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)), false) AS outlier FROM v JOIN s USING (feature))
"""
FEATURES = [f"f{i}" for i in range(DIMS)]


@query("outlier_values", VALUES + "SELECT vec_id, feature, value FROM o WHERE outlier")
def outlier_values(spark, d):
    return outliers.outlier_values(vectors(spark, d), ["vec_id"], FEATURES).filter("outlier").select("vec_id", "feature", "value")


@query("outlier_rows", """
WITH s AS (SELECT """ + ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS d{i}, quantile_cont({c}, 0.25) AS a{i}, quantile_cont({c}, 0.75) AS b{i}" for i, c in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax"))) + """ FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, s WHERE """ + " OR ".join(f"coalesce(abs(({c} - m{i}) / nullif(d{i}, 0)) > 1.7::DOUBLE, false) OR coalesce(b{i} > a{i} AND ({c} < a{i} - 1.5 * (b{i} - a{i}) OR {c} > b{i} + 1.5 * (b{i} - a{i})), false)" for i, c in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax"))))
def outlier_rows(spark, d):
    """Even values have nothing three deviations out; some of them are 1.7 out."""
    keys = ["l_orderkey", "l_linenumber", "l_extendedprice"]
    return outliers.outlier_rows(table(spark, d, "lineitem"), keys, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], zscore=1.7).filter("flagged").drop("flagged")


@query("outlier_flags", VALUES + "SELECT vec_id, string_agg(feature, ',' ORDER BY feature) AS features FROM o WHERE outlier GROUP BY 1")
def outlier_flags(spark, d):
    """The flags by column that come with removal, as the names of the columns that flag a photo."""
    _, flags = outliers.remove_outliers(vectors(spark, d), "vec_id", FEATURES)
    named = F.array_sort(F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in FEATURES])))
    return flags.select("vec_id", F.array_join(named, ",").alias("features")).filter("features <> ''")


@query("quartiles", "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS q2, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1")
def quartiles(spark, d):
    from ..operators.ranking import quantiles

    return quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"q1": 0.25, "q2": 0.5, "q3": 0.75})


@query("outlier_clean", VALUES + "SELECT label AS class, count(*) AS photos, count(*) FILTER (vec_id NOT IN (SELECT vec_id FROM o WHERE outlier)) * 8 AS rows_kept FROM (SELECT label::VARCHAR AS label, vec_id FROM embeddings) GROUP BY 1")
def outlier_clean(spark, d):
    """Photos by class, and the rows of all eight transforms that are left of them."""
    base = vectors(spark, d).withColumnRenamed("vec_id", "id")
    augmented = base.withColumn("augment", F.explode(F.array(*map(F.lit, TRANSFORMS))))
    kept, _ = outliers.remove_outlier_photos(augmented, SETTINGS)
    left = kept.groupBy("class").agg(F.count("*").alias("rows_kept"))
    return base.groupBy("class").agg(F.count("*").alias("photos")).join(left, "class", "left").select("class", "photos", F.coalesce("rows_kept", F.lit(0).cast("long")).alias("rows_kept"))


@query("outlier_hits_topk", VALUES + "SELECT feature, count(*) AS n FROM o WHERE outlier GROUP BY 1 ORDER BY n DESC, feature LIMIT 10")
def outlier_hits_topk(spark, d):
    return outliers.most_flagged(outliers.outlier_values(vectors(spark, d), ["vec_id"], FEATURES).filter("outlier"))


@query("mask_fraction_summary", "SELECT min(n_chars) AS low, quantile_cont(n_chars, 0.5) AS middle, max(n_chars) AS high FROM documents")
def mask_fraction_summary(spark, d):
    from ..operators.ranking import quantiles

    docs = table(spark, d, "documents")
    return quantiles(docs, [], "n_chars", {"middle": 0.5}).join(F.broadcast(docs.agg(F.min("n_chars").alias("low"), F.max("n_chars").alias("high"))))


@query("odd_masks", "SELECT doc_id, n_chars / 20000.0::DOUBLE AS fraction FROM documents WHERE n_chars / 20000.0::DOUBLE < 0.05 OR n_chars / 20000.0::DOUBLE > 0.5")
def odd_masks(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.col("n_chars") / F.lit(20000.0)).alias("fraction")).filter("fraction < 0.05D or fraction > 0.5D")


# --- folds -------------------------------------------------------------------------------------


def photos(spark, d) -> DataFrame:
    """Vectors as photos: batches of four of a class."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("class"))
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("class").orderBy("id")) - 1
    return v.withColumn("_p", place).select("id", "class", F.concat_ws("-", "class", F.expr("_p div 4").cast("string")).alias("batch_id"))


def augmented(spark, d) -> DataFrame:
    return photos(spark, d).withColumn("augment", F.explode(F.array(*map(F.lit, TRANSFORMS))))


PHOTOS = """
WITH p AS (SELECT vec_id AS id, label::VARCHAR AS class, label || '-' || ((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 4) AS batch_id FROM embeddings),
g AS (SELECT DISTINCT class, batch_id FROM p),
c AS (SELECT class, sum(n) OVER (ORDER BY class) - n AS start FROM (SELECT class, count(*) AS n FROM g GROUP BY 1)),
f AS (SELECT class, batch_id, ((row_number() OVER (PARTITION BY class ORDER BY md5('42|' || batch_id), batch_id) - 1 + start) % 5)::INT AS fold FROM g JOIN c USING (class)),
pf AS (SELECT p.*, fold FROM p JOIN f USING (class, batch_id)),
a AS (SELECT pf.*, augment FROM pf, (SELECT unnest(['""" + "', '".join(TRANSFORMS) + """']) AS augment)),
k AS (SELECT range::INT AS train_fold FROM range(5)),
tn AS (SELECT train_fold, class, count(*) AS n FROM pf, k WHERE fold <> train_fold GROUP BY 1, 2),
m AS (SELECT *, least(4, greatest(1, round_even(2.0 * max(n) OVER (PARTITION BY train_fold) / greatest(n, 1), 0)::INT - 1)) AS copies FROM tn)
"""


@query("stratified_group_folds", PHOTOS + "SELECT class, batch_id, fold FROM f")
def stratified_group_folds(spark, d):
    return folds.group_folds(photos(spark, d), SETTINGS.n_splits)


@query("class_multipliers", PHOTOS + "SELECT train_fold, class, n, copies FROM m")
def class_multipliers(spark, d):
    folded = folds.with_folds(augmented(spark, d), SETTINGS).filter(F.col("augment") == ORIGINAL)
    parts = folded.withColumn("train_fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).filter("fold <> train_fold")
    return sampling.class_multipliers(parts, ["train_fold"], SETTINGS.base_copies, SETTINGS.max_copies)


@query("fold_train_rows", PHOTOS + """, t AS (
SELECT a.id, a.class, train_fold, augment, copies, row_number() OVER (PARTITION BY train_fold, a.id ORDER BY CASE WHEN augment = 'rot0' THEN 0 ELSE 1 END, md5((42 + train_fold) || '|' || a.id || '|' || augment), augment) - 1 AS place
FROM a, k JOIN m USING (train_fold) WHERE fold <> train_fold AND m.class = a.class)
SELECT train_fold, id, class, augment FROM t WHERE place <= copies""")
def fold_train_rows(spark, d):
    return folds.train_rows(folds.with_folds(augmented(spark, d), SETTINGS), SETTINGS).select("train_fold", "id", "class", "augment")


@query("fold_val_originals", PHOTOS + "SELECT id, class, fold FROM a WHERE augment = 'rot0'")
def fold_val_originals(spark, d):
    return folds.validation_rows(folds.with_folds(augmented(spark, d), SETTINGS)).select("id", "class", "fold")


@query("full_training_rows", PHOTOS + """, n AS (SELECT class, count(*) AS n FROM p GROUP BY 1),
w AS (SELECT class, least(4, greatest(1, round_even(2.0 * max(n) OVER () / greatest(n, 1), 0)::INT - 1)) AS copies FROM n),
t AS (SELECT id, class, augment, copies, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN augment = 'rot0' THEN 0 ELSE 1 END, md5('42|' || id || '|' || augment), augment) - 1 AS place FROM a JOIN w USING (class))
SELECT id, class, augment FROM t WHERE place <= copies""")
def full_training_rows(spark, d):
    return folds.full_training_rows(augmented(spark, d), SETTINGS).select("id", "class", "augment")


# --- metrics -----------------------------------------------------------------------------------


def predictions(spark, d) -> DataFrame:
    """Two predictors of a vector's label, by the largest of its first or second ten values."""
    best = lambda lo: F.expr(f"cast(array_position(slice(embedding, {lo}, 10), array_max(slice(embedding, {lo}, 10))) - 1 as string)")
    v = table(spark, d, "embeddings").join(F.broadcast(folds.group_folds(photos(spark, d), 5).select("batch_id", "fold")).join(photos(spark, d).select(F.col("id").alias("vec_id"), "batch_id"), "batch_id").select("vec_id", "fold"), "vec_id")
    two = F.explode(F.array(F.struct(F.lit("random_forest").alias("model"), best(1).alias("predicted")), F.struct(F.lit("logistic_regression").alias("model"), best(11).alias("predicted")), F.struct(F.lit("lightgbm").alias("model"), best(21).alias("predicted"))))
    return v.select("vec_id", "fold", F.col("label").cast("string").alias("class"), two.alias("t")).select("vec_id", "fold", "class", "t.*")


PREDICTED = PHOTOS + """, y AS (
SELECT id AS vec_id, fold, class, t.model, (list_position(e[t.lo:t.lo + 9], list_max(e[t.lo:t.lo + 9])) - 1)::VARCHAR AS predicted
FROM pf JOIN (SELECT vec_id AS id, embedding::FLOAT[] AS e FROM embeddings) USING (id), (VALUES ('random_forest', 1), ('logistic_regression', 11), ('lightgbm', 21)) t(model, lo)),
ct AS (SELECT model, fold, class AS l, predicted AS p, count(*) AS n FROM y GROUP BY ALL),
cm AS (
SELECT model, fold, l AS class, sum(tp)::BIGINT AS tp, sum(s)::BIGINT AS support, sum(k)::BIGINT AS called FROM (
  SELECT model, fold, l, CASE WHEN l = p THEN n ELSE 0 END AS tp, n AS s, 0 AS k FROM ct UNION ALL SELECT model, fold, p, 0, 0, n FROM ct) GROUP BY ALL),
pr AS (SELECT *, coalesce(tp::DOUBLE / nullif(called, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS recall, coalesce(2.0::DOUBLE * tp / nullif(support + called, 0), 0) AS f1 FROM cm),
sc AS (SELECT model, fold, avg(f1) AS macro_f1 FROM pr GROUP BY ALL)
"""
LABELED = "SELECT quality::VARCHAR AS class, toxic::VARCHAR AS predicted FROM labels"


@query("confusion_matrix", f"WITH y AS ({LABELED}), l AS (SELECT class AS l FROM y UNION SELECT predicted FROM y) SELECT a.l AS true, b.l AS pred, count(y.class) AS n FROM l a CROSS JOIN l b LEFT JOIN y ON y.class = a.l AND y.predicted = b.l GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return metrics.confusion_cells(table(spark, d, "labels").select(F.col("quality").cast("string").alias("class"), F.col("toxic").cast("string").alias("predicted")))


@query("accuracy", PREDICTED + "SELECT model, avg((class = predicted)::INT::DOUBLE) AS accuracy FROM y GROUP BY 1")
def accuracy(spark, d):
    return metrics.accuracy(predictions(spark, d), ["model"])


@query("per_class_prf", PREDICTED + "SELECT model, class, tp, support, called, tp::DOUBLE / greatest(called, 1) AS precision, tp::DOUBLE / greatest(support, 1) AS recall, 2.0::DOUBLE * tp / (support + called) AS f1 FROM (SELECT model, class, sum(tp)::BIGINT AS tp, sum(support)::BIGINT AS support, sum(called)::BIGINT AS called FROM cm GROUP BY ALL)")
def per_class_prf(spark, d):
    return metrics.class_metrics(predictions(spark, d), ["model"])


@query("macro_f1", PREDICTED + "SELECT model, fold, round(macro_f1, 9) AS macro_f1 FROM sc")
def macro_f1(spark, d):
    return metrics.macro_f1(predictions(spark, d), ["model", "fold"]).withColumn("macro_f1", F.round("macro_f1", 9))


@query("per_fold_class_metrics", PREDICTED + "SELECT model, fold, class, precision, recall FROM pr WHERE support > 0")
def per_fold_class_metrics(spark, d):
    return metrics.per_fold_class_metrics(predictions(spark, d), ["model", "fold"])


@query("class_mean_metrics", PREDICTED + "SELECT model, class, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall FROM pr WHERE support > 0 GROUP BY ALL")
def class_mean_metrics(spark, d):
    each = metrics.per_fold_class_metrics(predictions(spark, d), ["model", "fold"])
    return each.groupBy("model", "class").agg(F.round(F.avg("precision"), 9).alias("precision"), F.round(F.avg("recall"), 9).alias("recall"))


@query("score_mean_std", PREDICTED + "SELECT model, round(avg(macro_f1), 9) AS mean, round(stddev_samp(macro_f1), 9) AS sd FROM sc GROUP BY 1")
def score_mean_std(spark, d):
    s = metrics.score_summary(metrics.macro_f1(predictions(spark, d), ["model", "fold"]))
    return s.select("model", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"))


@query("select_best_model", PREDICTED + "SELECT model AS selected, round(mean, 9) AS mean FROM (SELECT model, avg(macro_f1) AS mean FROM sc WHERE model <> 'logistic_regression' GROUP BY 1) ORDER BY mean DESC LIMIT 1")
def select_best_model(spark, d):
    return metrics.best_model(metrics.macro_f1(predictions(spark, d), ["model", "fold"])).withColumn("mean", F.round("mean", 9))


@query("pass_marks", PREDICTED + """, s AS (SELECT avg(macro_f1) AS mean, stddev_samp(macro_f1) AS sd FROM sc WHERE model = 'random_forest'),
cl AS (SELECT class, avg(precision) AS precision, avg(recall) AS recall FROM pr WHERE model = 'random_forest' AND support > 0 GROUP BY 1),
w AS (SELECT * FROM cl ORDER BY recall, class LIMIT 1), b AS (SELECT avg(macro_f1) AS base FROM sc WHERE model = 'logistic_regression'),
x AS (SELECT 'macro_f1' AS "check", mean AS v, 0.75::DOUBLE AS target, mean >= 0.75 AS passed FROM s
UNION ALL SELECT 'min_class_recall', recall, 0.6, recall >= 0.6 FROM w
UNION ALL SELECT 'class_1_precision', precision, 0.85, precision >= 0.85 FROM cl WHERE class = '1'
UNION ALL SELECT 'beats_baseline', mean - base, sd, mean - base > sd FROM s, b)
SELECT "check", round_even(v, 4) AS value, round(target, 9) AS target, passed FROM x""")
def pass_marks(spark, d):
    y = predictions(spark, d)
    found = metrics.pass_marks(y, metrics.macro_f1(y, ["model", "fold"]), "random_forest", {**SETTINGS.marks, "precision_class": "1"})
    return found.select("check", "value", F.round("target", 9).alias("target"), "passed")


@query("class_weights", "WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT vec_id, label, (SELECT sum(n) FROM n)::DOUBLE / ((SELECT count(*) FROM n) * n.n) AS weight FROM embeddings JOIN n USING (label)")
def class_weights(spark, d):
    return metrics.class_weights(table(spark, d, "embeddings"), "label").select("vec_id", "label", "weight")


@query("union_oof", PREDICTED + "SELECT model, vec_id, predicted FROM y WHERE model <> 'lightgbm'")
def union_oof(spark, d):
    y = predictions(spark, d).select("model", "vec_id", "predicted")
    return y.filter("model = 'random_forest'").unionByName(y.filter("model = 'logistic_regression'"))


@query("moisture_order", " UNION ALL ".join(f"SELECT '{c}' AS class, {i} AS moisture_rank" for i, c in enumerate(MOISTURE_ORDER, 1)))
def moisture_order(spark, d):
    return spark.createDataFrame([(c,) for c in sorted(MOISTURE_ORDER)], "class string").select("class", metrics.moisture_rank("class").cast("int").alias("moisture_rank"))


@query("family_shares", "WITH v AS (SELECT label, (i // 16)::INT AS family, sum(embedding[i + 1]::DOUBLE) AS value FROM embeddings, range(64) t(i) GROUP BY ALL) SELECT label, family, round(coalesce(abs(value) / nullif(sum(abs(value)) OVER (PARTITION BY label), 0), 0), 9) AS share FROM v")
def family_shares(spark, d):
    v = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", F.expr("cast(i div 16 as int)").alias("family")).agg(F.sum(F.col("x").cast("double")).alias("value"))
    return metrics.family_shares(v, ["label"]).select("label", "family", F.round("share", 9).alias("share"))


@query("seeded_ranks", "SELECT l_returnflag, count(*) AS n, sum(rank * l_linenumber)::BIGINT AS digest FROM (SELECT l_returnflag, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5('7|' || l_orderkey || '|' || l_linenumber), l_orderkey, l_linenumber) AS rank FROM lineitem) GROUP BY 1")
def seeded_ranks(spark, d):
    """The shuffled order that all seeded choices use, of classes that hold most rows."""
    ranked = shuffled_rank(table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber"), ["l_returnflag"], seeded(7, "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])
    return ranked.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(F.col("rank") * F.col("l_linenumber")).alias("digest"))


@query("pooled_and_fold_f1", PREDICTED + """, po AS (SELECT model, avg(f1) AS pooled FROM (SELECT model, class, 2.0::DOUBLE * sum(tp) / (sum(support) + sum(called)) AS f1 FROM cm GROUP BY ALL) GROUP BY 1)
SELECT model, round(pooled, 9) AS pooled, round(avg(macro_f1), 9) AS mean_of_folds FROM sc JOIN po USING (model) GROUP BY model, pooled""")
def pooled_and_fold_f1(spark, d):
    """Macro F1 of all predictions together, and the mean of the folds': kept apart."""
    y = predictions(spark, d)
    pooled = metrics.macro_f1(y, ["model"]).select("model", F.round("macro_f1", 9).alias("pooled"))
    means = metrics.score_summary(metrics.macro_f1(y, ["model", "fold"])).select("model", F.round("mean", 9).alias("mean_of_folds"))
    return pooled.join(means, "model")


@query("training_semi_join", PHOTOS + "SELECT id, augment FROM a WHERE id IN (SELECT id FROM pf WHERE fold <> 0)")
def training_semi_join(spark, d):
    """All transforms of the photos that fold 0 trains on."""
    folded = folds.with_folds(augmented(spark, d), SETTINGS)
    ids = folded.filter((F.col("augment") == ORIGINAL) & (F.col("fold") != 0)).select("id")
    return augmented(spark, d).join(ids, "id", "left_semi").select("id", "augment")


@query("class_feature_means", "SELECT label AS class, " + ", ".join(f"round(avg(embedding[{i}]::DOUBLE), 9) AS m{i}" for i in range(1, DIMS + 1)) + " FROM embeddings GROUP BY 1")
def class_feature_means(spark, d):
    return table(spark, d, "embeddings").groupBy(F.col("label").alias("class")).agg(*[F.round(F.avg(F.col("embedding")[i - 1].cast("double")), 9).alias(f"m{i}") for i in range(1, DIMS + 1)])


@query("leak_flag", PREDICTED + "SELECT model, avg((class = predicted)::INT::DOUBLE) > 0.25 AS leak FROM y GROUP BY 1")
def leak_flag(spark, d):
    return metrics.accuracy(predictions(spark, d), ["model"]).select("model", (F.col("accuracy") > SETTINGS.leak_accuracy).alias("leak"))
