"""Corpus audits over the driver's tables: documents stand for images (text: bytes and caption, doc_id % 3: split,
lang: generator), parts for sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .._registered import query
from ..operators import audit, stats
from ..sources import corpus
from .features import rounded

_DOCS = "d AS (SELECT x.*, (x.doc_id % 3)::INT AS split, l.quality, l.toxic FROM documents x LEFT JOIN labels l USING (doc_id))"


def docs(spark, sf_dir):
    d, lab = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return d.join(lab, "doc_id", "left").withColumn("split", (F.col("doc_id") % 3).cast("int"))


def sizes(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", F.col("p_size").alias("w"), (F.col("p_partkey") % 50 + 1).cast("int").alias("h"), (F.col("p_partkey") % 6).cast("int").alias("generator"))


_SIZES = "s AS (SELECT p_partkey, p_size AS w, (p_partkey % 50 + 1)::INT AS h, (p_partkey % 6)::INT AS generator FROM part)"


@query(f"""WITH {_DOCS}, g AS (SELECT grouping(split) AS gs, grouping(quality) AS ga, grouping(toxic) AS gb, split, quality, toxic, count(*) AS n FROM d GROUP BY GROUPING SETS ((split), (quality), (toxic), (quality, toxic), ()))
SELECT CASE WHEN gs = 0 THEN 'split' WHEN ga = 0 AND gb = 0 THEN 'label_pair' WHEN ga = 0 THEN 'label_a' WHEN gb = 0 THEN 'label_b' ELSE 'all' END AS level, split::VARCHAR AS split, quality::VARCHAR AS a, toxic::VARCHAR AS b, n FROM g""")
def label_accounting(spark, sf_dir):
    return audit.label_accounting(docs(spark, sf_dir), "split", "quality", "toxic")


@query(f"WITH {_DOCS} SELECT 'text' AS \"column\", count(*) FILTER (WHERE text IS NULL) AS nulls FROM d UNION ALL SELECT 'quality', count(*) FILTER (WHERE quality IS NULL) FROM d UNION ALL SELECT 'lang', count(*) FILTER (WHERE lang IS NULL) FROM d")
def null_accounting(spark, sf_dir):
    return audit.null_counts(docs(spark, sf_dir).select("text", "quality", "lang"))


@query(f"WITH {_DOCS} SELECT split, " + ", ".join(f"count(*) FILTER (WHERE lang = '{v}') AS n_{v}" for v in ("de", "en", "es", "fr")) + ", count(*) AS total FROM d GROUP BY split")
def split_generator_matrix(spark, sf_dir):
    return audit.cross_table(docs(spark, sf_dir), "split", "lang", ["de", "en", "es", "fr"])


@query("SELECT label, n::INT AS n, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE n <= 12")
def first_n_per_label(spark, sf_dir):
    return audit.first_per_group(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", "vec_id"), "label", ["vec_id"], 12).select("label", "n", "vec_id")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % (SELECT greatest(1, ceil(count(*) / 100.0))::BIGINT FROM embeddings) = 0")
def systematic_sample(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label")
    return audit.systematic_sample(e, "vec_id", e.count(), 100)


_GROUPS = """g AS (SELECT sha256(text) AS digest, count(*) AS n, bool_or(split = 0) AS in_0, bool_or(split = 1) AS in_1, bool_or(split = 2) AS in_2, min(quality) <> max(quality) AS cross_label, min(lang) <> max(lang) AS cross_generator FROM d GROUP BY 1 HAVING count(*) > 1)"""


def _groups(spark, sf_dir):
    d = docs(spark, sf_dir)
    return audit.duplicate_groups(d, F.sha2(F.col("text").cast("binary"), 256), F.col("split"), F.col("quality"), F.col("lang"))


@query(f"WITH {_DOCS}, {_GROUPS} SELECT * FROM g")
def duplicate_groups(spark, sf_dir):
    return _groups(spark, sf_dir)


@query(f"""WITH {_DOCS}, {_GROUPS} SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS rows_in_groups, count(*) FILTER (WHERE in_0 AND in_1) AS cross_01, count(*) FILTER (WHERE in_0 AND in_2) AS cross_02,
 count(*) FILTER (WHERE in_1 AND in_2) AS cross_12, count(*) FILTER (WHERE cross_label) AS cross_label, count(*) FILTER (WHERE cross_generator) AS cross_generator FROM g""")
def duplicate_summary(spark, sf_dir):
    return audit.duplicate_summary(_groups(spark, sf_dir))


_DIST = "count(v) AS n, round(min(v)::DOUBLE, 4) AS low, round(max(v)::DOUBLE, 4) AS high, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS p75, round(quantile_cont(v, 0.95), 4) AS p95"


@query(f"SELECT l_returnflag, {_DIST} FROM (SELECT l_returnflag, l_extendedprice::DOUBLE AS v FROM lineitem) GROUP BY 1")
def distribution_stats(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return stats.distribution(d, ["l_returnflag"], F.col("l_extendedprice").cast("double"))


@query(f"WITH {_SIZES} SELECT generator, {_DIST} FROM (SELECT generator, w / h::DOUBLE AS v FROM s) GROUP BY 1")
def geometry_by_group(spark, sf_dir):
    return stats.distribution(sizes(spark, sf_dir), ["generator"], F.col("w") / F.col("h").cast("double"))


@query(f"WITH {_SIZES} SELECT generator, CASE WHEN abs(w / h::DOUBLE - 1) < 0.001 THEN 'square' WHEN w / h::DOUBLE > 1.001 THEN 'landscape' ELSE 'portrait' END AS aspect, count(*) AS n FROM s GROUP BY ALL")
def aspect_categories(spark, sf_dir):
    return sizes(spark, sf_dir).groupBy("generator", audit.aspect_category(F.col("w"), F.col("h")).alias("aspect")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_SIZES} SELECT w, h, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM s)::DOUBLE, 4) AS pct FROM s GROUP BY w, h ORDER BY n DESC, w, h LIMIT 10")
def top_resolutions(spark, sf_dir):
    s = sizes(spark, sf_dir)
    return s.groupBy("w", "h").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w", "h").limit(10).withColumn("pct", F.round(100.0 * F.col("n") / s.count(), 4))


@query(f"WITH {_SIZES} SELECT p_partkey, w, h, least(w, h) AS side, floor((w - least(w, h)) / 2.0)::INT AS \"left\", floor((h - least(w, h)) / 2.0)::INT AS top FROM s")
def crop_geometry(spark, sf_dir):
    return sizes(spark, sf_dir).select("p_partkey", "w", "h", *audit.crop_box(F.col("w"), F.col("h")))


#: JPEG headers made of each page: two quantisation tables of one value each (ids 0 and 1), then the frame.
_TABLE = "'(' || array_to_string(list_transform(range(64), lambda i: ({v})::INT), ', ') || ')'"


@query(f"""SELECT page_id, 'T0:' || substr(md5({_TABLE.format(v="page_id % 251 + 1")}), 1, 8) || ';T1:' || substr(md5({_TABLE.format(v="octet_length(encode(html)) % 97 + 1")}), 1, 8) AS signature,
 161::BIGINT AS bytes, (page_id % 4000 + 1)::INT AS width, (octet_length(encode(html)) % 3000 + 1)::INT AS height, 3::INT AS components, NULL::VARCHAR AS error FROM pages""")
def encoding_signature(spark, sf_dir):
    size = F.octet_length("html").cast("long")

    def byte(c, n=1):
        return F.lpad(F.hex(c), 2 * n, "0")

    tables = [F.concat(F.lit(f"FFDB00430{i}"), F.repeat(byte(v), F.lit(64))) for i, v in enumerate((F.col("page_id") % 251 + 1, size % 97 + 1))]
    frame = F.concat(F.lit("FFC0001108"), byte(size % 3000 + 1, 2), byte(F.col("page_id") % 4000 + 1, 2), F.lit("03012200021101031101"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.unhex(F.concat(F.lit("FFD8"), *tables, frame, F.lit("FFD9"))).alias("data"))
    h = corpus.image_headers(pages, "page_id", "data")
    return h.select("page_id", audit.signature(F.col("tables"), F.col("table_ids")).alias("signature"), "bytes", "width", "height", "components", "error")


@query(f"WITH {_DOCS} SELECT trim(text) AS caption, count(*) AS n, min(quality) <> max(quality) AS cross_label, min(lang) <> max(lang) AS cross_generator FROM d GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, caption LIMIT 50")
def caption_duplicates(spark, sf_dir):
    g = audit.caption_groups(docs(spark, sf_dir), F.trim("text"), F.col("quality"), F.col("lang"))
    return g.orderBy(F.desc("n"), "caption").limit(50)


@query(f"WITH {_DOCS}, m AS (SELECT trim(text) AS k, bit_or(1 << split)::INT AS mask FROM d WHERE text IS NOT NULL GROUP BY 1) SELECT mask, count(*) AS n FROM m GROUP BY 1")
def caption_set_overlap(spark, sf_dir):
    return audit.set_overlap(docs(spark, sf_dir), F.trim("text"), F.col("split"))


@query("""SELECT 'quality_domain' AS rule, count(*) FILTER (WHERE NOT coalesce(quality IN (0, 1), false)) AS n FROM labels UNION ALL SELECT 'toxic_domain', count(*) FILTER (WHERE NOT coalesce(toxic IN (0, 1), false)) FROM labels
UNION ALL SELECT 'good_is_not_toxic', count(*) FILTER (WHERE NOT coalesce(quality = 0 OR toxic = 0, false)) FROM labels""")
def rule_violations(spark, sf_dir):
    rules = {"quality_domain": F.col("quality").isin(0, 1), "toxic_domain": F.col("toxic").isin(0, 1), "good_is_not_toxic": (F.col("quality") == 0) | (F.col("toxic") == 0)}
    return audit.violations(spark.read.parquet(f"{sf_dir}/labels.parquet"), rules)
