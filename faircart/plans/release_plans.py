"""Queries over releases of generated training data: a release a brand, a record a part."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import release
from .common import registry, table

QUERIES, ORACLE_SQL, query = registry()


def records(spark, sf_dir):
    """A record a part; about three in four have something that must not be published as it is, by key."""
    k, v = F.col("p_partkey"), F.col("p_partkey") % 13
    site = k % 40
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    site_id = F.when(v == 6, text("shop-", site)).when(v == 12, text("synthetic-shop-", (site + 5) % 40)).otherwise(text("synthetic-shop-", site))
    page_id = F.when(v == 7, text("synthetic-shop-", site + 1, "--page-", k)).otherwise(text(F.col("site_id"), "--page-", k))
    rows = table(spark, sf_dir, "part").withColumn("site_id", site_id).withColumn("page_id", page_id)
    file_split = F.when(site < 30, "train").otherwise("validation")
    return rows.select(
        F.col("p_brand").alias("release"),
        file_split.alias("file_split"),
        F.when(v == 4, text("real-", k)).otherwise(text("synthetic-", k)).alias("id"),
        F.when(v == 1, 2).otherwise(1).alias("version"),
        F.when(v == 2, "rank").when(k % 2 == 1, "extract-product").otherwise("discover-products").alias("task"),
        F.when(v == 3, "test").otherwise(file_split).alias("split"),
        F.when(v == 5, "synthetic-8").otherwise("synthetic-7").alias("capture_id"),
        "site_id",
        "page_id",
        F.when(v == 8, text("assets/../", F.col("page_id"), ".png")).otherwise(text("assets/", F.col("page_id"), ".png")).alias("image_path"),
        F.when(v == 9, "").when(v == 11, text(F.col("p_name"), " x", k, "@example.com")).otherwise(F.col("p_name")).alias("prompt"),
        F.when(v != 10, text("CARD n", site)).alias("target"),
        F.when(k % 17 != 0, F.col("p_type")).alias("metadata"),
        "p_partkey",
    )


def domains(spark, sf_dir):
    """The sites of each split; in brands that end with 3, site 3 is in both."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("release"), (F.col("p_partkey") % 40).alias("s")).distinct()
    both = (F.col("s") == 3) & F.col("release").endswith("3")
    splits = F.when(both, F.array(F.lit("train"), F.lit("validation"))).otherwise(F.array(F.when(F.col("s") < 30, "train").otherwise("validation")))
    return rows.select("release", F.explode(splits).alias("split"), F.concat(F.lit("synthetic-shop-"), "s").alias("site_id"))


@query(
    "release_records",
    """WITH p AS (SELECT *, p_partkey AS k, p_partkey % 13 AS v, p_partkey % 40 AS s FROM part),
    q AS (SELECT *, CASE WHEN s < 30 THEN 'train' ELSE 'validation' END AS fs, CASE v WHEN 6 THEN 'shop-' || s WHEN 12 THEN 'synthetic-shop-' || (s + 5) % 40 ELSE 'synthetic-shop-' || s END AS site FROM p),
    d AS (SELECT DISTINCT p_brand, 'synthetic-shop-' || p_partkey % 40 AS site, CASE WHEN p_partkey % 40 < 30 THEN 'train' ELSE 'validation' END AS fs FROM part
      UNION SELECT p_brand, 'synthetic-shop-3', 'validation' FROM part WHERE p_partkey % 40 = 3 AND p_brand LIKE '%3')
    SELECT k AS p_partkey, q.p_brand AS release, concat_ws(',',
      CASE WHEN v = 1 THEN 'version' END, CASE WHEN v = 2 THEN 'task' END, CASE WHEN v = 3 THEN 'split' END, CASE WHEN v = 4 THEN 'id' END, CASE WHEN v = 5 THEN 'capture-id' END,
      CASE WHEN v = 6 THEN 'site-id' END, CASE WHEN v IN (6, 7) THEN 'page-id' END, CASE WHEN v IN (6, 8) THEN 'image-path' END,
      CASE WHEN v = 6 OR (v = 12 AND d.p_brand IS NULL) THEN 'site-not-in-split' END,
      CASE WHEN v = 9 THEN 'prompt' END, CASE WHEN v = 10 THEN 'target' END, CASE WHEN k % 17 = 0 THEN 'metadata' END, CASE WHEN v = 11 THEN 'sensitive:email address' END) AS issues
    FROM q LEFT JOIN d ON d.p_brand = q.p_brand AND d.site = q.site AND d.fs = q.fs""",
)
def release_records(spark, sf_dir):
    """Why a record of a release may not be published."""
    manifests = records(spark, sf_dir).select("release", F.lit(7).alias("seed")).distinct()
    got = release.record_issues(records(spark, sf_dir), manifests, domains(spark, sf_dir))
    return got.select("p_partkey", "release", F.array_join("issues", ",").alias("issues"))


@query(
    "release_manifests",
    f"""WITH r AS ({ORACLE_SQL["release_records"]}), clean AS (SELECT DISTINCT release FROM r WHERE issues = ''),
    b AS (SELECT DISTINCT p_brand AS release, CAST(regexp_extract(p_brand, '[0-9]+$') AS INT) % 7 AS c FROM part),
    w(c, issue) AS (VALUES (0, 'dataset-type'), (1, 'generator-version'), (2, 'extraction-products'), (2, 'outcome-products'), (3, 'asset-pages'), (4, 'record-totals'), (4, 'split-records'), (5, 'asset-digests'), (6, 'domain-counts'))
    SELECT release, issue FROM b JOIN w USING (c) WHERE c <> 5 OR release IN (SELECT release FROM clean)
    UNION ALL SELECT DISTINCT p_brand, 'split-overlap' FROM part WHERE p_brand LIKE '%3' AND p_partkey % 40 = 3""",
)
def release_manifests(spark, sf_dir):
    """Manifests of the publishable records of each brand, most with one number or name that isn't so."""
    every = records(spark, sf_dir)
    sites = domains(spark, sf_dir)
    brands = every.select("release").distinct()
    kept = release.record_issues(every, brands.withColumn("seed", F.lit(7)), sites).where(F.size("issues") == 0)
    c = F.regexp_extract("release", "[0-9]+$", 0).cast("int") % 7
    count = lambda name, value: F.count_if(F.col(name) == value)
    n = kept.groupBy("release").agg(
        count("file_split", "train").alias("n_train"), count("file_split", "validation").alias("n_validation"), count("task", "discover-products").alias("n_discovery"), count("task", "extract-product").alias("n_extraction"), F.count("*").alias("pages")
    )
    s = sites.groupBy("release").agg(count("split", "train").alias("train_domains"), count("split", "validation").alias("validation_domains"))
    rows = brands.join(n, "release", "left").join(s, "release", "left").fillna(0)
    more = lambda name, at: (F.col(name) + F.when(c == at, 1).otherwise(0)).alias(name)
    manifests = rows.select(
        "release", F.when(c == 0, "collected").otherwise("synthetic-pretraining").alias("dataset_type"), F.lit("evidence-pointer").alias("target_format"), F.lit("deterministic-generator-and-evidence-validator").alias("label_source"),
        F.when(c == 1, 1).otherwise(2).alias("generator_version"), more("train_domains", 6), "validation_domains", more("n_train", 4), "n_validation", "n_discovery", "n_extraction",
        (F.col("n_extraction") + F.when(c == 2, 1).otherwise(0)).alias("products"), F.col("n_extraction").alias("comparable"), F.lit(0).alias("abstained"), more("pages", 3),
    )
    digest = F.sha2(F.col("page_id").cast("binary"), 256)
    assets = kept.select("release", F.col("image_path").alias("path"), F.when(c == 5, F.upper(F.concat(digest, F.lit("a")))).otherwise(digest).alias("sha256"))
    return release.manifest_issues(manifests, sites, assets, kept)
