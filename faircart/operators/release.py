"""Releases of generated training data: whether manifests agree with themselves and their tables, and which records may not go out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.privacy import sensitive_labels

# What a release of generated data is called and how its names are built.
KIND = {"dataset_type": "synthetic-pretraining", "target_format": "evidence-pointer", "label_source": "deterministic-generator-and-evidence-validator"}
GENERATOR_VERSION = 2
TASKS = ("discover-products", "extract-product")
SITE = r"\Asynthetic-shop-[0-9]+\z"
PAGE = r"\Asynthetic-shop-[0-9]+--page-[0-9]+\z"
ASSET = r"\Aassets/synthetic-shop-[0-9]+--page-[0-9]+\.png\z"
DIGEST = r"\A[a-f0-9]{64}\z"


def missed(rules: dict[str, Column]) -> Column:
    """The names of the rules that don't hold, in order; a rule that is null doesn't hold."""
    return F.array_compact(F.array(*(F.when(F.coalesce(ok, F.lit(False)), None).otherwise(F.lit(name)) for name, ok in rules.items())))


def told(c: str) -> Column:
    """Whether a text is there and not empty."""
    return F.length(c) > 0


def record_issues(records: DataFrame, manifests: DataFrame, domains: DataFrame) -> DataFrame:
    """``records`` and ``issues``, an array of names of what keeps each record from being published.

    ``records(release, file_split, id, version, task, split, capture_id, site_id, page_id, image_path, prompt, target, metadata)``
    stand in the file of ``file_split``; ``manifests(release, seed)`` has one row a release, ``domains(release, split, site_id)`` the
    sites that each split may use. A record of an unknown release matches no run and no site. Sensitive text is named by its label.
    """
    sites = domains.select("release", F.col("split").alias("file_split"), "site_id", F.lit(True).alias("assigned")).distinct()
    rows = records.join(manifests.select("release", "seed"), "release", "left").join(sites, ["release", "file_split", "site_id"], "left")
    rules = {
        "version": F.col("version") == 1,
        "task": F.col("task").isin(*TASKS),
        "split": F.col("split") == F.col("file_split"),
        "id": F.col("id").startswith("synthetic-"),
        "capture-id": F.col("capture_id") == F.concat(F.lit("synthetic-"), F.col("seed").cast("string")),
        "site-id": F.col("site_id").rlike(SITE),
        "page-id": F.col("page_id").rlike(PAGE) & F.col("page_id").startswith(F.concat(F.coalesce("site_id", F.lit("")), F.when(told("site_id"), "--").otherwise(""))),
        "image-path": F.col("image_path").rlike(ASSET),
        "site-not-in-split": F.col("site_id").isNull() | F.col("assigned"),
        "prompt": told("prompt"),
        "target": told("target"),
        "metadata": F.col("metadata").isNotNull(),
    }
    sensitive = F.flatten(F.array(*(sensitive_labels(F.coalesce(c, F.lit(""))) for c in ("id", "prompt", "target"))))
    sensitive = F.transform(F.array_sort(F.array_distinct(sensitive)), lambda x: F.concat(F.lit("sensitive:"), x))
    return rows.select(*(F.col(f"`{c}`") for c in records.columns), F.concat(missed(rules), sensitive).alias("issues"))


def manifest_issues(manifests: DataFrame, domains: DataFrame, assets: DataFrame, records: DataFrame) -> DataFrame:
    """``(release, issue)``: what a manifest says that isn't so, by its own numbers or by its tables.

    ``manifests`` has one row a release: the names of ``KIND``, ``generator_version``, ``train_domains``, ``validation_domains``, ``n_train``,
    ``n_validation``, ``n_discovery``, ``n_extraction``, ``products``, ``comparable``, ``abstained``, ``pages``.
    ``domains(release, split, site_id)``, ``assets(release, path, sha256)`` and ``records(release, file_split, task)`` are counted
    before they meet it, so a join has one row a release on both sides.
    """

    def n(condition: Column) -> Column:
        return F.count_if(F.coalesce(condition, F.lit(False)))

    def none(c: Column) -> Column:
        return F.coalesce(c, F.lit(0)) == 0

    site = domains.groupBy("release", "site_id").agg(n(F.col("split") == "train").alias("t"), n(F.col("split") == "validation").alias("v"))
    alien = n(~F.coalesce(F.col("site_id").rlike(SITE), F.lit(False)))
    site = site.groupBy("release").agg(F.sum("t").alias("t"), F.sum("v").alias("v"), n((F.col("t") > 0) & (F.col("v") > 0)).alias("both"), alien.alias("alien"))
    path, digest = (~F.coalesce(F.col(c).rlike(p), F.lit(False)) for c, p in (("path", ASSET), ("sha256", DIGEST)))
    asset = assets.groupBy("release").agg(F.count("*").alias("files"), n(path).alias("paths"), n(digest).alias("digests"))
    split, task = F.col("file_split"), F.col("task")
    record = records.groupBy("release").agg(
        n(split == "train").alias("in_train"), n(split == "validation").alias("in_validation"), n(task == TASKS[0]).alias("of_discovery"), n(task == TASKS[1]).alias("of_extraction")
    )
    rows = manifests.join(site, "release", "left").join(asset, "release", "left").join(record, "release", "left")

    def same(declared: str, counted: str) -> Column:
        return F.col(declared) == F.coalesce(F.col(counted), F.lit(0))

    rules = {name.replace("_", "-"): F.col(name) == value for name, value in KIND.items()}
    rules |= {
        "generator-version": F.col("generator_version") >= GENERATOR_VERSION,
        "alien-domain": none(F.col("alien")),
        "split-overlap": none(F.col("both")),
        "domain-counts": same("train_domains", "t") & same("validation_domains", "v"),
        "record-totals": F.col("n_train") + F.col("n_validation") == F.col("n_discovery") + F.col("n_extraction"),
        "extraction-products": F.col("n_extraction") == F.col("products"),
        "outcome-products": F.col("comparable") + F.col("abstained") == F.col("products"),
        "asset-pages": same("pages", "files"),
        "asset-paths": none(F.col("paths")),
        "asset-digests": none(F.col("digests")),
        "split-records": same("n_train", "in_train") & same("n_validation", "in_validation"),
        "task-records": same("n_discovery", "of_discovery") & same("n_extraction", "of_extraction"),
    }
    return rows.select("release", F.explode(missed(rules)).alias("issue"))
