from faircart.operators import release

RECORD = "release string, file_split string, id string, version int, task string, split string, capture_id string, site_id string, page_id string, image_path string, prompt string, target string, metadata string"
GOOD = ("r", "train", "synthetic-1", 1, "extract-product", "train", "synthetic-7", "synthetic-shop-1", "synthetic-shop-1--page-2", "assets/synthetic-shop-1--page-2.png", "p", "t", "{}")


def changed(**values):
    names = [c.split()[0] for c in RECORD.split(", ")]
    return tuple(values.get(n, g) for n, g in zip(names, GOOD, strict=True))


def test_records(spark):
    cases = [
        (GOOD, []),
        (changed(version=2, task="rank", prompt="", target=None), ["version", "task", "prompt", "target"]),
        (changed(file_split="validation"), ["split", "site-not-in-split"]),
        (changed(page_id="synthetic-shop-11--page-2"), ["page-id"]),
        (changed(page_id="synthetic-shop-1--page-2\n", image_path="assets/../synthetic-shop-1--page-2.png"), ["page-id", "image-path"]),
        (changed(site_id=None), ["site-id"]),
        (changed(release="other"), ["capture-id", "site-not-in-split"]),
        (changed(prompt="see https://shop.example/x", target="a@b.example"), ["sensitive:URL", "sensitive:email address"]),
        ((None,) * 13, ["version", "task", "split", "id", "capture-id", "site-id", "page-id", "image-path", "prompt", "target", "metadata"]),
    ]
    rows = spark.createDataFrame([(*r, i) for i, (r, _) in enumerate(cases)], RECORD + ", `a.b` int")
    manifests = spark.createDataFrame([("r", 7)], "release string, seed int")
    domains = spark.createDataFrame([("r", "train", "synthetic-shop-1")] * 2, "release string, split string, site_id string")
    got = release.record_issues(rows, manifests, domains)
    assert got.columns == [*rows.columns, "issues"]
    assert {r["a.b"]: r.issues for r in got.collect()} == {i: want for i, (_, want) in enumerate(cases)}
    assert release.record_issues(rows.limit(0), manifests, domains).count() == 0


def test_manifests(spark):
    kind = tuple(release.KIND.values())
    manifests = [("good", *kind, 2, 1, 1, 2, 1, 1, 2, 2, 1, 1, 1), ("empty", *kind, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), ("bad", "x", None, kind[2], 1, 2, 1, 3, 1, 1, 2, 3, 1, 1, 2)]
    names = "release string, dataset_type string, target_format string, label_source string, generator_version int, train_domains int, validation_domains int, n_train int, n_validation int, n_discovery int, n_extraction int, products int, comparable int, abstained int, pages int"
    domains = [("good", "train", "synthetic-shop-1"), ("good", "validation", "synthetic-shop-2"), ("bad", "train", "synthetic-shop-1"), ("bad", "validation", "synthetic-shop-1"), ("bad", "validation", "shop.example")]
    assets = [("good", "assets/synthetic-shop-1--page-2.png", "0a" * 32), ("bad", "/etc/synthetic-shop-1--page-2.png", "0A" * 32)]
    rows = [("good", "train", "extract-product")] * 2 + [("good", "validation", "discover-products"), ("bad", "train", "extract-product")]
    got = release.manifest_issues(
        spark.createDataFrame(manifests, names),
        spark.createDataFrame(domains, "release string, split string, site_id string"),
        spark.createDataFrame(assets, "release string, path string, sha256 string"),
        spark.createDataFrame(rows, "release string, file_split string, task string"),
    )
    want = "dataset-type target-format generator-version alien-domain split-overlap domain-counts record-totals extraction-products outcome-products asset-pages asset-paths asset-digests split-records task-records"
    assert sorted((r.release, r.issue) for r in got.collect()) == sorted(("bad", x) for x in want.split())
