import base64
import hashlib
import io

import pytest

from faircart.llm import warc


def expect(rows):
    best = {}
    for p, _, h in rows:
        key = (h or "").encode()
        if p is not None:
            best[key] = max(p, best.get(key, p))
    out = []
    for p, _, h in rows:
        key = (h or "").encode()
        first = best.get(key, p)
        digest = base64.b32encode(hashlib.sha1(key).digest()).decode()
        out.append((p, "response" if p == first else "revisit", None if p == first else first, len(key), digest))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    rows = [(i, f"http://a/{i}\né", "<p>" + "text " * (i % 7) + "é</p>") for i in range(60)]
    rows += [(100, None, None), (101, "", ""), (None, "x", "only"), (None, "y", "<p>é</p>"), (5, "http://a/5", rows[5][2])]
    rows += [(102, "http://long", "long\r\n\r\n" * 100_000), (103, "u", "only here")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as payload", "2 as n")
    path = f"file://{tmp_path}/w"
    assert warc.write_archives(pages.repartition(3), path) == len(rows)
    back = warc.read_archives(spark, path).collect()
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in back), key=str)
    assert got == expect(rows)
    bodies = {r.payload_digest: bytes(r.payload) for r in back if r.record_type == "response"}
    assert set(bodies.values()) == {(h or "").encode() for _, _, h in rows}
    assert {r.url for r in back if r.page_id == 3} == {"http://a/3%0Aé"}


def test_query_and_empty(spark, sf_dir, tmp_path):
    got = warc.op3_warc(spark, sf_dir)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    seen = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got.collect()]
    assert sorted(seen, key=str) == expect(rows)
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op3_warc(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 3, 300])
def test_frames(n):
    records = [warc.build_record(i, "u", b"body %d" % i * 50, warc.base32_sha1(b"body %d" % i * 50), None, "d") for i in range(n)]
    out = io.BytesIO()
    assert warc.write_archive(iter(records), out) == n
    assert list(warc.read_frames(out.getvalue(), step=100) if n else []) == records


def test_archives_are_bounded(spark, tmp_path):
    rows = [(i, f"u{i}", hashlib.sha256(b"%d" % i).hexdigest() * 20) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    assert warc.write_archives(pages.coalesce(1), path, roll=4_000) == 400
    files = list((tmp_path / "w").glob("*.warc.zst"))
    assert len(files) > 3 and not list((tmp_path / "w").glob("_*"))
    back = warc.read_archives(spark, path)
    assert sorted(tuple(r) for r in back.select("page_id", "url").collect()) == [(i, f"u{i}") for i in range(400)]


def test_faults_are_found():
    body = b"hello"
    good = warc.build_record(1, "u", body, warc.base32_sha1(body), None, "d")
    assert warc.parse_record(good)["payload"] == body
    for bad in (
        good[:-1],
        good.replace(b"WARC/1.1", b"WARC/9"),
        good.replace(b"hello", b"hellO"),
        good.replace(b"WARC-Type", b"WARC-Tipe"),
        good.replace(b"Content-Length: 5\r\n\r\n", b"Content-Length: 6\r\n\r\n"),
        good + b"x",
    ):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    out = io.BytesIO()
    warc.write_archive(iter([good] * 20), out)
    for bad in (b"", out.getvalue()[8:], out.getvalue()[:-3]):
        with pytest.raises((ValueError, warc.zstandard.ZstdError)):
            list(warc.read_frames(bad))
