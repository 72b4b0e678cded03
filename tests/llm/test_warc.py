import hashlib
import base64

import pytest

from tidemark.llm import warc as w


def test_chunks():
    for n in (0, 1, 4096, 4097, 9999):
        data = bytes(i % 251 for i in range(n))
        assert w.dechunked(w.chunked(data)) == data
    assert w.dechunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: y\r\n\r\n") == b"abc"
    for bad in (b"", b"3\r\nabcd\r\n0\r\n\r\n", b"3\r\nabc\r\n", b"zz\r\n", b"0\r\nx"):
        with pytest.raises(ValueError):
            w.dechunked(bad)


def test_segments():
    parts = [(r[0], f.get("warc-segment-total-length"), b) for r in w.response(1, "u", b"x" * 5000, 700) for f, b in w.records(r[1])]
    assert len(parts) == 8 and [p[1] is None for p in parts] == [True] * 7 + [False]
    own = [(n, int(t) if t else None, b) for n, t, b in parts]
    assert w.payload_of(w.joined(own[::-1])) == b"x" * 5000
    for bad in (own[:-1], own[1:], own + own[:1], own[:3] + own[4:], [(1, 3, b"ab")]):
        with pytest.raises(ValueError):
            w.joined(bad)
    with pytest.raises(ValueError):
        list(w.records(b"nonsense"))
    assert [f["warc-type"] for f, _ in w.records(w.revisit(2, None, "D", 1) + next(w.response(3, "a b\r\nc", b""))[1])] == ["revisit", "response"]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_query(spark, tmp_path):
    big = "é" * 30_000
    rows = [(1, "u", big), (2, None, big), (3, "a b", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", big), (3, "q", "other"), (1, "u", big)]
    spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS n").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, w.op9_warc_segments(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for k, _, t in rows:
        first = min(p for p, _, x in rows if digest(x) == digest(t) and p is not None)
        same = k == first
        want.append((k, len((t or "").encode()), digest(t), "response" if same else "revisit", None if same else first))
    assert got == sorted(want, key=repr)


def test_damaged_and_empty(spark):
    one = b"".join(r for _, r in w.response(1, "u", b"x" * 5000, 700))
    cut = b"".join(r for n, r in w.response(2, "u", b"y" * 5000, 700) if n != 3)
    df = spark.createDataFrame([(one,), (cut,)], "archive binary")
    got = {r.record: r for r in w.reassembled(w.parsed(df), strict=False).collect()}
    assert [r.damaged is None for r in sorted(got.values(), key=lambda r: r.damaged or "")] == [True, False]
    with pytest.raises(Exception, match="segments are missing"):
        w.reassembled(w.parsed(df)).collect()
    assert w.parsed(df.limit(0)).collect() == []


def test_ids_of_any_text(spark):
    """Ids that would break a header, look like null, or hold what parts names."""
    ids = ["null", None, "a\r\nWARC-Type: x", ">", "%0A", "é:/?", "", " pad "]
    rows = [(k, "u", f"page {i}") for i, k in enumerate(ids)] + [("zz", "u", "page 0"), (None, "u", "page 1")]
    got = w.told(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    want = [(k, digest(f"page {i}"), "response", None) for i, k in enumerate(ids)] + [("zz", digest("page 0"), "revisit", "null"), (None, digest("page 1"), "response", None)]
    assert sorted(((r.page, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)


def test_empty_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert w.op9_warc_segments(spark, str(tmp_path)).collect() == []


def test_what_a_task_holds(spark, tmp_path):
    """Archives are stored in small row groups, and payloads do not leave the task that reassembles them."""
    import random

    import pyarrow.parquet as pq

    rows = [(i, "u", random.Random(i).randbytes(400_000).hex()) for i in range(24)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    stored = w.archives(df)
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in stored.inputFiles()]
    sizes = [(m.row_group(i).num_rows, m.row_group(i).total_byte_size) for m in groups for i in range(m.num_row_groups)]
    assert sum(n for n, _ in sizes) > 2 * w.GROUP_ROWS and max(n for n, _ in sizes) <= w.GROUP_ROWS and max(b for _, b in sizes) < 10 << 20
    got = w.reassembled(w.parsed(stored), of=w._sums, columns="own string, n long")
    assert "payload" not in got.columns
    assert sorted((r.own, r.n) for r in got.collect()) == sorted((digest(t), len(t)) for _, _, t in rows)
