import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import mpegts as ts


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 700), st.integers(1, 5))
def test_round_trip(payload, unit, gop):
    s = ts.demux(ts.mux(payload, unit, gop))
    assert s.payload() == payload
    assert (s.continuity_errors, s.crc_errors, s.sync_errors) == (0, 0, 0)
    n = -(-len(payload) // unit)
    assert [u.pts for u in s.units] == [i * ts.TICKS for i in range(n)]
    assert [u.random_access for u in s.units] == [i % gop == 0 for i in range(n)]


def test_tables_and_packets():
    data = ts.mux(b"x" * 1000)
    assert len(data) % 188 == 0 and all(data[i] == 0x47 for i in range(0, len(data), 188))
    s = ts.demux(data)
    assert s.programs == {1: ts.PMT_PID} and s.streams == {ts.DATA_PID: (1, 6)}
    assert ts.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_lost_and_doubled_packets():
    data = ts.mux(bytes(range(256)) * 20)
    packets = [data[i : i + 188] for i in range(0, len(data), 188)]
    lost = ts.demux(b"".join(packets[:5] + packets[6:]))
    assert lost.continuity_errors == 1 and [u.broken for u in lost.units] == [True] + [False] * (len(lost.units) - 1)
    assert not any(u.broken for u in ts.demux(data).units) and ts.demux(data[:-188]).units[-1].broken
    doubled = ts.demux(b"".join(packets[:6] + packets[5:]))
    assert doubled.continuity_errors == 0 and doubled.payload() == bytes(range(256)) * 20
    broken = bytearray(data)
    broken[20] ^= 1  # in the first PAT
    assert ts.demux(bytes(broken)).crc_errors == 1
    assert ts.demux(b"\0" * 376).sync_errors == 2 and ts.demux(b"").packets == 0


def test_sections_over_packets_and_two_programs():
    body = b"".join(n.to_bytes(2, "big") + (0xE000 | 0x200 + n).to_bytes(2, "big") for n in range(1, 61))
    section = ts._section(0, 1, body)
    first = bytes([0x47, 0x40, 0, 0x10, 0]) + section[:183]
    second = (bytes([0x47, 0, 0, 0x11]) + section[183:]).ljust(188, b"\xff")
    assert len(ts.demux(first + second).programs) == 60


def test_query(spark, tmp_path):
    import hashlib

    rows = [(1, "abc"), (2, None), (3, ""), (4, "é" * 40_000), (5, "abc"), (None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS media", "2 AS n_bytes")
    got = ts.digests(ts.store(df)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for k, text in rows:
        data = ts.padded((text or "").encode())
        r = by[k]
        assert len(data) % 64 == 0 and len(data) > 0
        assert (r.n_bytes, r.payload_bytes) == (len((text or "").encode()), len(data))
        assert r.payload_sha256 == hashlib.sha256(data).hexdigest() and r.tail_crc32 == zlib.crc32(data[-64:])
    assert by[1][1:] == by[5][1:] and by[2][1:] == by[3][1:]
    assert ts.digests(ts.store(df.limit(0))).collect() == []
    seen = ts.parse(ts.store(df)).where("doc_id = 4").first()
    assert seen.continuity_errors == 0 and len(seen.units) == 10 and sum(u.bytes for u in seen.units) == 80_000 and len(seen.random_access_pts) == 3
