"""MPEG transport stream columns (ISO/IEC 13818-1).

``mux`` wraps a payload into access units carried by one private elementary
stream: program tables (PAT, PMT), PES packets with presentation timestamps,
continuity counters, PCR and random-access indicators. ``demux`` reads any
single- or multi-program stream back: it parses the program tables, checks the
continuity counters, reassembles elementary packets and lists timestamps and
random-access points.

Cases: null and empty texts have an empty payload, padded to 64 zero bytes;
repeated rows give repeated results; an empty table gives an empty table; other
columns are ignored. A stream of zero bytes has no programs and no units;
bytes that do not start with the sync byte count as ``sync_errors``.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from ._common import documents, id_text, map_arrow, stage, utf8

PACKET, SYNC = 188, 0x47
PMT_PID, DATA_PID, PROGRAM, PRIVATE_PES, PRIVATE_STREAM_1 = 0x100, 0x101, 1, 0x06, 0xBD
TICKS = 3600  #: of the 90 kHz clock between access units: 25 a second
PTS_WRAP = 1 << 33


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


@lru_cache(maxsize=4096)
def crc32_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2; zero over a section that ends with its own CRC."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, ext: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + ext.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


@lru_cache(maxsize=1)
def _tables() -> tuple[bytes, bytes]:
    pat = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    es = bytes([PRIVATE_PES]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"
    pmt = _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + es)
    return pat, pmt


def _psi_packet(pid: int, cc: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | cc, 0]) + section).ljust(PACKET, b"\xff")


def _pts(ts: int, mark: int = 2) -> bytes:
    return bytes([mark << 4 | (ts >> 29) & 14 | 1, (ts >> 22) & 255, (ts >> 14) & 254 | 1, (ts >> 7) & 255, (ts << 1) & 254 | 1])


#: Header of a packet that goes on with the data stream, payload only, by counter.
_GOING = [bytes([SYNC, DATA_PID >> 8, DATA_PID & 255, 0x10 | cc]) for cc in range(16)]


def mux(payload: bytes, unit_bytes: int = 8192, gop: int = 4) -> bytes:
    """Transport stream of ``payload`` in access units of ``unit_bytes``; every
    ``gop``-th is a random-access point, preceded by PAT and PMT."""
    if not 0 < unit_bytes <= 65_000:
        raise ValueError("unit_bytes must be from 1 to 65000, for a PES packet of bounded length")
    out: list[bytes] = []
    pat, pmt = _tables()
    psi_cc = cc = 0
    for k, at in enumerate(range(0, len(payload), unit_bytes)):
        data = payload[at : at + unit_bytes]
        ts = k * TICKS % PTS_WRAP
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _pts(ts) + data
        field_ = b""
        if k % gop == 0:
            out += (_psi_packet(0, psi_cc, pat), _psi_packet(PMT_PID, psi_cc, pmt))
            psi_cc = psi_cc + 1 & 15
            field_ = b"\x50" + (ts << 15 | 0x7E00).to_bytes(6, "big")  # random access and PCR flags; PCR base, reserved bits
        room = 183 - len(field_) if field_ else 184
        done = min(room, len(pes))
        start = bytes([SYNC, 0x40 | DATA_PID >> 8, DATA_PID & 255])
        out.append(_packet(start, cc, field_, pes[:done]))
        cc = cc + 1 & 15
        whole = done + (len(pes) - done) // 184 * 184
        for o in range(done, whole, 184):
            out += (_GOING[cc], pes[o : o + 184])
            cc = cc + 1 & 15
        if whole < len(pes):
            out.append(_packet(_GOING[0][:3], cc, b"", pes[whole:]))
            cc = cc + 1 & 15
    return b"".join(out)


def _packet(head: bytes, cc: int, field_: bytes, data: bytes) -> bytes:
    """A packet with the adaptation field that fills it up to 188 bytes."""
    fill = 184 - len(data)
    if not fill:
        return head + bytes([0x10 | cc]) + data
    body = field_ or (b"\x00" if fill > 1 else b"")
    return head + bytes([0x30 | cc, fill - 1]) + body.ljust(fill - 1, b"\xff") + data


@dataclass
class Unit:
    pid: int
    pts: int | None
    dts: int | None
    random_access: bool
    packet: int  #: number of the packet in which it starts
    data: bytes
    broken: bool = False  #: packets of it are missing


@dataclass
class Stream:
    packets: int = 0
    sync_errors: int = 0
    continuity_errors: int = 0
    crc_errors: int = 0
    programs: dict[int, int] = field(default_factory=dict)  #: program number: PMT PID
    streams: dict[int, tuple[int, int]] = field(default_factory=dict)  #: PID: (program number, stream type)
    units: list[Unit] = field(default_factory=list)

    def payload(self, pid: int = DATA_PID) -> bytes:
        return b"".join(u.data for u in self.units if u.pid == pid)


def _stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def demux(data: bytes) -> Stream:
    out = Stream()
    last_cc: dict[int, int] = {}
    repeated: dict[int, bool] = {}
    pes: dict[int, list] = {}
    sections: dict[int, bytearray] = {}
    n = len(data) // PACKET
    out.sync_errors += len(data) % PACKET > 0
    out.packets = n

    def close(pid: int) -> None:
        at, rap, parts, broken = pes.pop(pid)
        b = b"".join(parts)
        if len(b) < 6 or b[:3] != b"\x00\x00\x01":
            return
        length = b[4] << 8 | b[5]
        if length:
            broken = broken or len(b) < 6 + length
            b = b[: 6 + length]
        pts = dts = None
        start = 6
        if len(b) >= 9 and b[6] & 0xC0 == 0x80:
            start = 9 + b[8]
            if b[7] & 0x80 and b[8] >= 5:
                pts = _stamp(b[9:14])
            if b[7] & 0xC0 == 0xC0 and b[8] >= 10:
                dts = _stamp(b[14:19])
        out.units.append(Unit(pid, pts, dts, rap, at, b[start:], broken))

    def tables(pid: int, payload: bytes, starts: bool) -> None:
        held = sections.get(pid)
        if starts:
            if not payload:
                return
            skip = payload[0]
            if held is not None:
                held += payload[1 : 1 + skip]
                parse(pid, held)
            held = sections[pid] = bytearray(payload[1 + skip :])
        elif held is not None:
            held += payload
        if held is not None:
            parse(pid, held)

    def parse(pid: int, held: bytearray) -> None:
        while len(held) >= 3 and held[0] != 0xFF:
            end = 3 + ((held[1] & 15) << 8 | held[2])
            if len(held) < end:
                return
            section = bytes(held[:end])
            del held[:end]
            if end < 12 or crc32_mpeg(section):
                out.crc_errors += 1
            elif section[0] == 0 and pid == 0:
                for o in range(8, end - 4, 4):
                    if number := section[o] << 8 | section[o + 1]:
                        out.programs[number] = (section[o + 2] & 31) << 8 | section[o + 3]
            elif section[0] == 2:
                o = 12 + ((section[10] & 15) << 8 | section[11])
                while o + 5 <= end - 4:
                    out.streams[(section[o + 1] & 31) << 8 | section[o + 2]] = (section[3] << 8 | section[4], section[o])
                    o += 5 + ((section[o + 3] & 15) << 8 | section[o + 4])

    for k in range(n):
        o = k * PACKET
        if data[o] != SYNC:
            out.sync_errors += 1
            continue
        b1, b3 = data[o + 1], data[o + 3]
        pid = (b1 & 31) << 8 | data[o + 2]
        if pid == 0x1FFF:
            continue
        start, rap, gap = o + 4, False, False
        if b3 & 0x20:
            length = data[o + 4]
            if length:
                rap, gap = bool(data[o + 5] & 0x40), bool(data[o + 5] & 0x80)
            start = o + 5 + length
        if not b3 & 0x10:
            continue
        cc, before = b3 & 15, last_cc.get(pid)
        if before is not None and not gap and cc != before + 1 & 15:
            if cc == before and not repeated.get(pid):  # a packet may be sent twice
                repeated[pid] = True
                continue
            out.continuity_errors += 1
            if pid in pes:  # what was sent between is lost, of this unit at least
                pes[pid][3] = True
        last_cc[pid] = cc
        repeated[pid] = False
        if pid in out.streams:
            if b1 & 0x40:
                if pid in pes:
                    close(pid)
                pes[pid] = [k, rap, [data[start : o + PACKET]], False]
            elif pid in pes:
                pes[pid][2].append(data[start : o + PACKET])
        elif pid == 0 or pid in out.programs.values():
            tables(pid, data[start : o + PACKET], bool(b1 & 0x40))
    for pid in list(pes):
        close(pid)
    return out


def padded(data: bytes, unit: int = 64) -> bytes:
    """``data`` with zero bytes appended up to a positive multiple of ``unit``."""
    return data + bytes(-len(data) % unit or (0 if data else unit))


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A media table in the shared folder: doc_id, n_bytes and the stream of each text."""

    def rows(batch):
        for key, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            yield key, len(text), mux(padded(text))

    kind = df.schema[id_col].dataType.simpleString()
    return stage(map_arrow(id_text(df, id_col, text_col), rows, f"doc_id {kind}, n_bytes long, media binary", lambda r: len(r[2])), "ts")


UNIT = "struct<pid:int,pts:long,dts:long,random_access:boolean,packet:int,bytes:int,broken:boolean>"


def parse(df: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """Every stream's program tables, error counts, units and random-access
    points: doc_id, packets, sync_errors, continuity_errors, crc_errors,
    programs, streams, units, random_access_pts."""

    def rows(batch):
        for key, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            s = demux(media or b"")
            units = [{"pid": u.pid, "pts": u.pts, "dts": u.dts, "random_access": u.random_access, "packet": u.packet, "bytes": len(u.data), "broken": u.broken} for u in s.units]
            yield (
                key, s.packets, s.sync_errors, s.continuity_errors, s.crc_errors, list(s.programs.items()),
                [{"pid": p, "program": a, "type": t} for p, (a, t) in s.streams.items()], units,
                [u.pts for u in s.units if u.random_access and u.pts is not None],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(
        df.select(id_col, media_col), rows,
        f"doc_id {kind}, packets int, sync_errors int, continuity_errors int, crc_errors int, programs map<int,int>, "
        f"streams array<struct<pid:int,program:int,type:int>>, units array<{UNIT}>, random_access_pts array<long>",
        lambda r: 64 * len(r[7]),
    )


def digests(media: DataFrame) -> DataFrame:
    """What is read back from a stored media table, as digests and one feature string."""

    def rows(batch):
        for key, n, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            s = demux(data)
            payload = s.payload()
            stamps = [u.pts for u in s.units]
            raps = [u.pts for u in s.units if u.random_access]
            feature = (
                f"programs={len(s.programs)};streams={len(s.streams)};packets={s.packets};units={len(s.units)};"
                f"continuity_errors={s.continuity_errors};crc_errors={s.crc_errors};sync_errors={s.sync_errors};"
                f"pts={stamps[0] if stamps else ''}-{stamps[-1] if stamps else ''};random_access={','.join(map(str, raps))}"
            )
            yield (
                key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]),
                len(data), hashlib.sha256(data).hexdigest(), feature, len(s.units), len(raps), s.continuity_errors,
            )

    kind = media.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        media.select("doc_id", "n_bytes", "media"), rows,
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string, n_units long, n_random_access long, continuity_errors long",
        lambda r: 400,
    )


def op1_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(store(documents(spark, sf_dir)))
