"""MPEG transport streams in a binary column: multiplexing, and reading back.

A stream that is written here has one program of one elementary stream, in PES packets of 2304 payload bytes (the last may be
shorter) whose presentation timestamps are 2160 ticks of 90 kHz apart. Every GROUP-th unit is a random-access point: the
program tables (PAT and PMT, with their CRC) are sent anew before it, and its first packet has the random-access flag; every
unit's first packet has a clock reference.

Reading takes any transport stream of 188-byte packets: sections behind a pointer field and over several packets, tables that
come again, several programs and elementary streams, packets with adaptation fields only, stuffing, signalled discontinuities,
packets sent twice, PES packets of unstated length and without timestamps. Continuity counters are checked for each PID, and
each PES packet gives its payload, timestamps and whether it is a random-access point.

Nulls: a null text is empty. Empty texts have one unit of padding. Texts of any length are stored whole; equal texts give
equal streams, so repeated rows and ties give equal rows. Rows with a null id are kept. Columns other than the id and the text
aren't read, so extra ones of any name don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, utf8, with_columns

PACKET, UNIT, TICKS, BLOCK = 188, 2304, 2160, 576
#: Units from one random-access point to the next.
GROUP = 8
PMT_PID, ES_PID, STREAM_ID, STREAM_TYPE = 0x1000, 0x0100, 0xBD, 0x06


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    return crc


def _section(table: int, key: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + key.to_bytes(2, "big") + b"\xc1\0\0"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (b"\x47" + (0x4000 | pid).to_bytes(2, "big") + b"\x10\0" + section).ljust(PACKET, b"\xff")


_TABLES = np.frombuffer(
    _table_packet(0, _section(0, 1, b"\0\1" + (0xE000 | PMT_PID).to_bytes(2, "big")))
    + _table_packet(PMT_PID, _section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\0")),
    np.uint8,
).reshape(2, PACKET)


def _pts(t: int) -> bytes:
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, t >> 14 & 0xFE | 1, t >> 7 & 0xFF, t << 1 & 0xFE | 1])


def _pcr(t: int) -> bytes:
    return (t << 15 | 0x7E00).to_bytes(6, "big")


def mux(payload: bytes) -> bytes:
    out, counter = [], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        access = k % GROUP == 0
        if access:
            tables = _TABLES.copy()
            tables[:, 3] |= k // GROUP & 15
            out.append(tables)
        data, t = payload[at : at + UNIT], k * TICKS % 2**33
        pes = np.frombuffer(b"\0\0\1" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\5" + _pts(t) + data, np.uint8)
        rest = max(0, len(pes) - 176)
        stuffing = max(0, 176 - len(pes))
        n = 1 + -(-rest // 184)
        p = np.full((n, PACKET), 255, np.uint8)
        p[:, 0], p[:, 1], p[:, 2] = 0x47, ES_PID >> 8, ES_PID & 255
        p[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        p[0, 1] |= 0x40
        p[0, 3] |= 0x20
        p[0, 4:12] = np.frombuffer(bytes([7 + stuffing, 0x50 if access else 0x10]) + _pcr(t), np.uint8)
        p[0, 12 + stuffing :] = pes[:176]
        whole, tail = divmod(rest, 184)
        p[1 : 1 + whole, 4:] = pes[176 : 176 + 184 * whole].reshape(-1, 184)
        if tail:
            p[-1, 3] |= 0x20
            p[-1, 4] = 183 - tail
            if tail < 183:
                p[-1, 5] = 0
            p[-1, PACKET - tail :] = pes[len(pes) - tail :]
        out.append(p)
    return np.concatenate(out).tobytes() if out else b""


@dataclass
class Unit:
    """A PES packet: its payload, timestamps (None where it has none), and whether it is a random-access point."""

    payload: bytes
    pts: int | None
    dts: int | None
    access: bool


@dataclass
class Elementary:
    pid: int
    program: int
    kind: int
    units: list[Unit] = field(default_factory=list)


@dataclass
class Stream:
    """programs: {number: PID of its map}; errors: breaks of continuity by PID; streams in the order of the maps."""

    programs: dict[int, int]
    streams: list[Elementary]
    errors: dict[int, int]


#: Stream ids whose PES packets have no header beyond their length.
_BARE = frozenset((0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF))


def _body(packet: np.ndarray) -> bytes:
    """What must be the same in a packet sent twice: all but a clock reference, which counts on."""
    raw = packet.tobytes()
    return raw[:6] + raw[12:] if raw[3] & 0x20 and raw[4] >= 7 and raw[5] & 0x10 else raw


class _Pid:
    """The packets of one PID that count: in order, without those sent twice, and the breaks between them."""

    def __init__(self, p: np.ndarray):
        control, size = p[:, 3] >> 4 & 3, p[:, 4].astype(np.int32)
        has = control & 1 > 0
        adapted = control & 2 > 0
        flags = np.where(adapted & (size > 0), p[:, 5], 0)
        counter = p[:, 3].astype(np.int32) & 15
        keep = np.ones(len(p), bool)
        if len(p) > 1:
            step = np.diff(counter) & 15
            twice = (step == 0) & has[1:] & has[:-1] & (flags[1:] & 0x80 == 0)
            for i in np.flatnonzero(twice):
                twice[i] = _body(p[i]) == _body(p[i + 1])
            twice[1:] &= ~(twice[:-1] & twice[1:])  # a packet may be sent twice, not three times
            keep[1:] = ~twice
        p, has, flags, counter, adapted, size = (x[keep] for x in (p, has, flags, counter, adapted, size))
        wrong = np.zeros(len(p), bool)
        if len(p) > 1:
            wrong[1:] = ((counter[1:] - counter[:-1]) & 15 != has[1:]) & (flags[1:] & 0x80 == 0)
        self.begin = np.minimum(np.where(adapted, 5 + size, 4), PACKET)
        self.begin[~has] = PACKET
        self.packets, self.flags, self.breaks = p, flags, wrong
        self.starts = (p[:, 1] & 0x40 > 0) & (self.begin < PACKET)
        self.errors = int(wrong.sum())


def _sections(own: _Pid) -> Iterator[bytes]:
    """Whole sections of a PID, whatever packets they begin and end in."""
    held: bytes | None = None
    for packet, begin, start, broken in zip(own.packets, own.begin.tolist(), own.starts.tolist(), own.breaks.tolist()):
        data = packet[begin:].tobytes()
        held = None if broken else held
        if start:
            pointer = data[0]
            if held is not None:
                yield from _whole(held + data[1 : 1 + pointer])[0]
            data, held = data[1 + pointer :], b""
        if held is not None:
            found, held = _whole(held + data)
            yield from found


def _whole(data: bytes) -> tuple[list[bytes], bytes | None]:
    """Complete sections at the beginning of data, and what may be the beginning of another (None: stuffing)."""
    out = []
    while data:
        if data[0] == 0xFF:
            return out, None
        size = 3 + (int.from_bytes(data[1:3], "big") & 0xFFF) if len(data) > 2 else PACKET * 32
        if len(data) < size:
            return out, data
        out.append(data[:size])
        data = data[size:]
    return out, b""


def _table(own: _Pid, kind: int) -> dict[int, bytes]:
    """{table id extension: bodies of its sections that are in force now, the last version}."""
    out: dict[int, tuple[int, dict[int, bytes]]] = {}
    for s in dict.fromkeys(_sections(own)):
        if s[0] != kind:
            continue
        if crc32_mpeg_cached(s):
            raise ValueError("damaged table")
        if s[5] & 1:
            key, version = int.from_bytes(s[3:5], "big"), s[5] >> 1 & 31
            if key not in out or out[key][0] != version:
                out[key] = (version, {})
            out[key][1][s[6]] = s[8:-4]
    return {key: b"".join(parts[i] for i in sorted(parts)) for key, (_, parts) in out.items()}


def _time(x: list[int]) -> int:
    return (x[0] >> 1 & 7) << 30 | x[1] << 22 | x[2] >> 1 << 15 | x[3] << 7 | x[4] >> 1


def _units(own: _Pid) -> Iterator[Unit]:
    begins = np.flatnonzero(own.starts)
    on = np.arange(PACKET) >= own.begin[:, None]
    data = own.packets[on]
    place = np.r_[0, np.cumsum(PACKET - own.begin)]
    for i, end in zip(begins, np.r_[begins[1:], len(own.packets)]):
        unit = data[place[i] : place[end]]
        if len(unit) < 6 or unit[:3].tolist() != [0, 0, 1]:
            continue
        size = int(unit[4]) << 8 | int(unit[5])
        stop = size + 6 if size else len(unit)
        pts = dts = None
        head = 6
        if int(unit[3]) not in _BARE and len(unit) >= 9:
            head, flags = 9 + int(unit[8]), int(unit[7]) >> 6
            if flags & 2:
                pts = _time(unit[9:14].tolist())
            if flags == 3:
                dts = _time(unit[14:19].tolist())
        yield Unit(unit[head:stop].tobytes(), pts, dts, bool(own.flags[i] & 0x40))


def demux(raw: bytes) -> Stream:
    """Every elementary stream of every program. A stream must begin with a packet; bytes after the last whole one are ignored."""
    p = np.frombuffer(raw, np.uint8, len(raw) // PACKET * PACKET).reshape(-1, PACKET)
    if (p[:, 0] != 0x47).any():
        raise ValueError("lost sync")
    p = p[p[:, 1] & 0x80 == 0]  # packets that are marked as damaged
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    known: dict[int, _Pid] = {}

    def of(k: int) -> _Pid:
        if k not in known:
            known[k] = _Pid(p[pid == k])
        return known[k]

    programs: dict[int, int] = {}
    for body in _table(of(0), 0).values():
        entries = [(int.from_bytes(body[i : i + 2], "big"), int.from_bytes(body[i + 2 : i + 4], "big") & 0x1FFF) for i in range(0, len(body), 4)]
        programs |= {number: place for number, place in entries if number}
    streams: dict[int, Elementary] = {}
    for number, place in programs.items():
        body = _table(of(place), 2).get(number, b"")
        at = 4 + (int.from_bytes(body[2:4], "big") & 0xFFF)
        while at + 5 <= len(body):
            es = int.from_bytes(body[at + 1 : at + 3], "big") & 0x1FFF
            streams.setdefault(es, Elementary(es, number, body[at]))
            at += 5 + (int.from_bytes(body[at + 3 : at + 5], "big") & 0xFFF)
    for s in streams.values():
        s.units.extend(_units(of(s.pid)))
    return Stream(programs, list(streams.values()), {k: x.errors for k, x in known.items()})


_known: dict[bytes, int] = {}


def crc32_mpeg_cached(data: bytes) -> int:
    """Of a table's section; a corpus has few different ones."""
    if data not in _known:
        if len(_known) > 1000:
            _known.clear()
        _known[data] = crc32_mpeg(data)
    return _known[data]


def write_streams(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, ts binary): UTF-8, then bytes 255 up to a positive multiple of 576."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            raw = utf8(b.column(1))
            ts = [mux(x.ljust(max(1, -(-len(x) // BLOCK)) * BLOCK, b"\xff")) for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(ts, pa.binary())], names=["doc_id", "n_bytes", "ts"])

    return with_columns(df, **{id_col: "long", text_col: "string"}).mapInArrow(run, "doc_id long, n_bytes long, ts binary")


def read_streams(df: DataFrame) -> DataFrame:
    """Adds what is read of the stream's first elementary stream to (doc_id, n_bytes, ts): payload, pts (null where a unit has none),
    random_access (places in the payload), continuity_errors of all PIDs, pid, and how many programs and streams there are."""
    names = ["payload", "pts", "random_access", "continuity_errors", "pid", "programs", "streams"]
    types = [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def read(raw: bytes) -> tuple:
        s = demux(raw)
        units = s.streams[0].units if s.streams else []
        place = np.cumsum([0, *(len(u.payload) for u in units)])
        return b"".join(u.payload for u in units), [u.pts for u in units], [int(a) for a, u in zip(place, units) if u.access], sum(s.errors.values()), s.streams[0].pid if s.streams else None, len(s.programs), len(s.streams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            cols = list(zip(*map(read, b.column(2).to_pylist()))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "n_bytes", "ts", *names])

    return df.select("doc_id", "n_bytes", "ts").mapInArrow(run, "doc_id long, n_bytes long, ts binary, payload binary, pts array<long>, random_access array<long>, continuity_errors long, pid int, programs int, streams int")


def stream_digests(df: DataFrame) -> DataFrame:
    """The contract's columns, from the streams as they were read back."""
    r = read_streams(write_streams(df))
    end = lambda i: F.coalesce(F.try_element_at("pts", F.lit(i)), F.lit(-1))
    feature = F.format_string("pid=%d units=%d pts=%d..%d access=%s errors=%d", "pid", F.size("pts"), end(1), end(-1), F.array_join(F.col("random_access").cast("array<string>"), "+"), "continuity_errors")
    return r.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.octet_length("ts").cast("long").alias("media_bytes"),
        F.sha2("ts", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
