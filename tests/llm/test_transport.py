import hashlib
import random
import zlib

import pytest
from floodstats.llm import transport as T


def padded(text):
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")


def test_digests(docs, texts):
    rows = T.stream_digests(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        p = padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes) == (len(texts[r.doc_id].encode()), len(p))
        assert r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.tail_crc32 == zlib.crc32(p[-32:])
        ts = T.mux(p)
        assert (r.media_bytes, r.media_sha256) == (len(ts), hashlib.sha256(ts).hexdigest())
        assert f"units={-(-len(p) // 2304)} " in r.feature and r.feature.endswith("errors=0")


def test_odd_rows(odd, nothing):
    rows = T.stream_digests(odd).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 16 and by[3].payload_sha256 == by[4].payload_sha256 == hashlib.sha256(b"\xff" * 576).hexdigest()
    assert by[1].media_sha256 == by[2].media_sha256 and by[3].n_bytes == 0
    assert T.stream_digests(nothing).count() == 0


def only(ts):
    s = T.demux(ts)
    (es,) = s.streams
    return s, es


@pytest.mark.parametrize("size", [1, 160, 161, 162, 163, 345, 346, 347, 2303, 2304, 2305, 9216, 50_000])
def test_round_trip_of_any_size(size):
    data = random.Random(size).randbytes(size)
    ts = T.mux(data)
    assert len(ts) % 188 == 0 and all(ts[i] == 0x47 for i in range(0, len(ts), 188))
    s, es = only(ts)
    units = -(-size // 2304)
    assert b"".join(u.payload for u in es.units) == data and set(s.errors.values()) == {0} and es.pid == 0x100 and s.programs == {1: 0x1000}
    assert [u.pts for u in es.units] == [2160 * k for k in range(units)] and [u.access for u in es.units] == [k % 8 == 0 for k in range(units)]


def test_lost_packets_and_damage_are_seen():
    ts = T.mux(b"a" * 9216)
    cut = ts[: 188 * 6] + ts[188 * 7 :]
    assert T.demux(cut).errors[0x100] == 1
    with pytest.raises(ValueError):
        T.demux(b"\0" + ts[1:])
    broken = bytearray(ts)
    broken[10] ^= 1
    with pytest.raises(ValueError):
        T.demux(bytes(broken))


# A stream made by hand, field by field, with none of the writer's functions.


def crc(data):
    """By polynomial division of the message's bits."""
    bits = int.from_bytes(data, "big") << 32 ^ 0xFFFFFFFF << 8 * len(data)
    for i in range(8 * len(data) + 31, 31, -1):
        if bits >> i & 1:
            bits ^= 0x104C11DB7 << (i - 32)
    return bits.to_bytes(4, "big")


def packet(pid, counter, payload=b"", start=False, field=None):
    """field: the adaptation field without its length; it is stuffed so that the packet has 188 bytes."""
    room = 184 - len(payload)
    if room or field is not None:
        field = field if field is not None else b"" if room == 1 else b"\0"
        adaptation = bytes([room - 1]) + field.ljust(room - 1, b"\xff")
        assert len(adaptation) == room
    else:
        adaptation = b""
    control = (2 if adaptation else 0) | (1 if payload else 0)
    return bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, control << 4 | counter & 15]) + adaptation + payload


def section(table, key, body, version=0, now=1, number=0, last=0):
    size = len(body) + 9
    head = bytes([table, 0xB0 | size >> 8, size & 255, key >> 8, key & 255, 0xC0 | version << 1 | now, number, last])
    return head + body + crc(head + body)


def stamp(prefix, t):
    bits = f"{prefix:04b}{t >> 30 & 7:03b}1{t >> 15 & 32767:015b}1{t & 32767:015b}1"
    return int(bits, 2).to_bytes(5, "big")


def pes(data, pts=None, dts=None, stated=True, stuffing=0, stream=0xE0):
    times = (stamp(3 if dts is not None else 2, pts) if pts is not None else b"") + (stamp(1, dts) if dts is not None else b"")
    flags = (2 if pts is not None else 0) | (1 if dts is not None else 0)
    head = bytes([0x80, flags << 6, len(times) + stuffing]) + times + b"\xff" * stuffing
    return b"\0\0\1" + bytes([stream]) + (len(head) + len(data) if stated else 0).to_bytes(2, "big") + head + data


def foreign():
    pat = section(0, 7, b"\0\0\xe0\x10" + b"\0\5\xe0\x20" + b"\0\6\xe0\x21")  # a network, programs 5 and 6
    long = bytes([0x0A, 4]) + b"abcd"
    info = long * 40  # descriptors that take the map over a packet's end
    map5 = section(2, 5, b"\xe0\x50" + (0xF000 | len(info)).to_bytes(2, "big") + info + b"\x1b\xe0\x50\xf0\0" + b"\x0f\xe0\x51\xf0\6" + long)
    later = section(2, 5, b"\xe0\x99\xf0\0", version=1, now=0)  # not in force yet
    map6 = section(2, 6, b"\xe0\x60\xf0\0\x06\xe0\x60\xf0\0")
    five = b"\0" + map5
    ahead = five[:184]
    rest = five[184:]
    video = [pes(b"V" * 300, pts=2**33 - 1, dts=90_000, stated=False, stuffing=3), pes(b"W" * 184 * 2, stated=False), pes(b"X" * 10, pts=5)]
    sound = pes(b"s" * 50, pts=1234, stream=0xC0)
    out = [packet(0x1FFF, 9, b"\xff" * 184), packet(0, 3, b"\3\xff\xff\xff" + pat + b"\xff" * (180 - len(pat)), True)]
    out += [packet(0x20, 0, ahead, True), packet(0x50, 4, video[0][:184], True, None)]
    tail = bytes([len(rest)]) + rest + later  # the pointer says where the next section begins
    out += [packet(0x20, 1, tail + b"\xff" * (184 - len(tail)), True)]
    out += [packet(0x50, 4, field=b"\0")]  # an adaptation field alone doesn't count on
    second = packet(0x50, 5, video[0][184:])
    out += [second, second]  # sent twice
    out += [packet(0x21, 15, b"\0" + map6 + b"\xff" * (183 - len(map6)), True)]
    out += [packet(0x51, 0, sound, True, b"\x40")]
    clock = lambda n: packet(0x50, 6, video[1][:176], True, bytes([0x50]) + bytes(5) + bytes([n]))
    out += [clock(1), clock(2)]  # sent twice, the clock counts on
    out += [packet(0x50, 7, video[1][176:360]), packet(0x50, 8, video[1][360:])]
    out += [packet(0x50, 2, video[2], True, b"\x80")]  # a discontinuity that is signalled
    out += [packet(0x60, 0, pes(b"p" * 20, stream=0xBD), True), packet(0x60, 2, b"lost".ljust(184, b"l"))]  # one that is not
    return b"".join(out)


def test_a_foreign_stream():
    assert crc(b"123456789") == (0x0376E6E7).to_bytes(4, "big")
    s = T.demux(foreign())
    assert s.programs == {5: 0x20, 6: 0x21}
    assert [(e.pid, e.program, e.kind) for e in s.streams] == [(0x50, 5, 0x1B), (0x51, 5, 0x0F), (0x60, 6, 0x06)]
    video, sound, other = (e.units for e in s.streams)
    assert [(u.payload, u.pts, u.dts, u.access) for u in video] == [(b"V" * 300, 2**33 - 1, 90_000, False), (b"W" * 368, None, None, True), (b"X" * 10, 5, None, False)]
    assert [(u.payload, u.pts, u.access) for u in sound] == [(b"s" * 50, 1234, True)]
    assert [(u.payload, u.pts) for u in other] == [(b"p" * 20, None)]
    assert {k: e for k, e in s.errors.items() if e} == {0x60: 1}


def test_what_is_written_is_read_by_a_plain_parser():
    """A parser of this test alone: packet by packet, with none of the reader's functions."""
    data = random.Random(1).randbytes(40_000)
    ts, parts, points, times, counters = T.mux(data), [], [], [], {}
    for i in range(0, len(ts), 188):
        p = ts[i : i + 188]
        pid, control = (p[1] & 31) << 8 | p[2], p[3] >> 4 & 3
        assert p[0] == 0x47 and p[3] & 15 == counters.get(pid, -1) + 1 & 15
        counters[pid] = p[3] & 15
        at = 5 + p[4] if control & 2 else 4
        if pid in (0, 0x1000):
            size = 3 + (int.from_bytes(p[at + 2 : at + 4], "big") & 0xFFF)
            body = p[at + 1 : at + 1 + size]
            assert p[at] == 0 and crc(body[:-4]) == body[-4:]
            continue
        if p[1] & 0x40:
            if p[5] & 0x40:
                points.append(len(parts))
            bits = "".join(f"{b:08b}" for b in p[at + 9 : at + 14])
            times.append(int(bits[4:7] + bits[8:23] + bits[24:39], 2))
            parts.append([int.from_bytes(p[at + 4 : at + 6], "big") - 8, p[at + 14 :]])
        else:
            parts[-1][1] += p[at:]
    assert all(size == len(x) for size, x in parts) and b"".join(x for _, x in parts) == data
    assert points == [0, 8, 16] and times == [2160 * k for k in range(len(parts))] and set(counters) == {0, 0x1000, 0x100}


def test_crc():
    assert T.crc32_mpeg(b"123456789") == 0x0376E6E7
