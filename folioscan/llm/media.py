"""Media columns: MPEG transport streams.

write_ts wraps a payload in a transport stream: a program association table, a program map table with one private
stream, and the payload in elementary packets, each with a presentation time. read_ts parses the tables, checks the
continuity counters, reassembles the elementary packets and lists their times and the random-access points. Both work
on whole arrays of packets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.common import materialize, only, read_table

PACKET, BODY = 188, 184
PAT_PID, PMT_PID, ES_PID, PROGRAM, PRIVATE = 0, 0x1000, 0x100, 1, 0x06
#: Bytes of an access unit, ticks of 90 kHz between two, and access units from one random-access point to the next.
UNIT_BYTES, TICKS, GROUP = 9216, 3600, 8
PAD_TO = 576
_CRC = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = (_c << 1 ^ 0x04C11DB7 if _c & 0x80000000 else _c << 1) & 0xFFFFFFFF
    _CRC[_i] = _c


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ int(_CRC[c >> 24 ^ b])
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | len(body) + 9, number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc32_mpeg(head + body))


def _table_packet(pid: int, section: bytes, counter: int = 0) -> bytes:
    return (struct.pack(">BHBB", 0x47, 0x4000 | pid, 0x10 | counter, 0) + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(PAT_PID, _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))) + _table_packet(PMT_PID, _section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, PRIVATE, 0xE000 | ES_PID, 0xF000)))


def _clock(ticks: int, mark: int) -> bytes:
    return bytes([mark << 4 | (ticks >> 30 & 7) << 1 | 1]) + struct.pack(">HH", (ticks >> 15 & 0x7FFF) << 1 | 1, (ticks & 0x7FFF) << 1 | 1)


def _pcr(ticks: int) -> bytes:
    return struct.pack(">IH", ticks >> 1 & 0xFFFFFFFF, (ticks & 1) << 15 | 0x7E00)


def write_ts(payload: bytes) -> bytes:
    """The payload as a transport stream. An empty payload gives the tables alone."""
    out, counter = [_TABLES], 0
    for k, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        unit, ticks = payload[at : at + UNIT_BYTES], k * TICKS & (1 << 33) - 1
        pes = b"\0\0\1\xbd" + struct.pack(">HBBB", len(unit) + 8, 0x84, 0x80, 5) + _clock(ticks, 2) + unit
        field = bytes([0x50 if k % GROUP == 0 else 0x10]) + _pcr(ticks)
        room = BODY - 1 - len(field)  # of the first packet
        if len(pes) <= room:
            field += b"\xff" * (room - len(pes))
        room = BODY - 1 - len(field)
        out.append(struct.pack(">BHB", 0x47, 0x4000 | ES_PID, 0x30 | counter) + bytes([len(field)]) + field + pes[:room])
        counter = counter + 1 & 15
        n, rest = divmod(len(pes) - room, BODY)
        if n:
            block = np.empty((n, PACKET), np.uint8)
            block[:, 0], block[:, 1], block[:, 2] = 0x47, ES_PID >> 8, ES_PID & 255
            block[:, 3] = 0x10 | (counter + np.arange(n) & 15)
            block[:, 4:] = np.frombuffer(pes, np.uint8, n * BODY, room).reshape(n, BODY)
            out.append(block.tobytes())
            counter = counter + n & 15
        if rest:
            gap = BODY - rest - 1  # bytes of the adaptation field after its length
            field = b"" if not gap else b"\0" + b"\xff" * (gap - 1)
            out.append(struct.pack(">BHBB", 0x47, ES_PID, 0x30 | counter, gap) + field + pes[len(pes) - rest :])
            counter = counter + 1 & 15
    return b"".join(out)


def _packets(media: bytes) -> np.ndarray:
    if len(media) % PACKET:
        raise ValueError("not a whole number of packets")
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if len(p) and (p[:, 0] != 0x47).any():
        raise ValueError("a packet without its sync byte")
    return p


def _section_of(packets: np.ndarray, table: int) -> bytes:
    """The body of the first section of a table, which may go over several packets of its PID. What follows it in its
    last packet must be stuffing."""
    data, size = b"", None
    for p in packets:
        if not p[3] >> 4 & 1:  # no payload
            continue
        at, raw = 4 + (1 + int(p[4]) if p[3] >> 5 & 1 else 0), p.tobytes()
        if raw[1] & 0x40:
            if data:
                break
            at += 1 + (raw[at] if at < PACKET else 0)
        elif not data:
            continue
        data += raw[at:]
        if size is None and len(data) >= 3:
            size = 3 + ((data[1] & 15) << 8 | data[2])
        if size is not None and len(data) >= size:
            section = data[:size]
            if section[0] != table or size < 12 or crc32_mpeg(section) or data[size:].strip(b"\xff"):
                break
            return section[8:-4]
    raise ValueError("a missing or damaged program table")


def _programs(pat: bytes) -> list[tuple[int, int]]:
    """Number and map PID of each program; number 0 is the network's."""
    found = [struct.unpack_from(">HH", pat, k) for k in range(0, len(pat) - 3, 4)]
    return [(n, pid & 0x1FFF) for n, pid in found if n]


def _streams(pmt: bytes) -> list[tuple[int, int]]:
    """Type and PID of each elementary stream of a program map."""
    at, out = 4 + (struct.unpack_from(">H", pmt, 2)[0] & 0xFFF), []
    while at + 5 <= len(pmt):
        kind, pid, more = struct.unpack_from(">BHH", pmt, at)
        out.append((kind, pid & 0x1FFF))
        at += 5 + (more & 0xFFF)
    return out


def _continuity(p: np.ndarray) -> tuple[np.ndarray, int]:
    """Which packets of a stream aren't permitted repetitions, and how many counters don't follow. A packet may be sent
    twice in a row; a packet without payload keeps the counter; a stated discontinuity is none of these errors."""
    control, n = p[:, 3] >> 4 & 3, len(p)
    has = (control & 1).astype(bool)
    at = np.flatnonzero(has)
    again = np.zeros(n, bool)
    if len(at) > 1:
        a, b = p[at[:-1]], p[at[1:]]
        same = (a == b)
        clock = (control[at[1:]] & 2 > 0) & (b[:, 4] >= 7) & (b[:, 5] & 0x10 > 0)
        same[:, 6:12] |= clock[:, None]  # the clock reference may be another
        again[at[1:]] = same.all(axis=1)
        twice = again[at[1:]] & np.append(False, again[at[1:]][:-1])
        again[at[1:][twice]] = False  # a third is an error
    kept = at[~again[at]]
    counters = (p[kept, 3] & 15).astype(np.int64)
    stated = (control[kept] & 2 > 0) & (p[kept, 4] > 0) & (p[kept, 5] & 0x80 > 0)
    return ~again, int((((counters[1:] - counters[:-1]) % 16 != 1) & ~stated[1:]).sum())


def read_ts(media: bytes) -> dict:
    """program, pid, stream_type, packets, payload, pts (of each elementary packet), random_access (byte offsets of
    the payload at which decoding can start) and counter_errors (packets whose continuity counter doesn't follow) of
    the first elementary stream of the first program. A stream without whole packets or tables is a ValueError."""
    p = _packets(media)
    pid = (p[:, 1].astype(np.int64) & 31) << 8 | p[:, 2]
    programs = _programs(_section_of(p[pid == PAT_PID], 0))
    if not programs:
        raise ValueError("a stream without a program")
    program, pmt_pid = programs[0]
    streams = _streams(_section_of(p[pid == pmt_pid], 2))
    if not streams:
        raise ValueError("a program without an elementary stream")
    kind, es = streams[0]
    p = p[pid == es]
    kept, errors = _continuity(p)
    p = p[kept]
    control = p[:, 3] >> 4 & 3
    offset = np.where(control & 2, 5 + p[:, 4].astype(np.int64), 4)
    offset = np.where(control & 1, offset, PACKET)
    if (offset > PACKET).any():
        raise ValueError("an adaptation field beyond its packet")
    random = ((control & 2) > 0) & (p[:, 4] > 0) & ((p[:, 5] & 0x40) > 0)
    data = p[np.arange(PACKET)[None, :] >= offset[:, None]].tobytes()
    ends = np.cumsum(PACKET - offset)
    first = np.flatnonzero((p[:, 1] & 0x40) > 0)
    starts = (ends - (PACKET - offset))[first]
    parts, pts, points, size = [], [], [], 0
    for k, at in enumerate(starts.tolist()):
        end = int(starts[k + 1]) if k + 1 < len(starts) else len(data)
        if data[at : at + 3] != b"\0\0\1" or end - at < 9:
            raise ValueError("an elementary packet without its start code")
        length = struct.unpack(">H", data[at + 4 : at + 6])[0]
        body = at + 9 + data[at + 8]
        if data[at + 7] & 0x80:
            a, b, c = data[at + 9], *struct.unpack(">HH", data[at + 10 : at + 14])
            pts.append((a >> 1 & 7) << 30 | (b >> 1) << 15 | c >> 1)
        if random[first[k]]:
            points.append(size)
        unit = data[body : at + 6 + length if length else end]
        parts.append(unit)
        size += len(unit)
    return {"program": program, "pid": es, "stream_type": kind, "packets": len(p), "payload": b"".join(parts), "pts": pts, "random_access": points, "counter_errors": errors}


def padded(raw: bytes) -> bytes:
    """The bytes, followed by 255s up to a positive multiple of PAD_TO."""
    return raw + b"\xff" * (PAD_TO - len(raw) if not raw else -len(raw) % PAD_TO)


def add_media(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, the transport stream of each document's text (null: empty) as padded UTF-8. Other
    columns are ignored; repeated rows give repeated rows; no documents give none."""

    def mux(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # in pieces, as a batch of long texts would else be held several times
            ids, raws = b.column(0), b.column(1)
            at = 0
            while at < len(raws):
                media, sizes, held = [], [], 0
                first = at
                while at < len(raws) and held < 8 << 20:
                    raw = raws[at].as_py()
                    media.append(write_ts(padded(raw)))
                    sizes.append(len(raw))
                    held += len(media[-1])
                    at += 1
                yield pa.RecordBatch.from_arrays([ids.slice(first, at - first), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    d = only(documents, doc_id="bigint", text="string")
    return d.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw")).mapInArrow(mux, "doc_id bigint, n_bytes bigint, media binary")


PARSED = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, program int, pid int, stream_type int, packets bigint, counter_errors bigint, pts array<bigint>, random_access array<bigint>"


def parse_media(media: DataFrame) -> DataFrame:
    """Demultiplexes doc_id, n_bytes, media: digests of the payload as read back and of the stored bytes, the program,
    the packets, the continuity errors, and the times and random-access points of the elementary packets. A null media
    has nulls and empty lists; bytes that are no transport stream are an error. Repeated rows give repeated rows, no
    rows none; other columns are ignored."""

    def demux(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, n_bytes, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                m = m.as_py()
                if m is None:
                    rows.append({"doc_id": doc_id, "n_bytes": n_bytes, "pts": [], "random_access": []})
                    continue
                r = read_ts(m)
                payload = r.pop("payload")
                rows.append({"doc_id": doc_id, "n_bytes": n_bytes, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]), "media_bytes": len(m), "media_sha256": hashlib.sha256(m).hexdigest()} | r)
            yield pa.RecordBatch.from_pylist(rows, kinds)

    many = pa.list_(pa.int64())
    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("program", pa.int32()), ("pid", pa.int32()), ("stream_type", pa.int32()), ("packets", pa.int64()), ("counter_errors", pa.int64()), ("pts", many), ("random_access", many)])
    return media.select("doc_id", "n_bytes", "media").mapInArrow(demux, PARSED)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(add_media(read_table(spark, sf_dir, "documents")), "media")
    r = parse_media(stored)
    feature = F.format_string(
        "ts;program=%d;pid=%d;type=%d;packets=%d;units=%d;first_pts=%d;last_pts=%d;random_access=%s;errors=%d",
        "program", "pid", "stream_type", "packets", F.size("pts"), F.element_at("pts", 1), F.element_at("pts", -1),
        F.concat_ws(",", F.transform("random_access", lambda x: x.cast("string"))), "counter_errors",
    )
    return r.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "pts", "random_access")
