"""MPEG transport streams as a media column.

``mux`` packs a payload into one program of a transport stream: program
tables (PAT, PMT), packetised elementary stream packets with time stamps, a
clock reference and the random-access flag on entry points. ``demux`` reads
any transport stream back: it parses the program tables, checks continuity
counters, reassembles the elementary packets and lists time stamps with
random-access points. ``mux_texts`` and ``demux_streams`` are the same two as
operators on DataFrames; they work on one Arrow batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from civisphere.llm.common import bounded_batches

PACKET = 188
SYNC = 0x47
PMT_PID, ES_PID = 0x1000, 0x0100
#: Private data in PES packets.
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
#: Payload bytes of an access unit, ticks of the 90 kHz clock between two,
#: access units from one random-access point to the next.
UNIT, TICKS, GROUP = 8192, 3003, 4
FIRST_PTS = 90_000
BLOCK = 64


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = ((c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


@lru_cache(4096)
def crc32_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2 as program tables carry it; 0 over a table with its CRC."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, number >> 8, number & 255, 0xC1, 0, 0])
    return (s := head + body) + crc32_mpeg(s).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    data = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return np.frombuffer(data.ljust(PACKET, b"\xff"), np.uint8)


_PAT = _table_packet(0, _section(0, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255])))
_PMT = _table_packet(PMT_PID, _section(2, 1, bytes([0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0, STREAM_TYPE, 0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0])))


def _stamp(mark: int, t: int) -> bytes:
    t &= (1 << 33) - 1
    return bytes([mark << 4 | (t >> 30) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1])


def mux(payload: bytes) -> bytes:
    """A transport stream of one program whose elementary stream is ``payload``."""
    out, counter, tables = [], 0, 0
    for k, at in enumerate(range(0, max(1, len(payload)), UNIT)):
        unit = payload[at : at + UNIT]
        entry, pts = k % GROUP == 0, FIRST_PTS + k * TICKS
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, pts) + unit
        if entry:
            pair = np.stack([_PAT, _PMT])
            pair[:, 3] |= tables & 15
            tables += 1
            out.append(pair)
        # the first packet of an entry point has 8 bytes of adaptation field: flags and clock
        clock = bytes([7, 0x50]) + ((base := pts & (1 << 33) - 1) >> 1).to_bytes(4, "big") + bytes([(base & 1) << 7 | 0x7E, 0]) if entry else b""
        first = 184 - len(clock)
        n = 1 + max(0, -(-(len(pes) - first) // 184))
        packets = np.empty((n, PACKET), np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
        packets[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        packets[0, 1] |= 0x40
        if clock:
            packets[0, 3] |= 0x20
            packets[0, 4:12] = np.frombuffer(clock, np.uint8)
        data = np.frombuffer(pes, np.uint8)
        last = len(data) - (first + (n - 2) * 184 if n > 1 else 0)
        if n > 1:
            packets[0, PACKET - first :] = data[:first]
            packets[1:-1, 4:] = data[first : len(data) - last].reshape(n - 2, 184)
        room = first if n == 1 else 184
        if last < room:  # stuffing stands in the adaptation field
            end = packets[-1]
            had = 8 if n == 1 and clock else 0
            end[3] |= 0x20
            length = 184 - last
            if not had:
                end[4] = length - 1
                if length > 1:
                    end[5] = 0
                    end[6 : 4 + length] = 0xFF
            else:
                end[4] = length - 1
                end[4 + had : 4 + length] = 0xFF
        packets[-1, PACKET - last :] = data[len(data) - last :]
        out.append(packets)
    return np.concatenate(out).tobytes()


class Stamp(NamedTuple):
    """One elementary packet: its times in 90 kHz ticks (null: none), whether
    decoding can start there, and where its bytes begin in the stream."""

    pts: int | None
    dts: int | None
    random_access: bool
    offset: int


class Elementary(NamedTuple):
    program: int | None
    pid: int
    stream_type: int | None
    data: bytes
    stamps: list[Stamp]
    packets: int
    continuity_errors: int
    repeated: int


class Demuxed(NamedTuple):
    programs: dict[int, int]
    clocks: dict[int, int]
    streams: list[Elementary]
    packets: int
    lost_bytes: int
    table_errors: int


def _aligned(data: bytes) -> tuple[np.ndarray, int]:
    """Packets of a stream and the number of bytes outside of them."""
    whole = len(data) // PACKET
    a = np.frombuffer(data, np.uint8, whole * PACKET).reshape(whole, PACKET)
    if (a[:, 0] == SYNC).all():
        return a, len(data) - whole * PACKET
    raw, at, starts = np.frombuffer(data, np.uint8), 0, []
    while at + PACKET <= len(raw):
        # in step while the next sync bytes, as far as there are some, stand in place
        if all(p >= len(raw) or raw[p] == SYNC for p in (at, at + PACKET)):
            starts.append(at)
            at += PACKET
        else:
            at += 1
    a = np.stack([raw[s : s + PACKET] for s in starts]) if starts else np.empty((0, PACKET), np.uint8)
    return a, len(raw) - len(starts) * PACKET


def _sections(payloads: list[tuple[bool, bytes]]) -> Iterator[bytes]:
    """Sections of the packets of a PID: (begins one, payload) in order."""
    held = b""
    for begins, data in payloads:
        if begins:
            if not data:
                continue
            p = data[0] + 1
            held += data[1:p]
            if len(held) >= 3 and len(held) >= (n := 3 + ((held[1] & 15) << 8 | held[2])):
                yield held[:n]
            held = data[p:]
        elif held:
            held += data
        while len(held) >= 3 and held[0] != 0xFF and len(held) >= (n := 3 + ((held[1] & 15) << 8 | held[2])):
            yield held[:n]
            held = held[n:]


def _time(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


_COLUMNS = np.arange(PACKET, dtype=np.int16)


def demux(data: bytes) -> Demuxed:
    """Read a transport stream.

    Bytes out of step are skipped and counted, tables with a wrong checksum
    are counted and ignored, a repeated packet counts once, and a jump of a
    continuity counter that no discontinuity flag announces is an error. An
    elementary packet that does not begin within the stream is left out. An
    empty stream has no programs.
    """
    a, lost = _aligned(data)
    pid = (a[:, 1].astype(np.int32) & 0x1F) << 8 | a[:, 2]
    begins, control, counter = (a[:, 1] & 0x40) > 0, a[:, 3] >> 4 & 3, a[:, 3] & 15
    adapted = (control & 2) > 0
    length = np.where(adapted, a[:, 4], 0).astype(np.int16)
    flags = np.where(adapted & (length > 0), a[:, 5], 0)
    start = np.where(adapted, 5 + length, 4)
    has = ((control & 1) > 0) & (start < PACKET) & ((a[:, 1] & 0x80) == 0)

    def table(number: int, table_id: int) -> Iterator[bytes | None]:
        rows = np.flatnonzero((pid == number) & has)
        for s in _sections([(bool(begins[i]), a[i, start[i] :].tobytes()) for i in rows]):
            if s[0] == table_id:
                yield s if len(s) >= 12 and crc32_mpeg(s) == 0 else None

    programs, clocks, kinds, wrong = {}, {}, {}, 0
    for s in table(0, 0):
        if s is None:
            wrong += 1
            continue
        for k in range(8, len(s) - 7, 4):
            if number := s[k] << 8 | s[k + 1]:
                programs[number] = (s[k + 2] & 0x1F) << 8 | s[k + 3]
    for number, where in programs.items():
        for s in table(where, 2):
            if s is None:
                wrong += 1
            elif s[3] << 8 | s[4] == number:
                clocks[number] = (s[8] & 0x1F) << 8 | s[9]
                k = 12 + ((s[10] & 15) << 8 | s[11])
                while k + 5 <= len(s) - 4:
                    kinds[(s[k + 1] & 0x1F) << 8 | s[k + 2]] = number, s[k]
                    k += 5 + ((s[k + 3] & 15) << 8 | s[k + 4])
    streams = []
    tables = {0, 0x1FFF, *programs.values()}
    for p in sorted(kinds.keys() | ({int(x) for x in np.unique(pid)} - tables)):
        rows = np.flatnonzero((pid == p) & has)
        step = (counter[rows][1:].astype(np.int16) - counter[rows][:-1]) & 15
        again = np.concatenate([[False], (step == 0) & (a[rows][1:, 4:] == a[rows][:-1, 4:]).all(axis=1)]) if len(rows) else np.zeros(0, bool)
        told = (flags[rows] & 0x80) > 0
        errors = int(((step != 1) & ~again[1:] & ~told[1:]).sum()) if len(rows) else 0
        rows = rows[~again]
        part = a[rows]
        sizes = (PACKET - start[rows]).astype(np.int64)
        body = part[_COLUMNS >= start[rows][:, None]].tobytes()
        ends = np.cumsum(sizes)
        heads = np.flatnonzero(begins[rows])
        cuts = [int(ends[h] - sizes[h]) for h in heads] + [len(body)]
        out, stamps, offset = [], [], 0
        for h, b, e in zip(heads, cuts, cuts[1:], strict=False):
            if body[b : b + 3] != b"\x00\x00\x01" or e - b < 9:
                errors += 1
                continue
            said, shown, skip = int.from_bytes(body[b + 4 : b + 6], "big"), body[b + 7] >> 6, body[b + 8]
            pts = _time(body[b + 9 : b + 14]) if shown & 2 and skip >= 5 else None
            dts = _time(body[b + 14 : b + 19]) if shown == 3 and skip >= 10 else pts
            unit = body[b + 9 + skip : min(e, b + 6 + said) if said else e]
            stamps.append(Stamp(pts, dts, bool(flags[rows[h]] & 0x40), offset))
            out.append(unit)
            offset += len(unit)
        program, kind = kinds.get(p, (None, None))
        streams.append(Elementary(program, p, kind, b"".join(out), stamps, len(part), errors, int(again.sum())))
    return Demuxed(programs, clocks, streams, len(a), lost, wrong)


def padded(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length of a text (null: empty) and its bytes filled up with 0 to a
    positive multiple of 64."""
    b = (text or "").encode("utf-8", "surrogatepass")
    return len(b), b.ljust(max(1, -(-len(b) // BLOCK)) * BLOCK, b"\0")


def mux_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, media)``: each whole text as a transport stream.

    Null and empty texts give a stream of one block of zeros. Other columns of
    the input are left out, whatever their names. One row for each input row.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for text in batch.column(1).to_pylist():
                n, payload = padded(text)
                sizes.append(n)
                media.append(mux(payload))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    src = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id_col)


_STREAM = "array<struct<program:int,pid:int,stream_type:int,packets:int,continuity_errors:int,repeated:int,data:binary,stamps:array<struct<pts:long,dts:long,random_access:boolean,offset:long>>>>"


def demux_streams(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Add to each row what its transport stream holds: ``ts`` with packet and
    error counts and one entry for each elementary stream (see ``demux``).

    A null stream gives an empty ``streams`` array and zero counts. A column
    ``ts`` of the input is replaced; all others stay as they are.
    """
    bounded_batches(df.sparkSession)
    df = df.drop("ts")
    names = df.columns
    at = names.index(media_col)
    kind = f"struct<packets:int,lost_bytes:long,table_errors:int,programs:int,streams:{_STREAM}>"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"ts {kind}"])
    stamp = pa.struct([("pts", pa.int64()), ("dts", pa.int64()), ("random_access", pa.bool_()), ("offset", pa.int64())])
    stream = pa.struct([("program", pa.int32()), ("pid", pa.int32()), ("stream_type", pa.int32()), ("packets", pa.int32()), ("continuity_errors", pa.int32()), ("repeated", pa.int32()), ("data", pa.binary()), ("stamps", pa.list_(stamp))])
    whole = pa.struct([("packets", pa.int32()), ("lost_bytes", pa.int64()), ("table_errors", pa.int32()), ("programs", pa.int32()), ("streams", pa.list_(stream))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column(at).to_pylist():
                d = demux(media or b"")
                streams = [{"program": s.program, "pid": s.pid, "stream_type": s.stream_type, "packets": s.packets, "continuity_errors": s.continuity_errors, "repeated": s.repeated, "data": s.data, "stamps": [x._asdict() for x in s.stamps]} for s in d.streams]
                rows.append({"packets": d.packets, "lost_bytes": d.lost_bytes, "table_errors": d.table_errors, "programs": len(d.programs), "streams": streams})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, whole)], [*names, "ts"])

    return df.mapInArrow(run, schema)
