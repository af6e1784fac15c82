"""Media columns as MPEG transport streams (operator 10).

``mux`` stores bytes as a transport stream with one program and one private elementary stream;
``demux`` parses any transport stream column: it reads the program tables and checks their
checksums, follows the elementary streams, checks continuity counters, reassembles elementary
packets and returns their time stamps with the packets at which decoding may start.  A row is the first stream of
the first program; with ``every``, each stream of each program is a row, numbered by ``stream``.  A counter may jump where its packet flags
a discontinuity.  Tables count as they first come whole with a right checksum; later versions are not followed, scrambled packets are
left out.

Both work row by row on whole streams; a task holds one batch of rows, and a lost task is simply
run again.  Defined results: null bytes count as none; a stream whose length is no multiple of 188,
with a lost sync byte, without valid tables or with a gap in its counters still gives a row, with
``valid`` false and whatever could be read; a packet sent twice is used once; bytes of any length are stored whole, and a task
holds a few times the longest row; an empty table gives an empty result.  Other columns are kept by
neither function, so they cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm.common import table, utf8

# Fixed values of ISO/IEC 13818-1.
PACKET, SYNC, PAT_PID = 188, 0x47, 0
CRC_POLYNOMIAL = 0x04C11DB7
STREAM_TYPE_PRIVATE, STREAM_ID_PRIVATE = 0x06, 0xBD
CLOCK = 90_000

# Choices of this writer.
PMT_PID, ES_PID, PROGRAM = 0x1000, 0x0100, 1
UNIT_BYTES = 32_768
UNIT_TICKS = CLOCK // 25
OUT_ROWS = 1_000

MUX_SCHEMA = "doc_id long, n_bytes long, media binary"
DEMUX_SCHEMA = (
    "doc_id long, n_bytes long, media binary, stream int, payload binary, valid boolean, es_pid int, stream_type int, "
    "pts array<long>, random_access array<long>, cc_errors int, packets int"
)


@lru_cache(1)
def _crc_table() -> tuple[int, ...]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ CRC_POLYNOMIAL if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return tuple(out)


@lru_cache(256)
def crc32_mpeg(section: bytes) -> int:
    """The checksum of program tables; 0 over a section together with its own checksum."""
    t, c = _crc_table(), 0xFFFFFFFF
    for b in section:
        c = ((c << 8) & 0xFFFFFFFF) ^ t[(c >> 24) ^ b]
    return c


def _section(body: bytes) -> bytes:
    return body + crc32_mpeg(body).to_bytes(4, "big")


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The packets of the program association and program map tables, counters still 0."""
    pat = _section(bytes([0x00, 0xB0, 13, 0, 1, 0xC1, 0, 0]) + PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(
        bytes([0x02, 0xB0, 18]) + PROGRAM.to_bytes(2, "big") + bytes([0xC1, 0, 0]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"
        + bytes([STREAM_TYPE_PRIVATE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"
    )
    out = []
    for pid, section in ((PAT_PID, pat), (PMT_PID, pmt)):
        head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
        out.append(np.frombuffer((head + section).ljust(PACKET, b"\xff"), np.uint8))
    return out[0], out[1]


def _stamp(ticks: int) -> bytes:
    """A presentation time stamp in its five bytes with marker bits."""
    t = ticks % (1 << 33)
    return bytes([0x21 | (t >> 29) & 0x0E, (t >> 22) & 0xFF, 0x01 | (t >> 14) & 0xFE, (t >> 7) & 0xFF, 0x01 | (t << 1) & 0xFE])


def mux_bytes(payload: bytes) -> bytes:
    """A transport stream that carries the payload, a new elementary packet after each 32 KiB.

    Each elementary packet starts with both tables, a clock reference and the random-access flag, so
    decoding can begin at any of them.
    """
    parts, counter = [], 0
    for k, at in enumerate(range(0, max(1, len(payload)), UNIT_BYTES)):
        unit, ticks = payload[at : at + UNIT_BYTES], k * UNIT_TICKS
        head = b"\x00\x00\x01" + bytes([STREAM_ID_PRIVATE]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(ticks)
        data = np.frombuffer(head + unit, np.uint8)
        n = 1 + max(0, -(-(len(data) - 176) // 184))
        out = np.full((n + 2, PACKET), 0xFF, np.uint8)
        out[0], out[1] = _tables()
        out[:2, 3] |= k & 15
        es = out[2:]
        es[:, 0], es[:, 1], es[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
        es[:, 3] = 0x10 | ((counter + np.arange(n)) & 15)
        counter += n
        es[0, 1] |= 0x40
        es[0, 3] |= 0x20
        first = min(176, len(data))
        base = ticks % (1 << 33)
        es[0, 4:12] = (183 - first, 0x50, (base >> 25) & 0xFF, (base >> 17) & 0xFF, (base >> 9) & 0xFF, (base >> 1) & 0xFF, (base & 1) << 7 | 0x7E, 0)
        es[0, PACKET - first :] = data[:first]
        if n > 1:
            es[1 : n - 1, 4:] = data[first : first + 184 * (n - 2)].reshape(-1, 184)
            last = data[first + 184 * (n - 2) :]
            if len(last) < 184:  # stuffing in an adaptation field
                es[-1, 3] |= 0x20
                es[-1, 4] = 183 - len(last)
                if len(last) < 183:
                    es[-1, 5] = 0
            es[-1, PACKET - len(last) :] = last
        parts.append(out.tobytes())
    return b"".join(parts)


def _sections(packets: np.ndarray, table_id: int) -> dict[tuple[int, int], bytes]:
    """The whole sections with this id and a right checksum among the packets of one PID, by table and section number, as they first come."""
    out: dict[tuple[int, int], bytes] = {}
    body = b""
    for row in packets:
        p = row.tobytes()
        at = 4 + (1 + p[4] if p[3] & 0x20 else 0)
        if not p[3] & 0x10 or at >= PACKET:
            continue
        if p[1] & 0x40:
            at += 1 + p[at]
            body = b""
        body += p[at:]
        while len(body) >= 3 and body[0] != 0xFF:
            size = 3 + ((body[1] & 0x0F) << 8 | body[2])
            if len(body) < size:
                break
            section, body = body[:size], body[size:]
            if section[0] == table_id and size >= 12 and crc32_mpeg(section) == 0:
                out.setdefault((section[3] << 8 | section[4], section[6]), section)
    return out


def _programs(section: bytes) -> list[tuple[int, int]]:
    return [((section[i] << 8) | section[i + 1], (section[i + 2] & 0x1F) << 8 | section[i + 3]) for i in range(8, len(section) - 7, 4)]


def _streams(section: bytes) -> list[tuple[int, int]]:
    if len(section) < 16:
        return []
    at, out = 12 + ((section[10] & 0x0F) << 8 | section[11]), []
    while at + 5 <= len(section) - 4:
        out.append((section[at], (section[at + 1] & 0x1F) << 8 | section[at + 2]))
        at += 5 + ((section[at + 3] & 0x0F) << 8 | section[at + 4])
    return out


def _elementary(a: np.ndarray, pid: np.ndarray, es_pid: int) -> dict:
    """What the packets of one PID carry."""
    out = {"pts": []}
    where = np.flatnonzero(pid == es_pid)
    where = where[(a[where, 3] & 0x10 != 0) & (a[where, 3] & 0xC0 == 0)]
    es = a[where]
    step = np.diff((es[:, 3] & 15).astype(np.int16)) % 16
    again = np.concatenate([[False], (step == 0) & (es[1:, 4:] == es[:-1, 4:]).all(axis=1)]) if len(es) else np.zeros(0, bool)
    es, where = es[~again], where[~again]
    adapted = es[:, 3] & 0x20 != 0
    flags = np.where(adapted & (es[:, 4] > 0), es[:, 5], 0)
    step = np.diff((es[:, 3] & 15).astype(np.int16)) % 16
    out["cc_errors"] = int(((step != 1) & (flags[1:] & 0x80 == 0)).sum())
    start = np.where(adapted, 5 + es[:, 4].astype(np.int32), 4)
    opens = es[:, 1] & 0x40 != 0
    out["random_access"] = where[flags & 0x40 != 0].tolist()
    size = np.maximum(PACKET - start, 0)
    body = es[np.arange(PACKET) >= start[:, None]].tobytes()
    ends = np.cumsum(size)
    begins = (ends - size)[opens].tolist()
    units, good = [], bool(begins) and begins[0] == 0
    for b, e in zip(begins, [*begins[1:], len(body)][: len(begins)], strict=True):
        unit = body[b:e]
        if len(unit) < 9 or unit[:3] != b"\x00\x00\x01":
            good = False
            continue
        length = (unit[4] << 8) | unit[5]
        if unit[7] & 0x80 and len(unit) >= 14:
            p = unit[9:14]
            out["pts"].append((p[0] & 0x0E) << 29 | p[1] << 22 | (p[2] & 0xFE) << 14 | p[3] << 7 | p[4] >> 1)
        end = 6 + length if length else len(unit)
        good = good and end == len(unit)
        units.append(unit[9 + unit[8] : end])
    return out | {"payload": b"".join(units), "valid": good and not out["cc_errors"]}


def demux_streams(media: bytes) -> Iterator[dict]:
    """What a transport stream holds, for each elementary stream of each program; one empty result if there is none."""
    empty = {"stream": 0, "payload": b"", "valid": False, "es_pid": None, "stream_type": None, "pts": [], "random_access": [], "cc_errors": 0, "packets": len(media) // PACKET}
    a = np.frombuffer(media, np.uint8, empty["packets"] * PACKET).reshape(-1, PACKET)
    whole = bool(len(media)) and len(media) % PACKET == 0 and bool((a[:, 0] == SYNC).all())
    a = a[(a[:, 0] == SYNC) & (a[:, 1] & 0x80 == 0)]
    pid = (a[:, 1] & 0x1F).astype(np.int32) << 8 | a[:, 2]
    n = 0
    for section in _sections(a[pid == PAT_PID], 0x00).values():
        for program, pmt_pid in _programs(section):
            tables = _sections(a[pid == pmt_pid], 0x02) if program else {}
            for kind, es_pid in (x for (number, _), t in tables.items() if number == program for x in _streams(t)):
                made = empty | {"stream": n, "stream_type": kind, "es_pid": es_pid} | _elementary(a, pid, es_pid)
                yield made | {"valid": made["valid"] and whole}
                n += 1
    if not n:
        yield empty


def demux_bytes(media: bytes) -> dict:
    """What a transport stream holds: the first elementary stream of its first program."""
    return next(demux_streams(media))


def _in_parts(made: Iterator[tuple], names: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (id, size, values by name) as record batches of at most OUT_ROWS rows and some megabytes."""
    rows: list[tuple] = []
    held = 0
    for i, n, x in made:
        rows.append((i, n, *(x[k] for k in names)))
        held += len(x["media"])
        if len(rows) == OUT_ROWS or held > 16 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def mux(rows: DataFrame) -> DataFrame:
    """(doc_id, bytes) to (doc_id, n_bytes, media): bytes padded with zeros to a positive multiple of 64 and stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
        for b in batches:
            bodies = [x or b"" for x in b.column("bytes").to_pylist()]
            made = ((i, len(x), {"media": mux_bytes(x.ljust(max(64, -(-len(x) // 64) * 64), b"\0"))}) for i, x in zip(b.column("doc_id").to_pylist(), bodies, strict=True))
            yield from _in_parts(made, ["media"], schema)

    return rows.select(F.col("doc_id").cast("long"), "bytes").mapInArrow(run, MUX_SCHEMA)


def demux(streams: DataFrame, every: bool = False) -> DataFrame:
    """(doc_id, n_bytes, media) with the payload, time stamps and random-access packets read back from the media, of the first stream or of every one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        kinds = {"media": pa.binary(), "stream": pa.int32(), "payload": pa.binary(), "valid": pa.bool_(), "es_pid": pa.int32(), "stream_type": pa.int32(), "pts": longs, "random_access": longs, "cc_errors": pa.int32(), "packets": pa.int32()}
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), *kinds.items()])
        for b in batches:
            media = [x or b"" for x in b.column("media").to_pylist()]
            ids, sizes = b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist()
            rows = ((i, n, {"media": x} | found) for i, n, x in zip(ids, sizes, media, strict=True) for found in (demux_streams(x) if every else [demux_bytes(x)]))
            yield from _in_parts(rows, list(kinds), schema)

    return streams.select(F.col("doc_id").cast("long"), "n_bytes", "media").mapInArrow(run, DEMUX_SCHEMA)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes as a transport stream, read back and described."""
    docs = table(spark, sf_dir, "documents").select("doc_id", utf8(F.col("text")).alias("bytes"))
    got = demux(mux(docs))
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("valid="), F.col("valid").cast("string")),
        F.concat(F.lit("stream="), F.col("es_pid"), F.lit("/"), F.col("stream_type")),
        F.concat(F.lit("cc_errors="), F.col("cc_errors")),
        F.concat(F.lit("packets="), F.col("packets")),
        F.concat(F.lit("units="), F.size("pts")),
        F.concat(F.lit("pts="), F.element_at("pts", 1), F.lit("-"), F.element_at("pts", -1)),
        F.concat(F.lit("random_access="), F.size("random_access")),
    )
    return got.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), "pts", "random_access",
    )


QUERIES = {"op10_media": op10_media}
ORACLE_SQL: dict[str, str] = {}
