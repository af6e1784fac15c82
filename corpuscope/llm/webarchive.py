"""Web archives packaged in ZIP files: writer, and reader by ranges (operator 3).

An archive is a ZIP file whose members are stored, not compressed: ``archive/data.warc.gz`` holds WARC
records, each a gzip member of its own; ``indexes/index.cdxj`` has their offsets and lengths.  The reader finds
the central directory from the end of the file (the ZIP64 one where there is one), locates the
stored members, reads the index and then only ranges of the archive member; nothing is extracted.

Archives are written and read in place through pyarrow's file systems, by URI, so that they can lie in
any shared store that it knows.  Tasks write files named by task and attempt, and only the files of the attempt
that Spark commits appear in the manifest table; so a lost task leaves files that nobody reads.  A
writer holds one record and the index of one archive (``ARCHIVE_BYTES`` at most), a reader one span.

Equal payloads of at least ``MIN_REVISIT`` bytes are stored once: the record with the smallest page id is a
response, others are revisits that refer to it.

Defined results: a null html is an empty payload; a null url is replaced by a URN of the page; rows that share the
smallest id are all responses; a row without an id is a revisit where a row with one has the
same payload, otherwise a response; payloads of any length are whole, a record being what a task holds at least; an empty table gives
no archives and no rows; extra columns are not kept, so their names cannot clash.

Archives of other writers: an index may be gzipped and begin with header lines; an archive member that is not stored, or that the
index names but the archive lacks, cannot be range-read and gives one record of type ``unreadable`` for each of its index lines; so does a
record that is damaged.  A file that is no whole ZIP, or has no index that can be read, gives one such record.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm.common import table, utf8
from corpuscope.shared import new_path, written

MIN_REVISIT = 100
ARCHIVE_BYTES = 64 << 20
SPAN_BYTES = 2 << 20
SALTS = 16
DATE = "2020-01-01T00:00:00Z"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

# Fixed values of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64, DESCRIPTOR = (0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50, 0x08074B50)
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


# --- the container -------------------------------------------------------------------------------


class ZipWriter:
    """Stored members one after another to a stream that cannot seek, with ZIP64 sizes throughout."""

    def __init__(self, out) -> None:  # noqa: ANN001
        self.out, self.at, self.members = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def start(self, name: str) -> None:
        raw = name.encode()
        self.now = [raw, self.at, 0, 0]
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x0808, 0, 0, 0x21, 0, FULL32, FULL32, len(raw), len(extra)) + raw + extra)

    def write(self, data: bytes) -> None:
        self.now[2] = zlib.crc32(data, self.now[2])
        self.now[3] += len(data)
        self._put(data)

    def end(self) -> None:
        self._put(struct.pack("<IIQQ", DESCRIPTOR, self.now[2], self.now[3], self.now[3]))
        self.members.append(tuple(self.now))

    def close(self) -> None:
        start = self.at
        for raw, at, crc, size in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x0808, 0, 0, 0x21, crc, FULL32, FULL32, len(raw), len(extra), 0, 0, 0, 0, FULL32) + raw + extra)
        size, n = self.at - start, len(self.members)
        where = self.at
        self._put(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, start))
        self._put(struct.pack("<IIQI", LOCATOR64, 0, where, 1))
        self._put(struct.pack("<IHHHHIIH", END, 0, 0, FULL16, FULL16, FULL32, FULL32, 0))


def read_at(f, at: int, n: int) -> bytes:  # noqa: ANN001
    f.seek(at)
    return f.read(n)


def members(f, size: int) -> dict[str, tuple[int, int, int]]:  # noqa: ANN001
    """Members of a ZIP file by name: method, offset of the local header, stored size."""
    tail_at = max(0, size - 22 - FULL16)
    tail = read_at(f, tail_at, size - tail_at)
    at = tail.rfind(struct.pack("<I", END))
    if at < 0 or len(tail) - at < 22:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<HII", tail, at + 10)
    locator = tail_at + at - 20
    if locator >= 0 and (FULL16 == n or FULL32 in (length, start)):
        sig, _, where, _ = struct.unpack("<IIQI", read_at(f, locator, 20))
        if sig == LOCATOR64:
            head = read_at(f, where, 56)
            if struct.unpack_from("<I", head)[0] != END64:
                raise ValueError("no ZIP64 end of central directory")
            n, length, start = struct.unpack_from("<QQQ", head, 32)
    directory, out, p = read_at(f, start, length), {}, 0
    for _ in range(n):
        sig, flags, method, stored, plain, n_name, n_extra, n_note, offset = struct.unpack_from("<I4xHH8xIIHHH8xI", directory, p)
        if sig != CENTRAL:
            raise ValueError("damaged central directory")
        name = directory[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, q = directory[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            kind, k = struct.unpack_from("<HH", extra, q)
            if kind == 1:  # the fields that are full in the entry, in this order
                wide = iter(struct.unpack_from(f"<{k // 8}Q", extra, q + 4))
                plain = next(wide) if plain == FULL32 else plain
                stored = next(wide) if stored == FULL32 else stored
                offset = next(wide) if offset == FULL32 else offset
            q += 4 + k
        out[name] = (method, offset, stored)
        p += 46 + n_name + n_extra + n_note
    return out


def body_at(f, header_at: int) -> int:  # noqa: ANN001
    """Where a member's bytes begin: behind its local header, whose lengths can differ from the directory's."""
    sig, n_name, n_extra = struct.unpack("<I22xHH", read_at(f, header_at, 30))
    if sig != LOCAL:
        raise ValueError("no local header")
    return header_at + 30 + n_name + n_extra


def whole_member(f, entry: tuple[int, int, int]) -> bytes:  # noqa: ANN001
    """A small member such as an index, stored or deflated."""
    method, header_at, stored = entry
    data = read_at(f, body_at(f, header_at), stored)
    return data if method == 0 else zlib.decompress(data, -15)


def store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


# --- records -------------------------------------------------------------------------------------


def page_urn(page_id: int | None) -> str:
    return f"urn:page:{'none' if page_id is None else page_id}"


def page_of(urn: str | None) -> int | None:
    m = re.fullmatch(r"<?urn:page:(-?\d+)>?", urn or "")
    return int(m[1]) if m else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> tuple[bytes, str]:
    """A WARC record as one gzip member, and its target."""
    target = quote(url, safe=":/?#[]@!$&'()*+,;=%~-._") if url else page_urn(page_id)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{page_urn(page_id)}>", f"WARC-Target-URI: {target}",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{page_urn(refers_to)}>"]
    else:
        block += payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + made.flush(), target


def _fields(head: bytes) -> dict[str, str]:
    pairs = (x.split(":", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def parse(member: bytes) -> dict:
    """A record from its gzip member: headers, payload, and the payload's own length and digest."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    claimed = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "response":
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    else:
        size, digest = int(_fields(http).get("content-length", 0)), claimed
    return {
        "page_id": page_of(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None, "payload_bytes": size,
        "payload_digest": digest, "record_type": kind, "refers_to": page_of(fields.get("warc-refers-to")), "intact": digest == claimed,
    }


# --- operators -----------------------------------------------------------------------------------


def with_roles(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Pages with payload, digest, and what they are: response, or revisit of the page in ``refers_to``.

    Roles are decided on rows of id and digest, salted, since one digest can be that of many pages; payloads meet them by page
    and digest.
    """
    rows = pages.select(F.col("page_id").cast("long"), "url", utf8(F.col("html")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    narrow = rows.where(F.length("payload") >= min_bytes).groupBy("page_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.sum("n").alias("n")).where("n > 1")
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    revisits = narrow.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS).cast("long"))).join(first.select("digest", "first", salts), ["digest", "salt"])
    revisits = revisits.where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("role_page"), F.col("digest").alias("role_digest"), "first")
    # rows without an id would be one key: they meet their digests' rows under the digest
    key = lambda page, digest: F.coalesce(page.cast("string"), digest)
    same = (key(F.col("page_id"), F.col("digest")) == key(F.col("role_page"), F.col("role_digest"))) & (F.col("digest") == F.col("role_digest"))
    joined = rows.join(revisits.hint("merge"), same, "left")
    return joined.select("page_id", "url", "payload", "digest", F.col("first").isNotNull().alias("revisit"), F.col("first").alias("refers_to"))


def write_archives(rows: DataFrame, uri: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of ``with_roles`` below a URI; the manifest (path, records, bytes) of what was written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(uri)
        fs.create_dir(base, recursive=True)
        context, number, archive, lines = TaskContext.get(), 0, None, []
        stream = path = None

        def finish() -> pa.RecordBatch:
            archive.end()
            archive.start(INDEX)
            archive.write("".join(sorted(lines)).encode())
            archive.end()
            archive.start("datapackage.json")
            archive.write(json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}).encode())
            archive.end()
            archive.close()
            stream.close()
            return pa.RecordBatch.from_pydict({"path": [f"{uri}/{path}"], "records": [len(lines)], "bytes": [archive.at]})

        for b in batches:
            for page_id, url, payload, digest, revisit, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "revisit", "refers_to")), strict=True):
                if archive is None:
                    path = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{number:04d}.wacz"
                    stream = fs.open_output_stream(f"{base}/{path}")
                    archive, lines, number = ZipWriter(stream), [], number + 1
                    archive.start(DATA)
                member, target = record(page_id, url, payload, digest, refers_to, revisit)
                entry = {"url": target, "digest": f"sha256:{digest}", "offset": archive.now[3], "length": len(member), "filename": DATA}
                archive.write(member)
                lines.append(f"{target} {re.sub('[^0-9]', '', DATE)} {json.dumps(entry)}\n")
                if archive.now[3] >= archive_bytes:
                    yield finish()
                    archive = None
        if archive is not None:
            yield finish()

    return rows.mapInArrow(run, "path string, records long, bytes long")


def index_lines(f, found: dict[str, tuple[int, int, int]]) -> list[dict]:  # noqa: ANN001
    """The index lines (filename, offset, length) of all indexes of an archive, gzipped or not, without header lines."""
    out = []
    for name in sorted(found):
        if not name.startswith("indexes/"):
            continue
        body = whole_member(f, found[name])
        if body[:2] == b"\x1f\x8b":
            body = gzip.decompress(body)
        for line in body.decode("utf-8", "replace").splitlines():
            at = line.find("{")
            try:
                entry = json.loads(line[at:]) if at >= 0 else {}
                out.append({"filename": entry["filename"], "offset": int(entry["offset"]), "length": int(entry["length"])})
            except (ValueError, KeyError, TypeError):
                continue  # a header or meta line
    return sorted(out, key=lambda r: (r["filename"], r["offset"]))


def locate(manifest: DataFrame, span_bytes: int = SPAN_BYTES) -> DataFrame:
    """Spans of consecutive records of each archive, from its index: path, start, length, records' offsets in the span.

    What cannot be located is a span without a start, with an offset for each lost record.
    """
    longs = pa.list_(pa.int64())

    def span(path: str, start: int | None, length: int, offsets: list[int]) -> pa.RecordBatch:
        made = [pa.array([path]), pa.array([start], pa.int64()), pa.array([length], pa.int64()), pa.array([offsets], longs)]
        return pa.RecordBatch.from_arrays(made, ["path", "start", "length", "offsets"])

    def spans(path: str) -> Iterator[pa.RecordBatch]:
        fs, at = store(path)
        with fs.open_input_file(at) as f:
            found = members(f, f.size())
            rows = index_lines(f, found)
            base = {n: (body_at(f, e[1]), e[2]) for n, e in found.items() if e[0] == 0}
        name = lambda r: r["filename"] if r["filename"] in found else f"archive/{r['filename']}"
        good = [r for r in rows if name(r) in base and 0 <= r["offset"] <= r["offset"] + r["length"] <= base[name(r)][1]]
        if len(good) < len(rows) or not rows:
            yield span(path, None, 0, [0] * max(1, len(rows) - len(good)))
        held: list[tuple[int, int]] = []
        for r in [*good, None]:
            here = (base[name(r)][0] + r["offset"], r["length"]) if r else None
            if held and (here is None or here[0] != sum(held[-1]) or here[0] - held[0][0] >= span_bytes):
                yield span(path, held[0][0], sum(held[-1]) - held[0][0], [o - held[0][0] for o, _ in held])
                held = []
            if here:
                held.append(here)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                try:
                    yield from list(spans(path))
                except (ValueError, struct.error, zlib.error, EOFError, gzip.BadGzipFile):
                    yield span(path, None, 0, [0])

    return manifest.select("path").mapInArrow(run, "path string, start long, length long, offsets array<long>")


UNREADABLE = {"page_id": None, "url": None, "payload": None, "payload_bytes": 0, "payload_digest": None, "record_type": "unreadable", "refers_to": None, "intact": False}


def parsed(member: bytes) -> dict:
    """A record, or what stands for one that is damaged."""
    try:
        return parse(member)
    except (ValueError, KeyError, zlib.error):
        return dict(UNREADABLE)


def read_records(spans: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of spans, each span read by one range request."""
    text = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())]
    if with_payload:
        text, kinds = text + ", payload binary", [*kinds, ("payload", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, length, offsets in zip(*(b.column(c).to_pylist() for c in ("path", "start", "length", "offsets")), strict=True):
                if start is None:
                    made = [dict(UNREADABLE) for _ in offsets]
                else:
                    fs, at = store(path)
                    with fs.open_input_file(at) as f:
                        data = read_at(f, start, length)
                    made = [parsed(data[x:y]) for x, y in zip(offsets, [*offsets[1:], length], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in kinds], [k for k, _ in kinds])

    return spans.mapInArrow(run, text)


def op3_webarchive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back."""
    uri = new_path(spark, "archives")
    manifest = written(write_archives(with_roles(table(spark, sf_dir, "pages")), uri), "archive-manifest")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spans = locate(manifest).repartition(parts, "path", "start")
    return read_records(spans, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op3_webarchive": op3_webarchive}
ORACLE_SQL = {
    "op3_webarchive": f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {MIN_REVISIT} GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest"""
}
