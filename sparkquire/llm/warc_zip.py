"""WARC records in ZIP packages: written as stored members with an index each, read back by ranges.

A package holds ``archive/<n>.warc.gz`` members and one ``indexes/<n>.cdxj`` member for each
of them.  Members are stored, never compressed; within them each record is a gzip member of
its own, as WARC has it, so that a range of the package is a range of whole records.  The reader parses the end record, the
ZIP64 end record and the central directory, finds where the stored members begin, reads
the indexes, and then reads spans of records straight from the package; nothing is
extracted, and neither side holds more than one span of records in memory.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import give_back
from .sieve import Sieve
from ..storage import cut, shared_dir, store

MEMBER_BYTES = 256 << 20
SPAN_BYTES = 8 << 20
SPAN_RECORDS = 2000
GZIP_LEVEL = 3
#: Signatures and lengths of ZIP structures, as the format fixes them.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{digest}')}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {length}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url))
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names lower-cased) and the payload behind the HTTP head."""
    end = data.index(b"\r\n\r\n")
    first, *lines = data[:end].decode("utf-8").split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = data[end + 4 : end + 4 + int(headers["content-length"])]
    if len(block) != int(headers["content-length"]) or data[end + 4 + len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short or overlong")
    return headers, block[block.index(b"\r\n\r\n") + 4 :]


class _Forward(io.RawIOBase):
    """A write-only stream that can't seek, so that zipfile streams to any store."""

    def __init__(self, out: BinaryIO):
        self.out, self.at = out, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        raise OSError("a stream")

    def flush(self) -> None:
        self.out.flush()


def write_package(uri: str, records: Iterable[tuple[dict, bytes]], member_bytes: int = MEMBER_BYTES) -> int:
    """Streams records (index entry, bytes) into a package; their number."""
    system, path = store(uri)
    n = member = 0
    records = iter(records)
    with system.open_output_stream(path) as raw, zipfile.ZipFile(_Forward(raw), "w", zipfile.ZIP_STORED, allowZip64=True) as package:
        held = next(records, None)
        while held is not None:
            index, at = [], 0
            with package.open(zipfile.ZipInfo(f"archive/{member:05d}.warc.gz"), "w", force_zip64=True) as out:
                while held is not None and (at == 0 or at + len(held[1]) <= member_bytes):
                    out.write(held[1])
                    index.append(json.dumps(held[0] | {"offset": at, "length": len(held[1]), "filename": f"{member:05d}.warc.gz"}))
                    at, n = at + len(held[1]), n + 1
                    held = next(records, None)
            package.writestr(zipfile.ZipInfo(f"indexes/{member:05d}.cdxj"), "".join(f"- {x}\n" for x in index))
            member += 1
    return n


def _end_of_directory(file, size: int) -> tuple[int, int, int]:
    """Entries, length and offset of the central directory."""
    tail_at = max(0, size - 22 - 0xFFFF - 20)
    file.seek(tail_at)
    tail = file.read(size - tail_at)
    fits = lambda at: at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail)
    at = tail.rfind(END)
    while at >= 0 and not fits(at):  # those bytes may also stand in the package's comment
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP package, or cut short")
    entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if entries == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF or tail[max(0, at - 20) : at][:4] == LOCATOR64:
        if tail[at - 20 : at - 16] != LOCATOR64:
            raise ValueError("ZIP64 values without a ZIP64 locator")
        file.seek(struct.unpack_from("<Q", tail, at - 12)[0])
        end64 = file.read(56)
        if end64[:4] != END64:
            raise ValueError("no ZIP64 end record where its locator points")
        entries, length, offset = struct.unpack_from("<QQQ", end64, 32)
    return entries, length, offset


def members(file, size: int) -> Iterator[tuple[str, int, int]]:
    """(name, where its data begins, length) of every member, all of which must be stored."""
    entries, length, offset = _end_of_directory(file, size)
    file.seek(offset)
    directory, at = file.read(length), 0
    for _ in range(entries):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError("the central directory is damaged")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        local = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # ZIP64: only the values that are saturated above, in this order
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            extra = extra[4 + n :]
        if method or flags & 1 or packed != full:
            raise ValueError(f"{name} is compressed or encrypted; only stored members can be read by ranges")
        file.seek(local)
        header = file.read(30)
        if header[:4] != LOCAL:
            raise ValueError(f"no local header for {name}")
        yield name, local + 30 + sum(struct.unpack_from("<HH", header, 26)), full
        at += 46 + n_name + n_extra + n_comment


def record_spans(uri: str, span_bytes: int = SPAN_BYTES, span_records: int = SPAN_RECORDS) -> Iterator[tuple[int, list[int]]]:
    """(where it begins in the package, lengths of its records) of runs of neighbouring records."""
    system, path = store(uri)
    with system.open_input_file(path) as file:
        found = {name: (at, n) for name, at, n in members(file, file.size())}
        for name in sorted(x for x in found if x.startswith("indexes/")):
            at, n = found[name]
            file.seek(at)
            begin, lengths = None, []
            for line in file.read(n).decode().splitlines():
                entry = json.loads(line.partition(" ")[2])
                where = found["archive/" + entry["filename"]][0] + entry["offset"]
                if begin is not None and (where != begin + sum(lengths) or sum(lengths) + entry["length"] > span_bytes or len(lengths) >= span_records):
                    yield begin, lengths
                    begin, lengths = None, []
                begin = where if begin is None else begin
                lengths.append(entry["length"])
            if begin is not None:
                yield begin, lengths


def read_span(uri: str, begin: int, lengths: list[int]) -> Iterator[tuple[dict[str, str], bytes]]:
    system, path = store(uri)
    with system.open_input_file(path) as file:
        file.seek(begin)
        data = file.read(sum(lengths))
    at = 0
    for n in lengths:
        yield parse_record(gzip.decompress(data[at : at + n]))
        at += n


def _writer(folder: str, date: str, member_bytes: int, unshared: Sieve | None = None):
    """Writes the rows of a task as one package: (path, records).  With ``unshared``, only those whose key it clears."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                if unshared is not None:
                    batch = batch.filter(pa.array(~unshared.passes(batch["key"].to_numpy())))
                for i in range(0, len(batch), 256):
                    for r in batch.slice(i, 256).to_pylist():
                        digest = base64.b32encode(r["sha"]).decode()
                        record = record_bytes(r["page_id"], r["url"], (r["html"] or "").encode(), digest, r["n"], r["least"], r["revisit"], date)
                        yield {"page_id": r["page_id"], "digest": digest}, gzip.compress(record, GZIP_LEVEL, mtime=0)

        rest = records()
        first = next(rest, None)
        if first is None:
            return
        path = f"{folder}/part-{uuid.uuid4().hex}.zip"
        n = write_package(path, (x for part in ([first], rest) for x in part), member_bytes)
        yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})
        give_back()

    return write


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, date: str = "2020-01-01T00:00:00Z", member_bytes: int = MEMBER_BYTES) -> DataFrame:
    """Writes each row as a record, a package a task; (path, records) of the packages.  page_id must be integer.

    Of rows with equal payloads of ``min_bytes`` or more, that of the smallest page_id is a
    response and the others are revisits of it; rows that share that smallest id are all
    responses, as is each row of a group without any id; null ids come last.  A null html is
    an empty payload.  A retried task writes a package of its own name, and only the packages
    in the returned (checkpointed) rows count.  Packages stay in ``folder`` until its owner deletes it.

    Payloads are compared by ids, digests and lengths.  A row whose payload nobody repeats is written where
    it is read; a revisit is written without its payload; of a repeated payload one copy is
    shuffled, that of the response.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumns({"sha": F.unhex(F.sha1(F.col("html").cast("binary"))), "n": F.octet_length("html").cast("long")})
    named = cut(rows.select("page_id", "url", "sha", "n"))
    groups = named.where(F.col("n") >= min_bytes).groupBy("sha", "n").agg(F.min("page_id").alias("least"), F.count("*").alias("copies"))
    shared = cut(groups.where("copies > 1 and least is not null").select("sha", "n", "least"))
    payload = F.xxhash64("sha", "n")
    unshared = Sieve(shared.select(payload.alias("key")))
    kind, none = rows.schema["page_id"].dataType, F.lit(None)
    alone = rows.select("page_id", "url", "html", "sha", "n", none.cast(kind).alias("least"), F.lit(False).alias("revisit"), payload.alias("key"))

    known = named.where(unshared.may(payload)).join(shared, ["sha", "n"], "left")
    revisit = F.coalesce(F.col("least").isNotNull() & ~(F.col("page_id").eqNullSafe(F.col("least"))), F.lit(False))
    known = cut(known.withColumn("revisit", revisit).select("page_id", "url", "sha", "n", "least", "revisit"))
    again = known.where("revisit").select("page_id", "url", none.cast("string").alias("html"), "sha", "n", "least", "revisit")
    firsts = known.where("not revisit").select("page_id", "sha", "n").distinct()
    row_key = F.xxhash64("page_id", "sha", "n")
    x, y = rows.where(Sieve(firsts.select(row_key.alias("key"))).may(row_key)).alias("x"), firsts.alias("y")
    wanted = F.col("x.page_id").eqNullSafe(F.col("y.page_id")) & (F.col("x.sha") == F.col("y.sha")) & (F.col("x.n") == F.col("y.n"))
    firsts = x.join(y, wanted, "left_semi").select("page_id", "url", "html", "sha", "n", none.cast(kind).alias("least"), F.lit(False).alias("revisit"))

    system, path = store(folder)
    system.create_dir(path, recursive=True)
    parts = alone.mapInArrow(_writer(folder, date, member_bytes, unshared), "path string, records long")
    for part in (again, firsts):
        parts = parts.union(part.mapInArrow(_writer(folder, date, member_bytes), "path string, records long"))
    return cut(parts)


def read_archives(packages: DataFrame, span_bytes: int = SPAN_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of every record
    of the packages (column path), in two steps: spans of records from the directories and
    indexes, then one range read a span.  A response's digest is checked against its payload;
    a revisit has the digest and length of the full payload from its header, and no payload.  Page ids
    must be integers in the records."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                for begin, lengths in record_spans(path, span_bytes):
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([begin], pa.int64()), pa.array([lengths], pa.list_(pa.int64()))], ["path", "begin", "lengths"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for span in batch.to_pylist():
                out = []
                for h, payload in read_span(span["path"], span["begin"], span["lengths"]):
                    kind, digest = h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (digest_of(payload) != digest or len(payload) != int(h["x-payload-length"])):
                        raise ValueError(f"a payload of {span['path']} differs from its digest")
                    refers = h.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">")
                    out.append((int(h["x-page-id"]) if "x-page-id" in h else None, int(h["x-payload-length"]), digest, kind, int(refers) if refers else None, h.get("warc-target-uri"), payload.decode() if kind == "response" else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.large_string()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])
        give_back()

    spans = packages.mapInArrow(locate, "path string, begin long, lengths array<long>")
    spans = cut(spans)
    # rows of a few numbers stand for much work: they are dealt by number, not by size
    spans = spans.repartition(max(1, min(spans.count(), 8 * spans.sparkSession.sparkContext.defaultParallelism)), "path", "begin")
    return spans.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload string")


def archive_folder(spark) -> str:
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
