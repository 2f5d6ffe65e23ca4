"""Web archives (WARC) packed in ZIP files, written by Spark tasks and read back by byte ranges.

An archive is a ZIP file of two *stored* members: ``archive/data.warc.gz`` (one gzip member per record) and
``indexes/index.cdxj`` (a line per record with offset and length inside the first). The reader parses the end
record, the ZIP64 locator and end record, and the central directory; it finds where each stored member begins
and then reads ranges of records. Nothing is extracted.

Defined cases: a null payload is an empty one; null urls leave the target header out; a null page_id is kept and
is never the response of a larger payload group that has numbered pages; equal page_ids with equal payloads are
all responses; control characters of a url are percent-encoded; empty tables give archives without records, or
none. Columns beyond the three used are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfolio.llm.common import file_system, new_file, new_path, stored

# Fixed values of the ZIP format: signatures, and the field layout after them.
END, END_LAYOUT = b"PK\x05\x06", "<4HIIH"
END64, END64_LAYOUT = b"PK\x06\x06", "<QHHIIQQQQ"
LOCATOR64, LOCATOR64_LAYOUT = b"PK\x06\x07", "<IQI"
CENTRAL, CENTRAL_LAYOUT = b"PK\x01\x02", "<6H3I5H2I"
LOCAL, LOCAL_LAYOUT = b"PK\x03\x04", "<5H3I2H"
MAX32, MAX16, ZIP64_FIELD = 0xFFFFFFFF, 0xFFFF, 1

WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
MEMBERS = "path string, member string, method int, offset long, size long, crc long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


# Which pages are responses -----------------------------------------------------


def with_record_types(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """(page_id, url, payload, payload_digest, payload_bytes, record_type, refers_to) of ``pages(page_id, url, html)``.

    Of equal payloads of at least ``least_bytes`` the one of the largest page_id is the response. The largest page
    per digest comes from a partial aggregate, so a payload of a third of all pages sends one row per task.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    copies = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null")
    first = F.col("last").isNull() | F.col("page_id").eqNullSafe(F.col("last"))
    return rows.join(copies.drop("n"), "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_digest", "payload_bytes", F.when(first, "response").otherwise("revisit").alias("record_type"), F.when(~first, F.col("last")).alias("refers_to")
    )


# Writing -------------------------------------------------------------------------


def _record_id(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def warc_record(row: dict) -> bytes:
    """One record. A revisit keeps the HTTP header, with the payload's length, and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", _record_id(row["page_id"])), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if row["url"] is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"])))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    body = http
    if row["record_type"] == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(row["refers_to"]))]
    else:
        body += row["payload"]
    head.append(("Content-Length", str(len(body))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(records: DataFrame, folder: str, max_bytes: int = 256 << 20) -> DataFrame:
    """Write one or more archives per partition and return the stored manifest (path, n_records, warc_bytes).

    A task streams: it holds one record, and the index lines of the archive it writes. A new archive begins
    at ``max_bytes``, so no file grows with its partition.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for k in range(0, b.num_rows, 64) for row in b.slice(k, 64).to_pylist())
        row = next(rows, None)
        while row is not None:
            lines, offset = [], 0
            with new_file(folder, "pages.wacz") as (path, stream):
                with zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED) as archive:
                    with archive.open(zipfile.ZipInfo(WARC_MEMBER), "w", force_zip64=True) as member:
                        while row is not None and offset < max_bytes:
                            packed = _gzip(warc_record(row))
                            member.write(packed)
                            lines.append(json.dumps({"offset": offset, "length": len(packed), "page_id": row["page_id"]}))
                            offset += len(packed)
                            row = next(rows, None)
                    with archive.open(zipfile.ZipInfo(INDEX_MEMBER), "w", force_zip64=True) as member:
                        for line in lines:
                            member.write(line.encode() + b"\n")
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [len(lines)], "warc_bytes": [offset]})

    return stored(records.mapInArrow(write, "path string, n_records long, warc_bytes long"), "manifest")


# Reading -------------------------------------------------------------------------


def read_range(path: str, offset: int, length: int) -> bytes:
    system, at = file_system(path)
    with system.open_input_file(at) as f:
        return f.read_at(length, offset)


def zip_members(path: str) -> list[dict]:
    """The members that the directories of a ZIP file list, with the offset at which a stored member's bytes begin."""
    system, at = file_system(path)
    with system.open_input_file(at) as f:
        size = f.size()
        tail_at = max(0, size - (22 + MAX16))
        tail = f.read_at(size - tail_at, tail_at)
        found = tail.rfind(END)
        while found >= 0 and (found + 22 > len(tail) or found + 22 + struct.unpack_from("<H", tail, found + 20)[0] != len(tail)):
            found = tail.rfind(END, 0, found)  # the signature can also stand in a comment
        if found < 0:
            raise ValueError(f"{path} has no end record of a ZIP file")
        _, _, _, count, length, start, _ = struct.unpack_from(END_LAYOUT, tail, found + 4)
        locator = f.read_at(20, tail_at + found - 20) if tail_at + found >= 20 else b""
        if locator[:4] != LOCATOR64 and (count == MAX16 or MAX32 in (length, start)):
            raise ValueError(f"{path} needs a ZIP64 directory and has none")
        if locator[:4] == LOCATOR64:
            _, end64_at, _ = struct.unpack_from(LOCATOR64_LAYOUT, locator, 4)
            end64 = f.read_at(56, end64_at)
            if end64[:4] != END64:
                raise ValueError(f"{path}: no ZIP64 end record at {end64_at}")
            *_, count, length, start = struct.unpack_from(END64_LAYOUT, end64, 4)
        central, members, pos = f.read_at(length, start), [], 0
        for _ in range(count):
            if central[pos : pos + 4] != CENTRAL:
                raise ValueError(f"{path}: broken central directory at {pos}")
            _, _, _, method, _, _, crc, packed, plain, n_name, n_extra, n_comment, _, _, _, local = struct.unpack_from(CENTRAL_LAYOUT, central, pos + 4)
            name = central[pos + 46 : pos + 46 + n_name].decode("utf-8", "replace")
            extra = central[pos + 46 + n_name : pos + 46 + n_name + n_extra]
            while len(extra) >= 4:
                tag, n = struct.unpack_from("<HH", extra)
                if tag == ZIP64_FIELD:  # holds only those that don't fit, in this order
                    values = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                    plain = next(values) if plain == MAX32 else plain
                    packed = next(values) if packed == MAX32 else packed
                    local = next(values) if local == MAX32 else local
                extra = extra[4 + n :]
            head = f.read_at(30, local)
            if head[:4] != LOCAL:
                raise ValueError(f"{path}: no local header of {name} at {local}")
            n_name_local, n_extra_local = struct.unpack_from(LOCAL_LAYOUT, head, 4)[-2:]
            members.append({"path": path, "member": name, "method": method, "offset": local + 30 + n_name_local + n_extra_local, "size": packed, "crc": crc})
            pos += 46 + n_name + n_extra + n_comment
    return members


def parse_record(data: bytes) -> dict:
    """The fields of one unpacked record; the payload's digest and length are taken from the payload itself."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}
    body = rest[: int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    number = lambda x: None if x is None or x.endswith("null>") else int(x.rpartition(":")[2].rstrip(">"))
    said = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    revisit = fields["warc-type"] == "revisit"
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if not revisit and (hashlib.sha1(payload).hexdigest() != said or len(payload) != length):
        raise ValueError(f"the payload of {fields['warc-record-id']} is not the one its header names")
    return {
        "page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "refers_to": number(fields.get("warc-refers-to")),
        "payload_digest": said, "payload_bytes": length, "payload": None if revisit else payload,
    }


def archive_members(paths: DataFrame) -> DataFrame:
    """A row per member of the archives ``paths(path)``: name, method, and the place of its bytes in the file."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                yield pd.DataFrame(zip_members(path), columns=["path", "member", "method", "offset", "size", "crc"])

    spread = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return paths.select("path").repartition(spread, "path").mapInPandas(members, MEMBERS)


def _index_lines(path: str, offset: int, size: int, step: int = 1 << 20) -> Iterator[dict]:
    rest = b""
    for at in range(0, size, step):
        *lines, rest = (rest + read_range(path, offset + at, min(step, size - at))).split(b"\n")
        yield from (json.loads(x) for x in lines if x)
    if rest:
        yield json.loads(rest)


def record_ranges(members: DataFrame, span: int = 4 << 20) -> DataFrame:
    """(path, offset, lengths) of runs of neighbouring records, about ``span`` bytes each, from the stored indexes."""
    place = members.where("method = 0").select("path", "member", "offset", "size")
    warcs = place.where(F.col("member") == WARC_MEMBER).select("path", F.col("offset").alias("warc_at"))
    both = place.where(F.col("member") == INDEX_MEMBER).select("path", "offset", "size").join(warcs, "path")

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                start, lengths = r.warc_at, []
                for line in _index_lines(r.path, r.offset, r.size):
                    if sum(lengths) >= span:
                        yield pd.DataFrame({"path": [r.path], "offset": [start], "lengths": [lengths]})
                        start, lengths = r.warc_at + line["offset"], []
                    lengths.append(line["length"])
                if lengths:
                    yield pd.DataFrame({"path": [r.path], "offset": [start], "lengths": [lengths]})

    return both.mapInPandas(ranges, "path string, offset long, lengths array<long>")


def read_archives(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives: directories, then indexes, then ranges of records dealt over all tasks."""
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(name, types[kind]) for name, kind in map(str.split, RECORDS.split(", "))])
    spread = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                data, at, rows = read_range(r["path"], r["offset"], sum(r["lengths"])), 0, []
                for n in r["lengths"]:
                    row = parse_record(zlib.decompress(data[at : at + n], 31))
                    rows.append(row if payloads else row | {"payload": None})
                    at += n
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return record_ranges(archive_members(paths)).repartition(spread, "path", "offset").mapInArrow(records, RECORDS)


def archive_round_trip(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read every record back, without the payloads."""
    manifest = write_archives(with_record_types(pages, least_bytes), new_path(pages.sparkSession, "archives"))
    return read_archives(manifest, payloads=False).drop("payload")
