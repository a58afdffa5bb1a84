"""WARC records in ZIP archives: written by tasks, found through the archives' directories, read by range.

An archive holds `archive/data.warc.gz`, one gzip member a record, and `indexes/index.cdxj`, both
stored, so that a record is at a known place of the archive and is read without unpacking anything
else. The reader takes archives of others too: it parses the central directory, with its ZIP64
forms, and needs stored members and an index.

Writers and readers use the file system that the folder's address names. A writer's file has a name
of its own for every attempt, and only files listed by tasks that ended are read.
"""

from __future__ import annotations

import gzip
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import join_small, saved, shared_folder

#: Compressed bytes after which a task begins its next archive.
ROLL = 32 << 20
SMALLEST_REVISIT = 100
#: Archive bytes that one reading task has.
READ_BYTES = 128 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
RECORD = "archive string, offset bigint, length bigint, page_id bigint, record_type string"
CONTENT = "page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def with_revisits(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Add (payload, digest, refers_to): of equal payloads of 100 bytes or more the smallest id is referred to.

    Rows tied at the smallest id are responses. Payloads are compared by SHA-256. Rows without an id
    revisit one with an id; among none they are responses.
    """
    rows = pages.withColumn("payload", F.coalesce(F.col(html).cast("binary"), F.lit("").cast("binary")))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = rows.filter(F.octet_length("payload") >= SMALLEST_REVISIT).groupBy("digest").agg(
        F.min(page_id).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    rows = join_small(rows, saved(first, "payloads"), ["digest"], "left")
    return rows.withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col(page_id)), F.col("first"))).drop("first")


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit keeps the header of the response, with the length, and no payload."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url:
        head.append(f"WARC-Target-URI: {''.join(url.split())}")
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def whole(value) -> int | None:
    return None if value is None or value != value else int(value)


def write_archives(rows: DataFrame, folder: str, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(archive, records, bytes) of the archives written below `folder`; run once, its rows are the list."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        data, index = io.BytesIO(), []

        def close() -> pd.DataFrame:
            name = f"{base}/pages-{uuid.uuid4().hex}.zip"
            packed = io.BytesIO()
            with zipfile.ZipFile(packed, "w", zipfile.ZIP_STORED) as z:
                z.writestr(DATA, data.getvalue())
                z.writestr(INDEX, "\n".join(index))
            with store.open_output_stream(name) as out:
                out.write(packed.getbuffer())
            done = pd.DataFrame([(name, len(index), packed.tell())], columns=["archive", "records", "bytes"])
            data.seek(0)
            data.truncate()
            index.clear()
            return done

        for pdf in batches:
            for i, u, payload, digest, to in zip(pdf[page_id], pdf[url], pdf["payload"], pdf["digest"], pdf["refers_to"]):
                i, to, start = whole(i), whole(to), data.tell()
                data.write(gzip.compress(record(i, u, bytes(payload), digest, to), 1, mtime=0))
                entry = {"id": i, "url": u, "mime": "text/html" if to is None else "warc/revisit", "filename": DATA,
                         "offset": start, "length": data.tell() - start}
                index.append(f"page,{i} 19700101000000 {json.dumps(entry)}")
                if data.tell() >= ROLL:
                    yield close()
        if index:
            yield close()

    return rows.select(page_id, url, "payload", "digest", "refers_to").mapInPandas(write, "archive string, records bigint, bytes bigint")


def directory(f, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (method, header offset, stored size) of the members of a ZIP archive, by range reads."""
    tail_at = max(0, size - 65_557)
    tail = f.read_at(size - tail_at, tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    count, length, start = struct.unpack_from("<H", tail, at + 10)[0], *struct.unpack_from("<II", tail, at + 12)
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        locator = f.read_at(20, tail_at + at - 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        end64 = f.read_at(56, struct.unpack_from("<Q", locator, 8)[0])
        if end64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of a central directory")
        count, length, start = struct.unpack_from("<QQQ", end64, 32)
    listing, p, out = f.read_at(length, start), 0, {}
    for _ in range(count):
        if listing[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", listing, p + 10)[0]
        packed, full, n, m, k = struct.unpack_from("<IIHHH", listing, p + 20)
        offset = struct.unpack_from("<I", listing, p + 42)[0]
        name = listing[p + 46 : p + 46 + n].decode("utf-8", "replace")
        extra = listing[p + 46 + n : p + 46 + n + m]
        while len(extra) >= 4:
            tag, width = struct.unpack_from("<HH", extra)
            if tag == 1:  # ZIP64: the fields that overflowed, in this order
                values = iter(struct.unpack_from(f"<{width // 8}Q", extra, 4))
                full = next(values) if full == 0xFFFFFFFF else full
                packed = next(values) if packed == 0xFFFFFFFF else packed
                offset = next(values) if offset == 0xFFFFFFFF else offset
            extra = extra[4 + width :]
        out[name] = (method, offset, packed)
        p += 46 + n + m + k
    return out


def member_start(f, members: dict[str, tuple[int, int, int]], name: str) -> int:
    method, offset, _ = members[name]
    if method:
        raise ValueError(f"{name} is packed; only stored members are read by range")
    head = f.read_at(30, offset)
    return offset + 30 + sum(struct.unpack_from("<HH", head, 26))


def list_records(archives: DataFrame, folder: str) -> DataFrame:
    """The place of every record, from the archives' indexes: (archive, offset, length, page_id, record_type).

    `archives` has (archive, bytes).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = fs.FileSystem.from_uri(folder)
        for pdf in batches:
            for path in pdf["archive"]:
                with store.open_input_file(path) as f:
                    members = directory(f, f.size())
                    rows = []
                    for name in members:
                        if not name.startswith("indexes/") or not name.endswith((".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz")):
                            continue
                        text = f.read_at(members[name][2], member_start(f, members, name))
                        text = gzip.decompress(text) if name.endswith(".gz") else text
                        starts: dict[str, int] = {}
                        for line in text.decode().splitlines():
                            x = json.loads(line[line.index("{") :])
                            where = x["filename"] if x["filename"] in members else f"archive/{x['filename']}"
                            if where not in starts:
                                starts[where] = member_start(f, members, where)
                            kind = "revisit" if x["mime"] == "warc/revisit" else "response"
                            rows.append((path, starts[where] + int(x["offset"]), int(x["length"]), x.get("id"), kind))
                yield pd.DataFrame(rows, columns=["archive", "offset", "length", "page_id", "record_type"])

    # Paths are few bytes: the number of tasks follows the archives, not the size of this table.
    n, total = archives.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, total // READ_BYTES, min(n, archives.sparkSession.sparkContext.defaultParallelism))
    return archives.select("archive").repartition(tasks).mapInPandas(run, RECORD)


def parsed(raw: bytes) -> tuple:
    """(page_id, record_type, refers_to, payload_bytes, digest in the header, payload) of a record's bytes."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    full = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda x: None if x in (None, "<urn:page:null>") else int(x.rpartition(":")[2].rstrip(">"))
    kind = fields["warc-type"]
    return (number(fields["warc-record-id"]), kind, number(fields.get("warc-refers-to")), full,
            fields["warc-payload-digest"].rpartition(":")[2], None if kind == "revisit" else payload)


def read_records(places: DataFrame, folder: str) -> DataFrame:
    """The records at the given places, each read by its range; a broken payload is an error."""
    from hashlib import sha256

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = fs.FileSystem.from_uri(folder)
        for pdf in batches:
            for path, part in pdf.groupby("archive"):
                with store.open_input_file(path) as f:
                    for start in range(0, len(part), 256):
                        some = part.iloc[start : start + 256]
                        rows = [parsed(f.read_at(n, at)) for at, n in zip(some["offset"], some["length"])]
                        for row in rows:
                            if row[5] is not None and (len(row[5]), sha256(row[5]).hexdigest()) != row[3:5]:
                                raise ValueError(f"page {row[0]}: payload and header differ")
                        out = pd.DataFrame(rows, columns=["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])
                        yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return places.mapInPandas(run, CONTENT)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write `pages` (page_id, url, html) to archives and read every record back.

    Null html is an empty payload; a null url leaves its header out; a null id stays null; repeated
    rows are records of their own. An empty table writes no archive. Extra columns are not written.
    """
    folder = f"{shared_folder(pages.sparkSession)}/llm/warc-{uuid.uuid4().hex}"
    rows = with_revisits(pages.select("page_id", "url", "html"))
    archives = saved(write_archives(rows, folder), "archives")
    return read_records(list_records(archives, folder), folder)
