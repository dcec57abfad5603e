"""WARC records in ZIP packages: writing, and reading by ranges without extraction.

A package is a ZIP file with two stored (uncompressed) members: the archive, whose records are separate gzip members one after another, and an index with a line for each
record: its offset and length in the archive. The reader gets the end of the file, parses the end-of-directory records (also ZIP64) and the central directory, finds the
stored members, reads the index and then fetches records by ranges of the package; nothing is unpacked to disk and memory holds one window of records.

Packages lie in the folder that driver and executors share and are opened through a file system chosen by its URI. A task writes under a name of its own, and only the
names that successful tasks return get into the manifest, so that retried tasks and lost executors leave no half-written or doubled package in a result.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchgrid.llm import common

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
#: A package is closed when its records have so many bytes.
PACKAGE_BYTES = 32 << 20
#: Payloads below this are never revisits.
LEAST_REVISIT = 100
WINDOW_BYTES = 4 << 20
SALTS = 16

_LOCAL, _ENTRY, _END, _END64, _LOCATOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF
_DATE = "2024-01-01T00:00:00Z"


# ------------------------------------------------------------------ packages


def write_package(out, members: list[tuple[str, list[bytes]]], zip64: bool = False) -> None:
    """Stores members in a ZIP file. ZIP64 fields are used where a value needs them, or everywhere if zip64."""
    at, directory = 0, []
    for name, chunks in members:
        raw, size, crc = name.encode(), sum(map(len, chunks)), 0
        for c in chunks:
            crc = zlib.crc32(c, crc)
        wide = zip64 or size >= _MAX32 or at >= _MAX32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        shown = _MAX32 if wide else size
        out.write(struct.pack("<IHHHHHIIIHH", _LOCAL, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(extra)) + raw + extra)
        far = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
        directory.append(struct.pack("<IHHHHHHIIIHHHHHII", _ENTRY, 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, shown, shown, len(raw), len(far), 0, 0, 0, 0, _MAX32 if wide else at) + raw + far)
        for c in chunks:
            out.write(c)
        at += 30 + len(raw) + len(extra) + size
    block = b"".join(directory)
    out.write(block)
    wide = zip64 or at >= _MAX32 or len(directory) >= _MAX16
    if wide:
        out.write(struct.pack("<IQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, len(directory), len(directory), len(block), at))
        out.write(struct.pack("<IIQI", _LOCATOR, 0, at + len(block), 1))
    n = _MAX16 if wide else len(directory)
    out.write(struct.pack("<IHHHHIIH", _END, 0, 0, n, n, _MAX32 if wide else len(block), _MAX32 if wide else at, 0))


def _range(f, at: int, size: int) -> bytes:
    f.seek(at)
    got = f.read(size)
    if len(got) != size:
        raise ValueError(f"package ends at {at + len(got)}, {at + size} expected")
    return got


def stored_members(f, size: int) -> dict[str, tuple[int, int]]:
    """Name -> (offset of its bytes, length) of the stored members of a ZIP file of `size` bytes that can be read by ranges."""
    tail_at = max(0, size - 65_557)
    tail = _range(f, tail_at, size - tail_at)
    k = tail.rfind(struct.pack("<I", _END))
    if k < 0:
        raise ValueError("no end-of-directory record")
    _, _, _, _, n, length, at, _ = struct.unpack_from("<IHHHHIIH", tail, k)
    if n == _MAX16 or length == _MAX32 or at == _MAX32:
        sign, _, at64, _ = struct.unpack("<IIQI", _range(f, tail_at + k - 20, 20))
        if sign != _LOCATOR:
            raise ValueError("no ZIP64 locator")
        sign, _, _, _, _, _, _, n, length, at = struct.unpack("<IQHHIIQQQQ", _range(f, at64, 56))
        if sign != _END64:
            raise ValueError("no ZIP64 end-of-directory record")
    block, p, found = _range(f, at, length), 0, {}
    for _ in range(n):
        sign, _, _, _, method, _, _, _, packed, _, name_len, extra_len, note_len, _, _, _, where = struct.unpack_from("<IHHHHHHIIIHHHHHII", block, p)
        if sign != _ENTRY:
            raise ValueError("broken central directory")
        name, extra = block[p + 46 : p + 46 + name_len].decode(), block[p + 46 + name_len : p + 46 + name_len + extra_len]
        wanted = [struct.unpack_from("<I", block, p + 24)[0] == _MAX32, packed == _MAX32, where == _MAX32]
        q = 0
        while q + 4 <= len(extra):
            tag, m = struct.unpack_from("<HH", extra, q)
            if tag == 1:
                wide = iter(struct.unpack_from(f"<{m // 8}Q", extra, q + 4))
                _, packed, where = (next(wide) if w else v for w, v in zip(wanted, (0, packed, where), strict=True))
            q += 4 + m
        if method == 0:
            head = struct.unpack("<IHHHHHIIIHH", _range(f, where, 30))
            found[name] = (where + 30 + head[9] + head[10], packed)
        p += 46 + name_len + extra_len + note_len
    return found


# ------------------------------------------------------------------- records


def record_id(page: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{digest}')}>"


def _line(value: str) -> str:
    """A header's value: what isn't visible ASCII is percent-encoded."""
    return "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page, url, payload: bytes, digest: str, refers_to) -> bytes:
    """A WARC record as a gzip member: response with its payload, or revisit without it when refers_to is given."""
    mine = "" if page is None else str(page)
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": record_id(mine, digest), "WARC-Date": _DATE}
    if url is not None:
        head["WARC-Target-URI"] = _line(url)
    head |= {"WARC-Payload-Digest": f"sha256:{digest}", "WARC-Page": mine, "WARC-Payload-Length": str(len(payload)), "Content-Type": "application/http;msgtype=response"}
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    else:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(str(refers_to), digest), "WARC-Refers-To-Page": str(refers_to)}
    head["Content-Length"] = str(len(block))
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(2, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record (a gzip member)."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:20]}")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def read_records(f, size: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a package, fetched by ranges that hold about WINDOW_BYTES."""
    members = stored_members(f, size)
    start, _ = members[ARCHIVE]
    entries = [json.loads(x) for x in _range(f, *members[INDEX]).splitlines()]
    i = 0
    while i < len(entries):
        lo, j = entries[i]["offset"], i
        while j < len(entries) and (j == i or entries[j]["offset"] + entries[j]["length"] - lo <= WINDOW_BYTES):
            j += 1
        window = _range(f, start + lo, entries[j - 1]["offset"] + entries[j - 1]["length"] - lo)
        for e in entries[i:j]:
            yield parse_record(window[e["offset"] - lo : e["offset"] - lo + e["length"]])
        i = j


# ------------------------------------------------------------------ operators


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", zip64: bool = False) -> DataFrame:
    """Writes a record per row into packages under `folder` (a URI); returns the manifest (path, bytes, records), cut from its lineage.

    A null payload is empty. Of rows with equal payloads of at least LEAST_REVISIT bytes those with the smallest key are responses and the others revisit it; a null key is
    larger than any other. Equal digests are looked for among digests alone; the join back is salted, so that one payload on a third of all pages spreads over many tasks.
    """
    common.small_batches(pages.sparkSession)
    df = pages.select(F.col(key).alias("k"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload"))
    df = df.withColumn("digest", F.sha2("payload", 256)).withColumn("salt", F.pmod(F.xxhash64("k", "url"), F.lit(SALTS)).cast("int"))
    first = df.where(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.min("k").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    df = df.join(first, ["digest", "salt"], "left").withColumn("refers", F.when(~F.col("k").eqNullSafe(F.col("first")), F.col("first"))).select("k", "url", "payload", "digest", "refers")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = arrow_fs.FileSystem.from_uri(folder)
        system.create_dir(top, recursive=True)
        chunks: list[bytes] = []
        index: list[dict] = []
        size, done = 0, []

        def close() -> None:
            name = f"{top}/{uuid.uuid4().hex}.wacz"
            lines = "".join(json.dumps(x) + "\n" for x in index).encode()
            with system.open_output_stream(name) as out:
                write_package(out, [(ARCHIVE, chunks), (INDEX, [lines])], zip64)
            done.append((name, size + len(lines), len(index)))

        for pdf in batches:
            for k, u, body, digest, refers in pdf.itertuples(index=False):
                raw = record(None if pd.isna(k) else k, u, bytes(body), digest, None if pd.isna(refers) else refers)
                index.append({"offset": size, "length": len(raw)})
                chunks.append(raw)
                size += len(raw)
                if size >= PACKAGE_BYTES:
                    close()
                    chunks, index, size = [], [], 0
        if chunks:
            close()
        if done:
            yield pd.DataFrame(done, columns=["path", "bytes", "records"])

    as_text = df.withColumns({"k": F.col("k").cast("string"), "refers": F.col("refers").cast("string")})
    return common.written(as_text.mapInPandas(write, "path string, bytes long, records long"))


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the packages in the manifest: page, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits), package.

    Bytes and digest of a response are those of the payload that was read, which must agree with its header; a revisit has them in its header.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = arrow_fs.FileSystem.from_uri(folder)
        columns = ["page", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "package"]
        for pdf in batches:
            for path in pdf["path"]:
                rows, held = [], 0
                with system.open_input_file(path) as f:
                    for headers, block in read_records(f, f.size()):
                        kind, told = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        size, body = int(headers["WARC-Payload-Length"]), None
                        if kind == "response":
                            body = block.partition(b"\r\n\r\n")[2]
                            if len(body) != size or hashlib.sha256(body).hexdigest() != told:
                                raise ValueError(f"{path}: payload of {headers['WARC-Record-ID']} does not agree with its digest")
                        rows.append((headers["WARC-Page"] or None, headers.get("WARC-Target-URI"), size, told, kind, headers.get("WARC-Refers-To-Page"), body, path))
                        held += size
                        if held >= WINDOW_BYTES:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    n = common.partitions(manifest.sparkSession)
    return manifest.repartition(n, "path").mapInPandas(read, "page string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary, package string")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.shared_dir(spark)
    manifest = write_archives(common.read(spark, sf_dir, "pages"), folder)
    common.deleted_on_exit(spark, folder)
    found = read_archives(manifest, folder)
    return found.select(F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f
"""
