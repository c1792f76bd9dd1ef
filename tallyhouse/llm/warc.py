"""WARC archives compressed by record, with a Zstandard dictionary in front of each.

An archive is a skippable frame with the dictionary, then one frame per record.
The dictionary is trained on all records of the archive; an archive too small to
train one has no leading frame. Archives of lost or repeated task attempts stay
unread, as only those named in the stored manifest count.

A null payload is an empty one. Of records with equal payloads (length and
SHA-1) of at least ``revisit_from`` bytes the smallest id is a response and the
others are revisits of it; rows repeating that id are responses as well. A null
id is never the smallest: it revisits a known id, and is a response without one.
A null URL is written as a name made from the id. An empty table writes nothing.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import make_dir, picked, write_file
from tallyhouse.session import fresh_dir, stored

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEWLINE = b"\r\n"

SUFFIX = ".warc.zst"
MANIFEST = "archive string, records long, dictionary_bytes long, compressed_bytes long"
RECORDS = "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string"


def _name(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record as bytes; a revisit keeps the headers of its payload only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _name(page_id),
        "WARC-Date": date,
        "WARC-Target-URI": f"urn:page:{page_id}" if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%~"),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode(),
    }
    if page_id is not None:
        headers["Page-ID"] = str(page_id)
    if revisit:
        headers |= {"WARC-Profile": SAME_PAYLOAD, "WARC-Refers-To": _name(refers_to), "Refers-To-Page-ID": str(refers_to)}
    headers |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items())]
    return "\r\n".join(lines).encode() + 2 * NEWLINE + block + 2 * NEWLINE


def archive(records: list[bytes], dictionary_bytes: int, level: int) -> tuple[bytes, int]:
    """The archive of some records, and the size of its dictionary."""
    try:
        trained = zstandard.train_dictionary(dictionary_bytes, records, k=256, d=8)
    except zstandard.ZstdError:  # too few or too small records
        trained = None
    pack = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True)
    raw = trained.as_bytes() if trained else b""
    lead = struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw if raw else b""
    return lead + b"".join(pack.compress(x) for x in records), len(raw)


def records_of(data: bytes):
    """(headers, block) of every record in an archive."""
    trained, at = None, 0
    if len(data) >= 8 and (head := struct.unpack_from("<II", data))[0] == DICTIONARY_FRAME:
        at = 8 + head[1]
        trained = zstandard.ZstdCompressionDict(data[8:at])
    source = io.BytesIO(data)
    source.seek(at)
    unpack = zstandard.ZstdDecompressor(dict_data=trained)
    with io.BufferedReader(unpack.stream_reader(source, read_across_frames=True), 1 << 20) as stream:
        while version := stream.readline():
            if version != b"WARC/1.1\r\n":
                raise ValueError(f"no record where one should begin: {version[:40]!r}")
            headers = {}
            while (line := stream.readline()) != NEWLINE:
                key, _, value = line.decode().rstrip("\r\n").partition(": ")
                headers[key] = value
            block = stream.read(int(headers["Content-Length"]))
            if stream.read(4) != 2 * NEWLINE:
                raise ValueError("a record is cut short")
            yield headers, block


def _writer(folder: str, archive_bytes: int, dictionary_bytes: int, level: int, date: str):
    def save(held: list[bytes]) -> pa.RecordBatch:
        data, raw = archive(held, dictionary_bytes, level)
        name = uuid.uuid4().hex + SUFFIX  # a repeated task never touches the files of another
        write_file(folder, name, data)
        row = {"archive": [name], "records": [len(held)], "dictionary_bytes": [raw], "compressed_bytes": [len(data)]}
        return pa.RecordBatch.from_pydict(row)

    def write(batches):
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                held.append(record(row["id"], row["url"], row["payload"], row["refers_to"], row["refers_to"] is not None, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield save(held)
                    held, size = [], 0
        if held:
            yield save(held)

    return write


def _read(batches):
    for batch in batches:
        for file in batch.to_pylist():
            out = []
            for headers, block in records_of(file["content"]):
                head, _, payload = block.partition(2 * NEWLINE)
                stated = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                kind = headers["WARC-Type"]
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
                page, target = headers.get("Page-ID"), headers.get("Refers-To-Page-ID")
                out.append(
                    {
                        "id": None if page is None else int(page),
                        "url": headers["WARC-Target-URI"],
                        "payload_bytes": int(stated["Content-Length"]),
                        "payload_digest": digest,
                        "record_type": kind,
                        "refers_to": None if target is None else int(target),
                        "archive": file["archive"],
                    }
                )
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            names = [x.split()[0] for x in RECORDS.split(", ")]
            schema = pa.schema(list(zip(names, types, strict=True)))
            yield pa.RecordBatch.from_pylist(out, schema)


def write_warc(
    df: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    revisit_from: int = 0,
    archive_bytes: int = 32 << 20,
    dictionary_bytes: int = 64 << 10,
    level: int = 3,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write a record per row into archives of about ``archive_bytes`` before compression; the stored manifest comes back.

    Copies are found by digest: what is shuffled for them is a row per digest
    and task. Only repeated digests are joined back; adaptive execution splits a
    crowded one on the side of the pages.
    """
    make_dir(folder)
    pages = (
        picked(df, id=id_col, url=url_col, payload=payload_col)
        .select(F.col("id").cast("long").alias("id"), "url", F.coalesce("payload", F.lit("")).cast("binary").alias("payload"))
        .withColumns({"sha1": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    )
    copies = (
        pages.filter(F.col("size") >= revisit_from)
        .groupBy("sha1", "size")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1 AND first IS NOT NULL")
        .drop("copies")
    )
    copies = stored(copies, "copies")  # a join on top of a sum cannot be split at a crowded payload
    records = pages.join(copies, ["sha1", "size"], "left").select(
        "id", "url", "payload", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    )
    return stored(records.mapInArrow(_writer(folder, archive_bytes, dictionary_bytes, level, date), MANIFEST), "warc-manifest")


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives that the manifest names, an archive at a time."""
    files = manifest.sparkSession.read.format("binaryFile").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    return named.join(manifest.select("archive"), "archive", "left_semi").mapInArrow(_read, RECORDS)


def warc_round_trip(df: DataFrame, **options) -> DataFrame:
    """Archives written under the shared folder, then all their records."""
    folder = fresh_dir(df.sparkSession, "warc")
    return read_warc(write_warc(df, folder, **options), folder)
