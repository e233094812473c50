"""Web captures as WARC files, and their transactions put together again.

Writing: every page becomes a request, a response (or a revisit of an equal payload) and a metadata record. Request and
metadata name the response in ``WARC-Concurrent-To``; a revisit names its payload by digest. Records are gzip members.
Tasks write through ``pyarrow.fs`` under names of their own and return a manifest row per file; Spark commits the
manifest, so files of lost or repeated tasks are never read.

Reading: files are parsed as streams, one record in memory at a time, into one row per record. Records join through
their concurrent-to identifiers into one nested row per capture; revisits find their response by payload digest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdure.session import materialize, scratch_path

FILE_BYTES = 1 << 30
_LEVEL = 4
_ROWS = 256
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "record_id string, type string, concurrent_to string, target_uri string, date string, payload_digest string, "
    "payload_bytes long, fields map<string,string>, payload binary"
)
_LISTED = "array<struct<record_id:string,target_uri:string,date:string,fields:map<string,string>>>"


def plan_roles(pages: DataFrame, least: int = 100) -> DataFrame:
    """``page_id, url, html, digest, revisit`` for every row of ``pages(page_id, url, html)``.

    Of rows with equal payloads of at least ``least`` bytes those with the smallest page_id are responses and the others
    revisits. A null html is an empty payload. Rows with a null page_id are revisits where an id holds the payload,
    else responses. Only digests that occur more than once are joined back.
    """
    digest = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    pages = pages.select("page_id", "url", "html", digest.alias("digest"))
    long = pages.where(F.octet_length("html") >= least).select("page_id", "digest")
    first = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    joined = pages.join(first.select("digest", "first"), "digest", "left")
    revisit = F.coalesce((F.col("first") < F.col("page_id")) | (F.col("first").isNotNull() & F.col("page_id").isNull()), F.lit(False))
    return joined.select("page_id", "url", "html", "digest", revisit.alias("revisit"))


def write_warc(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", least: int = 100, folder: str | None = None) -> DataFrame:
    """Writes ``pages(page_id, url, html)`` as WARC files and returns the manifest ``path, records``.

    ``date`` is the capture date of all records. ``folder`` defaults to a new one below ``spark.checkpoint.dir``; it
    must be one that ``pyarrow.fs`` can open from all executors. A null url is written without target. Repeated rows
    are captures of their own. Other columns are not looked at.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")

    def write(batches):
        writer = None
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                for row in batch.slice(start, _ROWS).to_pylist():
                    writer = writer or _Writer(folder, date)
                    writer.capture(row)
                    if writer.size >= FILE_BYTES:
                        yield writer.close()
                        writer = None
        if writer:
            yield writer.close()

    return materialize(plan_roles(pages, least).mapInArrow(write, "path string, records long"), "manifest")


class _Writer:
    def __init__(self, folder: str, date: str):
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        self.space, self.date, self.records, self.size = uuid.uuid4(), date, 0, 0
        self.path = f"{folder}/{self.space.hex}.warc.gz"
        self.out = system.open_output_stream(f"{root}/{self.space.hex}.warc.gz", compression=None)

    def capture(self, row: dict) -> None:
        url, payload = row["url"], (row["html"] or "").encode()
        digest = f"sha256:{base64.b32encode(bytes.fromhex(row['digest'])).decode()}"
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        common = {"WARC-Payload-Digest": digest, "Content-Type": "application/http; msgtype=response"}
        if row["revisit"]:
            main = self._record("revisit", url, http, {"WARC-Profile": _REVISIT, **common})
        else:
            main = self._record("response", url, http + payload, common)
        ask = f"GET {_header(url or '')} HTTP/1.1\r\n\r\n".encode()
        self._record("request", url, ask, {"WARC-Concurrent-To": main, "Content-Type": "application/http; msgtype=request"})
        known = "" if row["page_id"] is None else f"page-id: {row['page_id']}\r\n"
        self._record("metadata", url, known.encode(), {"WARC-Concurrent-To": main, "Content-Type": "application/warc-fields"})

    def _record(self, kind: str, url: str | None, block: bytes, fields: dict[str, str]) -> str:
        name = f"<urn:uuid:{uuid.uuid5(self.space, str(self.records))}>"
        lines = {"WARC-Type": kind, "WARC-Record-ID": name, "WARC-Date": self.date}
        if url is not None:
            lines["WARC-Target-URI"] = _header(url)
        lines |= fields | {"Content-Length": str(len(block))}
        head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n"
        pack = zlib.compressobj(_LEVEL, wbits=31)
        data = pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()
        self.out.write(data)
        self.records += 1
        self.size += len(data)
        return name

    def close(self) -> pa.RecordBatch:
        self.out.close()
        return pa.RecordBatch.from_pydict({"path": [self.path], "records": pa.array([self.records], pa.int64())})


def _header(value: str) -> str:
    """A url on one header line: what cannot stand there is percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def parse(stream):
    """The records of an uncompressed WARC stream as ``(fields, block)``, field names in lower case."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        fields: dict[str, str] = {}
        name = ""
        while (line := stream.readline()).strip():
            if line[:1] in b" \t" and name:
                fields[name] += " " + line.decode().strip()
                continue
            name, _, value = line.decode().partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]):
            raise ValueError("a WARC record is cut off")
        yield fields, block


def _record_row(fields: dict[str, str], block: bytes, with_payload: bool) -> dict:
    kind = fields["warc-type"]
    row = {
        "record_id": fields["warc-record-id"],
        "type": kind,
        "concurrent_to": fields.get("warc-concurrent-to"),
        "target_uri": fields.get("warc-target-uri"),
        "date": fields["warc-date"],
        "fields": [],
    }
    if kind in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        http = dict(_pairs(head))
        row["fields"] = list(http.items())
        if kind == "response":
            row["payload_digest"] = hashlib.sha256(payload).hexdigest()
            row["payload_bytes"] = len(payload)
            row["payload"] = payload if with_payload else None
        else:
            # of a payload that is not repeated the record has the digest and the length in the HTTP header
            encoded = fields["warc-payload-digest"].partition(":")[2]
            row["payload_digest"] = base64.b32decode(encoded).hex()
            row["payload_bytes"] = int(http["content-length"])
    elif kind == "metadata":
        row["fields"] = _pairs(block)
    return row


def _pairs(lines: bytes) -> list[tuple[str, str]]:
    split = (x.decode().partition(":") for x in lines.split(b"\r\n") if b":" in x)
    return list({name.strip().lower(): value.strip() for name, _, value in split}.items())


def read_records(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the files in ``manifest(path)``; ``payload`` is null unless asked for.

    ``payload_digest`` and ``payload_bytes`` of a response are taken from the payload itself. A broken file is an error.
    """
    schema = pa.schema(
        [(c, pa.string()) for c in ("record_id", "type", "concurrent_to", "target_uri", "date", "payload_digest")]
        + [("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
    )

    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, name = fs.FileSystem.from_uri(path)
                with system.open_input_stream(name, compression=None) as raw, gzip.open(raw) as stream:
                    rows, size = [], 0
                    for fields, block in parse(stream):
                        rows.append(_record_row(fields, block, with_payload))
                        size += len(block) if with_payload else 0
                        if len(rows) >= 1024 or size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(parts, "path").mapInArrow(read, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: ``record_id, response, requests, metadata``.

    ``response`` is the response or revisit record; ``requests`` and ``metadata`` are the records concurrent to it, in
    order of their ids (empty arrays if there are none). Records concurrent to no capture are left out; repeated
    captures stay apart, since record ids are unique.
    """
    wanted = ["record_id", "type", "concurrent_to", "target_uri", "date", "payload_digest", "payload_bytes", "fields", "payload"]
    main = records.where("type in ('response', 'revisit')").select("record_id", F.struct(*wanted).alias("response"))
    # requests and metadata carry no payload column into their shuffle
    small = F.struct("record_id", "target_uri", "date", "fields")
    for kind, name in (("request", "requests"), ("metadata", "metadata")):
        side = records.where((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
        side = side.select(F.col("concurrent_to").alias("record_id"), small.alias("part")).groupBy("record_id")
        listed = side.agg(F.expr("array_sort(collect_list(part), (a, b) -> if(a.record_id < b.record_id, -1, 1))").alias(name))
        main = main.join(listed, "record_id", "left").withColumn(name, F.coalesce(name, F.expr(f"cast(array() as {_LISTED})")))
    return main


def captures(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """``assemble`` over the files of a manifest, with ``page_id`` and ``refers_to``.

    ``page_id`` comes from the metadata record. ``refers_to`` is, for a revisit, the smallest page_id among the
    responses with its payload; null for responses and for a revisit whose response is in none of the files.
    """
    # written once, since requests, responses and metadata are three inputs of the joins
    rows = assemble(materialize(read_records(manifest, with_payload), "records"))
    rows = rows.withColumn("page_id", F.get("metadata", 0)["fields"]["page-id"].cast("long"))
    rows = materialize(rows, "captures")
    digest, kind = F.col("response.payload_digest"), F.col("response.type")
    # one row per payload that a revisit names, joined to the revisits alone
    named = rows.where(kind == "revisit").select(digest.alias("digest")).distinct()
    held = rows.where(kind == "response").select(digest.alias("digest"), "page_id").join(named, "digest", "left_semi")
    held = held.groupBy("digest").agg(F.min("page_id").alias("refers_to"))
    revisits = rows.where(kind == "revisit").withColumn("digest", digest).join(held, "digest", "left").drop("digest")
    return rows.where(kind == "response").withColumn("refers_to", F.lit(None).cast("long")).unionByName(revisits)
