from __future__ import annotations

import gzip
import hashlib
import io
import random

import pytest

from verdure.llm import warc
from verdure.llm.warc import captures, parse, read_records, write_warc

SCHEMA = "page_id long, url string, html string"


def brute(rows, least=100):
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    count = {}
    for _, _, h in rows:
        count[h or ""] = count.get(h or "", 0) + 1
    out = []
    for p, u, h in rows:
        data = (h or "").encode()
        lead = first.get(h or "") if len(data) >= least and count[h or ""] > 1 else None
        revisit = lead is not None and (p is None or p > lead)
        out.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", lead if revisit else None))
    return sorted(out, key=repr)


def found(df):
    rows = df.select("page_id", "response.payload_bytes", "response.payload_digest", "response.type", "refers_to").collect()
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("file_bytes", [2000, 1 << 30])
def test_round_trip(spark, monkeypatch, file_bytes):
    monkeypatch.setattr(warc, "FILE_BYTES", file_bytes)
    rng = random.Random(1)
    bodies = ["<p>é\r\n\r\nWARC/1.1\r\n" + "x" * rng.choice([0, 60, 90, 300, 5000]) + str(k) for k in range(12)]
    rows = [(i, f"http://h{i % 3}.org/ü?{i}", rng.choice(bodies)) for i in range(80)]
    rows += [(None, None, bodies[3]), (200, "a\r\nb c", None), (201, "", ""), (5, "u", "y" * 150), (5, "u", "y" * 150), (None, "u", "z" * 200)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", type int").repartition(3)
    df = captures(write_warc(pages))
    assert found(df) == brute(rows)
    whole = {(r.page_id, r.response.payload.decode()) for r in df.where("response.type = 'response'").collect()}
    assert whole <= {(p, h or "") for p, _, h in rows}
    row = df.where("page_id = 7").first()
    assert len(row.requests) == len(row.metadata) == 1
    assert row.response.target_uri == row.requests[0].target_uri == "http://h1.org/ü?7"


def test_many_equal_pages_and_no_page(spark):
    rows = [(i, None, "same page " * 20) for i in range(400)]
    pages = spark.createDataFrame(rows, SCHEMA)
    assert found(captures(write_warc(pages), with_payload=False)) == brute(rows)
    assert captures(write_warc(pages.limit(0))).count() == 0


def test_records_of_others(spark, tmp_path):
    """Folded header lines, other record types, missing parts and plain order."""
    text = (
        "WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <a>\r\nWARC-Date: d\r\nContent-Length: 3\r\n\r\nx:y\r\n\r\n"
        "WARC/1.0\r\nwarc-type: request\r\nWARC-Record-ID: <q>\r\nWARC-Date: d\r\nWARC-Concurrent-To: <r>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
        "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <r>\r\nWARC-Date: d\r\nWARC-Target-URI: http://\r\n x\r\n"
        "Content-Length: 8\r\n\r\nA: b\r\n\r\n\r\n\r\n"
    ).encode()
    assert [f["warc-type"] for f, _ in parse(io.BytesIO(text))] == ["warcinfo", "request", "response"]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(gzip.compress(text[:100]) + gzip.compress(text[100:]))
    row = warc.assemble(read_records(spark.createDataFrame([(str(path),)], "path string"))).first()
    assert (row.record_id, row.response.payload_bytes, len(row.requests), row.metadata) == ("<r>", 0, 1, [])
    with pytest.raises(ValueError):
        list(parse(io.BytesIO(text[:-6])))
