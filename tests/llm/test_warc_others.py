"""Archives of other writers: plain gzip members, several records a member, uncompressed files."""

import gzip

import pytest
from pyspark.sql import functions as F

from vigil.llm import warc


def record(i, kind="response", body=b"", extra=""):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:0000-{i}>\r\nwarc-target-uri:http://x/{i}\r\n{extra}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


BODIES = [b"HTTP/1.1 200 OK\r\n\r\n<p>page " + str(i).encode() * (i * 37 % 900) + b"</p>" + (b"\r\n\r\nWARC/1.0 in text" if i % 9 == 0 else b"") for i in range(60)]


@pytest.mark.parametrize("form", ["members", "pairs", "one", "plain"])
def test_records_of_other_archives(spark, tmp_path, form):
    all_records = [record("info", "warcinfo", b"software: x\r\n")] + [record(i, "response" if i % 2 else "request", b, "X-Long: a\r\n b\r\n") for i, b in enumerate(BODIES)]
    packs = {"members": all_records, "pairs": [b"".join(all_records[i : i + 2]) for i in range(0, 61, 2)], "one": [b"".join(all_records)], "plain": all_records}[form]
    path = tmp_path / f"a.warc{'' if form == 'plain' else '.gz'}"
    path.write_bytes(b"".join(packs if form == "plain" else map(gzip.compress, packs)))
    for size in ("100000000", "700"):
        read = warc.registered(spark).read.format("warc").option("partitionBytes", size).load(f"file://{tmp_path}")
        got = {r.record_id: r for r in read.collect()}
        assert len(got) == read.count() == 61
        assert all(got[f"urn:uuid:0000-{i}"].payload == b and got[f"urn:uuid:0000-{i}"].payload_bytes == len(b) and got[f"urn:uuid:0000-{i}"].url == f"http://x/{i}" for i, b in enumerate(BODIES))
        assert all(r.page_id is None and r.refers_to is None for r in got.values())
        assert read.filter("record_type = 'request'").count() == 30
        assert {r.record_id for r in read.filter(F.col("record_id") == "urn:uuid:0000-7").collect()} == {"urn:uuid:0000-7"}


def test_a_broken_archive_says_so(spark, tmp_path):
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record(1, body=b"x" * 1000))[:-20])
    with pytest.raises(Exception, match="ends within"):
        warc.read(spark, f"file://{tmp_path}").collect()
