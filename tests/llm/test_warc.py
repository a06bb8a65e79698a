import base64
import hashlib
import uuid

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quern.llm import warc

PAGES = [
    (1, "http://a/x y\n", "<p>é</p>"), (2, None, None), (3, "u", ""), (4, "u", "<p>é</p>"), (4, "u", "<p>é</p>"), (0, "u", "line\r\n\r\nWARC/1.1\r\n"),
    (None, "u", "<p>é</p>"), (5, "u", "long" * 300_000), (6, "u", "only"), (1, "again", "<p>é</p>"),
]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "p", 1) for i, u, h in rows], "page_id long, url string, html string, payload string, refers_to int")


def want(rows, least=0):
    for i, _, h in rows:
        body = (h or "").encode()
        first = min((j for j, _, o in rows if j is not None and (o or "") == (h or "")), default=None)
        again = i is not None and first is not None and i > first and len(body) >= least
        yield i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", f"<urn:page:{first}>" if again else None, None if again else body


@pytest.mark.parametrize(("compression", "least"), [("none", 0), ("gzip", 0), ("none", 5)])
def test_pages_come_back(spark, tmp_path, compression, least, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1000)
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    warc.write_warc(warc.archive_pages(pages(spark, PAGES), least), path, compression)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in warc.read_warc(spark, path).collect()]
    assert sorted(got, key=str) == sorted(want(PAGES, least), key=str)


def test_headers_are_tested_before_payloads_are_read(spark, tmp_path):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    warc.write_warc(warc.archive_pages(pages(spark, PAGES)), path, date="2020-01-01T00:00:00Z")
    reader = warc.WarcReader({"path": path, "payload": "true"})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    kept = list(reader.pushFilters([EqualTo(("record_type",), "response"), In(("page_id",), (5, 6)), GreaterThan(("page_id",), 5)]))
    assert len(kept) == 1 and isinstance(kept[0], GreaterThan)
    rows = [row for part in reader.partitions() for row in reader.read(part)]
    assert sorted(r[4] for r in rows) == [5, 6]
    frame = warc.read_warc(spark, path, payload=False)
    assert frame.where("payload IS NOT NULL").count() == 0
    assert frame.where((F.col("record_type") == "revisit") & F.col("page_id").isin(1, 4) & F.col("page_id").isNotNull()).count() == 2
    assert {r.record_date for r in frame.collect()} == {"2020-01-01T00:00:00Z"}


def test_no_pages(spark, tmp_path):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    warc.write_warc(warc.archive_pages(pages(spark, [])), path)
    assert warc.read_warc(spark, path).collect() == []


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_cut_archives_fail_and_folders_below_are_read(spark, tmp_path, compression):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    warc.write_warc(warc.archive_pages(pages(spark, [(5, "u", "long" * 300_000)])), f"{path}/below", compression)
    (file,) = [f for f in warc.WarcReader({"path": path}).partitions()]
    assert warc.read_warc(spark, path).count() == 1
    whole = open(file.path, "rb").read()
    open(file.path, "wb").write(whole[: len(whole) // 2])
    for payload in ("true", "false"):
        reader = warc.WarcReader({"path": path, "payload": payload})
        with pytest.raises(ValueError, match="a record ends"):
            list(reader.read(file))


def test_jobs_of_one_path_do_not_meet(tmp_path):
    one, other = (warc.WarcWriter({"path": str(tmp_path)}) for _ in range(2))
    row = lambda i: Row(record_type="response", record_id=f"<urn:page:{i}>", target_uri=None, record_date=None, page_id=i, payload_digest=None, payload_bytes=1, refers_to=None, payload=b"x")
    first, second = one.write(iter([row(1)])), other.write(iter([row(2)]))
    one.commit([first])
    other.commit([second])
    reader = warc.WarcReader({"path": str(tmp_path)})
    assert sorted(r[4] for part in reader.partitions() for r in reader.read(part)) == [1, 2]
