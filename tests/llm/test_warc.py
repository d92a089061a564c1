import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import warc as W
from tidemark.llm.common import store_path

SCHEMA = "page_id bigint, url string, html string, digest string, file string, offset int, payload string"


def pages(n=150):
    r = random.Random(3)
    bodies = ["", None, "<p>a</p>", "\r\n\r\n", "WARC/1.1\r\n\r\n", "é\U0001f600" * 50, "<b>" + "x y " * 80_000] + [f"<p>{k}</p>" * r.randint(1, 60) for k in range(30)]
    rows = [(k, r.choice([None, f"http://h/{k}", "http://h/ä b\r\nX-Page-ID: 9"]), r.choice(bodies)) for k in range(n)]
    return rows + [(None, "u", "<p>a</p>"), (None, None, "only null id"), (None, None, "only null id"), rows[0], rows[0], rows[7], (n, "u", "last")]


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "d", "f", 1, "p") for r in rows], SCHEMA).repartition(parts)


def brute(rows, least=0):
    groups, out = {}, []
    for page, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(page)
    for data, ids in groups.items():
        ids.sort(key=lambda p: (p is not None, p or 0), reverse=True)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        for k, page in enumerate(ids):
            again = k > 0 and len(data) >= least
            out.append((page, len(data), digest, "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 10])
def test_read_back_against_brute_force(spark, least):
    rows = pages()
    index = W.write(frame(spark, rows), store_path(spark, "warc-test"), min_bytes=least, archive_bytes=20_000)
    records = W.read(index, span=5_000, gap=100)
    got = [tuple(r) for r in records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == brute(rows, least)
    assert sorted(((r["page_id"], r["url"]) for r in index.collect()), key=str) == sorted(((p, u) for p, u, _ in rows), key=str)
    whole = [(r["page_id"], bytes(r["payload"])) for r in W.resolve(records).collect()]
    assert sorted(whole, key=str) == sorted(((p, (h or "").encode()) for p, _, h in rows), key=str)


def test_report(spark):
    rows = pages()
    assert sorted((tuple(r) for r in W.report(frame(spark, rows)).collect()), key=str) == brute(rows)
    assert W.report(frame(spark, rows).limit(0)).collect() == []


def test_selection_and_archives(spark):
    """A selection reads its own records only; archives are whole gzip files whose members start where the index says."""
    index = W.write(frame(spark, pages()), store_path(spark, "warc-test"))
    some = index.filter(F.col("page_id") % 10 == 3)
    assert sorted(r["page_id"] for r in W.read(some).collect()) == sorted(r["page_id"] for r in some.collect())
    for file, rows in index.toPandas().groupby("file"):
        store, at = W.file_system(file)
        data = store.open_input_file(at).read()
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        rows = rows.sort_values("offset")
        ends = (rows.offset + rows.length).tolist()
        assert rows.offset.tolist()[1:] == ends[:-1] and ends[-1] == len(data)


def test_ranges():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 40, 5), ("a", 300, 5), ("a", 305, 900), ("b", 0, 3), ("b", 0, 3)]
    got = list(W.ranges(iter(rows), span=200, gap=50))
    assert got == [("a", 0, 45, [(0, 10), (10, 5), (40, 5)]), ("a", 300, 305, [(300, 5)]), ("a", 305, 1205, [(305, 900)]), ("b", 0, 3, [(0, 3), (0, 3)])]
    assert list(W.ranges(iter([]))) == []


def test_damaged_record(spark):
    good = W._record("response", [("WARC-Record-ID", "<x>"), ("WARC-Payload-Digest", "sha1:AAAA")], b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\nz")
    with pytest.raises(ValueError, match="digest"):
        W.parse(good)
