"""WARC archives: written records read by plain means, damaged archives, whole tables."""

import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import warc

LONG = "<p>" + "word " * 60 + "</p>"


def archive(*payloads):
    return b"".join(warc.page_member(str(i), f"http://x/{i}", p, hashlib.sha256(p).hexdigest(), None, "2020-01-01T00:00:00Z") for i, p in enumerate(payloads))


def test_a_member_is_one_whole_record():
    made = warc.page_member("7", "http://x/a b", b"<p>\r\n\r\n</p>", hashlib.sha256(b"<p>\r\n\r\n</p>").hexdigest(), None, "2020-01-01T00:00:00Z")
    head, _, block = gzip.decompress(made).partition(b"\r\n\r\n")
    lines = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and lines["WARC-Target-URI"] == "http://x/a%20b"
    assert len(block) == int(lines["Content-Length"]) + 4 and block.endswith(b"\r\n\r\n")
    assert block.partition(b"\r\n\r\n")[2] == b"<p>\r\n\r\n</p>\r\n\r\n"
    revisit = gzip.decompress(warc.page_member("8", None, b"abc", "00", "7", "2020-01-01T00:00:00Z"))
    assert b"WARC-Refers-To: <urn:corpusloom:page:7>" in revisit and b"Content-Length: 3\r\n" in revisit and b"abc" not in revisit
    assert warc.page_of(warc.record_id("a b/<é>")) == "a b/<é>" and warc.page_of(warc.record_id(None)) is None and warc.page_of("<urn:uuid:1>") is None


@pytest.mark.parametrize("piece", [1, 7, 1 << 16])
def test_reading_in_pieces(monkeypatch, piece):
    monkeypatch.setattr(warc, "PIECE", piece)
    payloads = [b"", b"x", b"\r\n\r\n", b"a" * 5000, LONG.encode()]
    found = list(warc.records_of(io.BytesIO(archive(*payloads))))
    assert [r.split()[1] for _, _, r, _ in found] == payloads and all(f is None for *_, f in found)
    data = archive(*payloads)
    for offset, length, record, _ in found:
        assert gzip.decompress(data[offset : offset + length]).startswith(b"WARC/1.1") and record.get("warc-type") == "response"


def test_damage_is_told():
    data = archive(b"one", b"two", b"three")
    assert [f for *_, f in warc.records_of(io.BytesIO(data[:-5]))][-1] == "archive ends within a gzip member"
    ends = [o for o, *_ in warc.records_of(io.BytesIO(data))]
    second = bytearray(gzip.decompress(data[ends[1] : ends[2]]))

    def again(changed):
        return [(r and r.split()[1], f) for _, _, r, f in warc.records_of(io.BytesIO(data[: ends[1]] + gzip.compress(bytes(changed)) + data[ends[2] :]))]

    assert again(second.replace(b"two", b"TWO"))[1] == (b"TWO", "block digest")
    assert [f for _, f in again(second.replace(b"two", b"TWO"))] == [None, "block digest", None]
    assert again(second[:-2])[-1] == (None, "Content-Length and gzip member differ")
    assert again(second + b"more")[-1] == (None, "Content-Length and gzip member differ")
    assert again(second.replace(b"Content-Length: ", b"Content-Length: x", 1))[-1] == (None, "no Content-Length")
    assert again(second.replace(b"WARC/1.1", b"WORC/1.1"))[-1] == (None, "no WARC version line")
    rng = random.Random(2)
    for _ in range(300):
        broken = bytearray(data)
        broken[rng.randrange(len(data))] ^= 1 << rng.randrange(8)
        read = list(warc.records_of(io.BytesIO(broken)))
        assert any(f for *_, f in read) or [r.split()[1] for _, _, r, _ in read] == [b"one", b"two", b"three"]


def test_other_digests_and_folded_headers():
    import base64

    block = b"hello"
    sha1 = base64.b32encode(hashlib.sha1(block).digest()).decode()
    raw = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Block-Digest: sha1:{sha1}\r\nX-Long: a\r\n b\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n".encode()
    [(_, _, record, fault)] = warc.records_of(io.BytesIO(gzip.compress(raw)))
    assert fault is None and record.get("x-long") == "a b"
    assert list(warc.records_of(io.BytesIO(gzip.compress(raw.replace(b"hello", b"hellu")))))[0][3] == "block digest"


def brute(rows):
    first = {}
    for page_id, _, html in rows:
        if len((html or "").encode()) >= 100 and page_id is not None:
            first[html] = min(first.get(html, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        to = first.get(html)
        to = None if to == page_id else to
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if to is not None else "response", to))
    return sorted(out, key=str)


def test_rows_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, f"http://h/{i}", rng.choice([LONG, LONG + "é", "short", "", None, "x" * 99, "y" * 100, LONG * rng.randint(1, 3)])) for i in range(300)]
    rows += [(5, "http://h/5", LONG), (5, "http://h/5", LONG), (None, None, LONG), (None, "http://h/ü\r\nX: y", "z" * 200), (400, None, "big " * 400_000), (401, "u", "big " * 400_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(4)
    archives = warc.write_archives(df, str(tmp_path / "w"), archive_bytes=20_000)
    assert archives.count() > 4 and archives.agg(F.sum("records")).head()[0] == len(rows)
    records = warc.read_archives(archives)
    assert records.where("record_type = 'warcinfo'").count() == archives.count()
    texts = {r.payload_digest: bytes(r.payload) for r in records.where("record_type = 'response'").collect()}
    assert {hashlib.sha256(t).hexdigest() for t in texts.values()} == set(texts)
    read = warc.resolved(warc.read_archives(archives, payloads=False))
    got = [(r.page_id and int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_page and int(r.refers_to_page)) for r in read.where("fault IS NULL").collect()]
    assert sorted(got, key=str) == brute(rows)


def test_lost_response_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", LONG), (2, "u", LONG)], "page_id long, url string, html string").coalesce(1)
    archives = warc.write_archives(df, str(tmp_path / "a"))
    records = warc.read_archives(archives).where("record_type <> 'response'")
    assert [r.fault for r in warc.resolved(records).collect()] == ["no such response"]
    with pytest.raises(Exception, match="no such response"):
        warc.resolved(records).select(warc.unbroken(F.col("page_id"))).collect()
    empty = warc.write_archives(df.limit(0), str(tmp_path / "b"))
    assert empty.count() == 0 and warc.read_archives(empty).count() == 0
