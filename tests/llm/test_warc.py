import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from kpiforge.llm import warc

FAKE = ("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:kpiforge:page:666>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n")


def pages_frame(spark, rows, parts=2):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)


def expected(rows):
    last = {}
    for i, _, h in rows:
        h = h or ""
        last[h] = max(last.get(h, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        d = base64.b32encode(hashlib.sha1(b).digest()).decode()
        one = i == last[h or ""]
        out.append((i, len(b), d, "response" if one else "revisit", None if one else last[h or ""]))
    return sorted(out)


def digest_rows(df):
    return sorted(tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


@pytest.mark.parametrize("chunk", [64, 700, 1 << 20])
def test_magic_inside_payloads_is_rejected(spark, chunk):
    rows = [(i, f"http://h/{i}", ["", "plain " * i, FAKE * (i % 4), "x\r\n\r\n" + FAKE + "é漢" * i, None][i % 5]) for i in range(60)]
    manifest = warc.write_archives(pages_frame(spark, rows))
    out = warc.read_archives(manifest, chunk_bytes=chunk)
    assert digest_rows(out) == expected(rows)
    assert out.where("NOT digest_ok OR page_id = 666").count() == 0


def test_payloads_come_back_whole_and_revisits_carry_none(spark):
    rows = [(1, "http://a/ b\r\nX: y", "same"), (2, None, "same"), (3, "http://c", "other" + FAKE)]
    out = {r.page_id: r for r in warc.read_archives(warc.write_archives(pages_frame(spark, rows)), payloads=True).collect()}
    assert bytes(out[2].payload) == b"same" and bytes(out[1].payload) == b"" and out[1].refers_to == 2
    assert bytes(out[3].payload).decode() == rows[2][2]
    assert out[1].url == "http://a/%20b%0D%0AX:%20y" and out[2].url is None


def test_broken_archive_keeps_the_records_before_the_break(spark, tmp_path):
    data = b"".join(warc.record(i, None, b"p" * i, "D", None, False, "2020") for i in range(5))
    cut = data.index(b"page:3")
    (tmp_path / "a.warc").write_bytes(data[:cut + 30])
    m = spark.createDataFrame([(f"{tmp_path}/a.warc", str(tmp_path), cut + 30, 5)], warc.MANIFEST)
    assert sorted(r.page_id for r in warc.read_archives(m, chunk_bytes=100).collect()) == [0, 1, 2]


def test_small_archives_and_least_bytes(spark):
    rows = [(i, None, "dup" if i % 2 else "d") for i in range(20)]
    m = warc.write_archives(pages_frame(spark, rows), least_bytes=2, archive_bytes=300)
    assert m.count() > 4
    kinds = {r.page_id: r.record_type for r in warc.read_archives(m).collect()}
    assert all(kinds[i] == "response" for i in range(0, 20, 2)) and kinds[19] == "response" and kinds[1] == "revisit"


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "u", ""), (2, "u", "z" * 200_000), (2, "u", "z" * 200_000)]
    d = pages_frame(spark, rows).withColumns({"payload": F.lit(1), "refers_to": F.lit(2), "n": F.lit(3)})
    got = sorted(((r.page_id or -1), r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(d)).collect())
    assert got == [(-1, "revisit", 1), (1, "response", None), (2, "response", None), (2, "response", None)]
    empty = warc.read_archives(warc.write_archives(pages_frame(spark, [])))
    assert empty.count() == 0


@pytest.mark.parametrize("chunk", [5000, 90_000, 1 << 20])
def test_long_url_in_the_middle_of_an_archive(spark, chunk):
    rows = [(i, "data:," + "u " * 100_000 if i == 20 else f"http://h/{i}", "x\r\n" + FAKE * (i % 3) + f"page {i}") for i in range(40)]
    manifest = warc.write_archives(pages_frame(spark, rows, 1))
    out = warc.read_archives(manifest, chunk_bytes=chunk)
    assert digest_rows(out) == expected(rows)
    assert len(out.where("page_id = 20").first().url) == 6 + 400_000
    assert warc.complete(manifest, out).count() == 40
    with pytest.raises(ValueError, match="39 of 40"):
        warc.complete(manifest, out.where("page_id != 7"))


def test_candidates_in_one_pass_equal_one_by_one():
    data = b"WARC/1.1\r\n" * 3 + FAKE.encode() * 2 + b"xWARC/1.0\r\nContent-Length: 3\r\n" + b"WARC/1.1\r\nno length\r\n\r\n\r\n\r\n" + b"WARC/1.1\r\nend"
    at = [m.start() for m in warc.MAGIC.finditer(data)]
    assert warc.candidate_heads(data, at) == [(x, head[1]) for x in at if (head := warc.parse_head(data, x))]
