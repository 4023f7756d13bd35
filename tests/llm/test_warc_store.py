import base64
import hashlib

import pytest

from pairweave.llm import warc_store as ws

HTMLS = ["<p>a</p>", "", None, "é\r\n\r\nWARC/1.1", "<p>a</p>", "x" * 70_000, "", "<p>a</p>", "\0"]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, address string, header int").repartition(3)


def test_records_against_plain_python(spark, tmp_path):
    rows = [(10 * i, None if i == 2 else f"http://h/{i}\r\nX: y", h, "clash", i) for i, h in enumerate(HTMLS)]
    got = {r.page_id: r for r in ws.archived(pages(spark, rows)).collect()}
    assert len(got) == len(rows)
    first = {}
    for page_id, _, html, _, _ in rows:
        body = (html or "").encode()
        first.setdefault(body, page_id)
        r = got[page_id]
        assert r.payload_bytes == len(body)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r.record_type == ("response" if first[body] == page_id else "revisit")
        assert r.refers_to == (None if first[body] == page_id else first[body])


def test_payloads_once_and_records_whole(spark, tmp_path):
    rows = [(i, "u", h, "", 0) for i, h in enumerate(HTMLS)]
    target = str(tmp_path / "warc")
    ws.write_archive(pages(spark, rows), target)
    assert spark.read.parquet(f"{target}/payloads").count() == len({h or "" for h in HTMLS})
    records = ws.read_records(spark, target).collect()
    back = {int(r.header.split("WARC-Page: ")[1].split("\r\n")[0]): bytes(r.payload).decode() for r in records}
    assert back == {i: h or "" for i, h in enumerate(HTMLS)}
    assert all(r.header.startswith("WARC/1.1\r\nWARC-Type: ") and r.header.endswith("\r\n\r\n") for r in records)


def test_small_payloads_stay_responses(spark):
    rows = [(1, "u", "ab", "", 0), (2, "u", "ab", "", 0), (3, "u", "abc", "", 0), (4, "u", "abc", "", 0)]
    got = {r.page_id: r.record_type for r in ws.archived(pages(spark, rows), least_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_exported_files_hold_whole_records(spark, tmp_path):
    rows = [(i, "u", h, "", 0) for i, h in enumerate(HTMLS)]
    target = str(tmp_path / "warc")
    ws.write_archive(pages(spark, rows), target)
    ws.export_warc(spark, target, str(tmp_path / "files"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "files").glob("part-*")))
    found = []
    while data:  # as a reader does: headers, then as many bytes as they say
        head, _, rest = data.partition(b"\r\n\r\n")
        n = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        found.append((b"Type: response" in head, rest[:n]))
        assert rest[n : n + 4] == b"\r\n\r\n"
        data = rest[n + 4 :]
    assert len(found) == len(HTMLS)
    assert sorted(x for full, x in found if full) == sorted({(h or "").encode() for h in HTMLS})


def test_changed_payload_is_noticed(spark, tmp_path):
    target = str(tmp_path / "warc")
    ws.write_archive(pages(spark, [(1, "u", "a", "", 0)]), target)
    spoiled = spark.read.parquet(f"{target}/payloads").selectExpr("address", "sha1", "cast('b' as binary) as payload").collect()
    spark.createDataFrame(spoiled, "address string, sha1 string, payload binary").write.mode("overwrite").parquet(f"{target}/payloads")
    with pytest.raises(Exception, match="does not match"):
        ws.record_facts(spark, target).collect()


def test_repeated_rows_null_id_and_empty_table(spark):
    twice = [(5, "u", "a", "", 0), (5, "u", "a", "", 0), (6, "u", "a", "", 0)]
    got = sorted((r.page_id, r.record_type, r.refers_to or 0) for r in ws.archived(pages(spark, twice)).collect())
    assert got == [(5, "response", 0), (5, "response", 0), (6, "revisit", 5)]
    assert ws.archived(pages(spark, [])).collect() == []
    nameless = [(None, None, "a", "", 0), (8, "u", "a", "", 0), (None, "u", "b", "", 0), (None, "u", "b", "", 0)]
    got = [(r.page_id, r.record_type, r.refers_to) for r in ws.archived(pages(spark, nameless)).collect()]
    assert sorted(got, key=repr) == [
        (8, "response", None), (None, "response", None), (None, "response", None), (None, "revisit", 8),
    ]
