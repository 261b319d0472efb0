import hashlib
import struct

import zstandard
from llm_data import FOLDER

from plumbline.llm.warc import SKIPPABLE, _frames, archive_pages, page_records, parse_record, read_archives, record_bytes


def expected(rows):
    out = []
    for page, html in rows:
        body = (html or "").encode()
        same = [p for p, h in rows if (h or "") == (html or "") and p is not None]
        last = max(same, default=None)
        revisit = len(body) >= 1000 and last is not None and page != last
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    big = "<p>ñ" + "x" * 1200
    rows = [(1, big), (2, None), (3, ""), (4, big), (5, big), (5, big), (None, big), (6, "small"), (7, "small"), (8, "y" * 3_000_000), (None, "z" * 2000)]
    rows += [(100 + i, f"<html>{'word ' * 40}{i}</html>") for i in range(40)]
    pages = spark.createDataFrame([(p, None if p == 3 else f"http://a/{p}", h, 1) for p, h in rows], "page_id long, url string, html string, digest int")
    assert sorted(map(tuple, page_records(spark, pages).collect()), key=str) == expected(rows)
    manifest = archive_pages(spark, pages, str(tmp_path))
    texts = {r.record_id: bytes(r.payload).decode() for r in read_archives(manifest).collect() if r.record_type == "response"}
    assert all(texts[str(p)] == (h or "") for p, h in rows if p is not None and str(p) in texts)
    real = archive_pages(spark, spark.read.parquet(f"{FOLDER}/pages.parquet"), str(tmp_path / "real"))
    with open(real.first().path, "rb") as f:
        assert struct.unpack("<I", f.read(4))[0] == SKIPPABLE
    assert page_records(spark, pages.limit(0)).count() == 0


def test_damage():
    raw = record_bytes("1", "http://a", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    assert parse_record(raw)["payload"] == b"abc" and parse_record(raw)["problem"] is None
    assert parse_record(raw.replace(b"abc", b"abd"))["problem"] == "digest differs"
    assert parse_record(raw[:-1])["problem"] == "length differs"
    assert parse_record(b"WARC/9" + raw)["problem"] == "no WARC header"
    assert parse_record(raw.replace(b"Content-Length: 3", b"Content-Length: 4"))["problem"] == "payload length differs"
    packed = zstandard.ZstdCompressor().compress(raw)

    def frames(data):
        at = 0

        def read(n):
            nonlocal at
            at += 7
            return data[at - 7 : at]

        return list(_frames(read))

    assert frames(packed * 3) == [raw] * 3 and frames(b"") == []
    assert frames(packed + packed[:-5]) == [raw, "truncated frame"]
    assert frames(b"junk" * 9)[0].startswith("bad frame")
    assert frames(struct.pack("<II", SKIPPABLE, 99) + b"x") == ["truncated dictionary"]
