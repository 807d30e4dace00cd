import base64
import gzip
import hashlib
import random
import zlib

import pytest

from factloom.llm.warc import archives_in, member, outermost, scan_warc, write_warc

PAGES = "page_id long, url string, html string, path string, bytes long, digest string"


def pages(seed=1):
    r = random.Random(seed)
    body = lambda n: "".join(r.choice("abc <p>é\n") for _ in range(n))
    same = body(400)
    rows = [(i, f"http://a.example/{i} x\r\ny", body(r.randint(0, 3000)), "", 1, "") for i in range(60)]
    rows += [(100 + i, "http://b.example", same, "", 1, "") for i in range(30)] + [(200, None, None, "", 1, ""), (201, "u", "", "", 1, ""), (202, "v", "", "", 1, "")]
    rows += [(129, "http://z.example", same, "", 1, "")] * 2 + [(7, "w", "twins", "", 1, "")] * 3 + [(None, "n", "nobody", "", 1, "")] * 2 + [(None, "n", same, "", 1, "")]
    rows += [(300, "long", body(60_000) * 30, "", 1, "")]
    r.shuffle(rows)
    return rows


def plain(rows, least=0):
    out, seen = [], {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True):
        data = (r[2] or "").encode()
        first = data not in seen or len(data) < least
        seen.setdefault(data, r[0])
        out.append((r[0], len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else seen[data]))
    return sorted(out, key=repr)


def number(x):
    return None if x is None else int(x)


@pytest.mark.parametrize("groups", [0, 1 << 17])
@pytest.mark.parametrize("least", [0, 10])
def test_round_trip_by_ranges(spark, tmp_path, groups, least):
    rows = pages()
    folder = f"file://{tmp_path}/w"
    files = write_warc(spark.createDataFrame(rows, PAGES).repartition(3), folder, min_bytes=least, file_bytes=20_000, groups=groups)
    assert files.count() > 3 and files.agg({"records": "sum"}).first()[0] == len(rows)
    assert {(f["path"].split(":")[-1].lstrip("/"), f["bytes"]) for f in archives_in(spark, folder).collect()} == {(f["path"].split(":")[-1].lstrip("/"), f["bytes"]) for f in files.collect()}
    for width in (997, 1 << 24):
        got = outermost(scan_warc(files, payloads=True, range_bytes=width)).where("record_type <> 'warcinfo'").collect()
        assert all(r["problem"] is None for r in got)
        assert sorted(((number(r["row_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], number(r["refers_to_row"])) for r in got), key=repr) == plain(rows, least)
        texts = {(r[0], r[2] or "") for r in rows}
        ids = {r["record_id"] for r in got if r["record_type"] == "response"}
        assert {(number(r["row_id"]), r["payload"].decode()) for r in got if r["record_type"] == "response"} <= texts
        assert all(r["refers_to"] in ids for r in got if r["record_type"] == "revisit")
        assert len({r["record_id"] for r in got}) == len(got)


def test_any_gzip_reader_reads_the_files(spark, tmp_path):
    files = write_warc(spark.createDataFrame(pages()[:9], PAGES), f"file://{tmp_path}/g")
    for f in files.collect():
        data = gzip.open(f["path"].removeprefix("file://")).read()
        assert data.startswith(b"WARC/1.1\r\n") and data.count(b"WARC-Record-ID: ") == f["records"] + 1


def test_no_pages(spark, tmp_path):
    files = write_warc(spark.createDataFrame([], PAGES), f"file://{tmp_path}/none")
    assert files.count() == 0 and scan_warc(files).count() == 0


def stored_member(header, block):
    """Uncompressed within its gzip member, so that the bytes of the block stand in the file as they are."""
    return member(header, [block], level=0)


def test_archives_in_payloads_damage_and_foreign_records(spark, tmp_path):
    r = random.Random(2)
    noise = bytes(r.randrange(256) for _ in range(3000))
    inner = member([("WARC-Type", "resource"), ("WARC-Record-ID", "<inner>")], [noise])
    whole = [stored_member([("WARC-Type", "resource"), ("WARC-Record-ID", "<outer>")], noise + inner + b"\x1f\x8b\x08" + noise), member([("WARC-Type", "metadata"), ("WARC-Record-ID", "<m>")], [b"a: b"])]
    lying = member([("WARC-Type", "resource"), ("WARC-Record-ID", "<lying>"), ("WARC-Payload-Digest", "sha1:AAAA")], [b"x"])
    broken = bytearray(member([("WARC-Type", "resource"), ("WARC-Record-ID", "<broken>")], [bytes(r.randrange(256) for _ in range(12_000))]))
    broken[-6000:-5000] = b"\0" * 1000
    cut = member([("WARC-Type", "resource"), ("WARC-Record-ID", "<cut>")], [noise])[:-900]
    data = b"".join([*whole, lying, bytes(broken), zlib.compress(b"other"), gzip.compress(b"no record"), whole[1], cut])
    path = tmp_path / "f.warc.gz"
    path.write_bytes(data)
    files = archives_in(spark, f"file://{tmp_path}")
    for width in (311, 4000, 1 << 20):
        got = {(x["record_id"], x["offset"]): x["problem"] for x in outermost(scan_warc(files, range_bytes=width)).collect()}
        places = [data.index(x) for x in (whole[0], whole[1], lying, bytes(broken))]
        want = dict(zip(zip(["<outer>", "<m>", "<lying>", "<broken>"], places, strict=True), [None, None, "digest", "corrupt"], strict=True))
        assert got == want | {("<m>", data.rindex(whole[1])): None, ("<cut>", data.rindex(cut)): "truncated"}
    assert any(x["record_id"] == "<inner>" for x in scan_warc(files, range_bytes=311).collect())  # and is taken out above
