import base64
import hashlib
import random
import re
import zlib

import pytest

from tidemark.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS data", "'clash' AS first", "'clash' AS key").repartition(3)


def brute(rows):
    first, lone = {}, {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        lead = first.get(h or "")
        revisit = lead != i
        if lead is None:  # no id in the group: one of its rows is the response
            revisit = h in lone
            lone[h] = True
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", lead if revisit else None))
    return sorted(out, key=repr)


def test_round_trip_of_any_payload(spark):
    rnd = random.Random(3)
    parts = ["\r\n", "\r\n\r\n", "a", "WARC/1.1\r\n", "\n", "\r", "é", "filedesc://", "</p>"]
    rows = [(i, f"http://x/{i} y" if i % 7 else None, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 7))) if i % 50 else None) for i in range(600)]
    rows += [(None, "u", "a"), (None, None, "alone"), (None, None, "pair"), (None, "v", "pair"), (5000, "u", "twice"), (5000, "u", "twice"), (5001, "u", "twice"), (6000, "u", "z" * 3000000)]
    assert sorted(map(tuple, warc.round_trip(pages(spark, rows)).collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, [])).collect() == []


def members(data):
    """The gzip members of a file, one by one."""
    out = []
    while data:
        z = zlib.decompressobj(31)
        out.append(z.decompress(data))
        assert z.eof
        data = z.unused_data
    return out


def test_archives_have_a_gzip_member_for_each_record(spark, tmp_path):
    path = str(tmp_path / "w")
    two = [(1, "http://a/ b", "<p>x"), (2, "http://b/", "<p>x")]
    warc.write(pages(spark, two), path)
    found = [m for f in sorted((tmp_path / "w").glob("*.warc.gz")) for m in members(f.read_bytes()) if m]
    assert all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in found)
    kinds = [re.search(rb"WARC-Type: (\w+)", m)[1] for m in found]
    assert kinds.count(b"response") == kinds.count(b"revisit") == 1 and kinds.count(b"warcinfo") >= 1
    response, revisit = (next(m for m, k in zip(found, kinds) if k == kind) for kind in (b"response", b"revisit"))
    header = lambda m, name: re.search(rb"%s: (.*?)\r\n" % name, m)[1]
    assert header(revisit, b"WARC-Refers-To") == header(response, b"WARC-Record-ID") != header(revisit, b"WARC-Record-ID")
    assert header(revisit, b"WARC-Refers-To-Target-URI") == header(response, b"WARC-Target-URI") == b"http://a/%20b"
    assert header(revisit, b"WARC-Refers-To-Date") == header(response, b"WARC-Date")
    assert b"<p>x" not in revisit and b"X-Page-Id: 2" in revisit
    warc.write(pages(spark, two), path, least_bytes=5)
    assert {r["record_type"] for r in warc.read(spark, path).collect()} == {"response"}


DATE, NAME = "20010203040506", "x.arc"
HTTP = b"HTTP/1.1 200 OK\r\n\r\nhi\nhttp://no 1.1.1.1 20010203040506 text/html 4\n"


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("size", [1, 7, 10**6])
def test_arc_is_parsed_by_declared_lengths(version, size):
    blocks = [HTTP, b"", b"\n\n\n"]
    urls = [b"http://a/0", "http://a/ü 1".encode(), b"http://a/\xff\xfe b"]
    data = warc.arc_version_block(version, NAME, DATE) + b"".join(warc.arc_record(version, u, DATE, "text/html; charset=x", b, 0, NAME) for u, b in zip(urls, blocks))
    chunks = [data[i : i + size] for i in range(0, len(data), size)]
    first, *found = warc.parse_arc(chunks)
    assert first.fields["URL"] == b"filedesc://" + NAME.encode() and [r.block for r in found] == blocks and [r.fields["URL"] for r in found] == urls
    assert all(r.fields["Content-type"] == b"text/html; charset=x" and list(r.fields) == list(warc.FIELDS[version]) for r in found)
    assert [warc.uri(u) for u in urls] == ["http://a/0", "http://a/%C3%BC%201", "http://a/%FF%FE%20b"]
    d = warc.describe(found[0], "f", "")
    (head, block), = warc.parse_warc(warc.warc_record(d, found[0].block).split(warc.END))
    assert block == blocks[0] and head["warc-date"] == "2001-02-03T04:05:06Z" and head["warc-payload-digest"] == "sha1:" + warc.digest(blocks[0][19:])


def test_a_broken_record_is_reported_and_the_next_is_read():
    good = lambda n: warc.arc_record(1, b"http://a/%d" % n, DATE, "text/html", HTTP, 0, NAME)
    start = warc.arc_version_block(1, NAME, DATE)
    for bad, ok in ((b"http://a/x 0.0.0.0 no header at all\nand text\n\n", [1, 2]), (b"http://a/x 0.0.0.0 20010203040506 text/html 3\nlonger than said\n", [1, 2]), (b"x" * 20000 + b" 0.0.0.0 20010203040506 text/html 3\nabc\n", [1, 2])):
        found = list(warc.parse_arc([start + good(1) + bad + good(2)]))
        urls = [r.fields["URL"] for r in found if r.fields and r.block == HTTP]
        assert urls == [b"http://a/%d" % i for i in ok] and sum(r.problem is not None for r in found) == 1
    cut = list(warc.parse_arc([start + good(1) + good(2)[:-9]]))
    assert [bool(r.problem) for r in cut] == [False, False, True]
    assert [bool(r.problem) for r in warc.parse_arc([good(1)])] == [True, False]
    assert [bool(r.problem) for r in warc.parse_arc([start.replace(b"1 0 tide", b"9 0 tide") + good(1)])] == [True, False, False]
    assert list(warc.parse_arc([b"", b"\n\n"])) == []


@pytest.mark.parametrize("date,want", [("20010203040506", "2001-02-03T04:05:06Z"), ("200102030405", "2001-02-03T04:05:00Z"), ("20010203", "2001-02-03T00:00:00Z"), ("20011303040506", None), ("0", None), ("-", None)])
def test_dates(date, want):
    assert warc.iso(date) == want


def test_heads_and_kinds():
    assert warc.http_parts(b"HTTP/1.0 200 OK\nA: b\n\nbody\r\n\r\nmore") == ({"a": "b"}, b"HTTP/1.0 200 OK\nA: b\n\n", b"body\r\n\r\nmore")
    kind = lambda url, block: warc.describe(next(r for r in warc.parse_arc([warc.arc_version_block(1, NAME, DATE) + warc.arc_record(1, url, DATE, "text/dns", block, 0, NAME)]) if r.ordinal), "f", "")
    dns, ftp, web = kind(b"dns:a.org", b"20010203\na.org. IN A 1.2.3.4"), kind(b"ftp://a/b", b"data"), kind(b"http://a/", HTTP)
    assert [(x.kind, x.content_type) for x in (dns, ftp, web)] == [("resource", "text/dns"), ("resource", "text/dns"), ("response", "application/http; msgtype=response")]
    assert dns.size == 28 and web.size == len(HTTP) - 19


def test_folders_of_archives_on_disk(spark, tmp_path):
    """Plain and compressed archives of both versions, as one member or many, with a broken one among them."""
    (tmp_path / "a" / "sub").mkdir(parents=True)
    web = lambda i: b"HTTP/1.0 200 OK\nX-Page-Id: %d\n\n<p>same" % i
    record = lambda v, i: warc.arc_record(v, b"http://a/%d" % i, f"2001020304050{i % 10}", "text/html", web(i), 0, NAME)
    parts = {v: [warc.arc_version_block(v, NAME, DATE), record(v, 2 * v), warc.arc_record(v, b"dns:a.org", DATE, "text/dns", b"ip", 0, NAME), record(v, 2 * v + 1)] for v in (1, 2)}
    (tmp_path / "a" / "one.arc").write_bytes(b"".join(parts[1]))
    (tmp_path / "a" / "two.arc.gz").write_bytes(b"".join(map(warc.member, parts[2])))
    (tmp_path / "a" / "sub" / "whole.arc.gz").write_bytes(warc.member(b"".join([parts[1][0], record(1, 9)])))
    (tmp_path / "a" / "sub" / "cut.arc.gz").write_bytes(warc.member(b"".join([parts[2][0], record(2, 8), record(2, 7)[:-12]])))
    problems = warc.convert(spark, str(tmp_path / "a"), str(tmp_path / "w")).collect()
    assert [(r["file"].rsplit("/", 1)[1], r["record"]) for r in problems] == [("cut.arc.gz", 2)]
    rows = warc.read(spark, str(tmp_path / "w")).collect()
    assert sorted((r["record_type"], r["page_id"], r["refers_to"]) for r in rows if r["record_type"] != "resource") == sorted([("response", 2, None), *(("revisit", i, 2) for i in (3, 4, 5, 8, 9))])
    assert [(r["target_uri"], r["payload_bytes"]) for r in rows if r["record_type"] == "resource"] == [("dns:a.org", 2)] * 2
    assert all(r["payload_bytes"] == 7 for r in rows if r["record_type"] != "resource") and len({r["record_id"] for r in rows}) == len(rows)


def test_broken_archives_are_refused(spark, tmp_path):
    (tmp_path / "w").mkdir()
    made = warc.Described("response", "<urn:uuid:1>", "http://a/", "2001-01-01T00:00:00Z", "-", "application/http; msgtype=response", warc.digest(b"payload"), 7, 1, b"")
    record = warc.warc_record(made, b"HTTP/1.1 200 OK\r\nX-Page-Id: 1\r\n\r\npayload")
    for bad in (record.replace(b"payload", b"pAyload"), record[:-8], b"nonsense"):
        (tmp_path / "w" / "a.warc").write_bytes(bad + warc.END)
        with pytest.raises(Exception):
            warc.read(spark, str(tmp_path / "w")).collect()
