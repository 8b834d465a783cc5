"""ARC and WARC round trips, and files by other hands."""

import pytest
from pyspark.sql import functions as F

from barline.llm import archives

EVENTS = "event_id bigint, url string, ts bigint, payload string, type string"

BLOCK = b"1 0 Some Crawler\n" + archives.ARC_FIELDS[1].encode() + b"\n"
ARC_V1 = (
    b"filedesc://old.arc 0.0.0.0 19970304050607 text/plain %d\n" % len(BLOCK) + BLOCK + b"\n"
    b"\n\nhttp://a.example/with space 1.2.3.4 19970304050608 text/html 30\nHTTP/1.0 200 OK\r\n\r\nHello ARC!!\n"
    b"dns:a.example 1.2.3.4 199703040506 text/dns 9\na.example\n"
    b"not a header\n"
    b"http://b.example/ 1.2.3.4 19970304050609 text/html 500\nHTTP/1.0 200 OK\r\n\r\ncut"
)


def test_version_one_with_oddities():
    rows = list(archives.parse_arc(ARC_V1))
    assert [r.get("URL") for r in rows] == [
        "filedesc://old.arc", "http://a.example/with space", "dns:a.example", None, "http://b.example/"
    ]
    assert rows[1]["body"] == b"HTTP/1.0 200 OK\r\n\r\nHello ARC!!" and rows[1]["version"] == 1
    assert rows[3]["error"] and rows[4]["truncated"] and not rows[2]["truncated"]
    warc = list(archives._convert("file:/x/old.arc", ARC_V1))
    assert [r.get("type") for r in warc] == ["warcinfo", "response", "resource", None, "response"]
    assert warc[2]["date"] == "1997-03-04T05:06:00Z" and warc[1]["payload"] == b"Hello ARC!!"
    assert len({r["record_id"] for r in warc}) == 5 and list(archives._convert("y/old.arc", ARC_V1)) == warc


def test_version_two_fields():
    body = b"HTTP/1.1 404 Not Found\r\nX: y\r\n\r\nno"
    block = b"2 0 c\n" + archives.ARC_FIELDS[2].encode() + b"\n"
    data = b"filedesc://v2.arc 0.0.0.0 20010101000000 text/plain 200 - - 0 v2.arc %d\n" % len(block) + block + b"\n"
    data += b"http://c.example/ 9.9.9.9 20010203040506 text/html 404 abc - 12 v2.arc %d\n" % len(body) + body + b"\n"
    first, second = archives.parse_arc(data)
    assert (second["version"], second["Result-code"], second["Checksum"], second["body"]) == (2, "404", "abc", body)


def round_trip(spark, tmp_path, rows, version):
    df = spark.createDataFrame([(*r, "clash") for r in rows], EVENTS)
    arc, warc = f"{tmp_path}/arc", f"{tmp_path}/warc"
    archives.write_arc(df.coalesce(1), arc, version, per_file=4)
    archives.write_warc(archives.convert_arc(spark, arc, "bigint"), warc, per_file=3)
    return archives.read_warc(spark, warc, "bigint")


def test_round_trip(spark, tmp_path):
    nasty = "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n\r\n\r\nfiledesc://x 0 0 0 9\n" * 5
    rows = [
        (1, "http://a.example/", 0, "x" * 100), (2, "http://b.example/ p", 1_000, "x" * 100), (3, None, None, "x" * 99),
        (4, "http://d.example/", 86_400_000, "x" * 99), (5, "http://e.example/", 0, None), (6, "", 0, ""), (7, "é", 0, nasty),
        (8, "http://g.example/", 0, nasty), (9, "http://h.example/", 0, "ü" * 300_000), (10, "http://h.example/", 0, "\r\n\r\n"),
    ]
    for version in (1, 2):
        folder = tmp_path / str(version)
        folder.mkdir()
        got = {r["event_id"]: r for r in round_trip(spark, folder, rows, version).filter("type <> 'warcinfo'").collect()}
        assert {i: (r["type"], r["refers_to"]) for i, r in got.items() if r["type"] == "revisit"} == {2: ("revisit", 1), 8: ("revisit", 7)}
        for i, _, _, payload in rows:
            r = got[i]
            assert r["error"] is None and r["payload_bytes"] == len((payload or "").encode())
            assert r["type"] == "revisit" or bytes(r["payload"]).decode() == (payload or "")
        assert got[2]["payload_digest"] == got[1]["payload_digest"] and got[4]["date"] == "1970-01-02T00:00:00Z"
        assert got[3]["uri"] == "urn:event:3" and got[2]["uri"] == "http://b.example/%20p"


def test_damaged_warc_gives_an_error_row(spark, tmp_path):
    data = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 10\r\n\r\nshort"
    assert next(archives.parse_warc("f", data))["error"]
    assert next(archives.parse_warc("f", b"rubbish"))["error"]


def test_empty_table(spark, tmp_path):
    assert round_trip(spark, tmp_path, [], 1).count() == 0


def test_repeated_ids_and_null_ids(spark, tmp_path):
    rows = [(None, "u:a", 0, "y" * 200), (4, "u:b", 0, "y" * 200), (4, "u:c", 0, "y" * 200), (None, "u:d", 0, "y" * 200)]
    got = round_trip(spark, tmp_path, rows, 1).filter("type <> 'warcinfo'").groupBy("type").agg(F.count("*").alias("n"), F.max("refers_to").alias("r"))
    assert {r["type"]: (r["n"], r["r"]) for r in got.collect()} == {"response": (1, None), "revisit": (3, 4)}


def test_no_page_is_lost_by_its_id_time_or_url(spark, tmp_path):
    rows = [
        (5_000_000_000, "http://a.example/", 5_000_000_000 * 60_000, "a"), (1 << 60, "filedesc://b 0", (1 << 62), "b"),
        (-7, "filedesc://c", -5, "2 0 c"), (8, "filedesc://d.arc 0.0.0.0 19700101000000 text/plain 4", 0, "z" * 200),
    ]
    for version in (1, 2):
        folder = tmp_path / str(version)
        folder.mkdir()
        got = {r["event_id"]: r for r in round_trip(spark, folder, rows, version).filter("type = 'response'").collect()}
        assert {i: bytes(r["payload"]).decode() for i, r in got.items()} == {i: p for i, _, _, p in rows}
        assert got[1 << 60]["date"] == "9999-12-31T23:59:59Z" and got[-7]["date"] == "1970-01-01T00:00:00Z"


def test_ids_of_any_size_in_the_query(spark, tmp_path):
    from barline.llm.queries import op2_warc

    ids = [1, 2, 4_223_371_200, 5_000_000_000, 1 << 60, (1 << 63) - 1, -3, -(1 << 63), None]
    pages = spark.createDataFrame([(i, "filedesc://x", f"page {i}") for i in ids], "page_id bigint, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted((r["page_id"] for r in op2_warc(spark, str(tmp_path)).collect()), key=str) == sorted(ids, key=str)


def test_errors_of_a_damaged_archive_are_not_swallowed(spark, tmp_path):
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "old.arc").write_bytes(ARC_V1)
    records = archives.convert_arc(spark, str(tmp_path / "arc"))
    assert records.filter("error IS NOT NULL").count() == 1
    with pytest.raises(Exception, match="no header line"):
        archives.write_warc(records, f"{tmp_path}/strict")
    archives.write_warc(records, f"{tmp_path}/loose", skip_errors=True)
    assert archives.read_warc(spark, f"{tmp_path}/loose").count() == 4
