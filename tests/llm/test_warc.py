import base64
import hashlib

from pricelens.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"
TRAP = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nHTTP/\r\n\r\n"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def trip(spark, tmp_path, rows, **more):
    folder = f"file://{tmp_path}/warc"
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), folder, **more)
    return warc.read_archives(spark, folder).collect()


def test_round_trip_with_traps(spark, tmp_path):
    texts = ["<p>ä\r\n\r\nb</p>", None, "", TRAP, f"x{TRAP}{TRAP}y" + "WARC/1.0\r\n" * 3, "x" * 300_000 + TRAP, "<p>ä\r\n\r\nb</p>", TRAP * 40, "WARC/1.0\r\nContent-Length: 99999\r\n\r\n"]
    rows = [(i, f"http://a b/{i}\n" if i % 2 else None, t, "clash") for i, t in enumerate(texts)] * 1 + [(50 + i, "u", f"{i % 7} words", "x") for i in range(60)]
    got = {r.page_id: r for r in trip(spark, tmp_path, rows)}
    assert len(got) == len(rows)
    first = {}
    for i, _, t, _ in sorted(rows, key=lambda r: r[0]):
        first.setdefault(t or "", i)
    for i, _, t, _ in rows:
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len((t or "").encode()), digest(t))
        assert (r.record_type, r.refers_to) == (("response", None) if first[t or ""] == i else ("revisit", first[t or ""]))
        assert r.payload is None if r.refers_to is not None else bytes(r.payload).decode() == (t or "")


def test_other_splits_after_the_chain(spark, tmp_path, monkeypatch):
    """Executors come and go: what was numbered before and what is read after must still agree."""
    folder = f"file://{tmp_path}/warc"
    rows = [(i, "u", f"<p>{i}</p>" + (f"text {TRAP} more" if i % 10 == 3 else "words " * (i % 50)), "x") for i in range(400)]
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(8), folder)
    chain = warc.chain

    def changed(found):
        judged = chain(found)
        spark.conf.set("spark.sql.files.minPartitionNum", "64")
        return judged

    monkeypatch.setattr(warc, "chain", changed)
    spark.conf.set("spark.sql.files.minPartitionNum", "2")
    try:
        got = warc.read_archives(spark, folder).collect()
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert sorted((r.page_id, r.payload_digest) for r in got) == [(i, digest(t)) for i, _, t, _ in rows]


def test_small_payloads_and_repeated_ids(spark, tmp_path):
    rows = [(1, "u", "aa", "x"), (2, "u", "aa", "x"), (3, "u", "aaaa", "x"), (4, "u", "aaaa", "x"), (3, "u", "aaaa", "x"), (None, "u", "aaaa", "x")]
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in trip(spark, tmp_path, rows, least_bytes=3))
    assert got == [(0, "revisit", 3), (1, "response", 0), (2, "response", 0), (3, "response", 0), (3, "response", 0), (4, "revisit", 3)]


def test_empty_table(spark, tmp_path):
    assert trip(spark, tmp_path, []) == []


def record(page, body, version="1.0"):
    http = f"HTTP/1.1 200 OK\r\nContent-Length: {len(body)}\r\n\r\n{body}"
    return f"WARC/{version}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{page}>\r\nContent-Length: {len(http)}\r\n\r\n{http}\r\n\r\n"


def read(spark, tmp_path, **files):
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    return sorted((r.page_id, bytes(r.payload).decode()) for r in warc.read_archives(spark, f"file://{tmp_path}").collect())


def test_other_versions_and_files_without_a_leading_record(spark, tmp_path):
    """No record is lost or invented: a file that starts with anything else is left out whole."""
    both = record(1, "one", "1.1") + record(2, f"two {record(9, 'trap', '1.1')}", "1.1")
    preamble = "WARC-Record-ID: <urn:page:77>\r\nContent-Length: 20\r\n\r\nHTTP/1.1 200 OK\r\n\r\nx\r\n\r\n" + record(3, "three")
    got = read(spark, tmp_path, a=both, b=preamble, c="WARC/1.x\r\n" + record(4, "four"), d=record(5, "five") + "trailing", e="nothing at all", f=record(6, "says WARC/1.zero"))
    assert got == [(1, "one"), (2, f"two {record(9, 'trap', '1.1')}"), (5, "five"), (6, "says WARC/1.zero")]


def test_one_archive_in_many_splits(spark, tmp_path):
    texts = {i: f"<p>{i}</p>" + ("word " * (i % 90)) + (record(1000 + i, "trap") if i % 7 == 0 else "") for i in range(600)}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    whole = "".join(record(i, t) for i, t in texts.items())
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(len(whole) // 50))
    try:
        got = read(spark, tmp_path, one=whole)
        assert spark.read.option("lineSep", warc.MAGIC).text(f"file://{tmp_path}").rdd.getNumPartitions() >= 50
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted(texts.items())
