import gzip
import hashlib

from pyarrow import fs

from switchback.llm.shared import shared_dir
from switchback.llm.warc import build_index, parse_record, read_captures, round_trip, write_archives

BIG = "<p>" + "x" * 200 + "</p>"


def expected(rows):
    least = {}
    for page_id, _, html in rows:
        if page_id is not None:
            least[html or ""] = min(page_id, least.get(html or "", page_id))
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        first = least.get(html or "") if len(data) >= 100 else page_id
        revisit = first is not None and first != page_id
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = [
        (5, "http://a.example.com/x", BIG), (3, "http://b.example.com:8080/?q=1#f", BIG), (3, "http://b.example.com:8080/?q=1#f", BIG),
        (9, None, BIG), (None, "http://c.example.org", BIG), (1, "HTTP://user@Q.Example.COM/É é\r\nX: y", "short"), (2, "", "short"),
        (4, "no scheme", None), (6, "http://a.example.com/x", ""), (7, "u", "é" * 50), (8, "u", "é" * 49)
    ]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, key string")
    got = round_trip(df).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
    assert {(r.page_id, bytes(r.payload).decode()) for r in got if r.record_type == "response"} == {
        (3, BIG), (1, "short"), (2, "short"), (4, ""), (6, ""), (7, "é" * 50), (8, "é" * 49)
    }
    assert round_trip(df.limit(0)).collect() == []


def test_index_blocks_and_lookups(spark):
    df = spark.range(500).selectExpr("id AS page_id", "concat('http://h', id % 7, '.example.com/', id % 50) AS url", "concat('page ', id) AS html")
    archives, index = shared_dir(spark, "a"), shared_dir(spark, "i")
    entries = write_archives(df, archives, most_bytes=2000)
    shards = build_index(entries.union(entries.where("page_id = 17")), index, block_entries=4)
    wanted = entries.where("page_id % 3 = 0 OR page_id = 17").select("key", "page_id")
    wanted = wanted.union(wanted).union(spark.createDataFrame([("", 1), ("zzz", 5), ("com,example,h1)/1", 10**9)], "key string, page_id long"))
    got = sorted((r.page_id, bytes(r.payload).decode()) for r in read_captures(wanted, shards, index, archives).collect())
    assert got == sorted([(i, f"page {i}") for i in range(500) if i % 3 == 0 or i == 17] + [(17, "page 17")])
    files, base = fs.FileSystem.from_uri(archives)
    for info in files.get_file_info(fs.FileSelector(base)):  # the archives can be read whole, too
        data = gzip.decompress(files.open_input_file(info.path).read())
        assert data.startswith(b"WARC/1.1\r\n") and parse_record(data)["record_type"] == "response"


def test_hot_payloads_and_a_long_page(spark):
    rows = [(i, f"http://h{i % 11}.example.org/{i}", BIG if i % 3 == 0 else f"{BIG}{i % 40}" if i % 3 == 1 else f"short {i % 5}") for i in range(3000)]
    rows += [(9000, "http://long.example.org/", "é<p>\n" * 2_000_000), (9001, "http://long.example.org/", "é<p>\n" * 2_000_000)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, payload string").repartition(5)
    back = round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r) for r in back.collect()), key=str) == expected(rows)
    assert back.rdd.getNumPartitions() >= 8  # read by many tasks
