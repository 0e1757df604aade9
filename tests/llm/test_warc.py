import base64
import gzip
import hashlib
from pathlib import Path

from pyspark.sql import functions as F

from lexiloom.llm import warc as w


def plain(rows, min_bytes=0):
    """page_id, bytes, digest, type, refers_to by definition; rows of one page_id and payload are alike but for one response."""
    sha = lambda h: hashlib.sha1((h or "").encode()).digest()
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    out, seen = [], {}
    for k, r in enumerate(sorted(rows, key=order)):
        size, d = len((r[2] or "").encode()), sha(r[2])
        at, first = seen.setdefault(d, (k, r)) if size >= min_bytes else (k, r)
        out.append((r[0], size, base64.b32encode(d).decode(), "response" if at == k else "revisit", None if at == k else first[0]))
    return out


def same(a, b):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted(map(tuple, a), key=key) == sorted(b, key=key)


ROWS = [
    (3, "http://a.example.org/x", "same"), (2, "http://b.example.org/x", "same"), (9, "https://www.a.example.org:443/x#top", "same"), (None, "http://c.example.org", "same"),
    (5, None, None), (4, "no url", ""), (6, "http://a.example.org/é?q=\r\n1", "ünï\r\n\r\n\U0001f600"), (7, "http://a.example.org/x", "x" * 300_000),
    (8, "HTTP://user@A.Example.org:8080", "own"), (8, "http://a.example.org/y", "own"), (10, "dup", "dup"), (10, "dup", "dup"), (None, None, "same"), (-1, "http://[::1]/", "z"),
]


def test_query(spark, tmp_path):
    more = [(100 + i, f"http://h{i % 7}.example.com/{i % 50}", f"text {i % 90}") for i in range(500)]
    rows = [tuple(r) for r in ROWS + more]
    spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, row string").repartition(5).write.parquet(str(tmp_path / "pages.parquet"))
    got = w.op11_warc(spark, str(tmp_path))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert same(got.collect(), plain(rows))


def test_keys():
    assert w.url_key("https://www.Blog.Example.com:443/en/1?x=2#top") == "com,example,blog)/en/1?x=2"
    assert w.url_key("http://example.com") == w.url_key("//example.com/") == "com,example)/"
    assert w.url_key("http://u:p@example.com:8080?q") == "com,example:8080)/?q"
    assert w.url_key(None) == ")" and w.url_key("x y") == ")x y"


def test_archives_are_warc(spark):
    """Files of one gzip member a record, in the format's order of lines."""
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    archives = w.write_archives(pages, min_bytes=4, limit=2000)
    captures = archives.captures.collect()
    assert len(captures) == len(ROWS)
    assert {r["type"] for r in captures if r["page_id"] in (5, 4, 8, 10)} == {"response"}
    folder = Path(archives.root.removeprefix("file:"))
    for name in {r["archive"] for r in captures}:
        raw = gzip.decompress((folder / name).read_bytes())
        assert raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    records = w.read_records(archives, archives.captures)
    texts = {(r["page_id"], r["payload"].decode()) for r in records.where("record_type = 'response'").collect()}
    assert (6, ROWS[6][2]) in texts and (7, "x" * 300_000) in texts
    assert same(records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect(), plain(ROWS, 4))


def test_lookup_reads_few_blocks(spark, tmp_path):
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.format_string("http://h%d.example.com/%d", F.col("id") % 40, F.col("id") % 1000).alias("url"), F.lit("t").alias("html"))
    archives = w.write_archives(pages)
    index = w.write_index(archives, lines=50)
    assert index.table.agg(F.sum("captures")).first()[0] == 4000
    asked = ["http://h7.example.com/7", "http://h0.example.com/0#x", "http://nowhere.example.com/", None, "http://h7.example.com/7"]
    found = w.lookup(index, spark.createDataFrame([(u,) for u in asked], "url string"))
    assert sorted(r["page_id"] for r in found.collect()) == sorted(i for i in range(4000) if (i % 40, i % 1000) in ((7, 7), (0, 0)))
    system, folder = w._files(index.root)
    name = next(n for n, first, last in index.parts if first <= "com,example,h7)/7" <= last)
    part = w.IndexPart(system, f"{folder}/{name}")
    assert [c[2] for c in part.captures("com,example,h7)/7")] and part.reads <= 2 < len(part.directory)


def test_one_url_over_many_blocks(spark):
    pages = spark.range(3000).select("id", F.lit("http://hot.example.com/").alias("url"), F.lit("t").alias("html")).withColumnRenamed("id", "page_id")
    archives = w.write_archives(pages)
    index = w.write_index(archives, lines=100)
    assert len(index.parts) > 1
    found = w.lookup(index, pages.select("url"))
    assert sorted(r["page_id"] for r in found.collect()) == list(range(3000))
    kinds = w.read_records(archives, found).groupBy("record_type", "refers_to").count().collect()
    assert {(r["record_type"], r["refers_to"], r["count"]) for r in kinds} == {("response", None, 1), ("revisit", 0, 2999)}


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    archives = w.write_archives(pages)
    index = w.write_index(archives)
    assert index.parts == []
    assert w.read_records(archives, w.lookup(index, pages)).count() == 0
