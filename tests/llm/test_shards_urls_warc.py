import hashlib
import io
import zlib

import pytest
import zstandard

from tests.compare import connect, difference
from tidemart.llm import queries, shards, urls, warc


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(name, spark, sf, con):
    assert difference(queries.QUERIES[name](spark, sf), con, queries.ORACLE[name]) is None


# -- sharding ---------------------------------------------------------------------------------

DOCS = "doc_id long, text string, shard string, slot int"


def test_shards_of_odd_rows(spark):
    rows = [(None, None, "x", 1), (1, "", "x", 1), (1, "", "x", 1), (2, "é" * 70_000, None, None), (3, "same", "", 0), (4, "same", "", 0)]
    got = shards.shard_documents(spark.createDataFrame(rows, DOCS), 4).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted(
        (d or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _, _ in rows)
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert max(sum(r.shard == s for r in got) for s in range(4)) - min(sum(r.shard == s for r in got) for s in range(4)) <= 1
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


def test_shards_of_an_empty_table(spark):
    assert shards.shard_documents(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 10, 200, 1001])
def test_permutation_whatever_the_partitioning(spark, n):
    df = spark.range(n)
    one = {r.id: r.position for r in shards.shuffle_into_shards(df.repartition(7), ["id"], 3, 5).collect()}
    two = {r.id: r.position for r in shards.shuffle_into_shards(df.coalesce(1), ["id"], 3, 5).collect()}
    assert one == two and sorted(one.values()) == list(range(n))
    if n > 100:
        assert sum(abs(one[i] - i) < n / 20 for i in range(n)) < n / 4
        other = {r.id: r.position for r in shards.shuffle_into_shards(df, ["id"], 3, 6).collect()}
        assert other != one


def test_walks_end(spark):
    for n in (5, 17, 90, 1000):
        a, b = shards.grid(n)
        steps = shards.walk_length(spark, n, a, b, 1)
        assert a * b >= n and 1 <= steps <= a * b - n + 1


# -- url rules --------------------------------------------------------------------------------

URLS = [
    ("http://example.net/en/x", "allow", "example.net/en/"), ("https://A.Example.NET/en/", "allow", "example.net/en/"),
    ("https://a.example.net/EN/", "block", "net/"), ("http://x.net", "allow", None), ("http://x.net/", "block", "net/"),
    ("http://notnet/", "allow", None), ("http://net/", "block", "net/"), ("http://example.com/de/1?q#f", "block", "example.com/de/"),
    ("http://example.com/de", "allow", None), ("http://x.org/fr/a?b", "allow", "org/fr/"), ("no scheme net/", "allow", None),
    (None, "allow", None), ("", "allow", None), ("http://", "allow", None), ("://x.net/#://", "block", "net/"),
    ("http://x.net?/", "allow", None), ("http://x\n.net/\n", "block", "net/"), ("http://x.net/" + "a" * 100_000, "block", "net/"),
]


def test_rules(spark):
    rows = [(i, u, "host", "v") for i, (u, _, _) in enumerate(URLS)] * 2
    got = urls.judge(spark.createDataFrame(rows, "page_id int, url string, host string, verdict string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.verdict, r.rule) == URLS[r.page_id][1:], URLS[r.page_id][0][:50]
    by_id = {r.page_id: r for r in got}
    assert (by_id[1].host, by_id[1].path) == ("a.example.net", "/en/")
    assert (by_id[7].host, by_id[7].path) == ("example.com", "/de/1")
    assert (by_id[10].host, by_id[10].path) == ("", "")


def test_rules_against_brute_force(spark, sf):
    rules = [("block", "", "/tag/"), ("allow", "example.com", ""), ("block", "www.example.com", "/en/1"), ("allow", "tionsh.example.net", "/e"),
             ("block", "tionsh.example.net", "/d"), ("block", "a+b.org", "/(x"), ("block", "org", "/en/")]
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    extra = spark.createDataFrame([(-1, "http://z.a+b.org/(x/"), (-2, "http://zaab.org/(x/"), (-3, "http://q/tag/")], "page_id long, url string")
    for r in urls.judge(pages.unionByName(extra), rules).collect():
        fit = [(len(h + p), v == "block", [-ord(c) for c in h + p], h + p, v) for v, h, p in rules
               if (not h or r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        assert (r.rule, r.verdict) == (max(fit)[3:] if fit else (None, "allow"))


def test_rules_of_an_empty_table(spark):
    assert urls.judge(spark.createDataFrame([], "page_id int, url string")).collect() == []


# -- web archives -----------------------------------------------------------------------------

LONG = "x" * 999
PAGES = [
    (1, "http://a/", LONG + "é"), (2, "http://b/", LONG + "é"), (3, None, LONG + "é"), (3, None, LONG + "é"), (None, "http://c/%\r\n", LONG + "é"),
    (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "ü", "\r\n\r\nWARC/1.1\r\n" * 5), (9, "u", "long " * 60_000),
    (None, "v", "y" * 2000), (None, "v", "y" * 2000), (10, "z", LONG),  (11, "z", LONG),
]


def test_archives_come_back(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, payload string").repartition(3)
    got = warc.round_trip(spark, pages, f"file://{tmp_path}/w", payloads=True)
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1]), r[2] or b"")
    back = warc.resolve(got).select("page_id", "url", "payload").collect()
    assert sorted(((r.page_id, r.url, bytes(r.payload)) for r in back), key=key) == sorted(
        ((p, u, (h or "").encode()) for p, u, h in PAGES), key=key)
    for r in got.collect():
        if r.page_id in (1, 2) or (r.page_id is None and r.payload_bytes == 1001):
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", 3, None)
            assert r.payload_digest == hashlib.sha1((LONG + "é").encode()).hexdigest() and r.payload_bytes == 1001
        else:
            assert (r.record_type, r.refers_to) == ("response", None)
    assert len(list((tmp_path / "w").iterdir())) == got.select("archive").distinct().count()


def test_only_repeated_payloads_are_moved(spark):
    """Without broadcasts, rows whose digest is not repeated pass beside the shuffle."""
    pages = spark.createDataFrame([(i, "u", f"{i % 40 if i < 60 else i} " * 800) for i in range(200)], "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        still = warc.plan_records(pages).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r.page_id: r.refers_to for r in still} == {i: i + 40 if i < 20 else None for i in range(200)}
    rows = pages.withColumn("payload_digest", warc.F.sha1(warc.F.col("html").cast("binary")))
    keys = rows.groupBy("payload_digest").count().filter("count > 1")
    maybe, others = warc.parted(rows, keys, ("payload_digest",))
    assert maybe.count() <= 42 and maybe.count() + others.count() == 200
    assert "hashpartitioning" not in others._jdf.queryExecution().executedPlan().toString()


def test_stores_by_their_addresses():
    assert warc._store("/tmp/x")[1] == "/tmp/x" and warc._store("file:///tmp/x")[1] == "/tmp/x"
    for path in ("s3a://bucket/a/b", "s3://bucket/a/b"):
        store, root = warc._store(path + "?region=us-east-1")
        assert store.type_name == "s3" and root == "bucket/a/b"


def test_empty_table_makes_no_archive(spark, tmp_path):
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/w").collect() == []


def test_file_layout():
    out = io.BytesIO()
    out.close = lambda: None
    archive = warc.Archive(lambda: out)
    records = [warc.record_bytes(i, f"http://x/{i}", f"<html><body>page number {i} of many</body></html>".encode() * 20, f"{i:040x}", None) for i in range(200)]
    for r in records:
        archive.add(r)
    archive.close()
    data = out.getvalue()
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little")
    size = int.from_bytes(data[4:8], "little")
    dictionary = zstandard.ZstdCompressionDict(data[8:8 + size])
    assert dictionary.dict_id() != 0
    # frames stand alone: the second one can be decompressed from its own offset
    at, frames = 8 + size, []
    while at < len(data):
        frame = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        frames.append(frame.decompress(data[at:]))
        at = len(data) - len(frame.unused_data)
    assert frames == records
    plain = sum(len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(r)) for r in records)
    assert archive.size - size - 8 < plain
    assert [f["X-Page-Id"] for f, _ in warc.read_archive(io.BytesIO(data))] == [str(i) for i in range(200)]
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(data[:-3])))
