import datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemart.plans import registry
from tidemart.sources import files, raw, tables


def test_files_with_different_headers_merge_by_name(spark, lines_in):
    root = lines_in({"t_1.csv": "a,b\n1,2\n", "t_2.csv": "b,c\n5,6\n"})
    df = raw.read_delimited(spark, root, "t_*").drop(raw.LINEAGE)
    assert sorted(df.columns) == ["a", "b", "c"]
    assert rows(df.select("a", "b", "c")) == sorted([("1", "2", None), (None, "5", "6")], key=repr)


def test_same_columns_in_another_order(spark, lines_in):
    root = lines_in({"t_1.csv": "a,b\n1,2\n", "t_2.csv": "b,a\n4,3\n"})
    df = raw.read_delimited(spark, root, "t_*").select("a", "b")
    assert rows(df) == [("1", "2"), ("3", "4")]


def test_quotes_commas_blanks_and_repeated_headers(spark, lines_in):
    root = lines_in({"t_1.csv": 'Id,Note,note\n1,"x, ""y""",\n2,,z\n3,"",w\n'})
    df = raw.read_delimited(spark, root).drop(raw.LINEAGE)
    assert df.columns == ["id", "note"]
    assert rows(df) == [("1", 'x, "y"'), ("2", "z"), ("3", "w")]


def test_quoted_line_breaks_on_request(spark, lines_in):
    root = lines_in({"t_1.csv": 'a,b\n1,"two\nlines"\n'})
    assert rows(raw.read_delimited(spark, root, multiline=True).select("a", "b")) == [("1", "two\nlines")]


def test_files_that_are_not_utf8_are_read_as_latin1(spark, lines_in):
    root = lines_in({
        "t_1.csv": "name\ncafé\n",
        "t_2.csv": "name\ncaf\xe9\n".encode("latin-1"),
        "t_3.csv": "name\nodd � sign\n",
    })
    assert rows(raw.read_delimited(spark, root, encoding="auto").select("name")) == [
        ("café",), ("café",), ("odd � sign",)]


def test_missing_files_and_empty_files(spark, lines_in):
    root = lines_in({"t_1.csv": "", "u_1.csv": "a\n"})
    assert raw.read_delimited(spark, root, "x_*") is None
    assert raw.read_delimited(spark, root, "t_*") is None
    assert raw.read_delimited(spark, root, "u_*").count() == 0


def test_uploads_by_suffix(spark, lines_in, tmp_path):
    root = lines_in({
        "a.csv": "K,V\n1,x\n", "a.tsv": "K\tV\n1\tx\n", "a.json": '[{"K": "1", "V": "x"}]', "a.txt": "no",
    })
    spark.createDataFrame([("1", "x")], "K string, V string").write.parquet(f"{root}/a.parquet")
    for suffix in ("csv", "tsv", "json", "parquet"):
        assert rows(raw.read_upload(spark, f"{root}/a.{suffix}").select("K", "V")) == [("1", "x")]
    with pytest.raises(ValueError):
        raw.read_upload(spark, f"{root}/a.txt")
    with pytest.raises(FileNotFoundError):
        raw.read_upload(spark, f"{root}/none.csv")


def test_coverage(spark, lines_in):
    root = lines_in({"t_1.csv": "a,b\n1,2\n3,4\n", "t_2.csv": "b,c\n5,6\n"})
    got = rows(raw.coverage(raw.read_delimited(spark, root, "t_*")))
    assert got == [("t_1.csv", 2, 2, "a,b"), ("t_2.csv", 1, 2, "b,c")]


def test_partitions_are_discovered_typed_and_pruned(spark, tmp_path):
    df = spark.createDataFrame(
        [("Region_001", 20240101, 1), ("Region_002", 20240102, 2)], "region string, date_key int, n int")
    path = str(tmp_path / "fact")
    tables.write_partitioned(df, path, ["region", "date_key"])
    back = spark.read.parquet(path)
    assert dict(back.dtypes) == {"n": "int", "region": "string", "date_key": "int"}
    plan = back.filter("region = 'Region_001'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(region" in plan
    assert rows(back.filter("region = 'Region_001'").select("n")) == [(1,)]


def test_a_partition_value_is_not_split_into_many_files(spark, tmp_path):
    df = spark.range(0, 4000, 1, 8).withColumn("part", F.col("id") % 3)
    path = tmp_path / "t"
    tables.write_partitioned(df, str(path), ["part"])
    assert all(len(list(d.glob("*.parquet"))) == 1 for d in path.glob("part=*"))


def test_publish_replaces_a_table_that_is_being_read(spark, tmp_path):
    root = str(tmp_path)
    tables.publish(spark.range(3), root, "t")
    before = tables.read_current(spark, root, "t")
    tables.publish(before.selectExpr("id + 10 as id"), root, "t")
    assert rows(tables.read_current(spark, root, "t")) == [(10,), (11,), (12,)]
    assert rows(before) == [(0,), (1,), (2,)]
    for _ in range(3):
        tables.publish(spark.range(1), root, "t")
    assert len(list((tmp_path / "t").glob("v=*"))) == 2


def test_an_unfinished_version_is_not_current(spark, tmp_path):
    root = str(tmp_path)
    tables.publish(spark.range(3), root, "t")
    (tmp_path / "t" / "v=000002").mkdir()
    assert tables.read_current(spark, root, "t").count() == 3
    tables.publish(spark.range(5), root, "t")
    assert tables.read_current(spark, root, "t").count() == 5


def test_layer_discovery_skips_hidden_names(spark, tmp_path):
    root = str(tmp_path)
    spark.range(2).write.parquet(f"{root}/plain.parquet")
    spark.range(2).write.parquet(f"{root}/_staging")
    spark.range(2).write.parquet(f"{root}/.old")
    tables.publish(spark.range(4), root, "versioned")
    layer = tables.layer(spark, root)
    assert sorted(layer) == ["plain", "versioned"]
    assert rows(tables.row_counts(layer)) == [("plain", 2), ("versioned", 4)]
    tables.register_views(layer)
    assert spark.sql("SELECT count(*) FROM versioned").first()[0] == 4
    assert tables.discover(spark, f"{root}/nowhere") == {}


def test_raw_append_adds_batches_and_repeats_safely(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([("1", 'a "quoted" one')], "k string, v string")
    for batch in ("1", "2", "2"):
        tables.append_raw(df, root, "things", batch)
    assert rows(raw.read_delimited(spark, root, "things_*").select("k", "v")) == [("1", 'a "quoted" one')] * 2


def test_empty_report_keeps_its_columns(spark):
    assert tables.empty(spark, "a int, b date").columns == ["a", "b"]
    assert tables.sample(spark.range(10), 3).count() == 3
    assert datetime.date.today()


def test_scratch_is_dropped_after_a_step(spark):
    from tidemart import session
    from tidemart.sources import files

    with session.scratch_scope(spark):
        df = session.settle(spark.range(5), "probe")
        path = df.inputFiles()[0].rsplit("/", 1)[0]
        assert df.count() == 5 and files.exists(spark, path)
    assert not files.exists(spark, path)
    kept = session.settle(spark.range(5), "probe")
    assert kept.count() == 5


def test_the_shared_folder_is_the_one_the_session_names(spark, monkeypatch):
    from tidemart import session

    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or session.shared_dir(spark) == named.rstrip("/")
    assert session.scratch_dir(spark, "x").startswith(session.shared_dir(spark))


def test_finite(spark):
    from tidemart.functions.columns import finite

    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, -0.5), (4, None)], "k int, x double")
    assert rows(finite(df)) == [(1, None), (2, None), (3, -0.5), (4, None)]


def test_profile_with_samples(spark):
    layer = {"a": spark.createDataFrame([(1, "x")] * 4 + [(1, "x")], "n int, s string"), "b": spark.createDataFrame([(None, [1, 2])], "`a.b` double, l array<int>"),
             "none": spark.createDataFrame([], "k int")}
    got = {(r.table, r.column): (r.row_count, r.samples) for r in tables.profile(spark, layer, 3).collect()}
    assert got == {("a", "n"): (5, ["1"] * 3), ("a", "s"): (5, ["x"] * 3), ("b", "a.b"): (1, [None]), ("b", "l"): (1, ["[1, 2]"]), ("none", "k"): (0, [])}
    assert "samples" not in tables.profile(spark, layer).columns


def test_encodings_are_told_apart_in_one_scan(spark, lines_in):
    """UTF-8, Latin-1 and a file of both; names too; one scan, and nothing read before it but headers."""
    root = lines_in({
        "t_1.csv": "\ufeffname,straße\ncafé,日本\nplain,\U0001d11e\n", "t_2.csv": "name,straße\ncafé,ü\nplain,\n".encode("latin-1"),
        "t_3.csv": b"name,other\n\xc3\xa9t\xc3\xa9,1\n\xe9t\xe9,2\n\xff\xfe,3\n"})
    df = raw.read_delimited(spark, root, encoding="auto")
    assert sorted(df.columns) == ["name", "other", raw.LINEAGE, "straße"]
    assert rows(df.select("name", "straße", "other")) == sorted([
        ("café", "日本", None), ("plain", "\U0001d11e", None), ("café", "ü", None), ("plain", None, None),
        ("été", None, "1"), ("été", None, "2"), ("ÿþ", None, "3")], key=repr)
    one = raw.read_delimited(spark, root, "t_3*", encoding="auto")
    assert one._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def _given(spark, path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_json_files_follow_bytes_not_ids(spark, tmp_path, monkeypatch):
    """Ids far apart used to make a folder each; a column without any value used to be missing from what was read."""
    seen = []
    read = raw.read_json_records
    monkeypatch.setattr(registry.raw, "read_json_records", lambda s, path, *a: seen.append(path) or read(s, path, *a))
    goods = [(i * 10**6 if i else None, f'say "{i}"\n', None, float(i)) for i in range(40)]
    sf = _given(spark, tmp_path, part=spark.createDataFrame(goods, "p_partkey long, p_name string, p_type string, p_retailprice double"))
    got = registry.QUERIES["json_scan"](spark, sf).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((str(k) if k is not None else None, n, t, p) for k, n, t, p in goods), key=repr)
    assert len(files.data_files(spark, seen[0])) <= 4


def test_raw_users_need_no_transactions(spark, tmp_path):
    """Only the customers' tables are there: the raw files of users are made of nothing else."""
    people = [(1, "Ann", 0, "BUILDING"), (2, "Bob", 0, "FURNITURE"), (3, "Cid", 0, "MACHINERY")]
    sf = _given(
        spark, tmp_path, customer=spark.createDataFrame(people, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        nation=spark.createDataFrame([(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        region=spark.createDataFrame([(0, "R")], "r_regionkey int, r_name string"))
    got = registry.QUERIES["users_latest_by_file"](spark, sf).select("user_id", "city").collect()
    assert sorted(map(tuple, got)) == [("1", "N"), ("2", "N"), ("3", "R")]
    written = files.data_files(spark, registry.raw_files(spark, sf, "users"))
    assert written and all(path.endswith(".gz") for path in written)
