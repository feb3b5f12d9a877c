import json

import pytest

from runledger.functions.money import cents
from runledger.operators.gates import required_keys
from runledger.operators.medallion import figures, gold_revenue, publish_snapshot
from runledger.operators.scan import Exemption, ScanRule, in_scope, term_scan
from runledger.operators import gates
from runledger.plans.acceptance import accept_run
from runledger.session import scratch_dir
from runledger.sources.landing import landed_days, landing_read, landing_stream, latest_day, missing_landings, parse_payload
from runledger.sources.snapshots import read_snapshot
from runledger.sources.tables import metadata_options, register_external, write_version
from runledger.sources.texts import paused_flag, read_pins, read_text_files
from runledger.sources.topics import kafka_options
from pyspark.sql import functions as F


@pytest.fixture
def landing(tmp_path):
    for date, lines in {
        "2024-01-01": ['{"id": 1, "amount": 5}'],
        "2024-01-10": ['{"id": 2, "amount": 6}', '{"id": "x", "amount": 7}', "not json"],
        "2024-01-09": ['{"id": 3}'],
    }.items():
        folder = tmp_path / f"landing_date={date}"
        folder.mkdir()
        (folder / "part.json").write_text("\n".join(lines) + "\n")
    return str(tmp_path)


def test_only_the_latest_landing_is_read_and_bad_records_stay(spark, landing):
    df = landing_read(spark, landing, "id bigint, amount bigint")
    got = sorted(
        (r.id or 0, r.amount or 0, r._corrupt_record, str(r.landing_date)) for r in df.collect()
    )
    assert got == [
        (0, 0, "not json", "2024-01-10"),
        (0, 7, '{"id": "x", "amount": 7}', "2024-01-10"),
        (2, 6, None, "2024-01-10"),
    ]


def test_older_landings_are_pruned(spark, landing):
    df = landing_read(spark, landing, "id bigint, amount bigint").select("id")
    files = df.inputFiles()
    assert len(files) == 1 and "landing_date=2024-01-10" in files[0]


def test_an_empty_newest_landing_is_not_hidden(spark, landing, tmp_path):
    folder = tmp_path / "landing_date=2024-01-11"
    folder.mkdir()
    for files in ([], ["part.json"]):
        for name in files:
            (folder / name).write_text("")
        latest = landing_read(spark, landing, "id bigint, amount bigint")
        assert latest.columns == ["id", "amount", "_corrupt_record", "landing_date"]
        broken = gates.non_empty({"feed": latest}).collect()
        assert [(r.gate, r.entity) for r in broken] == [("non_empty", "feed")]
    assert landing_read(spark, str(tmp_path / "nowhere"), "id bigint").isEmpty()


def test_registering_never_deletes_data(spark, tmp_path):
    spark.range(5).write.mode("overwrite").saveAsTable("kept_managed")
    spark.range(6).write.parquet(str(tmp_path / "one"))
    spark.range(7).write.parquet(str(tmp_path / "two"))
    spark.range(1).createOrReplaceTempView("kept_view")
    try:
        assert register_external(spark, {"kept_ext": str(tmp_path / "one")}).first().n_rows == 6
        spark.range(6, 9).write.mode("append").parquet(str(tmp_path / "one"))
        paths = {"kept_managed": str(tmp_path / "missing"), "kept_ext": str(tmp_path / "two")}
        got = {r.table_name: (r.registered, r.error) for r in register_external(spark, paths).collect()}
        assert got == {"kept_managed": (False, "TABLE_NOT_EXTERNAL"), "kept_ext": (False, "TABLE_OF_ANOTHER_FOLDER")}
        assert spark.table("kept_managed").count() == 5
        again = register_external(spark, {"kept_ext": str(tmp_path / "one")}).first()
        assert (again.registered, again.n_rows) == (True, 9)
    finally:
        spark.sql("DROP TABLE IF EXISTS kept_managed")
        spark.sql("DROP TABLE IF EXISTS kept_ext")


def test_the_landing_is_also_a_stream(spark, landing, tmp_path_factory):
    out = tmp_path_factory.mktemp("stream")
    query = (
        landing_stream(spark, landing, "id bigint, amount bigint", files_per_batch=1)
        .writeStream.format("parquet")
        .option("path", str(out / "out"))
        .option("checkpointLocation", str(out / "cp"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert spark.read.parquet(str(out / "out")).count() == 5


def test_payload_of_the_last_day(spark):
    df = spark.createDataFrame(
        [("2024-01-01 23:59:59", '{"k": 1}'), ("2024-01-02 00:00:00", '{"k": 2}'),
         ("2024-01-02 10:00:00", "{k")],
        "ts string, props string",
    ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = parse_payload(latest_day(df, "ts"), "props", "k bigint").orderBy("ts").collect()
    assert [(r.k, r._corrupt_record) for r in got] == [(2, None), (None, "{k")]


def test_one_failing_table_does_not_hide_the_others(spark, tmp_path):
    spark.range(7).write.parquet(str(tmp_path / "good"))
    spark.range(3).write.parquet(str(tmp_path / "it's"))
    paths = {n: str(tmp_path / n) for n in ("good", "missing", "it's")}
    paths["quoted"] = paths.pop("it's")
    # Its schema can be read, one of its files cannot.
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "torn"))
    (tmp_path / "torn" / "part-99999-torn.snappy.parquet").write_bytes(b"no parquet at all")
    paths["torn"] = str(tmp_path / "torn")
    got = {r.table_name: r for r in register_external(spark, paths, prefix="t_").collect()}
    assert (got["good"].registered, got["good"].n_rows, got["good"].error) == (True, 7, None)
    assert (got["quoted"].registered, got["quoted"].n_rows) == (True, 3)
    assert not got["missing"].registered and got["missing"].n_rows is None
    assert got["missing"].error and got["torn"].error and got["torn"].n_rows is None
    # Registering again replaces the entry and leaves the data alone.
    again = register_external(spark, paths, prefix="t_").where("error is null").count()
    assert again == 2 and spark.table("t_good").count() == 7


def test_a_version_is_never_overwritten(spark, tmp_path):
    write_version(spark.range(1), str(tmp_path), "1")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_version(spark.range(2), str(tmp_path), "1")


def test_snapshot_is_json_and_reads_back(spark, tmp_path, rows):
    df = spark.createDataFrame([("a", 1.1), ("a", 2.2), ("b", 3.3)], "g string, x double")
    parts = [
        figures(df, {"n": F.count(F.lit(1)), "cents": F.sum(cents(df.x))}, ["g"]),
        figures(df, {"all": F.count(F.lit(1)), "none": F.sum(F.lit(None).cast("bigint"))}),
    ]
    publish_snapshot("r1", parts, str(tmp_path / "snap"))
    files = list((tmp_path / "snap").glob("*.json"))
    records = [json.loads(line) for f in files for line in f.read_text().splitlines()]
    assert {"run_id": "r1", "metric": "cents/a", "value": 330} in records
    assert rows(read_snapshot(spark, str(tmp_path / "snap"))) == [
        ("r1", "all", 3), ("r1", "cents/a", 330), ("r1", "cents/b", 330), ("r1", "n/a", 2),
        ("r1", "n/b", 1), ("r1", "none", None),
    ]


def test_a_run_is_accepted_on_its_figures(spark, tmp_path, rows):
    part = figures(spark.range(4), {"n": F.count(F.lit(1))})
    right = spark.createDataFrame([("n", 4)], "metric string, value bigint")
    wrong = spark.createDataFrame([("n", 5)], "metric string, value bigint")
    path = str(tmp_path / "snap")
    assert rows(accept_run(spark, "r1", [part], right, path)) == [("n", 4, 4, "match")]
    assert rows(accept_run(spark, "r2", [part], wrong, path)) == [("n", 4, 5, "differ")]


def test_pins_are_read_and_checked(spark, tmp_path, rows):
    file = tmp_path / "versions.env"
    file.write_text("# A=0\nDB = 16\nno pin\n  #B=1\nURL=http://x?a=b\n")
    pins = read_pins(spark, str(file))
    assert rows(pins) == [("DB", "16"), ("URL", "http://x?a=b")]
    vendors = spark.createDataFrame([("p", "stream")], "entity string, kind string")
    missing = required_keys(vendors, {"stream": ["DB", "BROKER"]}, pins)
    assert [r.detail for r in missing.collect()] == ["missing key BROKER"]


def test_files_of_a_tree_are_scanned_by_scope(spark, tmp_path, rows):
    base = tmp_path / "tree + é"
    for path, data in {
        "zoo.cfg": b"north = zebra\nsouth = lion # no zebra\n",
        "pens/a.cfg": b"paint = zebra-stripe\r\npen = zebra\r\n",
        "guide.md": b"zebra",
        "tests/a.py": b"zebra",
        "pens/tests/b.py": b"  zebra  ",
        "photo.bin": b"zebra \xff\xfe",
    }.items():
        (base / path).parent.mkdir(parents=True, exist_ok=True)
        (base / path).write_bytes(data)
    files = read_text_files(spark, str(base))
    assert files.count() == 5
    covered = files.where(in_scope(F.col("path")))
    found = term_scan(covered, ScanRule("zebra", (Exemption("zebra-stripe", True),)))
    assert rows(found) == [
        ("pens/a.cfg", 2, "pen = zebra"),
        ("pens/tests/b.py", 1, "zebra"),
        ("zoo.cfg", 1, "north = zebra"),
    ]


def test_metadata_options():
    assert "numPartitions" not in metadata_options("jdbc:x", "dag_run")
    assert metadata_options("jdbc:x", "t", "id", (0, 9), 4)["numPartitions"] == "4"
    with pytest.raises(ValueError):
        metadata_options("jdbc:x", "t", parts=4)


def test_paused_words(spark):
    df = spark.createDataFrame([("True",), ("False",), ("",), (None,)], "is_paused string")
    assert [r[0] for r in df.select(paused_flag()).collect()] == [True, False, None, None]


def test_kafka_options_need_both_fields():
    options = kafka_options({"bootstrap": "b:9092", "topic": "t"}, startingOffsets="latest")
    assert options["kafka.bootstrap.servers"] == "b:9092"
    assert options["subscribe"] == "t" and options["startingOffsets"] == "latest"
    with pytest.raises(ValueError, match="topic"):
        kafka_options({"bootstrap": "b:9092"})


def test_scratch_is_the_shared_folder(spark):
    assert scratch_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")


def test_scratch_is_refused_on_a_cluster_that_names_no_folder():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Session(), "x")


def test_days_without_a_folder_are_told_from_empty_ones(spark, tmp_path):
    def land(feed, day, *texts):
        folder = tmp_path / f"feed={feed}" / f"landing_date=2024-01-{day:02d}"
        folder.mkdir(parents=True)
        for i, text in enumerate(texts):
            (folder / f"part-{i}.json").write_text(text)

    for day in (1, 2, 5, 6, 9):
        land("a", day, "{}")
    land("a", 3)  # a folder without files
    land("a", 7, "", "")  # empty files only
    land("b%2Fc", 4, "{}")
    (tmp_path / "feed=a" / "_tmp").mkdir()
    (tmp_path / "notes").mkdir()
    days = landed_days(spark, str(tmp_path))
    assert {(r.feed, r.landing_date.day): r.size for r in days.collect()} == {
        ("a", 1): 2, ("a", 2): 2, ("a", 3): 0, ("a", 5): 2, ("a", 6): 2, ("a", 7): 0, ("a", 9): 2, ("b/c", 4): 2,
    }
    found = missing_landings(days, F.lit("2024-01-10").cast("date")).collect()
    assert {(r.feed, r.kind, r.first_day.day, r.last_day.day, r.n_days) for r in found} == {
        ("a", "empty", 3, 3, 1), ("a", "absent", 4, 4, 1), ("a", "empty", 7, 7, 1), ("a", "absent", 8, 8, 1),
        ("a", "absent", 10, 10, 1), ("b/c", "absent", 5, 10, 6),
    }
    since = missing_landings(days, F.lit("2024-01-04").cast("date"), F.lit("2023-12-31").cast("date")).where("feed = 'b/c'")
    assert [(r.first_day.isoformat(), r.n_days) for r in since.collect()] == [("2023-12-31", 4)]
    assert missing_landings(days, F.lit("2023-01-01").cast("date")).collect() == []
    assert landed_days(spark, str(tmp_path / "nowhere")).collect() == []


def test_the_last_day_reaches_the_scan_as_a_literal(spark, tmp_path):
    spark.sql("select id, timestamp'2024-01-01 10:00:00' + make_dt_interval(0, id) as ts from range(100)").write.parquet(str(tmp_path / "t"))
    last = latest_day(spark.read.parquet(str(tmp_path / "t")), "ts")
    assert last.count() == 14  # up to hour 109: from the start of the fifth day
    plan = last._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts,2024-01-05" in plan
    assert latest_day(spark.read.parquet(str(tmp_path / "t")).limit(0), "ts").collect() == []


def test_money_without_an_order_stays_in_gold(spark):
    fact = spark.createDataFrame([(1, 10.0, 0.0), (2, 20.0, 0.5), (3, 5.0, 0.0), (None, 1.0, 0.0), (4, 2.0, 0.0)], "l_orderkey int, l_extendedprice double, l_discount double")
    orders = spark.createDataFrame([(1, 1), (2, 2), (3, None), (4, 3)], "o_orderkey int, o_custkey int")
    customer = spark.createDataFrame([(1, 1), (3, 77)], "c_custkey int, c_nationkey int")
    nation = spark.createDataFrame([(1, "N", 1)], "n_nationkey int, n_name string, n_regionkey int")
    region = spark.createDataFrame([(1, "R")], "r_regionkey int, r_name string")
    found = {(r.r_name, r.n_name): (r.n_lines, r.revenue_cents) for r in gold_revenue(fact, orders, customer, nation, region).collect()}
    assert found == {("R", "N"): (1, 1000), (None, None): (4, 1800)}
