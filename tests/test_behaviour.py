"""Cases that the test tables don't hold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logweave import functions as fn
from logweave.model import Catalogue, small
from logweave.operators import enrich, group, joins, search, stats, transforms
from logweave.sources import readers, sinks
from logweave.streaming import streams

U = dt.timezone.utc


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("v")).first()["v"]


def test_addresses(spark):
    assert one(spark, fn.ip_to_long(F.col("a")), a="10.1.2.3") == 167838211
    assert one(spark, fn.ip_to_long(F.col("a")), a="host") is None
    assert one(spark, fn.all_ips(F.col("a")), a="x 10.0.0.1, 10.0.0.12 1.2.3.4.5") == ["10.0.0.1", "10.0.0.12"]
    assert one(spark, fn.is_local(F.col("a"), [("10.0.0.0", "10.0.0.255")]), a=None) is False


def test_octets_above_255_stay_in_their_network(spark):
    """10.0.300.5 and 10.1.44.5 have the same number, 10.1.300.5 and 10.2.44.5 too; lookups go by the octets in front."""
    one_net, ips = [("10.1.0.0", "10.1.255.255")], ["10.0.300.5", "10.1.300.5", "10.1.255.255", "10.2.44.5", "10.1.3.999"]
    wanted = [False, True, True, False, True]
    df = spark.createDataFrame([(i, ip, "1.1.1.1", f"from {ip} to") for i, ip in enumerate(ips)], "id long, srcip string, dstip string, msg string").withColumn("ts", F.timestamp_seconds("id"))
    nets = spark.createDataFrame([((10 << 24) + (1 << 16), (10 << 24) + (2 << 16) - 1, "o", "c", True)], "start_ip long, end_ip long, org string, customer string, is_local boolean")
    assert [r.v for r in df.orderBy("id").select(fn.is_local(F.col("srcip"), one_net).alias("v")).collect()] == wanted
    assert [r.v for r in df.where(search.subnet_macro(one_net)).orderBy("id").select(F.col("id").alias("v")).collect()] == [1, 2, 4]
    assert [r.v == "c" for r in enrich.enrich_networks(df, nets, spark.createDataFrame([("o", "n")], "org string, name string")).orderBy("id").select(F.col("srcip_net.customer").alias("v")).collect()] == wanted
    assert [r.srcip for r in transforms.anonymise(df, one_net).orderBy("id").collect()] == ["10.0.300.5", "?.?.?.0", "?.?.?.1", "10.2.44.5", "?.?.?.2"]
    assert [r.v for r in df.orderBy("id").select(fn.is_address(F.col("srcip")).alias("v")).collect()] == [False, False, True, True, False]


def test_tokens_are_whole(spark):
    assert one(spark, fn.has_token(F.col("a"), "10.0.0.1"), a="from 10.0.0.12") is False
    assert one(spark, fn.has_token(F.col("a"), "A"), a="(a)") is True
    assert one(spark, fn.has_phrase(F.col("a"), "b c"), a="a-b c; b, c") is True
    assert one(spark, fn.has_prefix(F.col("a"), "fo*"), a="a foo") is True
    assert one(spark, fn.highlight(F.col("a"), ["foo", "foo.bar"]), a="foo foo.bar food") == "<b>foo</b> <b>foo.bar</b> food"


def test_url_parts(spark):
    parts = fn.url_parts(F.col("a"))
    row = spark.createDataFrame([("http://u:p@x.example.org:81/a/b?q=1",)], "a string").select(*[c.alias(n) for n, c in parts.items()]).first()
    assert row.asDict() == dict(proto="http", username="u", password="p", domain="x.example.org", port="81", resource="/a/b", query_string="q=1", tld="org")


def test_search_errors(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id long, msg string")
    assert [r.id for r in search.search(df, any=["a", "b"]).collect()] == [1]
    with pytest.raises(ValueError):
        search.search(df, none=["a"])
    with pytest.raises(ValueError):
        search.search(df, all=[("id", "=", 1), ("id", "=", 2)])
    with pytest.raises(ValueError):
        search.compare(df, Catalogue({"A": 5}, {"A": {"msg": "string"}}), "msg", "<", 1)


def test_histogram_fills_and_empty(spark):
    at = [dt.datetime(2024, 1, 1, h, tzinfo=U) for h in (0, 0, 3)]
    df = spark.createDataFrame([(t,) for t in at], "ts timestamp")
    assert [(r._groupby, r._count) for r in group.time_histogram(df, "hour").collect()] == [
        ("2024-01-01T00:00:00", 2), ("2024-01-01T01:00:00", 0), ("2024-01-01T02:00:00", 0), ("2024-01-01T03:00:00", 1)]
    assert group.time_histogram(df.where("false"), "hour").count() == 0


def test_having_default_operator(spark):
    g = spark.createDataFrame([("a", 5), ("b", 9), ("c", 5)], "_groupby string, _count long")
    assert [r._groupby for r in group.having_count(g, 5).collect()] == ["b", "a", "c"]
    assert [r._groupby for r in group.having_count(g, 5, "?").collect()] == ["b"]


def test_interval_lone_and_first(spark):
    rows = [(1, "a", 10), (2, "a", 14), (3, "b", 5)]
    df = spark.createDataFrame(rows, "id long, host string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert {r.id: r.interval for r in transforms.interval(df, ["host"]).collect()} == {1: 4, 2: 4, 3: 0}


def test_anonymise_whole_addresses(spark):
    rows = [(1, 5, "10.0.0.1 10.0.0.12 8.8.8.8", "10.0.0.12", None), (2, 4, "x 10.0.0.12", "8.8.8.8", "10.0.0.1")]
    df = spark.createDataFrame(rows, "id long, s long, msg string, srcip string, dstip string").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: (r.msg, r.srcip, r.dstip) for r in transforms.anonymise(df, [("10.0.0.0", "10.0.0.255")]).collect()}
    assert got == {1: ("?.?.?.0 ?.?.?.1 8.8.8.8", "?.?.?.1", None), 2: ("x ?.?.?.1", "8.8.8.8", "?.?.?.0")}


def test_range_join_small_and_large(spark):
    ranges = spark.createDataFrame([(0, 70000, "a"), (65536, 65540, "b"), (1 << 31, (1 << 32) - 1, "c")], "low long, high long, name string")
    left = spark.createDataFrame([(i, p) for i, p in enumerate([5, 65538, 70001, 1 << 31, None])], "id long, p long")
    wanted = {(0, "a"), (1, "a"), (1, "b"), (2, None), (3, "c"), (4, None)}
    for small_ in (10, 0):
        got = enrich.range_join(left, ranges, F.col("p"), "low", "high", small=small_)
        assert {(r.id, r.name) for r in got.collect()} == wanted


def test_range_join_wide_ranges(spark):
    """Ranges of many widths against brute force; wide ones have two cells, so many of them stay few rows."""
    import random

    random.seed(6)
    rows = []
    for i in range(300):
        a, b = sorted((random.randrange(1 << random.choice((6, 17, 31, 47, 60))), random.randrange(1 << random.choice((6, 17, 31, 47, 60)))))
        rows.append((a, b, i))
    points = [random.randrange(1 << random.choice((6, 17, 31, 47, 60))) for _ in range(200)] + [rows[0][0], rows[0][1]]
    ranges = spark.createDataFrame(rows, "low long, high long, name long")
    left = spark.createDataFrame([(i, p) for i, p in enumerate(points)], "id long, p long")
    for small_ in (10_000, 0):
        got = sorted((r.id, r.name) for r in enrich.range_join(left, ranges, F.col("p"), "low", "high", "inner", small_).collect())
        assert got == sorted((i, n) for i, p in enumerate(points) for a, b, n in rows if a <= p <= b)


def test_time_range_prunes_days(spark, tmp_path):
    df = spark.createDataFrame([(k, 86400 * k + 5, "URL") for k in range(20)], "id long, ts long, class string")
    sinks.append_logs(df, str(tmp_path / "log"))
    got = search.time_range(spark.read.parquet(str(tmp_path / "log")), 86400 * 3, 86400 * 5)
    assert sorted(r.id for r in got.collect()) == [3, 4]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "GreaterThanOrEqual(ts" in plan


def test_groups_of_least_squares():
    import itertools
    import random

    import numpy as np

    random.seed(3)
    for _ in range(30):
        x = np.array(sorted(random.sample(range(100), random.randrange(1, 9))), float)
        w = np.array([random.randrange(1, 4) for _ in x], float)
        k = random.randrange(1, len(x) + 1)
        spread = lambda a, b, x=x, w=w: float((w[a:b] * (x[a:b] - np.average(x[a:b], weights=w[a:b])) ** 2).sum())
        best = min(sum(spread(a, b) for a, b in itertools.pairwise((0, *c, len(x)))) for c in itertools.combinations(range(1, len(x)), k - 1))
        got = transforms._best_groups(x, w, k)
        cuts = [0, *(np.flatnonzero(np.diff(got)) + 1).tolist(), len(x)]
        assert len(cuts) == k + 1 and abs(sum(spread(a, b) for a, b in itertools.pairwise(cuts)) - best) < 1e-6


def test_clusters_do_not_overlap(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 3.0, 50.0, 51.0, 52.0, 100.0, 101.0, None])], "id long, v double")
    got = {}
    for r in transforms.cluster(df, "v", k=3).collect():
        got.setdefault(r.cluster, []).append(r.v)
    assert sorted(sorted(x) for c, x in got.items() if c) == [[1, 2, 3], [50, 51, 52], [100, 101]] and got[None] == [None]


def test_conflicts(spark):
    with pytest.raises(ValueError):
        search.search(spark.range(1), all=[("id", "=", 1), ("id", "=", 2)])


def test_pairs_stream_closes_requests(spark, tmp_path):
    rows = [(1, 100, "k", "q"), (2, 101, "k", "q"), (3, 105, "k", "r"), (4, 150, "k", "r"), (5, 160, "k", "q"), (6, 190, "k", "r"), (7, 500_000, "end", "r")]
    spark.createDataFrame(rows, "id long, s long, key string, kind string").withColumn("ts", F.timestamp_seconds("s")).write.parquet(str(tmp_path / "in"))
    read = lambda k: spark.readStream.schema("id long, s long, key string, kind string, ts timestamp").parquet(str(tmp_path / "in")).where(F.col("kind") == k)
    q = streams.pair_http_stream(read("q"), read("r"), "key").writeStream.format("memory").queryName("closed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.request_id: r.response_id for r in spark.table("closed").collect()} == {1: None, 2: 3, 5: None}


def test_pairs_stream_orders_inside_a_second(spark, tmp_path):
    """Rows count by microseconds, the timeout by whole seconds, as in pair_http."""
    rows = [(1, 100.2, "r"), (2, 100.7, "q"), (3, 105.0, "r"), (4, 200.1, "q"), (5, 210.9, "r"), (6, 300.0001, "r"), (7, 300.0004, "q"), (8, 300.0006, "q"), (9, 311.0, "r")]
    df = spark.createDataFrame([(i, s, "k", kind) for i, s, kind in rows] + [(10, 5e5, "end", "r")], "id long, s double, key string, kind string").withColumn("ts", F.timestamp_micros(F.round(F.col("s") * 1_000_000).cast("long")))
    df.write.parquet(str(tmp_path / "in"))
    read = lambda k: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).where(F.col("kind") == k)
    streams.pair_http_stream(read("q"), read("r"), "key").writeStream.format("memory").queryName("inside").trigger(availableNow=True).start().awaitTermination()
    wanted = {2: 3, 4: 5, 7: None, 8: None}
    assert {r.request_id: r.response_id for r in spark.table("inside").collect()} == wanted
    kinds = df.withColumn("kind", F.when(F.col("kind") == "q", "request").otherwise("response"))
    assert {r.request_id: r.response_id for r in streams.pair_http(kinds, "key", "kind").collect()} == wanted
    assert {r.request_id: r.answered and r.answered.microsecond for r in spark.table("inside").collect()}[4] == 900_000


def test_throttle_stream_orders_small_batches(spark, tmp_path):
    df = spark.createDataFrame([(1, t) for t in (50, 60, 0, 5, 100, 10)], "schedule long, at long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        sdf = streams.throttle_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 10)
        sdf.writeStream.format("memory").queryName("throttled").trigger(availableNow=True).start().awaitTermination()
        assert sorted(r.at for r in spark.table("throttled").collect()) == [0, 10, 50, 60, 100]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_alerts_throttled(spark):
    df = spark.createDataFrame([(1, 0), (1, 5), (1, 10), (1, 19), (2, 3)], "schedule long, at long")
    assert sorted(map(tuple, streams.throttle_alerts(df, 10).collect())) == [(1, 0), (1, 10), (2, 3)]


def test_pairs(spark):
    rows = [(1, 0, "k", "request"), (2, 1, "k", "request"), (3, 5, "k", "response"), (4, 50, "k", "response"), (5, 60, "k", "request"), (6, 90, "k", "response")]
    df = spark.createDataFrame(rows, "id long, s long, key string, kind string").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.request_id: r.response_id for r in streams.pair_http(df, "key", "kind").collect()}
    assert got == {1: None, 2: 3, 5: None}


def test_tsv_rejects(spark):
    rows = ["5\th.x\tsshd\t7\tm", "\th.x\tsshd\t7\tm", "\th.x\t\t7\tm", "5\t\tsshd\t7\tm", "5\th\t123\tunknown\tm", "5\th.x\tp\t9999\tm"]
    good, bad = readers.parse_log_tsv(spark.createDataFrame([(r,) for r in rows], "value string"), small(), F.lit(77).cast("long"))
    got = [(r.ts, r.host_id, r.program, r["class"]) for r in good.collect()]
    assert got == [(5, None, "sshd", "URL"), (77, None, "sshd", "URL"), (5, fn.LOCALHOST, "unknown", "NONE")]
    assert bad.count() == 3


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("timestamp,srcip,dstip\n5,10.0.0.1,'x,y'\n")
    (tmp_path / "in" / "messages").write_text("Jan  2 03:04:05 h sshd[1]: hi\nbroken\n")
    csv = readers.read_class_csv(spark, str(tmp_path / "in" / "a.csv"), small(), "URL")
    assert [tuple(r) for r in csv.collect()] == [(5, "URL", "5,10.0.0.1,x,y", "10.0.0.1", "x,y")]
    log = readers.read_syslog(spark, str(tmp_path / "in" / "messages"), 2024)
    assert [tuple(r) for r in log.collect()] == [(1704164645, "h", "sshd", "hi")]
    assert readers.read_syslog(spark, str(tmp_path / "in" / "messages"), 2024, skip=1).count() == 0
    kinds = {r.path.rsplit("/", 1)[1]: r.format for r in readers.detect_formats(spark, str(tmp_path / "in")).collect()}
    assert kinds == {"a.csv": "csv", "messages": "syslog"}
    with pytest.raises(ValueError):
        readers.parse_class_rows(spark.createDataFrame([("x",)], "nothing string"), small(), "URL")


def test_table_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, 100000, "URL", "m"), (2, 200000, "NONE", "n")], "id long, ts long, class string, msg string")
    assert tuple(sinks.append_logs(df, str(tmp_path / "log")).first()) == (2, 100000, 200000)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [1, 2]
    sinks.save_results(df, str(tmp_path / "saved"), 4, "mine", 9)
    back = sinks.load_results(spark, str(tmp_path / "saved"), 4, "id long, msg string")
    assert sorted(map(tuple, back.collect())) == [(1, "m"), (2, "n")]
    assert [(r.qid, r.rows, r.total) for r in sinks.list_saved(spark.read.parquet(str(tmp_path / "saved")), 9).collect()] == [(4, 2, 1)]
    sinks.forward_batch(df, str(tmp_path / "copy"))
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 2
    sinks.to_csv_grid(df.withColumn("ts", F.timestamp_seconds("ts")), ["id"]).write.csv(str(tmp_path / "grid"), header=True)
    assert spark.read.csv(str(tmp_path / "grid"), header=True).columns == ["timestamp", "epoch_time", "id", "msg"]


def test_sizes():
    assert stats.parse_size("2M") == 2 << 20 and stats.parse_size("33%", 300) == 99 and stats.parse_size(5) == 5


def test_silent_and_stream_join(spark, tmp_path):
    df = spark.createDataFrame([("a", 100), ("b", 10)], "host string, s long").withColumn("ts", F.timestamp_seconds("s"))
    expected = spark.createDataFrame([("a", 30), ("b", 30), ("c", 30)], "host string, interval long")
    got = joins.silent_hosts(df, expected, F.timestamp_seconds(F.lit(160)))
    assert sorted(r.host for r in got.collect()) == ["b", "c"]
    rows = spark.createDataFrame([(1, 100000, "k"), (2, 101000, "k")], "id long, s long, key string").withColumn("ts", F.timestamp_seconds("s"))
    rows.write.parquet(str(tmp_path / "q"))
    rows.withColumns({"id": F.col("id") + 10, "ts": F.timestamp_seconds(F.col("s") + 5)}).where("id < 12").write.parquet(str(tmp_path / "r"))
    read = lambda p: spark.readStream.schema(rows.schema).parquet(str(tmp_path / p))
    q = streams.pair_http_stream(read("q"), read("r"), "key").writeStream.format("memory").queryName("pairs").trigger(availableNow=True).start()
    q.awaitTermination()
    assert (1, 11) in [(r.request_id, r.response_id) for r in spark.sql("SELECT * FROM pairs").collect()]
