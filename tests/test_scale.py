"""Operators that must hold at scale: what they read, shuffle and keep, and their results against brute force."""

import datetime as dt
import os
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from logweave.operators import bloom, enrich, group, joins, retention, search, stats, transforms
from logweave.sources import databases, sinks
from logweave.streaming import schedules, streams

U = dt.timezone.utc


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def nodes(plan):
    """Physical operators of a plan that has run, through its adaptive stages."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from nodes(plan.executedPlan())
        return
    yield plan
    inner = [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    for p in inner:
        yield from nodes(p)


def metric(df, kind, name):
    found = [p.metrics().get(name) for p in nodes(df._jdf.queryExecution().executedPlan()) if p.getClass().getSimpleName().startswith(kind)]
    return sum(m.get().value() for m in found if m.isDefined())


# Retention


def days_table(spark, path, days, size=1, **more):
    df = spark.createDataFrame([(k, 86400 * (k % days) + 5, "URL" if k % 2 else "NONE", "m" * size) for k in range(days * 4)], "id long, ts long, class string, msg string")
    sinks.append_logs(df, str(path), **more)


def test_drop_days_keeps_the_files(spark, tmp_path):
    for batch in (1, 2):
        days_table(spark, tmp_path / "log", 10, batch=batch)
    before = {f: os.stat(f).st_ino for f in files(tmp_path / "log")}
    gone = retention.drop_days(spark, {str(tmp_path / "log"): 3}, dt.date(1970, 1, 10))
    assert sorted({str(r.day) for r in gone.collect()}) == [f"1970-01-{d:02}" for d in range(1, 7)] and gone.count() == 12
    after = {f: os.stat(f).st_ino for f in files(tmp_path / "log")}
    assert after == {f: n for f, n in before.items() if f.split("day=")[1][:10] >= "1970-01-07"}
    assert {r.id % 10 for r in spark.read.parquet(str(tmp_path / "log")).collect()} == {6, 7, 8, 9}
    assert retention.drop_days(spark, {str(tmp_path / "log"): 3}, dt.date(1970, 1, 10)).count() == 0


def test_drop_bytes(spark, tmp_path):
    at = {k: str(tmp_path / k) for k in ("index", "archive", "import")}
    for k, path in at.items():
        days_table(spark, path, 10)
    folders = {k: retention.day_folders(spark, p, k).collect() for k, p in at.items()}
    assert sum(r.bytes for r in folders["index"]) == sum(os.path.getsize(f) for f in files(at["index"]))
    whole = sum(r.bytes for k in ("index", "archive") for r in folders[k])
    assert retention.drop_bytes(spark, whole + 1, **{"index": at["index"], "archive": at["archive"], "imports": at["import"]}).count() == 0
    limit = whole // 2
    gone = retention.drop_bytes(spark, limit, at["index"], at["archive"], at["import"], import_limit="25%")
    for kind, most in (("index", limit - int(limit * 0.33)), ("archive", int(limit * 0.33)), ("import", limit // 4)):
        left = sorted((r.day, r.bytes) for r in folders[kind] if os.path.exists(r.folder.removeprefix("file:")))
        dropped = sorted(r.day for r in gone.collect() if r.kind == kind)
        assert left and dropped and max(dropped) < left[0][0]  # the oldest went
        oldest = next(r.bytes for r in folders[kind] if r.day == max(dropped))
        assert sum(b for _, b in left) <= most < sum(b for _, b in left) + oldest  # and no more than had to
    with pytest.raises(ValueError):
        retention.drop_bytes(spark, 0, at["index"])


def test_rows_without_a_day_stay(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "URL"), (2, 5, "URL"), (3, 86400 * 9, "URL")], "id long, ts long, class string")
    sinks.append_logs(df, str(tmp_path / "log"))
    retention.drop_days(spark, {str(tmp_path / "log"): 1}, dt.date(1970, 1, 10))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [1, 3]
    retention.drop_bytes(spark, 1, str(tmp_path / "log"))
    assert [r.id for r in spark.read.parquet(str(tmp_path / "log")).collect()] == [1]


# Alerts in order


def throttled(times, threshold):
    out = {}
    for k, t in sorted(set(times)):
        if k not in out or t - out[k][-1] >= threshold:
            out.setdefault(k, []).append(t)
    return sorted((k, t) for k, ts in out.items() for t in ts)


@pytest.mark.parametrize("cuts", [1, 3, 9])
def test_throttle_in_order_however_cut(spark, tmp_path, cuts):
    """Alerts up to 100 s out of order, in 1, 3 or 9 micro-batches of several files: always the answer of the whole."""
    random.seed(cuts)
    times = [(random.randrange(3), t) for t in range(10_000, 13_000, 7)]
    arrived = sorted(times, key=lambda x: x[1] + random.randrange(100))
    arrived += [(k, 10**6) for k in range(3)] + [(9, 2 * 10**6)]
    source, size = tmp_path / "in", -(-len(arrived) // cuts)
    schema = "schedule long, at long"
    got = tmp_path / "out"
    for i in range(cuts):
        spark.createDataFrame(arrived[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(source))
        sdf = streams.throttle_stream(spark.readStream.schema(schema).parquet(str(source)), 60, late="120 seconds")
        sdf.writeStream.format("parquet").option("path", str(got)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    found = sorted((r.schedule, r.at) for r in spark.read.schema(schema).parquet(str(got)).collect())
    assert found == throttled(times + [(k, 10**6) for k in range(3)], 60)


def test_throttle_drops_what_is_too_late(spark, tmp_path):
    schema, got = "schedule long, at long", []
    for batch in ([(1, 1000)], [(1, 5000)], [(1, 10), (None, 5500), (1, None)], [(1, 9000)], [(2, 99000)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        sdf = streams.throttle_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 100, late="60 seconds")
        sdf.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(((r.schedule, r.at) for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()), key=str)
    assert got == [(1, 1000), (1, 5000), (1, 9000), (None, 5500)]


# Term filters


def test_bloom_filter(spark):
    members = spark.range(20_000).select(F.concat(F.lit("m"), "id").alias("t"))
    held = bloom.members(members, "t")
    rows = members.unionAll(spark.range(20_000).select(F.concat(F.lit("x"), "id").alias("t")))
    passed = rows.where(bloom.may_be_in(F.col("t"), held)).groupBy(F.substring("t", 1, 1).alias("kind")).count().collect()
    n = {r.kind: r["count"] for r in passed}
    assert n["m"] == 20_000 and n.get("x", 0) < 200
    few = bloom.members(members, "t", words=4)  # over full: nothing is lost
    assert rows.where(bloom.may_be_in(F.col("t"), few, words=4)).where("t like 'm%'").count() == 20_000
    none = bloom.members(members.where("false"), "t")
    assert rows.where(bloom.may_be_in(F.col("t"), none)).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_sweep_shuffles_only_hits(spark, broadcast):
    log = spark.range(20_000).select("id", F.concat(F.lit("a b c d "), (F.col("id") % 1000).cast("string")).alias("msg"))
    terms = spark.createDataFrame([("7",), ("8",), (None,)], "term string")
    keys = spark.createDataFrame([("7", 1), ("8", 1)], "_groupby string, _count long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old if broadcast else "-1")
    try:
        for df in (joins.sweep_terms(log, terms), joins.subsearch(log, keys)):
            assert sorted(r.id for r in df.collect()) == [i for i in range(20_000) if i % 1000 in (7, 8)]
            assert metric(df, "ShuffleExchange", "shuffleRecordsWritten") < 1000  # of 100 000 tokens
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_subsearch_keeps_repeated_rows(spark):
    log = spark.createDataFrame([(1, "a x"), (1, "a x"), (1, "z"), (2, "x y a"), (3, None)], "id long, msg string")
    keys = spark.createDataFrame([("A", 1), ("x", 1), (None, 4)], "_groupby string, _count long")
    assert sorted((r.id, r.msg) for r in joins.subsearch(log, keys).collect()) == [(1, "a x"), (1, "a x"), (2, "x y a")]
    assert joins.subsearch(log, keys.where("false")).count() == 0


# Intervals


def test_lookup_of_one_key_with_many_intervals(spark):
    """One key, 100 000 intervals and as many records: what the join makes stays near what it finds."""
    records = spark.range(100_000).select(F.lit("k").alias("key"), (F.col("id") * 100).alias("at"))
    spans = spark.range(100_000).select(F.lit("k").alias("key"), (F.col("id") * 100 + 50).alias("a"), (F.col("id") * 100 + 150).alias("b"), F.col("id").alias("n"))
    began = time.time()
    out = enrich.enrich_lookup(records, spans, {"key": "key"}, ["n"], during=("at", "a", "b"))
    got = out.agg(F.sum(F.size("n")).alias("hits"), F.count("*").alias("rows")).first()
    assert (got.hits, got.rows) == (99_999, 100_000) and time.time() - began < 60


@pytest.mark.parametrize("kind", ["bigint", "double", "timestamp", "timestamp_ntz", "date", "decimal(20,2)"])
def test_lookup_during_against_brute_force(spark, kind):
    random.seed(4)
    cast = {"timestamp": "timestamp_seconds({})", "timestamp_ntz": "cast(timestamp_seconds({}) as timestamp_ntz)", "date": "date_add(date'2020-01-01', cast({} % 3000 as int))"}.get(kind, f"cast({{}} as {kind})")
    value = lambda x: x % 3000 if kind == "date" else x
    spans = [(i, *sorted(value(random.randrange(10 ** random.randrange(1, 10))) for _ in range(2))) for i in range(200)] + [(200, 5, 3)]
    points = [(i, value(random.randrange(10 ** random.randrange(1, 10)))) for i in range(300)] + [(300, None)]
    table = spark.createDataFrame(spans, "n long, a long, b long").selectExpr("n", f"{cast.format('a')} as a", f"{cast.format('b')} as b")
    df = spark.createDataFrame(points, "id long, t long").selectExpr("id", f"{cast.format('t')} as t")
    got = {r.id: r.n for r in enrich.enrich_lookup(df, table, {}, ["n"], during=("t", "a", "b")).collect()}
    assert got == {i: [n for n, a, b in spans if t is not None and a <= t <= b] for i, t in points}
    with pytest.raises(ValueError):
        enrich.enrich_lookup(df.withColumn("t", F.lit("x")), table, {}, ["n"], during=("t", "a", "b"))


def test_lookup_without_key_is_no_nested_loop(spark):
    df = spark.range(10).select("id", F.col("id").alias("t"))
    out = enrich.enrich_lookup(df, spark.range(10).select(F.col("id").alias("a"), F.col("id").alias("b"), F.col("id").alias("n")), {}, ["n"], during=("t", "a", "b"))
    assert [r.n for r in out.orderBy("id").collect()] == [[i] for i in range(10)]
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


# Histograms and pages


def test_filling_is_dealt_over_tasks(spark):
    ends = spark.createDataFrame([(-5,), (86400 * 20,)], "s long").withColumn("ts", F.timestamp_seconds("s"))
    out = group.time_histogram(ends, "timestamp")
    got = out.agg(F.count("*").alias("n"), F.sum("_count").alias("hits"), F.min("intval").alias("low"), F.max("intval").alias("high")).first()
    assert tuple(got) == (86400 * 20 + 6, 2, -5, 86400 * 20)
    per_task = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) > 1 and max(per_task) < 86400 * 20
    assert [r.intval for r in group.time_histogram(ends, "timestamp", limit=3).collect()] == [-5, -4, -3]


def test_pages(spark):
    random.seed(2)
    rows = [(i, None if i % 11 == 0 else random.randrange(40) * 1800) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, s long").withColumn("ts", F.timestamp_seconds("s")).repartition(7)
    for desc in (False, True):
        wanted = sorted(rows, key=lambda r: ((r[1] is None) == desc, 0 if r[1] is None else -r[1] if desc else r[1], r[0]))
        wanted = [i for i, _ in wanted]
        counts = group.range_counts(df)
        for offset in (0, 27, 28, 150, 273, 300):
            assert [r.id for r in group.page(df, 0, offset, desc=desc).collect()] == wanted[offset:]
            for limit in (40,):
                assert [r.id for r in group.page_at(df, counts, offset, limit, desc=desc).collect()] == wanted[offset : offset + limit]
        mark, seen = None, []
        while part := group.page_after(df, mark, 37, desc=desc).collect():
            seen += [r.id for r in part]
            mark = (part[-1].ts.replace(tzinfo=U) if part[-1].ts else None, part[-1].id)
        assert seen == wanted


def test_deep_pages_reach_the_scan(spark, tmp_path):
    spark.range(50_000).select("id", F.timestamp_seconds("id").alias("ts")).coalesce(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "log"))
    df = spark.read.parquet(str(tmp_path / "log"))
    out = group.page_at(df, group.range_counts(df), 40_000, 10)
    assert [r.id for r in out.collect()] == list(range(40_000, 40_010))
    plan = out._jdf.queryExecution().executedPlan().toString()
    rest = group.page(df, 0, 49_990)
    assert [r.id for r in rest.collect()] == list(range(49_990, 50_000))
    assert "SinglePartition" not in rest._jdf.queryExecution().executedPlan().toString() and "TakeOrdered" in plan
    after = group.page_after(df, (dt.datetime.fromtimestamp(49_000, U), 49_000), 5)
    assert "GreaterThan(ts" in after._jdf.queryExecution().executedPlan().toString()


# Footers, folds, bookmarks, databases


def test_coverage_reads_footers(spark, tmp_path):
    path = str(tmp_path / "log")
    days_table(spark, path, 12)
    sinks.append_logs(spark.createDataFrame([(1, None, "URL", "m"), (2, 7, None, "m")], "id long, ts long, class string, msg string"), path)
    key = lambda rows: sorted((str(r["class"]), r.start, r.end, r.records) for r in rows)
    whole = spark.read.parquet(path)
    assert key(stats.coverage_table(spark, path).collect()) == key(stats.coverage(whole).collect())
    plan = stats.partition_counts(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan and "PushedGroupBy: [class, day]" in plan
    assert stats.coverage_table(spark, path, "msg").first().records == 50  # no partition: from the rows


def fold():
    def ends(n, low, high):
        return pd.DataFrame({"n": [n], "low": [low], "high": [high]})

    return (
        lambda x: ends(len(x), x["v"].min(), x["v"].max()), lambda p: ends(p["n"].sum(), p["low"].min(), p["high"].max()),
        lambda p: pd.DataFrame({"key": p["key"], "n": p["n"], "span": p["high"] - p["low"]}), "n long, low long, high long", "key string, n long, span long",
    )


def test_fold_of_a_large_group(spark):
    """A million rows of one key beside others: no task holds a group, only slices of batches and partials."""
    df = spark.range(0, 1_020_000, 1, 8).select(F.when(F.col("id") < 1_000_000, "hot").when(F.col("id") % 2 == 0, F.concat(F.lit("k"), F.col("id") % 500)).alias("key"), F.col("id").alias("v"))
    got = {r.key: (r.n, r.span) for r in transforms.fold_groups(df, "key", *fold(), most_keys=100).collect()}
    wanted = {r.key: (r.n, r.span) for r in df.groupBy("key").agg(F.count("*").alias("n"), (F.max("v") - F.min("v")).alias("span")).collect()}
    assert got == wanted and got["hot"] == (1_000_000, 999_999) and None in got


def test_fold_of_many_groups_calls_once_a_group(spark):
    """Rows of a group lie apart in the table, yet part is called a few times for each group and not for each row or batch."""
    df = spark.range(0, 40_000, 1, 8).select((F.col("id") % 2000).cast("string").alias("key"), ((F.col("id") % 2000 < 1000).cast("long") * (2**60 + 1) + F.col("id")).alias("v"))
    df = df.withColumn("v", F.when(F.col("key") != "7", F.col("v")))  # one group has no value, the others must not become doubles by it
    _, merge, finish, partial, schema = fold()
    calls = spark.sparkContext.accumulator(0)

    def part(x):
        calls.add(1)
        return pd.DataFrame({"n": [len(x)], "low": [x["v"].astype("Int64").min()], "high": [x["v"].astype("Int64").max()]})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    try:
        once = transforms.fold_groups(df.where("key != '7'"), "key", part, merge, lambda p: pd.DataFrame({"key": p["key"], "n": p["n"], "span": p["high"]}), partial, schema).collect()
        assert calls.value <= 2 * 2000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.key: (r.n, r.span) for r in once} == {r.key: (r.n, r.high) for r in df.where("key != '7'").groupBy("key").agg(F.count("*").alias("n"), F.max("v").alias("high")).collect()}
    assert len(transforms.fold_groups(df, "key", part, merge, finish, partial, schema).collect()) == 2000


def test_fold_of_nothing(spark):
    df = spark.createDataFrame([], "key string, v long")
    assert transforms.fold_groups(df, "key", *fold()).count() == 0


def test_schedule_that_stops_between_its_writes(spark, tmp_path, monkeypatch):
    df = spark.range(100).select(F.timestamp_seconds(F.col("id") * 10).alias("ts"))
    schedule = spark.createDataFrame([(1, 100, True, 0, 10_000)], "id long, frequency long, enabled boolean, start long, end long")
    run = lambda now: schedules.run_due(df, schedule, {1: F.lit(True)}, f"file://{tmp_path}/runs", now, 0)
    seen = lambda: sorted((r.start, r.count_) for r in schedules.results(spark, f"file://{tmp_path}/runs").withColumnRenamed("count", "count_").collect())
    assert seen() == []
    assert run(250).count() == 2 and seen() == [(0, 10), (100, 10)]
    write = schedules._write_bookmark

    def stop(*a):
        raise RuntimeError("stopped")

    monkeypatch.setattr(schedules, "_write_bookmark", stop)
    with pytest.raises(RuntimeError):
        run(550)
    assert seen() == [(0, 10), (100, 10)]  # results without a bookmark don't count
    monkeypatch.setattr(schedules, "_write_bookmark", write)
    run(450), run(450), run(300)  # the missed one, the same one again, and one from the past
    assert seen() == [(t, 10) for t in range(0, 400, 100)]
    run(1000)
    assert seen() == [(t, 10) for t in range(0, 1000, 100)]
    assert sorted(tuple(r) for r in schedules.bookmarks(spark, f"file://{tmp_path}/runs").select("run", "from", "to").collect()) == [(0, 0, 250), (1, 250, 450), (2, 450, 1000)]
    assert [r.enabled for r in schedules.expired(schedule, 10_001).collect()] == [False]


def test_database_filters(spark, tmp_path):
    url = f"jdbc:derby:memory:{tmp_path.name};create=true"
    rows = [(i, "Ab_%c!" if i % 3 == 0 else "it's", 10.0 * i, dt.datetime(2024, 1, 1 + i % 20), 167772161 + i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, name string, v double, timestamp timestamp, ip long")
    df.write.format("jdbc").options(url=url, dbtable="things", createTableColumnTypes="name VARCHAR(20)").save()
    kinds = {"id": "int", "name": "", "v": "float", "ip": "ip_int"}
    for terms, keep in (({"name": "B_%C!"}, lambda r: r[0] % 3 == 0), ({"name": "IT'S"}, lambda r: r[0] % 3), ({"ip": "10.0.0.2", "v": "50"}, lambda r: r[0] == 5), ({"id": "7"}, lambda r: r[0] == 7), ({}, lambda r: True)):
        asked = dict(start=dt.datetime(2024, 1, 3), end=dt.datetime(2024, 1, 15))
        inside = [r for r in rows if keep(r) and asked["start"] <= r[3] <= asked["end"]]
        got = databases.search_database(spark, url, "things", kinds, terms, **asked, key="id", parts=3)
        local = stats.source_search(df, kinds, terms, F.lit(asked["start"]), F.lit(asked["end"]))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, local.collect())) and got.count() == len(inside)
        groups = databases.search_database(spark, url, "things", kinds, terms, **asked, group="ip")
        here = stats.source_search(df, kinds, terms, F.lit(asked["start"]), F.lit(asked["end"]), group="ip")
        assert list(map(tuple, groups.collect())) == list(map(tuple, here.collect()))
    plan = databases.search_database(spark, url, "things", kinds, {"name": "b_"}, **asked, key="id", parts=3)
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    text = plan._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "*StringContains(name_folded,b_)" in text and "*GreaterThanOrEqual(timestamp" in text and plan.rdd.getNumPartitions() == 3


def test_grids(spark):
    df = spark.createDataFrame([(5, {"a": "1"}, "m"), (6, {"b": "2", "msg": "x"}, "n"), (7, None, "o")], "s long, fields map<string,string>, msg string").withColumn("ts", F.timestamp_seconds("s"))
    grid = sinks.to_csv_grid(df, None)
    assert grid.columns == ["timestamp", "epoch_time", "a", "b", "msg"]
    assert sorted((r.epoch_time, r.a, r.b, r.msg) for r in grid.collect()) == [(5, "1", "", "m"), (6, "", "2", "n"), (7, "", "", "o")]
    listed = df.select("ts", "msg", F.array(F.struct(F.lit("a").alias("field"), F.lit("1").alias("value"), F.lit("c").alias("class")), F.struct(F.lit("a").alias("field"), F.col("msg").alias("value"), F.lit("d").alias("class"))).alias("_fields"))
    assert sorted(r.a for r in sinks.to_csv_grid(listed, None).collect()) == ["m", "n", "o"]
    groups = spark.createDataFrame([("x", 1), ("y", 5), (None, 2)], "_groupby string, _count long")
    assert [tuple(r) for r in sinks.to_group_grid({"h": groups}).collect()] == [("h", "y,,x")]


def test_sums_by_count(spark):
    df = spark.createDataFrame([("5", 9), ("a", 3), ("a", None), ("b", 0), ("", 4), (None, 4)], "v string, count long")
    sums = {r._groupby: r._count for r in transforms.sum_field(df, "v").collect()}
    assert sums == {"v": 8, "a": 1, "b": 1, "": 4}
    assert {r._groupby: r._count for r in transforms.sum_field(df.drop("count"), "v").collect()} == {"v": 5, "a": 2, "b": 1, "": 1}


def test_grep_chooses_columns(spark):
    df = spark.createDataFrame([(1, "x", {"port": "80"}), (2, "y", None)], "id long, host string, fields map<string,string>")
    assert [r.id for r in transforms.grep(df, "8", "PORT").collect()] == [1]
    assert [r.id for r in transforms.grep(df, "y", "^host$").collect()] == [2]
    assert [r.id for r in transforms.drop_matching(df, 70, "port", ">").collect()] == [2]
    assert "RLIKE" in search.search(df, all=[("id", ">", 0)]).where(transforms._hit(df, "y", "^host$", None))._jdf.queryExecution().toString()


def test_syslog_lines_behind_heads_are_not_shuffled(spark, tmp_path):
    """No line of a first split is sorted or sent to the task of its file."""
    from logweave.sources import readers

    spark.range(100).select(F.concat(F.lit("Jan  1 00:00:00 h p: "), "id")).repartition(3).write.text(str(tmp_path / "in"))
    df = readers.read_syslog(spark, str(tmp_path / "in"), 2024, skip=5)
    assert df.count() == 85
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "strategy=broadcast" in plan


def test_syslog_skips_heads_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in "ab":
        (tmp_path / "in" / name).write_text("".join(f"Jan  2 03:04:05 {name} p: m{k}\n" for k in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")  # many splits a file
    try:
        from logweave.sources import readers

        got = readers.read_syslog(spark, str(tmp_path / "in"), F.lit(2024), skip=5)
        assert got.rdd.getNumPartitions() > 4
        assert sorted((r.host, int(r.msg[1:])) for r in got.collect()) == [(n, k) for n in "ab" for k in range(5, 20_000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_tail_ends(spark, tmp_path):
    rows = spark.readStream.format("rate").load().select(F.col("value").alias("id"), F.lit("an error").alias("msg"))
    began = time.time()
    query = streams.tail_for(streams.live_tail(rows, ["error"]).writeStream.format("memory").queryName("tail"), 4)
    assert not query.isActive and query.exception() is None and 3 < time.time() - began < 60
