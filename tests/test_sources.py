import hashlib
import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from barline.operators import ledger, quality, regimes
from barline.operators.bars import fill_notional, merge_moments, moment_stats, side_buckets
from barline.operators.series import DAY_MS, index_rows, time_bucket
from barline.operators.upserts import insert_counts, insert_new, merge_keep_last, upsert_columns
from barline.sources import calendar, csv, lake, payloads

H = 3_600_000


def test_kline_csv_with_and_without_header(spark, tmp_path):
    row = "1700000000000,1,3,0.5,2,10,1700003599999,20,7,4,8,0"
    micro = "1700003600000000,2,4,1,3,11,1700007199999,22,8,5,9,0"
    (tmp_path / "a.csv").write_text(",".join(csv.KLINE_COLUMNS) + "\n" + row + "\n")
    (tmp_path / "b.csv").write_text(micro + "\n")
    got = csv.candles(csv.read_raw(spark, str(tmp_path), csv.KLINE_COLUMNS), "X", "1h").orderBy("ts").collect()
    assert [r.ts for r in got] == [1700000000000, 1700003600000]
    assert (got[0].volume, got[0].quote_volume, got[0].taker_buy_volume, got[0].trades) == (10.0, 20.0, 4.0, 7)


def test_metrics_csv_mixed_times(spark, tmp_path):
    (tmp_path / "m.csv").write_text(
        "2024-01-01 01:00:00,X,5,50,1,2,3,4\n1704074400000,X,6,60,1,-2,,1\n1704078300000,X,7,70,1,1,1,1\n"
    )
    m = csv.metrics(csv.read_raw(spark, str(tmp_path), csv.METRICS_COLUMNS), "X")
    assert [r.oi_base for r in csv.open_interest(m).orderBy("ts").collect()] == [5.0, 6.0]
    got = csv.long_short_ratios(m).orderBy("ts", "ratio_type").collect()
    assert [(r.ratio_type, r.ls_ratio) for r in got] == [
        ("all_account", 3.0), ("taker_volume", 4.0), ("top_trader_position", 2.0), ("taker_volume", 1.0)
    ]
    assert got[0].long_ratio == pytest.approx(0.75) and got[0].short_ratio == pytest.approx(0.25)


def test_fill_buckets(spark):
    f = spark.createDataFrame(
        [(0, "SELL", 10.0, 2.0, 9.0, 5.0), (299_999, "BUY", None, 2.0, 9.0, 5.0), (300_000, "SELL", 0.0, 2.0, 9.0, 1.0)],
        "ts bigint, side string, ap double, aq double, p double, q double",
    )
    n = fill_notional(F.col("ap"), F.col("aq"), F.col("p"), F.col("q"))
    got = side_buckets(f, [], F.col("side"), n, "SELL", "BUY").orderBy("ts").collect()
    assert [(r.ts, r.long_liq_usd, r.short_liq_usd, r.events, r.max_single_usd) for r in got] == [
        (0, 20.0, 45.0, 2, 45.0), (300_000, 9.0, 0.0, 1, 9.0)
    ]


def docs(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "payload string")


def test_empty_points_are_errors(spark):
    with pytest.raises(PySparkException):
        payloads.volatility_points(docs(spark, '{"result":{"data":[]}}')).collect()
    with pytest.raises(PySparkException):
        payloads.sentiment_point(docs(spark, '{"data":[]}')).collect()


def test_empty_snapshots_give_no_rows(spark):
    d = docs(spark, '{"data":[]}').withColumn("at", F.lit(1))
    assert payloads.funding_snapshot(d, "at").count() == 0
    assert payloads.open_interest_snapshot(d).count() == 0
    assert payloads.ratio_snapshot(d).count() == 0
    assert payloads.daily_bar_arrays(docs(spark, '{"chart":{"result":[]}}', '{"chart":{}}')).count() == 0


def test_funding_is_dated_by_observation(spark):
    d = docs(spark, '{"data":[{"instId":"A","fundingRate":"0.01","fundingTime":"999"}]}').withColumn("at", F.lit(5))
    assert payloads.funding_snapshot(d, "at").first().asDict() == {"ts": 5, "rate": 0.01, "next_funding_time": 999}


def test_liquidation_payloads(spark):
    d = docs(
        spark,
        '{"data":[{"details":null},{},{"details":[{"bkPx":"100","sz":"3","posSide":"long","ts":"10"},'
        '{"bkPx":"100","sz":"1","posSide":"short","ts":"20"}]}]}',
    )
    got = payloads.liquidation_buckets(d.withColumn("inst", F.lit("BTC-USDT-SWAP")), "inst", ["inst"]).first()
    assert (got.long_liq_usd, got.short_liq_usd, got.events, got.max_single_usd) == (3.0, 1.0, 2, 3.0)
    assert payloads.liquidation_buckets(d.withColumn("inst", F.lit("OTHER")), "inst", ["inst"]).count() == 0


def test_mints(spark):
    d = docs(
        spark,
        '{"status":"1","result":[{"from":"0x0000000000000000000000000000000000000000","value":"5000000","tokenDecimal":"6","timeStamp":"7","hash":"h1"},'
        '{"from":"0x1","value":"1","tokenDecimal":"6","timeStamp":"8","hash":"h2"}]}',
        '{"status":"0","result":[]}',
    )
    got = payloads.token_mints(d).collect()
    assert [(r.ts, r.magnitude, r.dedupe_key) for r in got] == [(7000, 5.0, "usdt_mint:h1")]


def test_calendar_is_inserted_once(spark):
    events = calendar.calendar_events(spark)
    assert events.count() == 8
    assert insert_new(events, events, "dedupe_key", ["ts"]).count() == 0
    assert insert_counts(events.limit(3), events, "dedupe_key").first().asDict() == {"written": 5, "skipped": 3}


def test_merges(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "ts bigint, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "ts bigint, v string")
    assert sorted(map(tuple, merge_keep_last(old, new, ["ts"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    a = spark.createDataFrame([(1, 1.0, 9.0)], "k bigint, x double, y double")
    b = spark.createDataFrame([(1, 2.0), (4, 5.0)], "k bigint, x double")
    assert sorted(map(tuple, upsert_columns(a, b, ["k"], ["x"]).collect())) == [(1, 2.0, 9.0), (4, 5.0, None)]


def test_manifest_hash_ignores_time_and_label(spark, tmp_path):
    root = str(tmp_path / "lake")
    df = spark.range(10).coalesce(1)
    df.write.parquet(f"{root}/curated/a")
    assert lake.read_dataset_hash(spark, root) == "unknown"
    one = lake.write_manifest(spark, root, "2024-01-01")
    files = sorted((p for p in (tmp_path / "lake").rglob("*.parquet")), key=str)
    listed = [{"key": str(p.relative_to(tmp_path / "lake")), "size": p.stat().st_size} for p in files]
    assert one == hashlib.sha256(json.dumps(listed, sort_keys=True).encode()).hexdigest()
    two = lake.write_manifest(spark, root, "2024-01-02")
    assert one == two == lake.read_dataset_hash(spark, root)
    df.write.parquet(f"{root}/curated/b")
    assert lake.write_manifest(spark, root, "2024-01-03") != one
    a = lake.content_hash(spark.range(100)).first()
    assert a == lake.content_hash(spark.range(100).repartition(7)).first()


def test_backup_keeps_eight_generations(spark, tmp_path):
    root = str(tmp_path / "backups")
    df = spark.range(3)
    for day in range(1, 12):
        assert lake.backup({"t": df}, root, f"2024-01-{day:02d}") == {"t": 3}
    kept = sorted(p.name for p in (tmp_path / "backups").iterdir())
    assert kept == [f"2024-01-{d:02d}" for d in range(4, 12)]


def test_missing_and_empty_tables(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        lake.read_table(spark, str(tmp_path / "none"))
    assert lake.read_or_empty(spark, str(tmp_path / "none"), lake.CANDLE_SCHEMA).count() == 0


def test_months(spark):
    df = spark.createDataFrame([("2024-11-20", "2025-02-01"), ("2024-11-20", "2024-11-30")], "a string, b string").select(
        F.to_date("a").alias("a"), F.to_date("b").alias("b")
    )
    got = [str(r.month)[:7] for r in lake.month_range(df, "a", "b").collect()]
    assert got == ["2024-11", "2024-12", "2025-01"]


def test_incremental_passes_long_gaps_and_keeps_null_keys(spark):
    day = 86_400_000
    stored = spark.createDataFrame([("a", 0), (None, 5 * day)], "k string, ts bigint")
    rows = [("a", 0), ("a", 400 * day), ("a", 401 * day), (None, 5 * day), (None, 700 * day), ("new", 3 * day)]
    got = lake.incremental(stored, spark.createDataFrame(rows, "k string, ts bigint"), ["k"], "1970-01-01").collect()
    assert {(r.k, r.ts // day) for r in got} == {("a", 400), ("a", 401), (None, 700), ("new", 3)}


def test_open_issues_and_actions_are_not_cut(spark):
    schema = "issue_id bigint, detected_at bigint, stream_id string, rule_id string, severity string, status string"
    rows = [(k, 1000 + k, "off:x", "DQ-01", "critical", "open") for k in range(60)] + [(99, 1, "on:y", "DQ-01", "critical", "open")]
    issues = spark.createDataFrame(rows, schema)
    sources = spark.createDataFrame([("off", "disabled"), ("on", "active")], "source_id string, status string")
    assert [r.issue_id for r in quality.open_issues(issues, sources).collect()] == [99]
    edges = spark.createDataFrame([], "edge_id string, title string, status string")
    states = spark.createDataFrame([], "edge_id string, state string")
    verdicts = spark.createDataFrame([], "edge_id string, run_id string, verdict string, decided_at bigint")
    assert ledger.action_queue(edges, states, verdicts, issues).count() == 61


def test_moments_merge_exactly(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(1e6, 1, 500)
    parts = [(int(len(p)), float(p.mean()), float(((p - p.mean()) ** 2).sum())) for p in np.array_split(x, 7)]
    df = spark.createDataFrame([("a", *p) for p in parts], "k string, n bigint, mean double, m2 double")
    got = merge_moments(df, ["k"]).withColumns(moment_stats()).first()
    assert got.n == 500 and got["stddev"] == pytest.approx(x.std(ddof=1), rel=1e-9)


def test_regimes(spark):
    """A steady climb is 'up'; too little history gives no label; short keys no history."""
    n = 260
    close = [100 * 1.004**i for i in range(n)]
    rows = [("a", i * DAY_MS, c, c * 1.01, c * 0.995) for i, c in enumerate(close)] + [("short", i * DAY_MS, 1.0, 1.0, 1.0) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, ts bigint, close double, high double, low double")
    ix = index_rows(df, ["k"], "ts", time_bucket("ts", 365 * DAY_MS))
    lab = regimes.classify(ix, ["k"]).cache()
    mine = lab.filter("k = 'a'").orderBy("pos").collect()
    assert mine[198].trend is None and mine[259].trend == "up"
    assert mine[50].vol is None and mine[200].vol is not None
    assert {r.k for r in regimes.history(lab, ["k"]).collect()} == {"a"}
    now = regimes.current(lab, ["k"]).collect()
    assert [(r.k, r.trend) for r in now] == [("a", "up")]


def test_merge_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([("p", 1, 1.0), ("p", 2, 2.0), ("q", 1, 3.0)], "part string, ts bigint, v double")
    lake.merge_partitions(old, path, ["part", "ts"], ["part"])
    before = {p.name for p in (tmp_path / "t" / "part=q").iterdir()}
    new = spark.createDataFrame([("p", 2, 9.0), ("r", 5, 5.0)], "part string, ts bigint, v double")
    lake.merge_partitions(new, path, ["part", "ts"], ["part"])
    got = sorted(map(tuple, spark.read.schema(old.schema).parquet(path).select("part", "ts", "v").collect()))
    assert got == [("p", 1, 1.0), ("p", 2, 9.0), ("q", 1, 3.0), ("r", 5, 5.0)]
    assert {p.name for p in (tmp_path / "t" / "part=q").iterdir()} == before


def test_folder_hashes_equal_a_plain_tree(spark):
    keys = {"a": 1, "b/c": 2, "b/d/e": 3, "b/d/f": 4, "x/y/z/w": 5, "b/d/": 0}
    got = {r.folder: (r.sha256, r.files) for r in lake.folder_hashes(spark.createDataFrame(list(keys.items()), "key string, size bigint")).collect()}

    def plain(folder):
        below = [k for k in keys if not folder or k.startswith(folder + "/")]
        entries, n = [], 0
        for name in {k[len(folder) + bool(folder) :].split("/")[0] for k in below}:
            path = f"{folder}/{name}" if folder else name
            if path in keys:
                entries.append(f"file {keys[path]} {len(name)} {name}")
                n += 1
            if any(k.startswith(path + "/") for k in below):
                sub, m = plain(path)
                entries.append(f"folder {sub} {len(name)} {name}")
                n += m
        return hashlib.sha256("\n".join(sorted(entries)).encode()).hexdigest(), n

    assert got == {f: plain(f) for f in ("", "b", "b/d", "x", "x/y", "x/y/z")}
    empty = spark.createDataFrame([], "key string, size bigint")
    assert lake.folder_hashes(empty).collect() == []


def test_bad_documents_become_rejects(spark):
    good = '{"result":{"data":[[3600001,0,0,0,41.5],[7200000,0,0,0,42]]}}'
    texts = [good, '{"result":{"data":[]}}', "{", None, '{"result":null}', good, '{"result":{"data":[null]}}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, payload string")
    parsed = payloads.volatility_points_or_rejects(df, ["id"])
    assert sorted((r.id, r.ts, r.dvol) for r in parsed.rows.collect()) == [(i, t, v) for i in (0, 5) for t, v in ((3600000, 41.5), (7200000, 42.0))]
    assert {r.id: r.reason for r in parsed.rejects.collect()} == {
        1: "no volatility points", 2: "not JSON", 3: "no document", 4: "no volatility points", 6: "no volatility points",
    }
    mood = '{"data":[{"value":"61","value_classification":"Greed","timestamp":"1700000000"}]}'
    parsed = payloads.sentiment_point_or_rejects(spark.createDataFrame([(1, mood), (2, '{"data":[]}')], "id int, payload string"), ["id"])
    assert tuple(parsed.rows.first()) == (1, 1700000000000, 61.0, "Greed")
    assert [(r.id, r.reason) for r in parsed.rejects.collect()] == [(2, "no sentiment points")]


def test_retired_partitions_are_verified_first(spark, tmp_path, monkeypatch):
    source, target = str(tmp_path / "t"), str(tmp_path / "old")
    rows = [(k, k * 1000, f"2020-0{1 + k % 4}") for k in range(40)] + [(99, 5, None)]
    df = spark.createDataFrame(rows, "id bigint, ts bigint, month string")
    df.write.partitionBy("month").parquet(source)
    whole = lake._copy
    # a copy that loses a row of one month: that month stays, the others go
    monkeypatch.setattr(lake, "_copy", lambda d, to, column: whole(d.filter("id <> 5"), to, column))
    first = {r.part: r.dropped for r in lake.retire(spark, source, target, "month", "2020-04").collect()}
    assert first == {"2020-01": True, "2020-02": False, "2020-03": True}
    left = {r.id for r in lake.read_table(spark, source).collect()}
    assert left == {k for k in range(40) if k % 4 in (1, 3)} | {99}
    # a crash before anything was dropped: the repeat finds what is archived, and mends the damaged month
    monkeypatch.setattr(lake, "_copy", whole)
    again = lake.retire(spark, source, target, "month", "2020-04").collect()
    assert [(r.part, r.rows, r.dropped) for r in again] == [("2020-02", 10, True)]
    assert lake.retire(spark, source, target, "month", "2020-04").collect() == []
    kept = lake.read_table(spark, source).unionByName(lake.read_table(spark, target))
    assert sorted((r.id, r.ts, r.month) for r in kept.collect() if r.month) == sorted(r for r in rows if r[2])
    assert lake.read_table(spark, target).count() == 30


def test_a_month_in_the_archive_is_not_copied_again(spark, tmp_path, monkeypatch):
    source, target = str(tmp_path / "t"), str(tmp_path / "old")
    spark.createDataFrame([(1, 1, 2019), (2, 2, 2021)], "id bigint, ts bigint, year int").write.partitionBy("year").parquet(source)
    lake._copy(lake.read_table(spark, source).filter("year = 2019"), target, "year")
    monkeypatch.setattr(lake, "_copy", lambda *a: pytest.fail("copied"))
    assert [r.dropped for r in lake.retire(spark, source, target, "year", "2020").collect()] == [True]
    assert [r.id for r in lake.read_table(spark, source).collect()] == [2]
