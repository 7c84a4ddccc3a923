from datetime import datetime, timedelta
from functools import reduce
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoroll import queries as own
from chronoroll.engine import Engine
from chronoroll.functions.dims import from_callable
from chronoroll.operators.rollup import aggregated
from chronoroll.plans.fields import INFINITE
from chronoroll.plans.parser import QueryError
from chronoroll.sources.points import read_json, report
from chronoroll.sources.sinks import text_table, write_csv
from chronoroll.streaming.continuous import ContinuousTable
from chronoroll.streaming.metrics import Progress

DATA = "/root/testdata/sf0.001"
E0 = datetime(2021, 6, 1, 10, 0, 0)


def rows(df):
    return [tuple(r) for r in df.collect()]


#: Seconds after E0, site, floor, and the values of meters; label: the end of the second.
READINGS = [
    (0.25, "north", 1, {"heat": 4, "watts": 50, "load": 8}),
    (0.25, "north", 1, {"heat": 6, "watts": 70, "load": 3}),
    (0.50, "south", 1, {"heat": 900, "watts": 900, "load": 1}),
    (0.75, "north", 2, {"heat": "broken", "watts": None}),
    (1.00, "north", 2, {"heat": 5}),
    (1.50, "north", 2, {"heat": 7, "watts": 11, "gas": 2}),
    (1.75, "north", 3, {"watts": 30, "load": 12}),
    (4.10, "north", 1, {"heat": 1, "watts": 2, "gas": 3}),
]
SAMPLES = list(range(1, 101))


def by_label(site="north"):
    """Values per second, with the number of points."""
    out = {}
    for at, s, floor, vals in READINGS:
        if s == site:
            own = out.setdefault(E0 + timedelta(seconds=-(-at // 1)), {"n": 0, "heat": [], "watts": [], "load": [], "gas": [], "floors": set()})
            own["n"] += 1
            own["floors"].add(floor)
            for k, v in vals.items():
                if isinstance(v, int | float):
                    own[k].append(v)
    return out


@pytest.fixture(scope="module")
def meters(spark):
    e = Engine(spark, whitelist=["site", "floor", "kind"])
    e.insert("readings", [(E0 + timedelta(seconds=at), {"site": s, "floor": f, "kind": "meter", "note": "not kept"}, v) for at, s, f, v in READINGS])
    e.create_table("meters", """SELECT IF(kind = 'meter', SUM(heat)) AS heat, watts, heat * watts / COUNT(watts) AS mixed, AVG(load) AS load, AVG(BOUNDED(load, 0, 10)) AS calm, gas
        FROM readings WHERE site = 'north' GROUP BY site, floor, note, period(1s)""", "300s")  # fmt: skip
    return e


def mean(x):
    return sum(x) / len(x) if x else 0


def test_all_fields(meters):
    got = rows(meters.query("SELECT * FROM meters WHERE note IS NULL GROUP BY _ ORDER BY _time"))
    want = []
    for label, v in sorted(by_label().items()):
        heat, watts = sum(v["heat"]), sum(v["watts"])
        mixed = heat * watts / len(v["watts"]) if v["watts"] else 0 if not heat * watts else INFINITE
        want.append((label, v["n"], heat, watts, mixed, mean(v["load"]), mean([x for x in v["load"] if x <= 10]), sum(v["gas"])))
    assert [r[0] for r in got] == [w[0] for w in want]
    for g, w in zip(got, want):
        assert g[1:] == pytest.approx(w[1:])


def test_strides_shifts_and_what_is_present(meters):
    of = {label: sum(v["heat"]) for label, v in by_label().items()}
    at = lambda k: E0 + timedelta(seconds=k)
    q = lambda sql: rows(meters.query(sql))
    assert q("SELECT heat FROM meters GROUP BY _ ORDER BY _time LIMIT 0") == sorted(of.items())
    back = {label: (of.get(label, 0), of.get(label - timedelta(seconds=1), 0)) for label in (at(1), at(2), at(3), at(5))}
    assert q("SELECT CROSSHIFT(heat, '-2s', '1s') FROM meters GROUP BY _ HAVING heat_1s > 0 OR heat > 0 ORDER BY _time") == [(k, *v) for k, v in sorted(back.items())]
    assert q("SELECT SHIFT(heat, '1s') AS later FROM meters GROUP BY _") == []
    assert q("SELECT heat FROM meters GROUP BY _, STRIDE(4s) ORDER BY _time") == [(at(1), of[at(1)]), (at(5), of[at(5)])]
    assert q("SELECT _ FROM meters GROUP BY floor, period(300s) ORDER BY floor") == [(at(5), f) for f in (1, 2, 3)]
    assert q("SELECT heat FROM (SELECT * FROM meters GROUP BY _) ORDER BY _time") == sorted(of.items())
    low = [(label, sum(v["heat"])) for label, v in sorted(by_label().items()) if sum(v["gas"]) < 3 and sum(v["heat"]) > 5]
    assert q("SELECT heat FROM meters GROUP BY CROSSTAB(site) HAVING gas < 3 AND heat > 5 ORDER BY _time") == low


@pytest.mark.parametrize("copies", [1, 2])
def test_elements_of_arrays_are_points(spark, copies):
    e = Engine(spark, array_tail_copies=copies)
    e.insert("s", [(E0, {"d": "x"}, {"v": [float(x) for x in SAMPLES]}), (E0, {"d": "x"}, {"v": 7.0})])
    e.create_table("t", "SELECT v, PERCENTILE(v * 1, 90, 0, 1000, -1) AS coarse, PERCENTILE(v, 5, 0, 1000, 2) AS fine, IF(TRUE = TRUE, PERCENTILE(v, 40, 0, 1000, 2)) AS some FROM s GROUP BY d, period(1s)")
    all_ = sorted([*SAMPLES[:1], *(SAMPLES[1:] * copies), 7])
    at = lambda p: all_[max(0, int(len(all_) * p / 100 + 0.5) - 1)]
    got = e.query("SELECT _points, v, coarse, fine, some, PERCENTILE(fine, 60) AS most FROM t GROUP BY _").first()
    assert (got["_points"], got["v"]) == (len(all_), sum(all_))
    assert got["coarse"] == pytest.approx(at(90), abs=10) and got["fine"] == pytest.approx(at(5), rel=0.02) and got["some"] == pytest.approx(at(40), rel=0.02) and got["most"] == pytest.approx(at(60), rel=0.02)


def test_subqueries_in_where(spark):
    e = Engine(spark)
    at = [E0 - timedelta(seconds=9 - k) for k in range(10)]
    e.insert("s", [(at[k], {"x": x, "y": y}, v) for k, x, y, v in ((0, 1, None, {"a": 10}), (1, None, 3, {"b": 20}), (4, 1, 3, {"a": 50}), (5, 2, 5, {"b": 60}), (6, 1, None, {"a": 70}), (7, None, 3, {"b": 80}), (8, 1, 5, {"a": 90}), (9, 2, 2, {"b": 100}))])
    e.create_table("tablea", "SELECT a, b FROM s GROUP BY x, y, period(1s)", "10s")
    sql = "SELECT AVG(a)+AVG(b) AS avg_total FROM (SELECT * FROM tablea WHERE x IN (SELECT x FROM tablea WHERE x = 1) OR y IN (SELECT y FROM tablea WHERE y = 3)) HAVING avg_total > 20 ORDER BY _time LIMIT 1"
    assert rows(e.query(sql)) == [(at[4], 1, 3, 50.0)]
    got = rows(e.query("SELECT a+b AS add FROM tablea ASOF '-8s' UNTIL '-2s' GROUP BY y, period(2s) ORDER BY y, _time"))
    assert got == [(at[7], None, 70.0), (at[5], 3, 50.0), (at[7], 3, 80.0), (at[5], 5, 60.0)]
    for bad in ("SELECT a FROM tablea ASOF '-1h'", "SELECT a FROM tablea GROUP BY period(1500ms)", "SELECT a FROM tablea GROUP BY period(500ms)", "SELECT a FROM nope", "SELECT a FROM tablea ORDER BY zz", "SELECT a FROM tablea GROUP BY CITY(x) AS c"):
        with pytest.raises(QueryError):
            e.query(bad)


def test_percentiles_are_bucket_values(spark):
    e = Engine(spark)
    e.insert("s", [(E0, {"d": "x"}, {"v": [k / 10 for k in range(1, 101)] * 5})])
    e.create_table("t", "SELECT PERCENTILE(v, 99, 0, 10, 1) AS p99 FROM s GROUP BY d, period(1s)")
    got = rows(e.query("SELECT p99, PERCENTILE(p99, 50) AS p50, PERCENTILE(p99, 10) AS p10 FROM t"))[0]
    assert got[2:] == pytest.approx((9.9, 5.1, 1.0))


def test_functions_of_users(spark):
    from chronoroll.functions.dims import from_mapping

    e = Engine(spark)
    e.insert("s", [(E0, {"ip": ip}, {"v": 1}) for ip in ("1.1.1.1", "2.2.2.2", "3.3.3.3")])
    e.create_table("t", "SELECT v FROM s GROUP BY ip, period(1s)")
    e.dims.register("CITY", from_mapping({"1.1.1.1": "Here", "2.2.2.2": "There"}))
    e.dims.register("ISP", from_callable(lambda ip: f"isp{ip[0]}"))
    with pytest.raises(QueryError):
        e.dims.register("city", lambda c: c)
    got = rows(e.query("SELECT v FROM t GROUP BY CITY(ip) AS city, PISP(ip) AS isp ORDER BY isp"))
    assert [r[1:] for r in got] == [("Here", "isp1", 1.0), ("There", "isp2", 1.0), (None, "isp3", 1.0)]


@pytest.mark.parametrize("parts", [1, 17])
def test_results_do_not_depend_on_partitions(spark, parts):
    e = own.engine(spark, DATA)
    s = e.streams["events"]
    sql = own.QUERIES["crosstabt"]
    want = sorted(rows(own.rounded(e.query(sql))))
    s.df = s.df.repartition(parts)
    assert sorted(rows(own.rounded(e.query(sql)))) == want


#: Prices that add up to 60 and to 50 with all their decimals, and to more as doubles: the first two in some orders, the third in every order.
AT_60, AT_50 = [(38.84, 12.42, 8.74), (31.76, 26.75, 1.49), (3.49, 32.09, 24.42)], [(45.78, 1.52, 2.7), (10.88, 36.1, 3.02)]


def dealt(spark, groups):
    """A table ``t`` of ``v`` by ``who``: each group's points in all orders, each order by a ``who`` of its own, each point in a partition of its own."""
    e = Engine(spark)
    sets = [order for g in groups for order in permutations(g)]
    e.insert("s", [(E0, {"who": k, "at": at}, {"v": v}) for k, order in enumerate(sets) for at, v in enumerate(order)])
    s = e.streams["s"]
    s.df = reduce(lambda a, b: a.unionByName(b), [s.df.where(F.col("at") == at).coalesce(1) for at in range(3)])
    e.create_table("t", "SELECT v, AVG(v) AS mean, WAVG(v, v) AS own, PERCENTILE(v, 50, 0, 100, 2) AS mid FROM s GROUP BY who, period(1s)")
    return e, len(sets)


@pytest.mark.parametrize("mid", ["", ", mid"])  # with a histogram, sums are merged in two steps
def test_means_at_a_bound_are_within_it(spark, mid):
    e, n = dealt(spark, AT_60)
    assert [r[2] for r in rows(e.query(f"SELECT BOUNDED(mean, 10, 20) AS m{mid} FROM t GROUP BY who"))] == [20.0] * n
    assert rows(e.query("SELECT mean FROM t GROUP BY who HAVING mean > 20")) == []


@pytest.mark.parametrize("mid", ["", ", mid"])
def test_sums_at_a_bound_are_not_beyond_it(spark, mid):
    e, n = dealt(spark, AT_50)
    assert [r[2] for r in rows(e.query(f"SELECT v{mid} FROM t GROUP BY who HAVING v >= 50"))] == [50.0] * n
    for sql in (f"SELECT v{mid} FROM t GROUP BY who HAVING v > 50", "SELECT v FROM t GROUP BY CROSSTAB(who) HAVING v > 600", "SELECT v FROM t GROUP BY who, CROSSTAB(who) HAVING v > 50"):
        assert rows(e.query(sql)) == []


def test_exact_sums_keep_what_is_no_price(spark):
    values = [1e300, -1e300, 1e-300, 5e-324, 2.0**60, 1 / 3, -7.123456789, float("inf"), float("nan"), None]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v double")
    got = {r["k"]: r["v"] for r in aggregated(df, ["k"], {"v": "exact"}, []).collect()}
    assert all(got[k] == v or v != v and got[k] != got[k] for k, v in enumerate(values))
    assert aggregated(df.where("k IN (5, 6, 9)"), [], {"v": "exact"}, []).first()["v"] == pytest.approx(1 / 3 - 7.123456789, rel=1e-15)


def test_two_steps_equal_one(spark, tmp_path):
    e = own.engine(spark, DATA)
    sql = "SELECT value, mean, p90 FROM full GROUP BY event_type, period(6h)"
    want = sorted(rows(own.rounded(e.query(sql))))
    e.materialize("full", str(tmp_path / "full"))
    assert sorted(rows(own.rounded(e.query(sql)))) == want
    plan = e.query("SELECT value FROM full ASOF '-1d' GROUP BY event_type")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "GreaterThan(_time" in plan


def test_continuous_table(spark, tmp_path):
    progress = Progress()
    spark.streams.addListener(progress)
    e = Engine(spark)
    e.create_table("t", "SELECT value, AVG(value) AS mean, PERCENTILE(value, 50, 0, 1000, 2) AS p FROM events GROUP BY event_type, period(1h)", "400d")
    src = str(tmp_path / "in")
    events = spark.read.parquet(f"{DATA}/events.parquet").select("ts", "event_type", "value")
    events.limit(500).write.parquet(src)
    c = ContinuousTable(e, "t", str(tmp_path / "t"))
    follow = lambda: c.start(spark.readStream.schema(events.schema).parquet(src), str(tmp_path / "cp")).awaitTermination()
    follow()
    c.compact()
    spark.createDataFrame([(datetime(2024, 1, 2, 3, 30), "click", 7.0)], events.schema).write.mode("append").parquet(src)
    follow()
    info = c.info()
    assert info["base_rows"] > 100 and info["delta_rows"] == 1 and info["delta_mark"] <= info["base_mark"] and "event_type" in info["columns"]
    assert sum(q["rows"] for q in progress.queries.values()) == 501
    spark.streams.removeListener(progress)
    before = e.query("SELECT value FROM t GROUP BY _, period(400d)").first()["value"]
    after = e.query("SELECT value FROM t GROUP BY _, period(400d)", fresh=True).first()["value"]
    assert after == pytest.approx(before + 7)
    c.take(spark.createDataFrame([(datetime(2024, 1, 2, 3, 30), "click", 7.0)], events.schema), max(n for n, _ in c._deltas(-1)))  # delivered again
    c.compact()
    assert e.query("SELECT value FROM t GROUP BY _, period(400d)").first()["value"] == pytest.approx(after)
    batch = Engine(spark)
    batch.add_stream("events", spark.read.parquet(src))
    batch.create_table("t", "SELECT value, AVG(value) AS mean, PERCENTILE(value, 50, 0, 1000, 2) AS p FROM events GROUP BY event_type, period(1h)", "400d")
    sql = "SELECT value, mean, p FROM t GROUP BY event_type, period(24h)"
    assert sorted(rows(own.rounded(e.query(sql)))) == sorted(rows(own.rounded(batch.query(sql))))


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


@pytest.mark.parametrize(("sql", "windows"), [
    ("SELECT p90, PERCENTILE(p90, 50) AS half, value FROM full GROUP BY event_type, period(24h)", 0), ("SELECT value, SHIFT(value, '-24h') AS before FROM activity GROUP BY event_type", 0),
    ("SELECT CROSSHIFT(value, '-7d', '1h') FROM activity GROUP BY event_type", 0), ("SELECT value / 10 AS tenth FROM activity GROUP BY user_id", 1),
])
def test_a_query_reads_its_source_once(spark, sql, windows):
    df = own.engine(spark, DATA).query(sql)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert scans(df) == 1 and "Join" not in plan and plan.count("Window [") == windows


def test_shifts_copy_merged_rows(spark):
    e = own.engine(spark, DATA)
    steps = e.plan("SELECT CROSSHIFT(p90, '-3d', '1d'), mean FROM full GROUP BY event_type, period(24h)").steps
    assert steps.index("merge by period") < steps.index("copies for 2 shifts")
    plain = {tuple(r)[:2]: r["p90"] for r in e.query("SELECT p90 FROM full GROUP BY event_type, period(24h)").collect()}
    for r in e.query("SELECT CROSSHIFT(p90, '-3d', '1d') FROM full GROUP BY event_type, period(24h)").collect():
        assert (r["p90"], r["p90_1d"]) == (plain.get((r["_time"], r["event_type"]), 0), plain.get((r["_time"] - timedelta(days=1), r["event_type"]), 0))


def test_percentiles_of_wide_histograms_are_linear(spark):
    import time

    e = Engine(spark)
    df = spark.range(60_000).selectExpr("timestamp_ntz'2021-01-01 00:00:00' AS ts", "id % 2 AS d", "cast(id AS double) AS v")
    e.add_stream("s", df, "ts", ["v"])
    e.create_table("t", "SELECT PERCENTILE(v, 50, 0, 100000, 5) AS p FROM s GROUP BY d, period(1s)")
    began = time.perf_counter()
    assert [r["p"] for r in e.query("SELECT p FROM t ORDER BY d").collect()] == pytest.approx([29999, 29999], rel=1e-3)
    assert time.perf_counter() - began < 30  # a walk that ranks anew at every bucket takes hours


def test_deadlines_and_kept_results(spark, tmp_path):
    e = own.engine(spark, DATA)
    sql = "SELECT value FROM activity GROUP BY event_type ORDER BY _time, event_type"
    assert e.collect(sql, timeout=300) == e.query(sql).collect()
    e.dims.register("SLOW", from_callable(lambda x: __import__("time").sleep(0.05)))
    with pytest.raises(QueryError, match="more than 2 seconds"):
        e.collect("SELECT value FROM activity GROUP BY SLOW(event_type) AS s", timeout=2)
    name = e.keep(sql, str(tmp_path))
    assert sorted(Engine(spark).kept(name, str(tmp_path)).collect()) == sorted(e.query(sql).collect())
    with pytest.raises(QueryError):
        e.kept("../other", str(tmp_path))


def test_queries_over_http(spark, tmp_path):
    import json
    from urllib.error import HTTPError
    from urllib.parse import quote
    from urllib.request import urlopen

    from chronoroll.sources.http_api import serve

    e = own.engine(spark, DATA)
    server = serve(e, str(tmp_path), most=20_000)
    get = lambda path: json.load(urlopen(f"http://127.0.0.1:{server.server_port}{path}"))
    sql = "SELECT value FROM activity GROUP BY event_type, period(24h) ORDER BY _time, event_type LIMIT 5"
    try:
        want = [[x.isoformat() if hasattr(x, "isoformat") else x for x in r] for r in e.query(sql).collect()]
        assert get(f"/run?sql={quote(sql)}") == {"columns": ["_time", "event_type", "value"], "rows": want}
        name = get(f"/keep?sql={quote(sql)}")["name"]
        assert sorted(get(f"/kept/{name}")["rows"]) == sorted(want)
        for path, status in (("/run?sql=SELECT", 400), (f"/run?sql={quote('SELECT value FROM activity')}", 400), ("/kept/none", 400), ("/other", 404)):
            with pytest.raises(HTTPError) as error:
                get(path)
            assert error.value.code == status and "error" in json.load(error.value)
    finally:
        server.shutdown()


def test_rows_can_be_rewritten_for_queries(spark):
    e = own.engine(spark, DATA)
    sql = "SELECT value FROM activity GROUP BY event_type, period(400d) ORDER BY event_type"
    all_ = {r["event_type"]: r["value"] for r in e.query(sql).collect()}
    e.rewrite_rows("activity", lambda df: df.where("event_type <> 'view'").withColumn("event_type", F.upper("event_type")))
    assert {r["event_type"]: r["value"] for r in e.query(sql).collect()} == pytest.approx({k.upper(): v for k, v in all_.items() if k != "view"})
    e.rewrite_rows("activity", None)
    assert {r["event_type"]: r["value"] for r in e.query(sql).collect()} == pytest.approx(all_)


def follower(spark, tmp_path, sql="SELECT value FROM events GROUP BY event_type, period(1h)", **options):
    e = Engine(spark)
    e.create_table("t", sql, "400d")
    return e, ContinuousTable(e, "t", str(tmp_path / "t"), **options)


def points(spark, *rows):
    return spark.createDataFrame([(E0 + timedelta(hours=h), kind, float(v)) for h, kind, v in rows], "ts timestamp_ntz, event_type string, value double")


def total(e):
    return e.query("SELECT value FROM t GROUP BY _, period(400d)", fresh=True).first()["value"]


def test_a_crash_between_two_steps_changes_nothing(spark, tmp_path, monkeypatch):
    e, c = follower(spark, tmp_path, compact_after=None)
    c.take(points(spark, (0, "a", 1), (1, "b", 2)), 0)
    c.compact()
    write = ContinuousTable._write

    def stops(name):
        def no(self, to, value):
            if to.startswith(name):
                raise KeyboardInterrupt
            write(self, to, value)

        return no

    for name in ("mark", "pointer"):
        monkeypatch.setattr(ContinuousTable, "_write", stops(name))
        before = total(e)
        with pytest.raises(KeyboardInterrupt):
            c.take(points(spark, (2, "a", 10)), 1)
            c.compact()
        if name == "mark":
            assert total(e) == before == 3  # the batch was not finished
        else:
            assert total(e) == 13  # the batch was, the compaction was not
        monkeypatch.setattr(ContinuousTable, "_write", write)
        c.take(points(spark, (2, "a", 10)), 1)  # delivered again
        assert total(e) == 13
    c.compact()
    c.take(points(spark, (2, "a", 10)), 1)  # and once more, after it was compacted
    assert total(e) == 13 and c.info()["delta_rows"] == 0
    (tmp_path / "t" / "pointer" / "99.json").write_text("{half")
    assert total(e) == 13


def test_batches_and_compaction_do_not_overwrite_each_other(spark, tmp_path, monkeypatch):
    e, c = follower(spark, tmp_path, compact_after=None)
    for n in range(3):
        c.take(points(spark, (n, "a", 1)), n)
    write = ContinuousTable._write

    def meanwhile(self, to, value):
        if to.startswith("pointer"):
            monkeypatch.setattr(ContinuousTable, "_write", write)
            c.take(points(spark, (50, "b", 5)), 3)  # a batch arrives while the base is being written
        write(self, to, value)

    monkeypatch.setattr(ContinuousTable, "_write", meanwhile)
    c.compact()
    assert total(e) == 8 and [n for n, _ in c._deltas(-1)] == [3] and c.state()["upto"] == 2
    assert c.state()["latest"] == c.info()["latest_point"] == int((E0 + timedelta(hours=50) - datetime(1970, 1, 1)).total_seconds()) * 10**6
    c.compact()
    assert total(e) == 8


def test_compaction_by_itself_and_quarantine(spark, tmp_path):
    e, c = follower(spark, tmp_path, compact_after=3)
    for n in range(8):
        c.take(points(spark, (n, "a", 1)), n)
    assert total(e) == 8 and len(c._deltas(-1)) == 2 and c.state()["upto"] == 5
    assert c.check() == []
    damaged = next((tmp_path / "t" / "delta" / "batch=7").glob("*.parquet"))
    damaged.write_bytes(b"PAR1 not much of a file PAR1")
    for crc in damaged.parent.glob(".*.crc"):
        crc.unlink()
    assert len(c.check(quarantine=True)) == 1 and total(e) == 7 and list((tmp_path / "t" / "quarantine").iterdir())
    e2, c2 = follower(spark, tmp_path / "timed", compact_after=None, compact_every=0.0)
    c2.take(points(spark, (0, "a", 1)), 0)
    assert c2._deltas(-1) == [] and total(e2) == 1


def test_only_points_that_pass_move_the_clock(spark, tmp_path):
    sql = "SELECT value FROM events WHERE event_type <> 'noise' GROUP BY event_type, period(1h)"
    e, c = follower(spark, tmp_path, sql)
    c.take(points(spark, (0, "a", 1), (24 * 900, "noise", 7)), 0)
    c.take(points(spark, (1, "a", 2)), 1)
    assert total(e) == 3  # with the noise's time all else would have expired
    batch = Engine(spark)
    batch.add_stream("events", points(spark, (0, "a", 1), (24 * 900, "noise", 7), (1, "a", 2)))
    batch.create_table("t", sql, "400d")
    assert total(batch) == 3


def test_json_points_and_sinks(spark, tmp_path):
    lines = ['{"ts":"2020-01-01T00:00:10Z","dims":{"a":"x","n":1},"vals":{"v":[1,2]}} {"dims":{"a":"}{\\"{"},"vals":{"v":5}}', '{"dims":{"a":"y"},"vals":{"v":3}}', '{"dims":{},"vals":{"v":1}}', '{"dims":{"a":"z"}}{"dims":{"a":"w"},"vals":{"v":4}} and more', "nonsense"]
    (tmp_path / "in.json").write_text("\n".join(lines) + "\n")
    good, bad = read_json(spark, str(tmp_path / "in.json"), {"a": "string", "n": "int"}, ["v"], now="2020-01-01 00:00:20")
    assert sorted(r["reason"] for r in bad.collect()) == ["no dimensions", "no values", "not a point", "not a point"]
    assert sorted(r["a"] for r in good.collect()) == ["w", "x", "y", '}{"{']
    assert report(good, bad) == {"succeeded": 4, "failed": 4, "errors": {"no dimensions": 1, "no values": 1, "not a point": 2}}
    good = good.where("a IN ('x', 'y')")
    e = Engine(spark)
    e.add_stream("s", good, "ts", ["v"])
    e.create_table("t", "SELECT v FROM s GROUP BY *, period(1m)")
    df = e.query("SELECT v FROM t ORDER BY a")
    assert [tuple(r)[1:] for r in df.collect()] == [("x", 1, 3.0), ("y", None, 3.0)]
    table = text_table(df, ["v"])
    assert "only the first 1 rows" in text_table(df, ["v"], 1) and "only" not in text_table(df, ["v"], 2)
    assert "-----" in table and "3.0000" in table and "Wed, 01 Jan 2020 00:01:00 UTC" in table
    write_csv(df, str(tmp_path / "csv"), ["v"])
    assert sorted(spark.read.csv(str(tmp_path / "csv"), header=True).columns) == ["_time", "a", "n", "v"]


def test_cache_stats_and_empty(spark):
    e = own.engine(spark, DATA)
    sql = "SELECT value FROM activity GROUP BY event_type"
    assert e.cached(sql) is e.cached(sql)
    assert e.stats("clicks")["expired"] == 0 and sum(e.stats("clicks").values()) == 1000
    assert "group by" in e.explain(sql)
    with pytest.raises(QueryError):
        e.query("SELECT * FROM base")
    with pytest.raises(QueryError):
        e.query(sql, max_age="1d")
    s = e.streams["events"]
    s.df = s.df.where("false")
    e._times.clear()
    assert e.query(sql).count() == 0


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = own.queries()[name](spark, DATA).toPandas(), con.sql(own.SQL[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns) and len(got) == len(want)
    keys = [c for c in names if got[c].dtype.kind != "f"] + [c for c in names if got[c].dtype.kind == "f"]
    got, want = (x.sort_values(keys).reset_index(drop=True) for x in (got, want))
    for c in names:
        if got[c].dtype.kind == "f":
            assert np.allclose(got[c].astype(float), want[c].astype(float), atol=1.1e-4, rtol=1e-12), c
        elif got[c].dtype.kind == "M":
            assert (got[c].astype("datetime64[us]") == want[c].astype("datetime64[us]")).all(), c
        else:
            assert got[c].astype(str).replace("nan", "None").tolist() == want[c].astype(str).replace("nan", "None").tolist(), c
