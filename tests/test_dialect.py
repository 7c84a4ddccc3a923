import math

import pytest

from chronoroll.functions.dims import Dimensions
from chronoroll.functions.durations import format_duration, parse_duration
from chronoroll.functions.timegrid import ceil_us
from chronoroll.plans.catalog import Catalog, grouping, select_fields
from chronoroll.plans.fields import INFINITE, apply, fills_gaps, when_unset
from chronoroll.plans.parser import QueryError, parse_query

H, D, W = 3_600_000_000, 86_400_000_000, 604_800_000_000


def test_durations():
    assert parse_duration("1w2d3h4m5s") == W + 2 * D + 3 * H + 4 * 60_000_000 + 5_000_000
    assert parse_duration("-1.5h") == -int(1.5 * H)
    assert [format_duration(x) for x in (23 * H + 55 * 60_000_000, D + 23 * H + 55 * 60_000_000, W + 23 * H + 55 * 60_000_000, W, D)] == ["23h55m0s", "1d23h55m0s", "1w0d23h55m0s", "1w", "1d"]
    for bad in ("", "5", "h", "1x", "1ns"):
        with pytest.raises(ValueError):
            parse_duration(bad)


def test_labels_are_period_ends():
    assert ceil_us(H, H) == H and ceil_us(H + 1, H) == 2 * H and ceil_us(-1, H) == 0
    assert ceil_us(2 * D, W) == 4 * D  # weeks end on Mondays; 1970-01-05 is one


def fields_of(sql, known=()):
    """Texts of a query's fields by name, and of its HAVING."""
    fields, having = select_fields(parse_query(sql), {f.name: f.expr for f in known}, Dimensions(), tuple(known))
    return {f.name: str(f.expr) for f in fields}, having and str(having)


def test_comments_and_marks_of_freshness():
    q = parse_query("SELECT -- force_fresh\n speed FROM Lanes // the rest\n WHERE road = 'A7'")
    assert q.fresh and q.source == "Lanes" and q.where is not None
    assert not parse_query("SELECT speed FROM lanes").fresh


def test_names_are_lower_case_and_may_be_quoted():
    assert fields_of("SELECT Speed, `Cars`, SUM(Trucks) AS Heavy FROM lanes")[0] == {"speed": "SUM(speed)", "cars": "SUM(cars)", "heavy": "SUM(trucks)"}


@pytest.mark.parametrize(("sql", "name", "text"), [
    ("SELECT speed / (cars - 3) * 4 AS x FROM lanes", "x", "((SUM(speed) / (SUM(cars) - 3)) * 4)"),
    ("SELECT WAVG(speed, cars) AS x FROM lanes", "x", "WAVG(speed, cars)"),
    ("SELECT SUM(BOUNDED(speed, 30, 130)) AS x FROM lanes", "x", "SUM(BOUNDED(speed, 30, 130))"),
    ("SELECT IF(road = 'A7', MAX(speed)) AS x FROM lanes", "x", "IF((road = 'A7'), MAX(speed))"),
    ("SELECT 12 AS x FROM lanes", "x", "12"),
    ("SELECT LOG2(cars) AS x FROM lanes", "x", "LOG2(SUM(cars))"),
    ("SELECT SHIFT(MIN(speed), '-2h') AS x FROM lanes", "x", f"SHIFT(MIN(speed), {-2 * H})"),
    ("SELECT cars AS y, y + y AS x FROM lanes", "x", "(SUM(cars) + SUM(cars))"),
])
def test_fields(sql, name, text):
    assert fields_of(sql)[0][name] == text


def test_known_fields_stand_for_what_they_are_defined_as():
    known = Catalog(Dimensions()).define("lanes", "SELECT AVG(speed) AS pace, PERCENTILE(wait, 95, 0, 600, 1) AS slow FROM s GROUP BY period(1m)", D).fields
    text, having = fields_of("SELECT pace, LN(pace) AS l, PERCENTILE(slow, 50) AS middle, * FROM lanes HAVING Pace > 3 AND other < 1", known)
    assert text["pace"] == "AVG(speed)" and text["l"] == "LN(AVG(speed))" and text["middle"] == "PERCENTILE(PERCENTILE(wait, 95, 0, 600, 1), 50)" and "slow" in text
    assert having == "((AVG(speed) > 3) AND (SUM(other) < 1))"


def test_cross_shift_names_its_copies():
    names = list(fields_of("SELECT CROSSHIFT(cars, '-4h', '1h') FROM lanes")[0])
    assert [n for n in names if n.startswith("cars")] == ["cars", "cars_1h0m0s", "cars_2h0m0s", "cars_3h0m0s"]


def test_ranges_order_and_limits():
    q = parse_query("SELECT cars FROM lanes ASOF '-2d' UNTIL '-30m' ORDER BY Cars DESC, road LIMIT 7, 3")
    assert q.as_of.value == "-2d" and q.until.value == "-30m" and q.order == [("cars", True), ("road", False)] and (q.offset, q.limit) == (7, 3)


def test_groups():
    g = grouping(parse_query("SELECT cars FROM lanes GROUP BY road, PCONCAT('-', road, lane) AS place, CROSSTABT(kind), STRIDE('1d'), period(10m)"), Dimensions())
    assert g.period == H // 6 and g.stride == D and g.crosstab.name == "CROSSTABT" and [n for n, _ in g.dims] == ["place", "road"]


@pytest.mark.parametrize("cond", [
    "road LIKE 'A%'", "road NOT LIKE 'B_'", "lane > 2 OR (lane = 1 AND road <> 'A1')", "open != false", "toll IS NULL", "toll IS NOT NULL", "lane IN (1, 2)",
    "lane NOT IN (3)", "road IN (SELECT road FROM works WHERE lane > 1 HAVING cars > 5)", "RAND() < 0.25", "NOT road = 'A1'",
])
def test_conditions_are_read(cond):
    assert parse_query(f"SELECT cars FROM lanes WHERE {cond}").where is not None


@pytest.mark.parametrize("sql", [
    "SELECT a + b FROM t", "SELECT SUM(a, b) AS x FROM t", "SELECT SUM(*) AS x FROM t", "SELECT COUNT(1) AS n FROM t", "SELECT NOPE(a) AS x FROM t", "SELECT IF(d = 1, 5) AS x FROM t",
    "SELECT PERCENTILE(a, 5) AS x FROM t", "SELECT SUM(a + b) AS x FROM t", "SELECT CROSSHIFT(a, '0s', '1h') FROM t", "SELECT -a AS x FROM t", "SELECT a FROM t HAVING NOT a > 5",
    "SELECT BOUNDED(a, 0, 5) * 2 AS x FROM t", "SELECT BOUNDED(SUM(a), 0, 5) AS y, 1 + y AS x FROM t",
])
def test_errors_in_fields(sql):
    with pytest.raises(QueryError):
        select_fields(parse_query(sql), {}, Dimensions())


@pytest.mark.parametrize("sql", ["SELECT", "SELECT a", "SELECT a FROM t WHERE", "SELECT a FROM t LIMIT x", "SELECT a FROM t; x", "SELECT a FROM t extra words"])
def test_errors_in_text(sql):
    with pytest.raises(QueryError):
        parse_query(sql)


def test_errors_in_groups():
    for by in ("LEN(a)", "CROSSTAB(a), CROSSTAB(b)", "period(0s)", "period(5)"):
        with pytest.raises((QueryError, ValueError)):
            grouping(parse_query(f"SELECT a FROM t GROUP BY {by}"), Dimensions())


def test_arithmetic():
    assert apply("/", 1, 0) == INFINITE and apply("/", 0, 0) == 0 and apply("AND", 1, 0) == 0 and apply("OR", 0, 2) == 1 and apply(">=", 1, 1) == 1
    fields, having = select_fields(parse_query("SELECT a / 10 AS x, LN(0) AS l, a / b AS y FROM t HAVING x < 5"), {}, Dimensions())
    assert [fills_gaps(f.expr) for f in fields] == [True, False, False]
    assert when_unset(fields[0].expr) == 0 and when_unset(fields[1].expr) == -math.inf and when_unset(fields[2].expr) is None and when_unset(having) == 1


SCHEMA = """
pace_and_cars:
  view: true
  sql: SELECT cars + pace AS both FROM open_lanes WHERE road = 'A7'
open_lanes:
  retentionperiod: 1h
  view: true
  sql: SELECT * FROM raw_lanes WHERE closed IS NULL
raw_lanes:
  virtual: true
  sql: SELECT cars, AVG(pace) AS pace FROM loops GROUP BY *, period(15s)
"""


def test_schema():
    c = Catalog(Dimensions())
    assert c.apply_schema(SCHEMA) == ["raw_lanes", "open_lanes", "pace_and_cars"]
    d = c["Pace_and_Cars"]
    assert d.stream == "loops" and d.resolution == 15_000_000 and d.retention == H and [f.name for f in d.fields] == ["_points", "both"]
    assert str(d.fields[1].expr) == "(SUM(cars) + AVG(pace))"
    c.apply_schema(SCHEMA)  # again: altered, not doubled
    with pytest.raises(QueryError):
        c.define("raw_lanes", "SELECT a FROM s GROUP BY period(1s)", D)
    with pytest.raises(QueryError):
        c.apply_schema("v: {view: true, sql: SELECT * FROM nowhere}")
    for sql, keep in (("SELECT a FROM s", D), ("SELECT a FROM s GROUP BY period(1h)", 1), ("SELECT a FROM s GROUP BY period(1h)", 0)):
        with pytest.raises(QueryError):
            c.define("x", sql, keep)
