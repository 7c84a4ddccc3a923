"""The engine's queries over the driver's tables, each with the DuckDB SQL of its result.

Doubles are rounded on both sides, as sums depend on their order: to four decimals, means
to seven and their squares to nine, since means of prices often lie halfway between two values of four decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions.dims import from_hashes, from_scripts, from_sets

ALIASES = """
SHORT = SUBSTR(%v, 0, 3)
PERCENT = DECODE(%v, %v, 'yes', 'no')
"""


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """Streams over events, lineitem and orders, and the tables that the queries read."""
    e = Engine(spark)
    e.dims.load_aliases(ALIASES)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    e.add_stream("events", events.select("ts", "event_type", "user_id", k.alias("k"), "value"), "ts", ["value"])
    e.add_stream("lineitem", spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_shipdate", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount"), "l_shipdate", ["l_quantity", "l_extendedprice", "l_discount"])
    e.add_stream("orders", spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderdate", "o_orderstatus", "o_orderpriority", "o_totalprice"), "o_orderdate", ["o_totalprice"])
    e.add_stream("measures", events.select("ts", "event_type", F.array(F.col("value"), F.col("value") * 2, F.col("value") + 1).alias("value")), "ts", ["value"])
    e.create_table("activity", "SELECT value FROM events GROUP BY event_type, user_id, period(1h)")
    e.create_table("full", "SELECT value, MIN(value) AS low, MAX(value) AS high, COUNT(value) AS n, AVG(value) AS mean, WAVG(value, value) AS selfmean, AVG(BOUNDED(value, 5, 20)) AS inner_mean, IF(event_type = 'error', SUM(_points)) AS errors, PERCENTILE(value, 90, 0, 1000, 2) AS p90 FROM events GROUP BY event_type, user_id, k, period(1h)")
    e.create_table("everything", "SELECT value FROM events GROUP BY *, period(1h)")
    e.create_table("weekly", "SELECT value FROM events GROUP BY event_type, period(1w)")
    e.create_table("recent", "SELECT value FROM events GROUP BY event_type, period(1h)", retention="10d")
    e.create_table("backfilled", "SELECT value FROM events GROUP BY event_type, period(1h)", backfill="5d")
    e.create_table("base", "SELECT value, COUNT(value) AS n FROM events GROUP BY *, period(1h)", virtual=True)
    e.create_view("clicks", "SELECT * FROM base WHERE event_type = 'click'")
    e.create_view("click_mean", "SELECT value / n AS per FROM clicks WHERE k > 50 GROUP BY user_id, period(2h)")
    e.create_table("arrays", "SELECT value FROM measures GROUP BY event_type, period(1h)")
    e.create_table("early", "SELECT value FROM events WHERE k < 5 AND event_type <> 'view' GROUP BY event_type, period(1h)")
    e.create_table("deep", "SELECT PERCENTILE(value, 90, 0, 1000, 2) AS p90, PERCENTILE(p90, 50, 0, 500, 2) AS half FROM events GROUP BY event_type, period(1h)")
    e.dims.register("HGET", from_hashes({"names": {"click": "Click", "view": "View"}}), 2, 2)
    e.dims.register("SISMEMBER", from_sets({"loud": ["error", "purchase"]}), 2, 2)
    e.dims.register("LUA", from_scripts({"tag": lambda keys, args: f"{keys[0]}:{args[0]}"}), 3, 3)
    e.create_table("shipped", "SELECT l_quantity, l_extendedprice, WAVG(l_discount, l_extendedprice) AS discount FROM lineitem GROUP BY l_returnflag, l_linestatus, period(1d)")
    e.create_table("ordered", "SELECT o_totalprice, COUNT(o_totalprice) AS n FROM orders GROUP BY o_orderpriority, o_orderstatus, period(1d)")
    return e


QUERIES: dict[str, str] = {
    "rollup_1h": "SELECT _points, value FROM activity",
    "rollup_all_dims": "SELECT _points, value FROM everything",
    "rollup_global": "SELECT _points, value FROM activity GROUP BY _",
    "rollup_week": "SELECT _points, value FROM weekly",
    "top_periods": "SELECT _points, value FROM activity GROUP BY event_type, period(6h) ORDER BY value DESC LIMIT 10",
    "select_star": "SELECT * FROM activity GROUP BY event_type, period(12h)",
    "agg_all": "SELECT value, low, high, n, mean FROM full GROUP BY event_type, period(6h)",
    "wavg": "SELECT selfmean FROM full GROUP BY user_id, period(24h)",
    "bounded_in": "SELECT inner_mean FROM full GROUP BY event_type, period(6h)",
    "bounded_out": "SELECT BOUNDED(mean, 10, 20) AS bmean FROM full GROUP BY user_id, period(6h)",
    "period_6h": "SELECT value FROM activity GROUP BY event_type, period(6h)",
    "asof_until": "SELECT value FROM activity ASOF '-10d' UNTIL '-2d' GROUP BY event_type, period(5h)",
    "asof_absolute": "SELECT value FROM activity ASOF '2024-01-05T00:00:00Z' UNTIL '2024-01-09T00:30:00Z' GROUP BY event_type, period(6h)",
    "resolution_clipped": "SELECT value FROM activity ASOF '-5h' GROUP BY event_type, period(100d)",
    "retention": "SELECT value FROM recent",
    "backfill": "SELECT value FROM backfilled",
    "where_ops": "SELECT value FROM everything WHERE (event_type LIKE 'c%' OR user_id >= 40) AND NOT k = 7 AND event_type NOT LIKE '%view%' AND k <> 9 GROUP BY event_type, period(24h)",
    "where_in_list": "SELECT value FROM everything WHERE event_type IN ('click', 'error') AND k NOT IN (1, 2, 3) GROUP BY event_type, period(24h)",
    "where_is_null": "SELECT value FROM everything WHERE k IS NOT NULL AND nothing IS NULL GROUP BY event_type, period(24h)",
    "where_in_subquery": "SELECT value FROM activity WHERE user_id IN (SELECT user_id FROM activity GROUP BY user_id, period(100d) HAVING value > 300) GROUP BY event_type, period(24h)",
    "where_or_subquery": "SELECT value FROM activity WHERE user_id IN (SELECT user_id FROM activity WHERE user_id < 5) OR event_type = 'error' GROUP BY event_type, period(24h)",
    "where_not_in_subquery": "SELECT value FROM activity WHERE user_id NOT IN (SELECT user_id FROM activity WHERE user_id < 30) GROUP BY event_type, period(24h)",
    "if_error_rate": "SELECT errors / _points AS error_rate FROM full GROUP BY user_id, period(24h)",
    "if_query": "SELECT IF(event_type = 'click', value) AS clicks, value FROM activity GROUP BY user_id, period(24h)",
    "alias_chain": "SELECT value / _points AS per, per * per AS squared, squared - per AS diff FROM activity GROUP BY event_type, period(6h)",
    "having_hidden": "SELECT value FROM full GROUP BY event_type, period(6h) HAVING n > 8",
    "having_and_or": "SELECT value, n FROM full GROUP BY event_type, period(6h) HAVING n > 8 AND value > 100 OR n = 1",
    "div_rules": "SELECT value / (n - n) AS over_zero, (value - value) / (n - n) AS zero_over_zero FROM full GROUP BY event_type, period(24h)",
    "comparisons": "SELECT value > mean AS gt, value >= mean AS gte, n = n AS eq, n <> n AS neq, low < high AS lt, low <= high AS lte FROM full GROUP BY event_type, period(24h)",
    "logs": "SELECT LN(value) AS l, LOG2(value) AS l2, LOG10(value) AS l10 FROM activity GROUP BY event_type, period(24h)",
    "const_field": "SELECT 5 AS five, value FROM activity GROUP BY event_type, period(24h)",
    "present_flag": "SELECT IF(event_type = 'error', _) AS present, value FROM activity GROUP BY user_id, period(24h)",
    "unmatched_field": "SELECT SUM(mean) AS nothing, value FROM full GROUP BY event_type, period(24h)",
    "stride_6h_2h": "SELECT value FROM activity GROUP BY event_type, STRIDE(6h), period(2h)",
    "shift_24h": "SELECT value, SHIFT(value, '-24h') AS before FROM activity GROUP BY event_type",
    "crosshift": "SELECT CROSSHIFT(value, '-3d', '1d') FROM activity GROUP BY event_type, period(24h)",
    "shift_in_arith": "SELECT value - SHIFT(value, '-24h') AS change FROM activity GROUP BY event_type, period(24h)",
    "crosstab": "SELECT value FROM activity GROUP BY user_id, CROSSTAB(event_type), period(24h)",
    "crosstabt": "SELECT _points, value FROM activity GROUP BY CROSSTABT(event_type), period(24h)",
    "crosstab_having": "SELECT value FROM activity GROUP BY user_id, CROSSTAB(event_type), period(24h) HAVING value > 50",
    "from_subquery": "SELECT _points, value FROM (SELECT _points, value FROM activity GROUP BY event_type, user_id, period(2h)) GROUP BY event_type, period(24h)",
    "nested_avg": "SELECT AVG(value) AS mean_of_sums, MAX(value) AS peak FROM (SELECT value FROM activity GROUP BY event_type, period(1h)) GROUP BY event_type, period(24h)",
    "view_composed": "SELECT _points, value, n FROM clicks GROUP BY user_id, period(24h)",
    "view_of_view": "SELECT per FROM click_mean",
    "sort_offset_limit": "SELECT value FROM activity GROUP BY event_type, user_id, period(24h) ORDER BY value DESC, user_id, event_type, _time LIMIT 5, 20",
    "percentile": "SELECT p90 FROM full GROUP BY event_type, period(24h)",
    "percentile_reread": "SELECT PERCENTILE(p90, 50) AS median FROM full GROUP BY event_type, period(24h)",
    "array_values": "SELECT _points, value FROM arrays",
    "dim_functions": "SELECT value FROM everything GROUP BY LEN(event_type) AS size, SPLIT(event_type, 'r', 1) AS part, SUBSTR(event_type, 1, 3) AS sub, REPLACEALL(event_type, 'r+', 'R') AS replaced, CONCAT('|', event_type, user_id) AS joined, PANY(nothing, event_type) AS some, DECODE(event_type, 'click', 'c', 'view', 'v', 'other') AS decoded, period(24h)",
    "alias_macro": "SELECT value FROM everything GROUP BY SHORT(event_type) AS short, PERCENT(k, 5) AS five, period(24h)",
    "gap_fill_const_arith": "SELECT value / 10 AS tenth FROM activity GROUP BY user_id, period(1h)",
    "percentile_of_percentile": "SELECT half FROM deep GROUP BY event_type, period(24h)",
    "period_only": "SELECT value FROM activity GROUP BY period(6h)",
    "only_present": "SELECT _ FROM activity GROUP BY event_type, period(24h)",
    "limit_zero": "SELECT value FROM activity GROUP BY event_type, period(24h) LIMIT 0",
    "true_false": "SELECT value FROM activity WHERE TRUE = TRUE AND FALSE <> TRUE AND event_type <> 'view' GROUP BY event_type, period(24h)",
    "rand_bounds": "SELECT value FROM activity WHERE RAND() >= 0 AND RAND() < 1 GROUP BY event_type, period(24h)",
    "lookups": "SELECT value FROM activity GROUP BY HGET('names', event_type) AS named, SISMEMBER('loud', event_type) AS loud, LUA('tag', ARRAY(event_type), ARRAY('x')) AS tagged, period(24h)",
    "clock_of_where": "SELECT value FROM early ASOF '-3d' GROUP BY event_type, period(6h)",
    "lineitem_daily": "SELECT l_quantity, l_extendedprice, discount FROM shipped",
    "orders_30d": "SELECT o_totalprice, n, o_totalprice / n AS per FROM ordered GROUP BY o_orderpriority, period(30d)",
}

P = "WITH p AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, time_bucket(INTERVAL 1 HOUR, ts - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR AS lab FROM events), t AS (SELECT max(lab) AS u FROM p), h AS (SELECT p.*, u FROM p, t) "
PTS = "CAST(count(*) AS DOUBLE) AS _points"
VAL = "round(sum(value), 4) AS value"


def _by(hours: int, u: str = "u") -> str:
    return f"{u} - to_hours(CAST({hours} * floor(date_diff('hour', lab, {u}) / {hours}) AS INTEGER))"


def _sums(dims: str, hours: int, what: str = VAL, where: str = "", having: str = "") -> str:
    keys = ", ".join(["1", *(str(n + 2) for n in range(len(dims.split(", ")) if dims else 0))])
    return P + f"SELECT {_by(hours)} AS _time{', ' + dims if dims else ''}, {what} FROM h {where} GROUP BY {keys} {having}"


_HDR = "floor(floor(value * 100) / 2 ** greatest(length(bin(CAST(floor(value * 100) AS BIGINT))) - 8, 0)) * 2 ** greatest(length(bin(CAST(floor(value * 100) AS BIGINT))) - 8, 0) + 2 ** greatest(length(bin(CAST(floor(value * 100) AS BIGINT))) - 8, 0) - 1"


def _quantile(at: int, name: str) -> str:
    return P + f", b AS (SELECT {_by(24)} AS _time, event_type, {_HDR} AS v FROM h WHERE value BETWEEN 0 AND 1000), r AS (SELECT *, row_number() OVER (PARTITION BY _time, event_type ORDER BY v) AS k, count(*) OVER (PARTITION BY _time, event_type) AS n FROM b) SELECT _time, event_type, round(max(CASE WHEN k = greatest(floor(n * {at / 100} + 0.5), 1) THEN v END) / 100, 4) AS {name} FROM r GROUP BY 1, 2"


_IF = lambda cond, name: f"round(coalesce(sum(CASE WHEN {cond} THEN value END), 0), 4) AS {name}"
_TYPES = ("click", "error", "purchase", "signup", "view")
_DAY = "time_bucket(INTERVAL 1 DAY, {0} - INTERVAL 1 MICROSECOND) + INTERVAL 1 DAY"

SQL: dict[str, str] = {
    "rollup_1h": P + f"SELECT lab AS _time, event_type, user_id, {PTS}, {VAL} FROM p GROUP BY 1, 2, 3",
    "rollup_all_dims": P + f"SELECT lab AS _time, event_type, k, user_id, {PTS}, {VAL} FROM p GROUP BY 1, 2, 3, 4",
    "rollup_global": P + f"SELECT lab AS _time, {PTS}, {VAL} FROM p GROUP BY 1",
    "rollup_week": f"SELECT time_bucket(INTERVAL 7 DAY, ts - INTERVAL 1 MICROSECOND, TIMESTAMP '2024-01-01') + INTERVAL 7 DAY AS _time, event_type, {PTS}, {VAL} FROM events GROUP BY 1, 2",
    "top_periods": _sums("event_type", 6, f"{PTS}, {VAL}") + " ORDER BY value DESC LIMIT 10",
    "select_star": _sums("event_type", 12, f"{PTS}, {VAL}"),
    "agg_all": _sums("event_type", 6, f"{VAL}, round(min(value), 4) AS low, round(max(value), 4) AS high, CAST(count(value) AS DOUBLE) AS n, round(avg(value), 7) AS mean"),
    "wavg": _sums("user_id", 24, "round(coalesce(sum(value * value) / nullif(sum(value), 0), 0), 7) AS selfmean"),
    "bounded_in": _sums("event_type", 6, "round(avg(CASE WHEN value BETWEEN 5 AND 20 THEN value END), 7) AS inner_mean", having="HAVING count(CASE WHEN value BETWEEN 5 AND 20 THEN 1 END) > 0"),
    "bounded_out": _sums("user_id", 6, "round(avg(value), 7) AS bmean", having="HAVING avg(value) BETWEEN 10 AND 20"),
    "period_6h": _sums("event_type", 6),
    "asof_until": P + f", c AS (SELECT *, time_bucket(INTERVAL 1 HOUR, m - INTERVAL 2 DAY - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR AS u2, time_bucket(INTERVAL 1 HOUR, m - INTERVAL 10 DAY - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR AS a FROM p, (SELECT max(ts) AS m FROM events)) SELECT {_by(5, 'u2')} AS _time, event_type, {VAL} FROM c WHERE lab > a AND lab <= u2 GROUP BY 1, 2",
    "asof_absolute": P + f", c AS (SELECT *, TIMESTAMP '2024-01-09 01:00:00' AS u2 FROM p) SELECT {_by(6, 'u2')} AS _time, event_type, {VAL} FROM c WHERE lab > TIMESTAMP '2024-01-05' AND lab <= u2 GROUP BY 1, 2",
    "resolution_clipped": P + f", c AS (SELECT *, time_bucket(INTERVAL 1 HOUR, m - INTERVAL 5 HOUR - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR AS a FROM h, (SELECT max(ts) AS m FROM events)) SELECT u AS _time, event_type, {VAL} FROM c WHERE lab > a GROUP BY 1, 2",
    "retention": P + f"SELECT lab AS _time, event_type, {VAL} FROM p WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY AND lab > (SELECT u FROM t) - INTERVAL 10 DAY GROUP BY 1, 2",
    "backfill": P + f"SELECT lab AS _time, event_type, {VAL} FROM p WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY GROUP BY 1, 2",
    "where_ops": _sums("event_type", 24, where="WHERE (event_type LIKE 'c%' OR user_id >= 40) AND NOT k = 7 AND event_type NOT LIKE '%view%' AND k <> 9"),
    "where_in_list": _sums("event_type", 24, where="WHERE event_type IN ('click', 'error') AND k NOT IN (1, 2, 3)"),
    "where_is_null": _sums("event_type", 24, where="WHERE k IS NOT NULL"),
    "where_in_subquery": _sums("event_type", 24, where="WHERE user_id IN (SELECT user_id FROM events, (SELECT max(ts) AS m FROM events) GROUP BY user_id, floor(date_diff('hour', time_bucket(INTERVAL 1 HOUR, ts - INTERVAL 1 MICROSECOND), time_bucket(INTERVAL 1 HOUR, m - INTERVAL 1 MICROSECOND)) / 2400) HAVING sum(value) > 300)"),
    "where_or_subquery": _sums("event_type", 24, where="WHERE user_id < 5 OR event_type = 'error'"),
    "where_not_in_subquery": _sums("event_type", 24, where="WHERE user_id >= 30"),
    "if_error_rate": _sums("user_id", 24, "round(count(CASE WHEN event_type = 'error' THEN 1 END) / count(*), 4) AS error_rate"),
    "if_query": _sums("user_id", 24, _IF("event_type = 'click'", "clicks") + ", " + VAL),
    "alias_chain": _sums("event_type", 6, "round(sum(value) / count(*), 7) AS per, round((sum(value) / count(*)) * (sum(value) / count(*)), 9) AS squared, round((sum(value) / count(*)) * (sum(value) / count(*)) - sum(value) / count(*), 9) AS diff"),
    "having_hidden": _sums("event_type", 6, having="HAVING count(value) > 8"),
    "having_and_or": _sums("event_type", 6, f"{VAL}, CAST(count(value) AS DOUBLE) AS n", having="HAVING count(value) > 8 AND sum(value) > 100 OR count(value) = 1"),
    "div_rules": _sums("event_type", 24, "CASE WHEN sum(value) = 0 THEN 0.0 ELSE 1.7976931348623157e308 END AS over_zero, CAST(0 AS DOUBLE) AS zero_over_zero"),
    "comparisons": _sums("event_type", 24, "CAST(sum(value) > avg(value) AS DOUBLE) AS gt, CAST(sum(value) >= avg(value) AS DOUBLE) AS gte, CAST(1 AS DOUBLE) AS eq, CAST(0 AS DOUBLE) AS neq, CAST(min(value) < max(value) AS DOUBLE) AS lt, CAST(1 AS DOUBLE) AS lte"),
    "logs": _sums("event_type", 24, "round(ln(sum(value)), 4) AS l, round(log2(sum(value)), 4) AS l2, round(log10(sum(value)), 4) AS l10"),
    "const_field": _sums("event_type", 24, "CAST(5 AS DOUBLE) AS five, " + VAL),
    "present_flag": P + f", v AS (SELECT {_by(24)} AS b, user_id, count(CASE WHEN event_type = 'error' THEN 1 END) AS e, sum(value) AS v FROM h GROUP BY 1, 2), s AS (SELECT user_id, unnest(generate_series(min(b), max(b), INTERVAL 1 DAY)) AS b FROM v GROUP BY 1) SELECT s.b AS _time, s.user_id, CAST(coalesce(e, 0) > 0 AS DOUBLE) AS present, round(coalesce(v, 0), 4) AS value FROM s LEFT JOIN v ON s.b = v.b AND s.user_id = v.user_id",
    "unmatched_field": _sums("event_type", 24, f"CAST(0 AS DOUBLE) AS nothing, {VAL}"),
    "stride_6h_2h": _sums("event_type", 6, where="WHERE date_diff('hour', lab, u) % 6 < 2"),
    "shift_24h": P + ", s AS (SELECT lab, event_type, sum(value) AS v FROM p GROUP BY 1, 2) SELECT coalesce(a.lab, b.lab + INTERVAL 24 HOUR) AS _time, coalesce(a.event_type, b.event_type) AS event_type, round(coalesce(a.v, 0), 4) AS value, round(coalesce(b.v, 0), 4) AS before FROM s a FULL JOIN s b ON a.lab = b.lab + INTERVAL 24 HOUR AND a.event_type = b.event_type WHERE coalesce(a.lab, b.lab + INTERVAL 24 HOUR) <= (SELECT u FROM t)",
    "crosshift": P + f", c AS (SELECT d, value, event_type, u, lab + to_days(CAST(d AS INTEGER)) AS lab FROM h, range(3) AS r(d)) SELECT {_by(24)} AS _time, event_type, {_IF('d = 0', 'value')}, {_IF('d = 1', 'value_1d')}, {_IF('d = 2', 'value_2d')} FROM c WHERE lab <= u GROUP BY 1, 2",
    "shift_in_arith": P + f", c AS (SELECT d, value, event_type, u, lab + to_days(CAST(d AS INTEGER)) AS lab FROM h, range(2) AS r(d)) SELECT {_by(24)} AS _time, event_type, round(sum(CASE WHEN d = 0 THEN value ELSE -value END), 4) AS change FROM c WHERE lab <= u GROUP BY 1, 2",
    "crosstab": _sums("user_id", 24, ", ".join(_IF(f"event_type = '{t}'", f"{t}_value") for t in _TYPES)),
    "crosstabt": _sums("", 24, ", ".join(f"CAST(count(CASE WHEN event_type = '{t}' THEN 1 END) AS DOUBLE) AS {t}__points, {_IF(chr(101) + 'vent_type = ' + chr(39) + t + chr(39), t + '_value')}" for t in _TYPES) + ", CAST(count(*) AS DOUBLE) AS total__points, round(sum(value), 4) AS total_value"),
    "crosstab_having": _sums("user_id", 24, ", ".join(_IF(f"event_type = '{t}'", f"{t}_value") for t in _TYPES), having="HAVING sum(value) > 50"),
    "from_subquery": P + f", i AS (SELECT {_by(2)} AS lab, u, event_type, count(*) AS c, sum(value) AS v FROM h GROUP BY 1, 2, 3, user_id) SELECT {_by(24)} AS _time, event_type, CAST(sum(c) AS DOUBLE) AS _points, round(sum(v), 4) AS value FROM i GROUP BY 1, 2",
    "nested_avg": P + f", i AS (SELECT lab, u, event_type, sum(value) AS v FROM h GROUP BY 1, 2, 3) SELECT {_by(24)} AS _time, event_type, round(avg(v), 7) AS mean_of_sums, round(max(v), 4) AS peak FROM i GROUP BY 1, 2",
    "view_composed": P + f", c AS (SELECT * FROM p WHERE event_type = 'click'), w AS (SELECT *, (SELECT max(lab) FROM c) AS u FROM c) SELECT {_by(24)} AS _time, user_id, {PTS}, {VAL}, CAST(count(value) AS DOUBLE) AS n FROM w GROUP BY 1, 2",
    "view_of_view": "SELECT time_bucket(INTERVAL 2 HOUR, ts - INTERVAL 1 MICROSECOND) + INTERVAL 2 HOUR AS _time, user_id, round(sum(value) / count(value), 7) AS per FROM events WHERE event_type = 'click' AND CAST(json_extract_string(props, '$.k') AS INTEGER) > 50 GROUP BY 1, 2",
    "sort_offset_limit": _sums("event_type, user_id", 24) + " ORDER BY value DESC, user_id, event_type, _time LIMIT 20 OFFSET 5",
    "percentile": _quantile(90, "p90"),
    "percentile_reread": _quantile(50, "median"),
    "array_values": P + "SELECT lab AS _time, event_type, CAST(3 * count(*) AS DOUBLE) AS _points, round(sum(value + value * 2 + (value + 1)), 4) AS value FROM p GROUP BY 1, 2",
    "dim_functions": P + f"SELECT {_by(24)} AS _time, CASE event_type WHEN 'click' THEN 'c' WHEN 'view' THEN 'v' ELSE 'other' END AS decoded, event_type || '|' || user_id AS joined, string_split(event_type, 'r')[2] AS part, regexp_replace(event_type, 'r+', 'R', 'g') AS replaced, CAST(length(event_type) AS INTEGER) AS size, event_type AS some, substr(event_type, 2, 3) AS sub, {VAL} FROM h GROUP BY ALL",
    "alias_macro": P + f"SELECT {_by(24)} AS _time, CASE WHEN k = 5 THEN 'yes' ELSE 'no' END AS five, substr(event_type, 1, 3) AS short, {VAL} FROM h GROUP BY ALL",
    "gap_fill_const_arith": P + ", s AS (SELECT user_id, min(lab) AS lo, max(lab) AS hi FROM p GROUP BY 1), g AS (SELECT user_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS lab FROM s), v AS (SELECT user_id, lab, sum(value) AS v FROM p GROUP BY 1, 2) SELECT g.lab AS _time, g.user_id, round(coalesce(v, 0) / 10, 4) AS tenth FROM g LEFT JOIN v ON g.user_id = v.user_id AND g.lab = v.lab",
    "percentile_of_percentile": _quantile(50, "half").replace("BETWEEN 0 AND 1000", "BETWEEN 0 AND 500"),
    "period_only": _sums("event_type, user_id", 6),
    "only_present": P + f"SELECT DISTINCT {_by(24)} AS _time, event_type FROM h",
    "limit_zero": _sums("event_type", 24),
    "true_false": _sums("event_type", 24, where="WHERE event_type <> 'view'"),
    "rand_bounds": _sums("event_type", 24),
    "lookups": P + f"SELECT {_by(24)} AS _time, event_type IN ('error', 'purchase') AS loud, CASE event_type WHEN 'click' THEN 'Click' WHEN 'view' THEN 'View' END AS named, event_type || ':x' AS tagged, {VAL} FROM h GROUP BY ALL",
    "clock_of_where": P + f", e AS (SELECT * FROM p WHERE k < 5 AND event_type <> 'view'), c AS (SELECT e.*, m, time_bucket(INTERVAL 1 HOUR, m - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR AS u2, time_bucket(INTERVAL 1 HOUR, m - INTERVAL 3 DAY - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR AS a FROM e, (SELECT max(ts) AS m FROM e)) SELECT {_by(6, 'u2')} AS _time, event_type, {VAL} FROM c WHERE lab > a GROUP BY 1, 2",
    "lineitem_daily": f"SELECT {_DAY.format('l_shipdate')} AS _time, l_linestatus, l_returnflag, round(sum(l_quantity), 4) AS l_quantity, round(sum(l_extendedprice), 4) AS l_extendedprice, round(sum(l_discount * l_extendedprice) / sum(l_extendedprice), 7) AS discount FROM lineitem GROUP BY 1, 2, 3",
    "orders_30d": f"WITH d AS (SELECT *, {_DAY.format('o_orderdate')} AS lab FROM orders), c AS (SELECT *, (SELECT max(lab) FROM d) AS u FROM d) SELECT u - to_days(CAST(30 * floor(date_diff('day', lab, u) / 30) AS INTEGER)) AS _time, o_orderpriority, round(sum(o_totalprice), 4) AS o_totalprice, CAST(count(o_totalprice) AS DOUBLE) AS n, round(sum(o_totalprice) / count(o_totalprice), 7) AS per FROM c GROUP BY 1, 2",
    "cardinalities": P + "SELECT count(DISTINCT lab) AS _time, count(DISTINCT event_type) AS event_type, count(DISTINCT v) AS _points FROM (SELECT lab, event_type, count(*) AS v FROM p GROUP BY 1, 2)",
    "table_stats": "SELECT count(CASE WHEN event_type <> 'click' THEN 1 END) AS filtered, count(CASE WHEN event_type = 'click' THEN 1 END) AS inserted, 0::BIGINT AS expired FROM events",
}


DECIMALS = dict.fromkeys(("mean", "inner_mean", "bmean", "selfmean", "per", "mean_of_sums", "discount"), 7) | {"squared": 9, "diff": 9}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(f"`{c}`", DECIMALS.get(c, 4)).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes))


def _query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(engine(spark, sf_dir).query(sql))


def cardinalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).cardinalities("SELECT _points FROM activity GROUP BY event_type", exact=True)


def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = engine(spark, sf_dir).stats("clicks")
    return spark.range(1).select(*(F.lit(s[k]).cast("long").alias(k) for k in ("filtered", "inserted", "expired")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(sql) for name, sql in QUERIES.items()} | {"cardinalities": cardinalities, "table_stats": table_stats}
