"""Gap filling and resampling (W) and model combination (J, S, U, O) on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from isobarn.operators import combine as C
from isobarn.operators import fill, resample
from isobarn.plans import tables as T
from isobarn.sources import storage as S

LOC = ["location_id"]
KEY = ["location_id", "variable"]


def fill_linear(spark, sf_dir):
    return T.tidy(fill.fill_linear(T.regular(spark, sf_dir), LOC))


def fill_degrees(spark, sf_dir):
    return T.tidy(fill.fill_degrees(T.regular(spark, sf_dir).withColumn("value", F.col("value") * 7.3 % 360), LOC))


def fill_backwards(spark, sf_dir):
    return T.tidy(fill.fill_backwards(T.regular(spark, sf_dir), False, LOC))


def fill_backwards_sum(spark, sf_dir):
    return T.tidy(fill.fill_backwards(T.regular(spark, sf_dir), True, LOC))


def fill_hermite(spark, sf_dir):
    return T.tidy(fill.fill_hermite(T.regular(spark, sf_dir), (0.0, 500.0), LOC))


def upsample_linear(spark, sf_dir):
    return T.tidy(resample.upsample_linear(T.regular(spark, sf_dir), 3600, 900, None, LOC))


def upsample_degrees(spark, sf_dir):
    return T.tidy(resample.upsample_degrees(T.regular(spark, sf_dir).withColumn("value", F.col("value") * 7.3 % 360), 3600, 1800, None, LOC))


def upsample_hermite(spark, sf_dir):
    return T.tidy(resample.upsample_hermite(T.regular(spark, sf_dir), 3600, 1200, (0.0, 60.0), None, LOC))


def upsample_backwards(spark, sf_dir):
    return T.tidy(resample.upsample_backwards(T.regular(spark, sf_dir), 3600, 1800))


def upsample_backwards_sum(spark, sf_dir):
    return T.tidy(resample.upsample_backwards(T.regular(spark, sf_dir), 3600, 1200, summation=True))


def downsample_mean(spark, sf_dir):
    filled = fill.fill_linear(T.regular(spark, sf_dir), LOC)
    return T.tidy(resample.downsample(filled, 3600, 10800, "mean", LOC))


def downsample_sum(spark, sf_dir):
    filled = fill.fill_linear(T.regular(spark, sf_dir), LOC)
    return T.tidy(resample.downsample(filled, 3600, 21600, "sum", LOC))


def downsample_instant(spark, sf_dir):
    return T.tidy(resample.downsample(T.regular(spark, sf_dir), 3600, 10800))


def deaccumulate(spark, sf_dir):
    return T.tidy(resample.deaccumulate(T.regular(spark, sf_dir), LOC))


def deaverage(spark, sf_dir):
    return T.tidy(resample.deaverage(T.regular(spark, sf_dir), LOC), 4)


def deaccumulate_sections(spark, sf_dir):
    lines = T.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    total = F.sum("q").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    steps = lines.select(F.col("l_orderkey").alias("run"), F.lit(0).alias("step_start"), F.col("l_linenumber").alias("step_end"), F.when(F.col("l_orderkey") % 2 == 0, "accum").otherwise("avg").alias("step_type"), total.alias("value"))
    return T.tidy(resample.deaccumulate_sections(steps, ["run"]))


def sliding_mean(spark, sf_dir):
    filled = fill.fill_linear(T.regular(spark, sf_dir), LOC)
    return T.tidy(resample.sliding_mean(filled, 8, True, LOC))


def trailing_mean(spark, sf_dir):
    return T.tidy(resample.trailing_mean(T.daily_long(spark, sf_dir), 3, LOC, "date"))


def shift_24h(spark, sf_dir):
    return T.tidy(resample.shift(T.regular(spark, sf_dir), 24, LOC))


def blended_models(spark, sf_dir):
    return T.tidy(C.fill_from_lower_priority(T.model(spark, sf_dir, True), T.model(spark, sf_dir, False), True, KEY))


def cut_models(spark, sf_dir):
    return T.tidy(C.fill_from_lower_priority(T.model(spark, sf_dir, True), T.model(spark, sf_dir, False), False, KEY))


def seamless_models(spark, sf_dir):
    return T.tidy(C.seamless([T.model(spark, sf_dir, True), T.model(spark, sf_dir, False)], False, KEY))


def priority_layers(spark, sf_dir):
    return T.tidy(C.read_priority_layers([T.model(spark, sf_dir, True), T.model(spark, sf_dir, False)], KEY))


def ranked_models(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select(F.col("user_id").alias("location_id"), F.date_trunc("day", "ts").alias("valid_time"), F.col("event_id").alias("rank"), "value")
    return T.tidy(C.rank_models(e, "rank", ["location_id", "valid_time"]))


def as_of_run(spark, sf_dir):
    return T.tidy(C.as_of_run(T.runs(spark, sf_dir), "timestamp'2024-01-20 00:00:00'", KEY))


def latest_run(spark, sf_dir):
    return C.latest_run(T.runs(spark, sf_dir), ["domain", "variable"])


def latest_by_lead(spark, sf_dir):
    return T.tidy(C.latest_by_lead(T.runs(spark, sf_dir), KEY).drop("domain"))


def paired_variables(spark, sf_dir):
    return T.tidy(C.pair_variables(T.hourly(spark, sf_dir), ["view", "click"], KEY))


def compared_models(spark, sf_dir):
    on = [*KEY, "valid_time"]
    return T.tidy(C.compare_models(T.model(spark, sf_dir, True), T.model(spark, sf_dir, False), on, ["variable"]))


def current_values(spark, sf_dir):
    return T.tidy(C.current_values(T.hourly(spark, sf_dir), F.lit("2024-01-15 12:40:00").cast("timestamp"), 900, KEY))


def interpolated_level(spark, sf_dir):
    h = T.hourly(spark, sf_dir).withColumn("level", F.when(F.col("variable") == "view", 850.0).when(F.col("variable") == "click", 925.0).when(F.col("variable") == "error", 900.0)).where("level IS NOT NULL").drop("variable")
    return T.tidy(C.interpolate_levels(h, 900.0, 850.0, 925.0, "linear", LOC))


def merged_sections(spark, sf_dir):
    h = T.hourly(spark, sf_dir)
    day = lambda v: h.where(F.col("variable") == v).groupBy(F.date_trunc("day", "valid_time").alias("valid_time")).agg(F.avg("value").alias("value"))
    return T.tidy(C.merge_sections({"view": day("view"), "click": day("click")}, ["valid_time"]))


def stacked_models(spark, sf_dir):
    return T.tidy(C.stack_models({"high": T.model(spark, sf_dir, True), "low": T.model(spark, sf_dir, False)}))


def unique_valid_times(spark, sf_dir):
    return C.unique_valid_times(T.hourly(spark, sf_dir))


def common_coverage(spark, sf_dir):
    return C.common_coverage([T.model(spark, sf_dir, True), T.model(spark, sf_dir, False)], [*KEY, "valid_time"])


def changed_rows(spark, sf_dir):
    keys = [*KEY, "valid_time"]
    return C.changed_rows(T.model(spark, sf_dir, False).select(*keys), T.model(spark, sf_dir, True).select(*keys))


def merged_series(spark, sf_dir):
    new = T.model(spark, sf_dir, True).withColumn("value", F.when(F.col("location_id") % 2 == 0, F.col("value") * 2))
    return T.tidy(S.merge_series(T.model(spark, sf_dir, False), new, KEY))


def merged_rolling(spark, sf_dir):
    run = F.lit("2024-01-20 06:00:00").cast("timestamp")
    return T.tidy(S.merge_rolling(T.model(spark, sf_dir, False), T.model(spark, sf_dir, True), run, 5, KEY))


def merged_previous_days(spark, sf_dir):
    """Runs of even days are stored by lead day; those of odd days are merged into them, of several the newest."""
    runs = T.runs(spark, sf_dir)
    newest = lambda df: df.groupBy(*KEY, "lead_day", "valid_time").agg(F.max_by("value", "run_time").alias("value"))
    even = F.datediff("run_time", F.lit("2024-01-01")) % 2 == 0
    stored, new = newest(S.by_lead_day(runs.where(even))), newest(S.by_lead_day(runs.where(~even)))
    return T.tidy(S.merge_series(stored, new, [*KEY, "lead_day"]))


def run_metadata(spark, sf_dir):
    found = S.build_run_metadata(T.runs(spark, sf_dir))
    return T.tidy(found.withColumn("variables", F.array_join("variables", ",")))


def scan_health(spark, sf_dir):
    return T.tidy(S.scan_health(T.hourly(spark, sf_dir).drop("location_id").groupBy("variable", "valid_time").agg(F.avg("value").alias("value"))))


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__}

_r = T.r
_NB = """nb AS (SELECT *, row_number() OVER w - 1 AS i, last_value(value IGNORE NULLS) OVER p AS v0, first_value(value IGNORE NULLS) OVER n AS v1 FROM {src}
  WINDOW w AS (PARTITION BY location_id ORDER BY valid_time), p AS (PARTITION BY location_id ORDER BY valid_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  n AS (PARTITION BY location_id ORDER BY valid_time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
nx AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN i END) OVER (PARTITION BY location_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS i0,
  min(CASE WHEN value IS NOT NULL THEN i END) OVER (PARTITION BY location_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS i1 FROM nb)"""
_FILL = f"{T.REGULAR}, {_NB.format(src='regular')}"
_DEG = f"{T.REGULAR}, deg AS (SELECT location_id, valid_time, value * 7.3 % 360 AS value FROM regular), {_NB.format(src='deg')}"
_F = "((i - i0) / (i1 - i0))"
_LINEAR = f"{_FILL}, lin AS (SELECT location_id, valid_time, coalesce(value, v1 * {_F} + v0 * (1 - {_F})) AS value FROM nx)"
# neighbours by number among the valid rows
_RUNNING = f"""{T.REGULAR}, r0 AS MATERIALIZED (SELECT *, row_number() OVER w - 1 AS i, count(value) OVER w AS k FROM regular WINDOW w AS (PARTITION BY location_id ORDER BY valid_time ROWS UNBOUNDED PRECEDING)),
vd AS MATERIALIZED (SELECT location_id, k, i AS pos, value AS v FROM r0 WHERE value IS NOT NULL),
nx AS (SELECT r0.*, n.v AS v1, n.pos AS i1, p.pos AS i0 FROM r0 LEFT JOIN vd n ON n.location_id = r0.location_id AND n.k = r0.k + CASE WHEN value IS NULL THEN 1 ELSE 0 END
  LEFT JOIN vd p ON p.location_id = r0.location_id AND p.k = r0.k - CASE WHEN value IS NULL THEN 0 ELSE 1 END)"""
_BACK = """st AS (SELECT location_id, min(i) AS p1, min(CASE WHEN k = 2 THEN i END) AS p2 FROM (SELECT location_id, i, row_number() OVER (PARTITION BY location_id ORDER BY i) AS k FROM nx WHERE value IS NOT NULL) GROUP BY location_id),
bk AS (SELECT nx.*, CASE WHEN p2 IS NULL THEN p1 ELSE greatest(p1 - (p2 - p1 - 1), 0) END AS fi FROM nx LEFT JOIN st USING (location_id))"""
def _cubic(a: str, b: str, c: str, d: str, f: str) -> str:
    return f"least(greatest({b} + {f} * (({c} - {a}) / 2 + {f} * ({a} - 2.5 * {b} + 2 * {c} - {d} / 2 + {f} * (({d} - {a}) / 2 + 1.5 * ({b} - {c})))), 0), 500)"


_UP = "up AS (SELECT location_id, valid_time, value, {cols}, unnest(range({n})) AS j FROM {src})"
_CUBIC = "(b + f * ((c - a) / 2 + f * (a - 2.5 * b + 2 * c - d / 2 + f * ((d - a) / 2 + 1.5 * (b - c)))))"
_LIN_UP = "CASE WHEN row_number() OVER w = count(*) OVER (PARTITION BY location_id) THEN value ELSE lead(value) OVER w END"
_W = "WINDOW w AS (PARTITION BY location_id ORDER BY valid_time)"
ORACLE = {
    "fill_linear": f"WITH {_LINEAR} SELECT location_id, valid_time, {_r('value')} AS value FROM lin",
    "fill_degrees": f"""WITH {_DEG}, a AS (SELECT *, CASE WHEN abs(v0 - v1) > 180 AND v1 < v0 THEN v1 + 360 ELSE v1 END AS a2, CASE WHEN abs(v0 - v1) > 180 AND v1 > v0 THEN v0 + 360 ELSE v0 END AS b2 FROM nx)
      SELECT location_id, valid_time, {_r(f'coalesce(value, (a2 * {_F} + b2 * (1 - {_F})) % 360)')} AS value FROM a""",
    "fill_backwards": f"WITH {_RUNNING}, {_BACK} SELECT location_id, valid_time, {_r('CASE WHEN i >= fi THEN coalesce(v1, value) ELSE value END')} AS value FROM bk",
    "fill_backwards_sum": f"WITH {_RUNNING}, {_BACK} SELECT location_id, valid_time, {_r('CASE WHEN i >= fi THEN coalesce(v1 / (i1 - coalesce(i0, fi - 1)), value) ELSE value END')} AS value FROM bk",
    "fill_hermite": f"""WITH RECURSIVE {_RUNNING}, vp AS (SELECT location_id, pos AS i, v, lead(pos) OVER w AS ni, lead(v) OVER w AS nv, lag(pos) OVER w AS pi, lag(v, 2) OVER w AS ppv FROM vd WINDOW w AS (PARTITION BY location_id ORDER BY pos)),
      gp AS (SELECT *, coalesce(ni - i, lag(ni - i) OVER w, 0) AS w FROM vp WHERE i - coalesce(pi, -1) > 1 WINDOW w AS (PARTITION BY location_id ORDER BY i)),
      g AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY i) AS n FROM gp WHERE pi IS NOT NULL),
      h AS (SELECT location_id, 0::BIGINT AS n, list(value ORDER BY i) AS a FROM r0 GROUP BY location_id UNION ALL
        SELECT location_id, n, a[1:pi + 1] || list_transform(range(pi + 1, i), lambda t: {_cubic('aa', 'bb', 'v', 'coalesce(nv, v)', '((t - spot) / (i - spot))')}) || a[i + 1:] FROM (
          SELECT *, CASE WHEN far THEN pi ELSE bi END AS spot, CASE WHEN far THEN a[pi + 1] ELSE a[bi + 1] END AS bb, CASE WHEN far THEN coalesce(ppv, a[pi + 1]) ELSE coalesce(a[CASE WHEN bi >= w THEN bi - w ELSE bi END + 1], a[bi + 1]) END AS aa FROM (
            SELECT h.location_id, h.n + 1 AS n, h.a, g.i, g.pi, g.v, g.nv, g.ppv, g.w, greatest(g.i - g.w, 0) AS bi, g.w = 0 OR h.a[greatest(g.i - g.w, 0) + 1] IS NULL AS far FROM h JOIN g ON g.location_id = h.location_id AND g.n = h.n + 1))),
      l AS (SELECT location_id, arg_max(a, n) AS a FROM h GROUP BY location_id)
      SELECT r0.location_id, r0.valid_time, {_r('l.a[r0.i + 1]')} AS value FROM r0 JOIN l USING (location_id)""",
    "upsample_linear": f"""WITH {T.REGULAR}, s AS (SELECT *, {_LIN_UP} AS b FROM regular {_W}), {_UP.format(cols='b', n=4, src='s')}
      SELECT location_id, valid_time + to_minutes(CAST(j * 15 AS INTEGER)) AS valid_time, {_r('value * (1 - j / 4) + b * (j / 4)')} AS value FROM up""",
    "upsample_degrees": f"""WITH {_DEG}, s AS (SELECT location_id, valid_time, value, {_LIN_UP} AS b FROM deg {_W}), {_UP.format(cols='b', n=2, src='s')},
      c AS (SELECT *, CASE WHEN abs(b - value) > 180 AND value < b THEN value + 360 ELSE value END AS a2, CASE WHEN abs(b - value) > 180 AND value > b THEN b + 360 ELSE b END AS b2 FROM up)
      SELECT location_id, valid_time + to_minutes(CAST(j * 30 AS INTEGER)) AS valid_time, {_r('(a2 * (1 - j / 2) + b2 * (j / 2)) % 360')} AS value FROM c""",
    "upsample_hermite": f"""WITH {T.REGULAR}, s AS (SELECT *, value AS b, coalesce(lag(value) OVER w, value) AS a, coalesce(lead(value) OVER w, value) AS c,
        CASE WHEN row_number() OVER w > count(*) OVER (PARTITION BY location_id) - 2 THEN coalesce(lead(value) OVER w, value) ELSE coalesce(lead(value, 2) OVER w, value) END AS d FROM regular {_W}),
      {_UP.format(cols='a, b, c, d', n=3, src='s')}, u AS (SELECT *, j / 3 AS f FROM up)
      SELECT location_id, valid_time + to_minutes(CAST(j * 20 AS INTEGER)) AS valid_time, CASE WHEN {_CUBIC} IS NOT NULL THEN {_r(f'least(greatest({_CUBIC}, 0), 60)')} END AS value FROM u""",
    "upsample_backwards": f"WITH {T.REGULAR}, {_UP.format(cols='1 AS o', n=2, src='regular')} SELECT location_id, valid_time - to_minutes(CAST(j * 30 AS INTEGER)) AS valid_time, {_r('value')} AS value FROM up",
    "upsample_backwards_sum": f"WITH {T.REGULAR}, {_UP.format(cols='1 AS o', n=3, src='regular')} SELECT location_id, valid_time - to_minutes(CAST(j * 20 AS INTEGER)) AS valid_time, {_r('value / 3')} AS value FROM up",
    "downsample_mean": f"""WITH {_LINEAR}, g AS (SELECT location_id, to_timestamp(CAST(ceil(epoch(valid_time) / 10800.0) AS BIGINT) * 10800)::TIMESTAMP AS valid_time, avg(value) AS v, count(value) AS n FROM lin GROUP BY ALL)
      SELECT location_id, valid_time, CASE WHEN n = 3 THEN {_r('v')} END AS value FROM g""",
    "downsample_sum": f"""WITH {_LINEAR}, g AS (SELECT location_id, to_timestamp(CAST(ceil(epoch(valid_time) / 21600.0) AS BIGINT) * 21600)::TIMESTAMP AS valid_time, sum(value) AS v, count(value) AS n FROM lin GROUP BY ALL)
      SELECT location_id, valid_time, CASE WHEN n = 6 THEN {_r('v')} END AS value FROM g""",
    "downsample_instant": f"WITH {T.REGULAR} SELECT location_id, valid_time, {_r('value')} AS value FROM regular WHERE epoch(valid_time) % 10800 = 0",
    "deaccumulate": f"WITH {_FILL} SELECT location_id, valid_time, {_r('CASE WHEN v0 IS NULL THEN value ELSE (value - v0) / (i - i0) END')} AS value FROM nx",
    "deaverage": f"""WITH {_FILL}, s AS (SELECT *, min(CASE WHEN value IS NOT NULL THEN i END) OVER (PARTITION BY location_id) AS s FROM nx)
      SELECT location_id, valid_time, {_r('CASE WHEN v0 IS NULL THEN value ELSE (value * (i - s + 1) - v0 * (i0 - s + 1)) / (i - i0) END', 4)} AS value FROM s""",
    "deaccumulate_sections": f"""WITH q AS (SELECT l_orderkey AS run, l_linenumber AS e, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), t AS (SELECT run, e, sum(q) OVER (PARTITION BY run ORDER BY e) AS v FROM q),
      p AS (SELECT *, lag(v) OVER w AS v0, lag(e) OVER w AS e0 FROM t WINDOW w AS (PARTITION BY run ORDER BY e))
      SELECT run, e AS step_end, CASE WHEN run % 2 = 0 THEN 'accum' ELSE 'avg' END AS step_type, coalesce(e0, 0) AS step_start,
      {_r('CASE WHEN v0 IS NULL THEN v WHEN run % 2 = 0 THEN v - v0 ELSE (v * e - v0 * e0) / (e - e0) END')} AS value FROM p""",
    "sliding_mean": f"""WITH {_LINEAR}, s AS (SELECT location_id, valid_time, row_number() OVER (PARTITION BY location_id ORDER BY valid_time) AS k, avg(value) OVER f AS m, count(value) OVER f AS n FROM lin
      WINDOW f AS (PARTITION BY location_id ORDER BY valid_time ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)) SELECT location_id, valid_time, CASE WHEN n = 8 THEN {_r('m')} END AS value FROM s WHERE k > 8""",
    "trailing_mean": f"WITH {T.DAILY} SELECT location_id, date, {_r('avg(value) OVER (PARTITION BY location_id ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)')} AS value FROM daily_long",
    "shift_24h": f"WITH {T.REGULAR} SELECT location_id, valid_time, {_r('lead(value, 24) OVER (PARTITION BY location_id ORDER BY valid_time)')} AS value FROM regular",
    "blended_models": f"""WITH {T.MODELS}, j AS (SELECT location_id, variable, valid_time, high.value AS h, low.value AS l FROM high FULL OUTER JOIN low USING (location_id, variable, valid_time)),
      i AS (SELECT *, row_number() OVER (PARTITION BY location_id, variable ORDER BY valid_time) AS i FROM j),
      d AS (SELECT *, min(CASE WHEN h IS NULL AND l IS NOT NULL THEN i END) OVER (PARTITION BY location_id, variable ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) - i AS d FROM i)
      SELECT location_id, variable, valid_time, {_r('CASE WHEN h IS NOT NULL AND l IS NOT NULL AND d IS NOT NULL THEN l * (4 - d) / 4 + h * d / 4 ELSE coalesce(h, l) END')} AS value FROM d""",
    "cut_models": f"WITH {T.MODELS} SELECT location_id, variable, valid_time, {_r('coalesce(high.value, low.value)')} AS value FROM high FULL OUTER JOIN low USING (location_id, variable, valid_time)",
    "seamless_models": f"WITH {T.MODELS} SELECT location_id, variable, valid_time, {_r('coalesce(high.value, low.value)')} AS value FROM high FULL OUTER JOIN low USING (location_id, variable, valid_time)",
    "priority_layers": f"WITH {T.MODELS} SELECT location_id, variable, valid_time, {_r('CASE WHEN high.value IS NOT NULL THEN high.value ELSE low.value END')} AS value FROM high FULL OUTER JOIN low USING (location_id, variable, valid_time)",
    "ranked_models": f"SELECT user_id AS location_id, date_trunc('day', ts)::TIMESTAMP AS valid_time, {_r('arg_min(value, event_id)')} AS value, min(event_id) AS rank FROM events GROUP BY ALL",
    "as_of_run": f"WITH {T.RUNS} SELECT location_id, variable, valid_time, {_r('arg_max(value, run_time)')} AS value, max(run_time)::TIMESTAMP AS run_time FROM runs WHERE run_time <= TIMESTAMP '2024-01-20' GROUP BY ALL",
    "latest_run": f"WITH {T.RUNS} SELECT domain, variable, max(run_time)::TIMESTAMP AS run_time FROM runs GROUP BY ALL",
    "latest_by_lead": f"WITH {T.RUNS} SELECT location_id, variable, valid_time, max(run_time)::TIMESTAMP AS run_time, {_r('arg_max(value, run_time)')} AS value FROM runs GROUP BY ALL",
    "paired_variables": f"WITH {T.HOURLY} SELECT location_id, valid_time, {_r('''max(value) FILTER (variable = 'view')''')} AS view, {_r('''max(value) FILTER (variable = 'click')''')} AS click FROM hourly WHERE variable IN ('view', 'click') GROUP BY ALL",
    "compared_models": f"""WITH {T.MODELS} SELECT variable, {_r('avg(h.value - l.value)')} AS mean_error, {_r('sqrt(avg((h.value - l.value) ** 2))')} AS rmse, {_r('sqrt(avg(abs(h.value - l.value)))')} AS sqrt_mae, count(*) AS n
      FROM high h JOIN low l USING (location_id, variable, valid_time) GROUP BY ALL""",
    "current_values": f"WITH {T.HOURLY} SELECT location_id, variable, {_r('arg_max(value, valid_time)')} AS value, max(valid_time)::TIMESTAMP AS valid_time FROM hourly WHERE valid_time <= TIMESTAMP '2024-01-15 12:30:00' GROUP BY ALL",
    "interpolated_level": f"""WITH {T.HOURLY}, p AS (SELECT location_id, valid_time, max(value) FILTER (variable = 'error') AS m, max(value) FILTER (variable = 'view') AS a, max(value) FILTER (variable = 'click') AS b
      FROM hourly WHERE variable IN ('view', 'click', 'error') GROUP BY ALL) SELECT location_id, valid_time, {_r('coalesce(m, a * (1 - 50 / 75) + b * (50 / 75))')} AS value, CAST(900 AS DOUBLE) AS level FROM p""",
    "merged_sections": f"""WITH {T.HOURLY} SELECT date_trunc('day', valid_time)::TIMESTAMP AS valid_time, {_r('''avg(value) FILTER (variable = 'view')''')} AS value_view, {_r('''avg(value) FILTER (variable = 'click')''')} AS value_click
      FROM hourly WHERE variable IN ('view', 'click') GROUP BY ALL""",
    "stacked_models": f"WITH {T.MODELS} SELECT location_id, variable, valid_time, {_r('value')} AS value, 'high' AS domain FROM high UNION ALL SELECT location_id, variable, valid_time, {_r('value')}, 'low' FROM low",
    "unique_valid_times": f"WITH {T.HOURLY} SELECT DISTINCT valid_time FROM hourly",
    "common_coverage": f"WITH {T.MODELS} SELECT location_id, variable, valid_time FROM high INTERSECT SELECT location_id, variable, valid_time FROM low",
    "changed_rows": f"WITH {T.MODELS} SELECT *, 'a' AS side FROM (SELECT location_id, variable, valid_time FROM low EXCEPT SELECT location_id, variable, valid_time FROM high)",
    "merged_series": f"""WITH {T.MODELS} SELECT location_id, variable, valid_time, {_r('coalesce(CASE WHEN location_id % 2 = 0 THEN high.value * 2 END, low.value)')} AS value FROM high FULL OUTER JOIN low USING (location_id, variable, valid_time)""",
    "merged_rolling": f"""WITH {T.MODELS} SELECT location_id, variable, valid_time, {_r('coalesce(high.value, low.value)')} AS value FROM high FULL OUTER JOIN low USING (location_id, variable, valid_time) WHERE valid_time >= TIMESTAMP '2024-01-15'""",
    "merged_previous_days": f"""WITH {T.RUNS}, l AS (SELECT *, unnest(range(1, least(CAST(floor(epoch(valid_time - run_time) / 86400) AS BIGINT), 7) + 1)) AS lead_day FROM runs),
      n AS (SELECT location_id, variable, valid_time, lead_day, date_diff('day', TIMESTAMP '2024-01-01', run_time) % 2 = 0 AS even, arg_max(value, run_time) AS value FROM l GROUP BY ALL)
      SELECT location_id, variable, valid_time, lead_day, {_r('coalesce(max(value) FILTER (NOT even), max(value) FILTER (even))')} AS value FROM n GROUP BY ALL""",
    "run_metadata": f"""WITH {T.RUNS} SELECT domain, run_time::TIMESTAMP AS run_time, min(valid_time)::TIMESTAMP AS start, max(valid_time)::TIMESTAMP AS "end", count(DISTINCT valid_time) AS n_times,
      string_agg(DISTINCT variable, ',' ORDER BY variable) AS variables, {_r('epoch(max(valid_time) - min(valid_time)) / nullif(count(DISTINCT valid_time) - 1, 0)')} AS step_seconds FROM runs GROUP BY ALL""",
    "scan_health": f"""WITH {T.HOURLY}, v AS (SELECT variable, valid_time, avg(value) AS value FROM hourly GROUP BY ALL),
      g AS (SELECT *, coalesce(greatest(epoch(valid_time - lag(valid_time) OVER (PARTITION BY variable ORDER BY valid_time)) / 3600 - 1, 0), 0) AS gap FROM v)
      SELECT variable, CAST(floor(epoch(valid_time) / 1209600) AS BIGINT) AS time_chunk, count(*) AS n_rows, CAST(0 AS DOUBLE) AS null_share, {_r('min(value)')} AS min, {_r('max(value)')} AS max, CAST(sum(gap) AS BIGINT) AS missing_steps FROM g GROUP BY ALL""",
}
