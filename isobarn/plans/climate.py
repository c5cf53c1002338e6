"""Normals, seasonal means, distributions and bias correction (A15 to A21, B), and the stored and streamed forms (R)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from isobarn.operators import bias as B
from isobarn.plans import tables as T
from isobarn.session import shared_dir
from isobarn.sources import storage as S
from isobarn.sources.versioned import Store
from isobarn.streaming import streams as R

LOC = ["location_id"]


def _timed(spark, sf_dir):
    return T.daily_long(spark, sf_dir).select("location_id", F.col("date").cast("timestamp").alias("valid_time"), "value")


def _control(spark, sf_dir):
    return _timed(spark, sf_dir).withColumn("value", F.col("value") * 1.2 + 3)


def seasonal_means(spark, sf_dir):
    return T.tidy(B.seasonal_weighted_means(_timed(spark, sf_dir), 6, LOC))


def bias_corrected(spark, sf_dir):
    own, control = _timed(spark, sf_dir), _control(spark, sf_dir)
    means = lambda df: B.seasonal_weighted_means(df, 6, LOC)
    return T.tidy(B.apply_bias(control, means(own), means(control), "add", 6, (0.0, 500.0), LOC))


def bias_scaled(spark, sf_dir):
    own, control = _timed(spark, sf_dir), _control(spark, sf_dir)
    means = lambda df: B.seasonal_weighted_means(df, 6, LOC)
    return T.tidy(B.apply_bias(control, means(own), means(control), "multiply", 6, None, LOC))


def bias_preferred(spark, sf_dir):
    land = B.seasonal_weighted_means(_timed(spark, sf_dir).where("location_id % 2 = 0"), 4, LOC)
    world = B.seasonal_weighted_means(_control(spark, sf_dir), 4, LOC)
    return T.tidy(B.preferred_weights([land, world], LOC))


def value_bins(spark, sf_dir):
    return T.tidy(B.value_range_bins(_timed(spark, sf_dir), 100, None, LOC))


def seasonal_distribution(spark, sf_dir):
    own = _timed(spark, sf_dir)
    return T.tidy(B.seasonal_cdf(own, B.value_range_bins(own, 20, None, LOC), 3, 20, LOC))


def sliding_distribution(spark, sf_dir):
    own = _timed(spark, sf_dir)
    return T.tidy(B.sliding_cdf(own, B.value_range_bins(own, 20, None, LOC), 4, 2, 20, LOC))


def quantile_mapped(spark, sf_dir):
    own, control = _timed(spark, sf_dir), _control(spark, sf_dir)
    return T.tidy(B.quantile_delta_mapping(own, control, "add", False, LOC, n=50, years=2), 3)


def quantile_mapped_detrended(spark, sf_dir):
    own, control = _timed(spark, sf_dir), _control(spark, sf_dir)
    return T.tidy(B.quantile_delta_mapping(own, control, "multiply", True, LOC, n=50, years=2), 3)


def trend_removed(spark, sf_dir):
    return T.tidy(B.linear_trend_removed(T.daily_long(spark, sf_dir), LOC, "date"), 4)


def daily_normals(spark, sf_dir):
    return T.tidy(B.daily_normals(T.daily_long(spark, sf_dir), [1996, 1999], 4, LOC))


def dry_day_normals(spark, sf_dir):
    d = T.daily_long(spark, sf_dir).withColumn("value", F.greatest(F.col("value") - 30, F.lit(0.0)))
    return T.tidy(B.daily_normals_keep_dry_days(d, [1998], 6, LOC, "end"))


def _stream(spark, sf_dir):
    """The events as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return events.select(F.col("ts").cast("timestamp").alias("valid_time"), F.col("user_id").alias("location_id"), F.col("event_type").alias("variable"), "value")


def _run(spark, stream, name):
    """Run a stream to its end in append mode and read what it wrote: what the watermark has closed."""
    out = f"{shared_dir(spark).rstrip('/')}/isobarn/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode("append").trigger(availableNow=True).format("parquet").option("path", out).option("checkpointLocation", out + "-checkpoint").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def streamed_resample(spark, sf_dir):
    return T.tidy(_run(spark, R.stream_resample(_stream(spark, sf_dir), 10800, ["variable"]), "resample"))


def streamed_sliding_mean(spark, sf_dir):
    return T.tidy(_run(spark, R.stream_sliding_mean(_stream(spark, sf_dir), 8, ["variable"]), "sliding"))


def streamed_mean_spread(spark, sf_dir):
    own = _stream(spark, sf_dir).withColumn("valid_time", F.date_trunc("hour", "valid_time"))
    return T.tidy(_run(spark, R.stream_ensemble_mean_spread(own, ["variable"]), "spread"))


def streamed_probability(spark, sf_dir):
    return T.tidy(_run(spark, R.stream_probability(_stream(spark, sf_dir), 3600, ["variable"], 20.0), "probability"))


def _path(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/isobarn/{name}-{uuid.uuid4().hex}"


def _canonical(spark, sf_dir, high):
    return T.model(spark, sf_dir, high).select(F.lit("events").alias("domain"), "variable", "location_id", F.lit(0).alias("member"), F.lit(0).alias("lead_day"), "valid_time", "value")


def stored_series(spark, sf_dir):
    """Written in time chunks, read back by domain, variables and range."""
    path = _path(spark, "store")
    S.write_series(_canonical(spark, sf_dir, False), path)
    found = S.read_series(spark, path, "events", ["view", "click"], "2024-01-10 00:00:00", "2024-01-25 12:00:00")
    return T.tidy(found.select("variable", "location_id", "valid_time", "value"))


def stored_year(spark, sf_dir):
    """A compacted month of complete chunks, and what differs from its source."""
    own = _canonical(spark, sf_dir, False)
    path = _path(spark, "year")
    S.compact_yearly(own, 2024, allow_missing=True).write.parquet(path)
    copy = spark.read.parquet(path)
    lost = S.verify_compaction(own, copy).groupBy("variable").agg(F.count(F.lit(1)).alias("lost"))
    return copy.groupBy("variable").agg(F.count(F.lit(1)).alias("n")).join(lost, "variable", "left").fillna(0, ["lost"])


def upserted_batches(spark, sf_dir):
    """Two models merged into one store as micro-batches, the second one twice."""
    path = _path(spark, "upsert")
    batch = R.upsert_batch(path)
    batch(_canonical(spark, sf_dir, False), 0)
    for _ in range(2):
        batch(_canonical(spark, sf_dir, True).withColumn("value", F.col("value") + 100), 1)
    return T.tidy(Store(spark, path).read().select("variable", "location_id", "valid_time", "value"))


def streamed_pairs(spark, sf_dir):
    """Hours in which a user has both a view and a click, from two streams."""
    own = _stream(spark, sf_dir).withColumn("valid_time", F.date_trunc("hour", "valid_time")).withColumn("value", F.lit(1.0))
    side = lambda v: own.where(F.col("variable") == v).select("location_id", "valid_time", "value")
    out = _path(spark, "pairs")
    pairs = R.stream_pair(side("view"), side("click"), ["location_id"])
    query = pairs.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(pairs.schema).parquet(out).select("location_id", "valid_time")


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", "") == __name__ and not f.__name__.startswith("_")}

_r = T.r


def _share(source: str, bins: int) -> str:
    w = 31557600 // bins
    return f"""sh AS (SELECT location_id, valid_time, value, s // {w} AS b, s % {w} / {w} AS f FROM (SELECT *, CAST(epoch(valid_time) AS BIGINT) % 31557600 AS s FROM {source})),
wt AS (SELECT location_id, valid_time, value, b AS season, 1 - f AS weight FROM sh UNION ALL SELECT location_id, valid_time, value, (b + 1) % {bins}, f FROM sh)"""


_TIMED = f"{T.DAILY}, timed AS (SELECT location_id, CAST(date AS TIMESTAMP) AS valid_time, value FROM daily_long)"
_CONTROL = "control AS (SELECT location_id, valid_time, value * 1.2 + 3 AS value FROM timed)"


def _means(name: str, source: str, bins: int = 6) -> str:
    return _share(source, bins).replace("sh AS", f"sh_{name} AS").replace("FROM sh ", f"FROM sh_{name} ").replace("FROM sh)", f"FROM sh_{name})").replace("wt AS", f"wt_{name} AS") + f",\n{name} AS (SELECT location_id, season, sum(value * weight) / sum(weight) AS mean FROM wt_{name} GROUP BY ALL HAVING sum(weight) > 0.001)"


_AT = """j AS (SELECT c.location_id, c.valid_time, c.value, m1.mean * (1 - f) + m2.mean * f AS m, o1.mean * (1 - f) + o2.mean * f AS o FROM sh_o c
  LEFT JOIN m m1 ON m1.location_id = c.location_id AND m1.season = c.b LEFT JOIN m m2 ON m2.location_id = c.location_id AND m2.season = (c.b + 1) % 6
  LEFT JOIN o o1 ON o1.location_id = c.location_id AND o1.season = c.b LEFT JOIN o o2 ON o2.location_id = c.location_id AND o2.season = (c.b + 1) % 6)"""


def _cdf(weighted: str, group: str, n: int) -> str:
    return f"""rg AS (SELECT location_id, min(value) AS a, (max(value) - min(value)) / {n - 1} AS w FROM timed GROUP BY ALL),
pl AS (SELECT t.*, rg.a, rg.w FROM {weighted} t JOIN rg USING (location_id)),
ed AS (SELECT {group}, bin, sum(weight * CASE WHEN bin = {n - 1} THEN 1 WHEN value < a + bin * w THEN 1 WHEN value < a + (bin + 1) * w THEN (a + (bin + 1) * w - value) / w ELSE 0 END) AS c
  FROM pl, (SELECT unnest(range({n})) AS bin) GROUP BY ALL)
SELECT {group}, bin, {_r(f'CASE WHEN max(c) OVER (PARTITION BY {group}) > 0 THEN c / max(c) OVER (PARTITION BY {group}) ELSE 0 END')} AS cdf FROM ed"""


_Y = 31557600


def _curves(name: str, source: str, seasons: int, n: int, years: int | None, least: str = "min(value)") -> str:
    """<name>: location_id, a, w, fy, bl and cs, the list of (k, q): all distributions of a series, by 100 * block + season."""
    wide = _Y // seasons
    blocks = f"SELECT *, pl AS b0 FROM (SELECT {name}w.*, (s / {_Y} - fy - {(years or 1) / 2}) / {years or 1} AS pl, bl FROM {name}w JOIN {name}g USING (location_id))"
    shared = f"SELECT location_id, value, season, CAST(floor(pl) AS BIGINT) + o AS block, weight * CASE o WHEN 0 THEN 1 - (pl - floor(pl)) ELSE pl - floor(pl) END AS weight FROM ({blocks}), (SELECT unnest([0, 1]) AS o) WHERE floor(pl) + o >= 0 AND floor(pl) + o < bl"
    return f"""{name}s AS (SELECT location_id, value, CAST(epoch(valid_time) AS BIGINT) AS s FROM {source}),
      {name}g AS (SELECT location_id, {least} AS a, (max(value) - {least}) / {n - 1} AS w, round(min(s) / {_Y}) AS fy, greatest(floor((round(max(s) / {_Y}) - round(min(s) / {_Y}) + 1) / {years or 1}), 1) AS bl FROM {name}s GROUP BY ALL),
      {name}w AS (SELECT location_id, s, value, (s % {_Y} // {wide} + o) % {seasons} AS season, CASE o WHEN 0 THEN 1 - s % {_Y} % {wide} / {wide} ELSE s % {_Y} % {wide} / {wide} END AS weight FROM {name}s, (SELECT unnest([0, 1]) AS o)),
      {name}y AS ({shared if years else f"SELECT location_id, value, season, 0 AS block, weight FROM {name}w"}),
      {name}e AS (SELECT location_id, block, season, bin, sum(weight * CASE WHEN bin = {n - 1} THEN 1 WHEN value < a + bin * w THEN 1 WHEN value < a + (bin + 1) * w THEN (a + (bin + 1) * w - value) / w ELSE 0 END) AS c
        FROM {name}y JOIN {name}g USING (location_id), (SELECT unnest(range({n})) AS bin) GROUP BY ALL),
      {name}q AS (SELECT location_id, 100 * block + season AS k, list(CASE WHEN m > 0 THEN c / m ELSE 0 END ORDER BY bin) AS q FROM (SELECT *, max(c) OVER (PARTITION BY location_id, block, season) AS m FROM {name}e) GROUP BY ALL),
      {name} AS (SELECT location_id, any_value(a) AS a, any_value(w) AS w, any_value(fy) AS fy, any_value(bl) AS bl, list({{'k': k, 'q': q}}) AS cs FROM {name}q JOIN {name}g USING (location_id) GROUP BY location_id)"""


def _curve_at(name: str, s: str, seasons: int, n: int, years: int | None) -> tuple[str, str, str]:
    """Places in seasons and blocks, the curves there, and between them the distribution of `name` at the second s: columns over one another."""
    wide, x = _Y // seasons, name
    place = f"CAST(({s} % {_Y} + {_Y}) % {_Y} AS BIGINT)"
    columns = f"{place} // {wide} AS {x}s0, ({place} // {wide} + 1) % {seasons} AS {x}s1, {place} % {wide} / {wide} AS {x}f"
    if years:
        block = f"(({s}) / {_Y} - {x}_fy - {years / 2}) / {years}"
        columns += f", least(greatest(floor({block}), 0), {x}_bl - 1) AS {x}b0, least(greatest(floor({block}) + 1, 0), {x}_bl - 1) AS {x}b1, CASE WHEN floor({block}) < 0 OR floor({block}) >= {x}_bl - 1 THEN 0 ELSE {block} - floor({block}) END AS {x}p"
    one = lambda block, season: f"list_filter({x}_cs, lambda c: c.k = {block} * 100 + {season})[1].q"
    corners = [(f"{x}b0", f"{x}s0"), (f"{x}b0", f"{x}s1"), (f"{x}b1", f"{x}s0"), (f"{x}b1", f"{x}s1")] if years else [("0", f"{x}s0"), ("0", f"{x}s1")]
    curves = ", ".join(f"{one(*c)} AS {x}q{i}" for i, c in enumerate(corners))
    line = lambda a, b: f"({x}q{a}[i] * (1 - {x}f) + {x}q{b}[i] * {x}f)"
    value = f"{line(0, 1)} * (1 - {x}p) + {line(2, 3)} * {x}p" if years else line(0, 1)
    return columns, curves, f"list_transform(range(1, {n + 1}), lambda i: {value})"


def _inverse(q: str, a: str, w: str, n: int) -> str:
    left = f"coalesce(nullif(list_position(list_transform({q}[2:], lambda y: y >= e - 1e-9), true), 0), {n - 1})"
    inside = f"CASE WHEN {q}[{left} + 1] > {q}[{left}] THEN least(greatest((e - {q}[{left}]) / ({q}[{left} + 1] - {q}[{left}]), 0), 1) ELSE 0 END"
    return f"({a} + ({left} - 1 + {inside}) * {w})"


def _mapped_sql(n: int, years: int, detrend: bool) -> str:
    least = "0.0::DOUBLE" if detrend else "min(value)"
    seasons, span = (3, None) if detrend else (4, years)
    flat = lambda source: f"(SELECT location_id, valid_time, value - i * m - c / 2 AS value FROM (SELECT *, CAST(row_number() OVER (PARTITION BY location_id ORDER BY valid_time) - 1 AS DOUBLE) AS i FROM {source}) JOIN (SELECT location_id, regr_slope(value, i) AS m, regr_intercept(value, i) AS c FROM (SELECT *, CAST(row_number() OVER (PARTITION BY location_id ORDER BY valid_time) - 1 AS DOUBLE) AS i FROM {source}) GROUP BY ALL) USING (location_id))"
    during = "(SELECT c.* FROM control c JOIN en USING (location_id) WHERE c.valid_time <= en.stop)"
    c = _curves("cc", flat(during), 3, n, None, least) if detrend else _curves("cc", "control", 4, n, years, least)
    then = "s" if detrend else f"CASE WHEN s >= fin THEN fin + s % {_Y} - {_Y} ELSE s END"
    names = {"ff": _curve_at("ff", "s", 4, n, years), "rr": _curve_at("rr", "z", seasons, n, span), "cc": _curve_at("cc", "z", seasons, n, span)}
    joined = ", ".join(f"{x}.{y} AS {x}_{y}" for x in names for y in ("a", "w", "fy", "bl", "cs"))
    found = "mp + value - ow" if not detrend else "CASE WHEN value > 0 THEN mp * CASE WHEN ow = 0 THEN 10 ELSE least(greatest(value / ow, -10), 10) END ELSE 0 END"
    return f"""WITH {_TIMED}, {_CONTROL}, en AS (SELECT location_id, CAST(max(epoch(valid_time)) AS BIGINT) - {_Y * years // 2} AS fin, max(valid_time) AS stop FROM timed GROUP BY ALL),
      {_curves('rr', flat('timed') if detrend else 'timed', seasons, n, span, least)}, {c}, {_curves('ff', 'control', 4, n, years, least)},
      j1 AS (SELECT *, CAST(epoch(valid_time) AS BIGINT) AS s FROM control), j2 AS (SELECT j1.*, fin, {then} AS z, {joined} FROM j1 JOIN en USING (location_id) JOIN rr USING (location_id) JOIN cc USING (location_id) JOIN ff USING (location_id)),
      j3 AS (SELECT *, {', '.join(x for x, _, _ in names.values())} FROM j2), j3q AS MATERIALIZED (SELECT * EXCLUDE ({', '.join(f'{x}_cs' for x in names)}), {', '.join(x for _, x, _ in names.values())} FROM j3),
      j4 AS MATERIALIZED (SELECT location_id, valid_time, value, rr_a, rr_w, cc_a, cc_w, ff_a, ff_w, {', '.join(f'{q} AS {x}q' for x, (_, _, q) in names.items())} FROM j3q),
      j5 AS (SELECT *, least(greatest(CASE WHEN ff_w > 0 THEN (value - ff_a) / ff_w ELSE 0 END, 0), {n - 1}.0::DOUBLE) AS pl FROM j4), j6 AS (SELECT *, CAST(least(floor(pl), {n - 2}) AS BIGINT) AS lf FROM j5),
      j7 AS (SELECT *, ffq[lf + 1] + (ffq[lf + 2] - ffq[lf + 1]) * (pl - lf) AS e FROM j6), j8 AS (SELECT *, {_inverse('rrq', 'rr_a', 'rr_w', n)} AS mp, {_inverse('ccq', 'cc_a', 'cc_w', n)} AS ow FROM j7)
      SELECT location_id, valid_time, {_r(found, 3)} AS value FROM j8"""


ORACLE = {
    "quantile_mapped": _mapped_sql(50, 2, False),
    "quantile_mapped_detrended": _mapped_sql(50, 2, True),
    "seasonal_means": f"WITH {_TIMED}, {_share('timed', 6)} SELECT location_id, season, CASE WHEN sum(weight) > 0.001 THEN {_r('sum(value * weight) / sum(weight)')} END AS mean FROM wt GROUP BY ALL",
    "bias_corrected": f"WITH {_TIMED}, {_CONTROL}, {_means('m', 'timed')}, {_means('o', 'control')}, {_AT} SELECT location_id, valid_time, {_r('least(greatest(value + m - o, 0), 500)')} AS value FROM j",
    "bias_scaled": f"WITH {_TIMED}, {_CONTROL}, {_means('m', 'timed')}, {_means('o', 'control')}, {_AT} SELECT location_id, valid_time, {_r('value * (m / o)')} AS value FROM j",
    "bias_preferred": f"""WITH {_TIMED}, {_CONTROL}, even AS (SELECT * FROM timed WHERE location_id % 2 = 0), {_means('m', 'even', 4)}, {_means('o', 'control', 4)}
      SELECT location_id, season, {_r('coalesce(m.mean, o.mean)')} AS mean FROM o FULL OUTER JOIN m USING (location_id, season)""",
    "value_bins": f"WITH {_TIMED} SELECT location_id, {_r('min(value)')} AS bin_min, {_r('(max(value) - min(value)) / 99')} AS bin_width FROM timed GROUP BY ALL",
    "seasonal_distribution": f"WITH {_TIMED}, {_share('timed', 3)}, {_cdf('wt', 'location_id, season', 20)}",
    "sliding_distribution": f"""WITH {_TIMED}, {_share('timed', 4)}, sp AS (SELECT location_id, round(min(epoch(valid_time)) / 31557600) AS fy, greatest(floor((round(max(epoch(valid_time)) / 31557600) - round(min(epoch(valid_time)) / 31557600) + 1) / 2), 1) AS bl FROM timed GROUP BY ALL),
      yb AS (SELECT wt.*, (epoch(valid_time) / 31557600 - fy - 1) / 2 AS pl, bl FROM wt JOIN sp USING (location_id)),
      wy AS (SELECT location_id, value, season, CAST(floor(pl) AS BIGINT) + o AS block, weight * CASE o WHEN 0 THEN 1 - (pl - floor(pl)) ELSE pl - floor(pl) END AS weight FROM yb, (SELECT unnest([0, 1]) AS o) WHERE floor(pl) + o >= 0 AND floor(pl) + o < bl),
      {_cdf('wy', 'location_id, block, season', 20)}""",
    "trend_removed": f"""WITH {T.DAILY}, i AS (SELECT *, CAST(row_number() OVER (PARTITION BY location_id ORDER BY date) - 1 AS DOUBLE) AS i FROM daily_long), f AS (SELECT location_id, regr_slope(value, i) AS m, regr_intercept(value, i) AS c FROM i GROUP BY ALL)
      SELECT location_id, date, {_r('value - i * m - c / 2', 4)} AS value FROM i JOIN f USING (location_id)""",
    "daily_normals": f"""WITH {T.DAILY}, p AS (SELECT location_id, value, y AS period, date - DATE '1970-01-01' + o AS d FROM daily_long, (SELECT unnest([1996, 1999]) AS y), (SELECT unnest([-2, -1, 0, 1, 2]) AS o) WHERE year(date) >= y - 2 AND year(date) < y + 2)
      SELECT location_id, period, CAST(floor(d - floor(d / 365.25::DOUBLE) * 365.25::DOUBLE) AS BIGINT) % 365 AS day, {_r('avg(value)')} AS normal FROM p GROUP BY ALL""",
    "dry_day_normals": f"""WITH {T.DAILY}, v AS (SELECT location_id, date, greatest(value - 30, 0) AS v FROM daily_long WHERE year(date) >= 1995 AND year(date) < 2001),
      p AS (SELECT location_id, v, (CAST(floor((date - DATE '1970-01-01') * 86400 / 606876.0) AS BIGINT) + o + 52) % 52 AS part FROM v, (SELECT unnest([-2, -1, 0, 1, 2]) AS o)),
      q AS (SELECT location_id, part, avg(v) AS m, avg(CASE WHEN v < 0.3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS dry FROM p GROUP BY ALL),
      s AS (SELECT location_id, day, least(day // 7, 51) AS part FROM (SELECT DISTINCT location_id FROM q), (SELECT unnest(range(365)) AS day))
      SELECT location_id, 1998 AS period, CAST(day AS INTEGER) AS day, {_r('CASE WHEN day % 7 >= round(dry * 7) THEN m / (greatest(7 - round(dry * 7), 1) / 7) ELSE 0 END')} AS normal FROM s LEFT JOIN q USING (location_id, part)""",
    "streamed_resample": f"""SELECT * FROM (SELECT event_type AS variable, to_timestamp(CAST(ceil(epoch(ts) / 10800.0) AS BIGINT) * 10800)::TIMESTAMP AS valid_time, {_r('avg(value)')} AS value FROM events GROUP BY ALL)
      WHERE valid_time <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    "streamed_sliding_mean": f"""WITH e AS (SELECT event_type AS variable, value, CAST(floor(epoch(ts) / 3600) AS BIGINT) + k AS h FROM events, (SELECT unnest(range(1, 9)) AS k))
      SELECT variable, to_timestamp(h * 3600)::TIMESTAMP AS valid_time, {_r('avg(value)')} AS value FROM e WHERE to_timestamp(h * 3600)::TIMESTAMP <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""",
    "streamed_mean_spread": f"SELECT event_type AS variable, date_trunc('hour', ts)::TIMESTAMP AS valid_time, {_r('avg(value)')} AS mean, {_r('stddev_samp(value)')} AS spread, count(value) AS members FROM events WHERE date_trunc('hour', ts) <= (SELECT date_trunc('hour', max(ts)) - INTERVAL 6 HOUR FROM events) GROUP BY ALL",
    "streamed_probability": f"SELECT event_type AS variable, date_trunc('hour', ts)::TIMESTAMP AS valid_time, {_r('100.0 * count(*) FILTER (value >= 20) / count(*)')} AS precipitation_probability FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 6 HOUR FROM events) GROUP BY ALL HAVING count(*) > 1",
    "stored_series": f"WITH {T.MODELS} SELECT variable, location_id, valid_time, {_r('value')} AS value FROM low WHERE variable IN ('view', 'click') AND valid_time >= TIMESTAMP '2024-01-10' AND valid_time < TIMESTAMP '2024-01-25 12:00:00'",
    "stored_year": f"WITH {T.MODELS} SELECT variable, count(*) AS n, CAST(0 AS BIGINT) AS lost FROM low GROUP BY ALL",
    "upserted_batches": f"WITH {T.MODELS} SELECT variable, location_id, valid_time, {_r('coalesce(high.value + 100, low.value)')} AS value FROM low FULL OUTER JOIN high USING (variable, location_id, valid_time)",
    "streamed_pairs": """SELECT DISTINCT user_id AS location_id, date_trunc('hour', ts)::TIMESTAMP AS valid_time FROM events a WHERE event_type = 'view'
      AND EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'click' AND b.user_id = a.user_id AND date_trunc('hour', b.ts) = date_trunc('hour', a.ts))""",
}
