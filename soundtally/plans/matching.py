"""Queries that match, merge, number, filter and align: nearest joins, region algebra, predicates, resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundtally.functions import levels as L
from soundtally.operators import asof, regions, spectrogram, timeline
from soundtally.plans.base import ENERGY, H, areas, log, overview, query, spectra
from soundtally.sources import inventory

DAY = L.DAY_MS

SEGMENTS = """, d as (select *, ms - lag(ms) over (partition by position order by ms, event_id) as delta from log),
 lim as (select position, greatest(300000, 5 * quantile_cont(delta, 0.5)) as lim from d group by 1),
 s as (select d.*, sum(coalesce((delta > lim)::int, 0)) over (partition by position order by ms, event_id)::bigint as segment from d join lim using (position)),
 seg as (select position, segment, min(ms) as s, max(ms) as e from s group by 1, 2)"""


@query(
    SEGMENTS
    + """, rec as (select event_id, position, ms + (event_id % 90 - 45) * 86400000::bigint - (laeq * 10000)::bigint as s, ms + (event_id % 90 - 45) * 86400000::bigint as e from log),
 c as (select rec.event_id, segment, case when rec.s <= seg.e and rec.e >= seg.s then 0 else least(abs(rec.s - seg.e), abs(rec.e - seg.s)) end as dist from rec join seg using (position)),
 b as (select event_id, min_by(segment, (dist, segment)) as segment, min(dist) as dist from c group by 1)
 select event_id, case when dist <= 43200000 then rec.s end as start_ms, case when dist <= 43200000 then segment end as segment,
 case when dist <= 7200000 then 'high' when dist <= 43200000 then 'medium' else 'unmatched' end as confidence from rec left join b using (event_id)""",
    "log",
)
def j4_match_recordings(spark, d):
    rows = log(spark, d)
    # recordings from a month and a half before to a month and a half after
    end = F.col("ms") + (F.col("event_id") % 90 - 45) * DAY
    rec = rows.select("event_id", "position", (end - F.round(F.col("laeq") * 10000).cast("long")).alias("start_ms"), end.alias("end_ms"))
    return asof.match_recordings(rec, timeline.segments(rows)).select("event_id", "start_ms", "segment", "confidence")


@query(
    """, m as (select event_id as marker_id, ms, case event_id % 3 when 0 then 'click' when 1 then 'view' else 'global' end as pool from log where position = 'error'),
 p as (select event_id, ms, case when position in (select pool from m) then position else 'global' end as pool from log where position <> 'error')
 select p.event_id, min_by(m.marker_id, (abs(m.ms - p.ms), m.ms, m.marker_id)) as marker_id from p left join m using (pool) group by 1""",
    "log",
)
def j6_nearest_marker(spark, d):
    rows = log(spark, d)
    pool = F.when(F.col("event_id") % 3 == 0, "click").when(F.col("event_id") % 3 == 1, "view").otherwise("global")
    marks = rows.where("position = 'error'").select(F.col("event_id").alias("marker_id"), "ms", pool.alias("pool"))
    own = marks.select(F.col("pool").alias("position")).distinct().withColumn("pool", F.col("position"))
    points = rows.where("position <> 'error'").join(own, "position", "left").select("event_id", "ms", F.coalesce("pool", F.lit("global")).alias("pool"))
    return asof.nearest_at(points, marks, "pool", "marker_id").select("event_id", "marker_id")


THIN = "(select * from spectra where freq_hz % (3 + substr(position, 2)::int) <> 0)"


def thin(df):
    return df.where(F.col("freq_hz") % (3 + F.substring("position", 2, 9).cast("int")) != 0)


@query(
    f""", t as (select position, freq_hz, {ENERGY.format("level")} as laeq from {THIN} group by 1, 2),
 b as (select freq_hz from t where position = (select position from t group by 1 order by count(*) desc, position limit 1))
 select p.position, b.freq_hz, t.laeq from (select distinct position from t) p cross join b left join t on t.position = p.position and t.freq_hz = b.freq_hz""",
    "spectra",
)
def j9_align_spectra(spark, d):
    return spectrogram.align(thin(spectra(spark, d)))


@query(
    """, p as (select marker_id, position, m.ms from markers m cross join (select distinct position from log)), q as (select * from log)
 select p.marker_id, p.position, round(l.laeq, 6) as laeq, round(l.lafmax, 6) as lafmax, case when l.ms is null then 'no data' else 'ok' end as status
 from p left join lateral (select * from q where q.position = p.position and q.ms <= p.ms order by q.ms desc, q.event_id desc limit 1) l on true""",
    "log", "markers",
)
def j11_values_at(spark, d):
    rows = log(spark, d)
    marks = rows.where("position = 'error'").select(F.col("event_id").alias("marker_id"), "ms")
    # the result has a row for each marker and position by definition
    points = marks.crossJoin(rows.select("position").distinct())
    got = asof.last_at(points, rows, "position", ["laeq", "lafmax"], order="event_id")
    return got.select("marker_id", "position", "laeq", "lafmax", F.when(F.col("at_ms").isNull(), "no data").otherwise("ok").alias("status"))


@query("select position, round(min(p), 6) as period_s from (select position, median(delta) / 1000 as p from (select position, ms - lag(ms) over (partition by position order by ms) as delta, row_number() over (partition by position order by ms) as i from log) where i <= 32 and delta > 0 group by 1 union all select distinct position, 3600.0 from overview union all select position, 0.0 from log) where p > 0 group by 1", "log", "overview")
def a9_effective_period(spark, d):
    rows = log(spark, d)
    peeked = timeline.time_step(rows).select("position", (F.col("step_ms") / 1000).alias("p"))
    named = overview(rows).select("position", F.lit(3600.0).alias("p")).distinct()
    unknown = rows.select("position", F.lit(0.0).alias("p")).distinct()
    return peeked.unionByName(named).unionByName(unknown).where("p > 0").groupBy("position").agg(F.min("p").alias("period_s"))


@query("select position, round(coalesce(min(x), 0), 6) as lo, round(coalesce(max(x), 100), 6) as hi from (select position, case when position <> 'P3' then level end as x from spectra) group by 1", "spectra")
def a12_level_range(spark, d):
    return spectrogram.level_range(spectra(spark, d).withColumn("level", F.when(F.col("position") != "P3", F.col("level")).otherwise(float("nan"))))


@query(f"select c.start_ms, c.start_ms + {DAY} as end_ms, p.position from (select distinct ms // {DAY} * {DAY} as start_ms from log where position = 'click') c cross join (select distinct position from log where position <> 'view') p", "log")
def r2_comparison_to_regions(spark, d):
    rows = log(spark, d)
    slices = rows.where("position = 'click'").select((F.floor(F.col("ms") / DAY) * DAY).alias("start_ms")).distinct()
    included = rows.where("position <> 'view'").select("position").distinct()
    # the result has a row for each slice and included position by definition
    return slices.crossJoin(included).select("start_ms", (F.col("start_ms") + DAY).alias("end_ms"), "position")


@query(
    """, g as (select region_id, position || '/' || (start_ms // 86400000) as scope, case when region_id % 5 = 0 then region_id % 40 + 1 end as given from areas),
 s as (select *, row_number() over (partition by scope order by region_id) as i from g)
 , f as (select scope, list(struct_pack(r := region_id, g := given) order by i) as rows from s group by 1)
 , w as (with recursive w as (select scope, rows, 0 as k, 0::bigint as top, []::bigint[] as ids from f union all
  select scope, rows, k + 1, greatest(top, id), list_append(ids, id) from (select *, case when rows[k + 1].g is not null and not list_contains(ids, rows[k + 1].g) then rows[k + 1].g else top + 1 end as id from w where k < len(rows)))
  select * from w where k = len(rows))
 select rows[i].r as region_id, ids[i] as id from w, unnest(range(1, len(rows) + 1)) as t(i)""",
    "log", "areas",
)
def r3_assign_region_ids(spark, d):
    """Ids within each position and day; every fifth region brings one."""
    given = F.when(F.col("region_id") % 5 == 0, F.col("region_id") % 40 + 1)
    scope = F.concat_ws("/", "position", F.floor(F.col("start_ms") / DAY).cast("string"))
    return regions.with_ids(areas(log(spark, d)).select("region_id", scope.alias("scope"), given.alias("given")), "region_id", "given", "scope").select("region_id", "id")


MERGES = """, g as (select case when t.position = a.position then t.region_id else a.region_id end as region_id, a.position, a.start_ms, a.end_ms from areas a left join areas t on t.region_id = a.region_id // 400 * 400 where a.start_ms < a.end_ms),
 o as (select *, case when start_ms <= max(end_ms) over (partition by region_id, position order by start_ms, end_ms rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from g),
 i as (select *, sum(fresh) over (partition by region_id, position order by start_ms, end_ms rows unbounded preceding) as isl from o),
 u as (select region_id, position, min(start_ms) as start_ms, max(end_ms) as end_ms from i group by region_id, position, isl)"""


def united(spark, d):
    a = areas(log(spark, d))
    pairs = a.select("region_id", (F.floor(F.col("region_id") / 400) * 400).alias("target_id")).where("region_id <> target_id")
    return regions.merge_regions(a, pairs)


@query(MERGES + " select * from u", "log", "areas")
def u3_merge_regions(spark, d):
    return united(spark, d)


@query(MERGES + " select *, case when count(*) over (partition by region_id) > 1 then row_number() over (partition by region_id order by start_ms, end_ms) else 0 end as part from u", "log", "areas")
def u4_split_region(spark, d):
    return regions.split_regions(united(spark, d))


@query("select distinct freq_hz, position from spectra", "spectra")
def u6_distinct_bands(spark, d):
    return spectra(spark, d).select("freq_hz", "position").distinct()


@query(
    """, st as (select position, median(delta) / 1000 as s from (select position, ms - lag(ms) over (partition by position order by ms) as delta, row_number() over (partition by position order by ms) as i from log) where i <= 32 and delta > 0 group by 1),
 th as (select position, position <> 'signup' as has_log, case when position in ('click', 'view') then least(greatest(900000 + (s - 100) / 900 * 2700000, 900000), 3600000) / 1000 end as t from st),
 r as (select event_id, position, laeq * 80 as span_s, case when event_id % 15 = 0 then 3000.0 end as manual_s from log),
 u as (select event_id, span_s, least(coalesce(manual_s, case when not has_log then 3600 else coalesce(t, (select min(t) from th), 3600) end), 3600) as used_s from r join th using (position))
 select event_id, round(used_s, 6) as used_s, case when span_s <= used_s then 'log' else 'overview' end as dataset from u""",
    "log",
)
def v5_choose_resolution(spark, d):
    rows = log(spark, d)
    own = F.when(F.col("position").isin("click", "view"), L.log_window_ms(F.col("step_ms") / 1000) / 1000)
    thresholds = timeline.time_step(rows).select("position", (F.col("position") != "signup").alias("has_log"), own.alias("threshold_s"))
    asked = rows.select("event_id", "position", (F.col("laeq") * 80).alias("span_s"), F.when(F.col("event_id") % 15 == 0, F.lit(3000.0)).alias("manual_s"))
    return spectrogram.choose_resolution(asked, thresholds, limit_s=3600, default_s=3600).select("event_id", "used_s", "dataset")


@query(
    """, g as (select position, ms, freq_hz, case when (freq_hz + ms // 1000) % 15 > 0 then level end as level from spectra), t as (select distinct position, ms from g),
 p as (select distinct vec_id as k, 'P' || ((label + 1) % 10) as position, vec_id * 1000 + 500 as ms from embeddings), a as (select p.*, (select max(ms) from t where t.position = p.position and t.ms <= p.ms) as at_ms from p)
 select a.k, a.position, a.ms, g.freq_hz, round(coalesce(g.level, 0), 6) as level from a join g on g.position = a.position and g.ms = a.at_ms and g.freq_hz between 8 and 32""",
    "spectra",
)
def v10_spectrum_at(spark, d):
    s = spectra(spark, d)
    holed = s.withColumn("level", F.when((F.col("freq_hz") + F.floor(F.col("ms") / 1000)) % 15 > 0, F.col("level")))
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    points = e.select(F.col("vec_id").alias("k"), F.concat(F.lit("P"), (F.col("label") + 1) % 10).alias("position"), (F.col("vec_id") * 1000 + 500).alias("ms"))
    return spectrogram.spectrum_at(points, holed, 8, 32).select("k", "position", "ms", "freq_hz", "level")


@query(MERGES + " select u.region_id, count(*) as n, round(max(l.laeq), 6) as most from u join log l on l.position = u.position and l.ms between u.start_ms and u.end_ms group by 1", "log", "areas")
def f2_slice_areas(spark, d):
    met = asof.in_intervals(log(spark, d).select("position", "ms", "laeq"), united(spark, d), "position")
    return met.groupBy("region_id").agg(F.count(F.lit(1)).alias("n"), F.max("laeq").alias("most"))


@query("select event_id, round(try_cast(case when event_id % 11 = 0 then 'n/a' else laeq::varchar end as double), 6) as laeq from log where event_id % 13 <> 0 and event_id % 11 <> 0", "log")
def f4_drop_bad_rows(spark, d):
    text = F.when(F.col("event_id") % 11 == 0, "n/a").when(F.col("event_id") % 13 != 0, F.col("laeq").cast("string"))
    return log(spark, d).select("event_id", text.try_cast("double").alias("laeq")).dropna(subset=["laeq"])


@query(
    """, r as (select s.*, case position when 'P3' then 100 else 8 end as lo, case position when 'P3' then 200 else 16 end as hi from spectra s)
 select position, freq_hz, count(*) as n from (select *, bool_or(freq_hz between lo and hi) over (partition by position) as hit from r) where not hit or freq_hz between lo and hi group by 1, 2""",
    "spectra",
)
def f5_band_range(spark, d):
    s = spectra(spark, d)
    odd = F.col("position") == "P3"
    ranges = s.select("position").distinct().select("position", F.when(odd, 100).otherwise(8).alias("lo"), F.when(odd, 200).otherwise(16).alias("hi"))
    return spectrogram.band_range(s, ranges).groupBy("position", "freq_hz").agg(F.count(F.lit(1)).alias("n"))


@query("select page_id from pages where coalesce(case page_id % 3 when 0 then true when 1 then false end, true) and page_id % 5 > 0 and url is not null")
def f6_enabled_sources(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    enabled = F.when(F.col("page_id") % 3 == 0, True).when(F.col("page_id") % 3 == 1, False)
    place = F.when(F.col("page_id") % 5 > 0, F.concat(F.lit("P"), F.col("page_id") % 5))
    return inventory.enabled_sources(p.select("page_id", F.col("url").alias("path"), enabled.alias("enabled"), place.alias("position"))).select("page_id")


@query(SEGMENTS + " select position, segment, coalesce(e - s < 3600000, false) as is_spot from seg", "log")
def f7_spot_measurement(spark, d):
    return timeline.segments(log(spark, d)).select("position", "segment", timeline.is_spot(F.col("start_ms"), F.col("end_ms")).alias("is_spot"))


@query(
    """, t as (select position || '/' || (ms // 86400000) as position, 'log' as profile, laeq > 85 as spectral from log where position in ('click', 'view') union all select position || '/' || (ms // 86400000), 'overview', lafmax > 93 from log where position in ('view', 'error'))
 select position, coalesce(bool_or(profile = 'overview' and not spectral), false) as has_overview, coalesce(bool_or(profile = 'log' and not spectral), false) as has_log, coalesce(bool_or(profile = 'overview' and spectral), false) as has_overview_spectra, coalesce(bool_or(profile = 'log' and spectral), false) as has_log_spectra from t group by 1""",
    "log",
)
def f8_presence(spark, d):
    """Which tables each position has on a day."""
    rows = log(spark, d).withColumn("place", F.concat_ws("/", "position", F.floor(F.col("ms") / DAY).cast("string")))
    table = lambda names, profile, spectral: rows.where(F.col("position").isin(names)).select(F.col("place").alias("position"), F.lit(profile).alias("profile"), spectral.alias("spectral"))
    return timeline.presence(table(["click", "view"], "log", F.col("laeq") > 85).unionByName(table(["view", "error"], "overview", F.col("lafmax") > 93)))


@query("select region_id from (select region_id, case region_id % 7 when 0 then end_ms when 1 then -1 else start_ms end as s, end_ms as e from areas) where s >= 0 and e > s", "log", "areas")
def f9_valid_range(spark, d):
    a = areas(log(spark, d))
    s = F.when(F.col("region_id") % 7 == 0, F.col("end_ms")).when(F.col("region_id") % 7 == 1, -1).otherwise(F.col("start_ms"))
    return regions.valid_ranges(a.select("region_id", s.alias("start_ms"), "end_ms")).select("region_id")


@query("select event_id, ms + greatest(-3600000, least(3600000, (event_id % 5 - 2) * 1800000 * 2)) as ms from log", "log")
def p11_apply_offset(spark, d):
    return log(spark, d).select("event_id", L.shifted(F.col("ms"), (F.col("event_id") % 5 - 2) * 3_600_000).alias("ms"))


@query("select region_id, start_ms - case position when 'click' then 600000 when 'view' then -3600000 else 0 end as start_ms, end_ms - case position when 'click' then 600000 when 'view' then -3600000 else 0 end as end_ms from areas", "log", "areas")
def p11_source_areas(spark, d):
    offsets = spark.createDataFrame([("click", 600_000), ("view", -9_000_000)], "position string, chart_offset_ms long")
    return regions.source_areas(areas(log(spark, d)), offsets).select("region_id", "start_ms", "end_ms")


@query("select event_id, position, ms from (select *, row_number() over (partition by position order by ms, event_id) as r from log) where r <= 20", "log")
def o6_head_rows(spark, d):
    return timeline.head(log(spark, d), 20).select("event_id", "position", "ms")


@query("select event_id as marker_id, ms, row_number() over (order by ms, event_id) as rank from (select event_id, ms // 60000 * 60000 as ms from log where position = 'error')", "log")
def o5_marker_order(spark, d):
    """Markers by time and id; times are whole minutes, of which some are equal."""
    m = log(spark, d).where("position = 'error'").select(F.col("event_id").alias("marker_id"), (F.floor(F.col("ms") / 60000) * 60000).alias("ms"))
    return timeline.ranked(m, "ms", H, "marker_id")


@query("select event_id, position, case position when 'signup' then 1 when 'click' then 2 else 2 + (case position when 'error' then 1 when 'purchase' then 2 else 3 end) end as place from log", "log")
def o7_position_order(spark, d):
    return timeline.in_position_order(log(spark, d), ["signup", "absent", "click"]).select("event_id", "position", "place")


@query(
    """, q as (select position, ms, event_id, case when position in ('click', 'view') then laeq end as laeq, case when position in ('view', 'error') then lafmax end as lzeq from log),
 p as (select marker_id, position, m.ms from markers m cross join (select distinct position from log)),
 g as (select p.*, l.ms as at_ms, l.laeq, l.lzeq from p left join lateral (select * from q where q.position = p.position and q.ms <= p.ms order by q.ms desc, q.event_id desc limit 1) l on true)
 select marker_id, position, at_ms, case when at_ms is not null then case when position in ('click', 'view') then 'LAeq' when position = 'error' then 'LZeq' end end as parameter, round(case when position in ('click', 'view') then laeq when position = 'error' then lzeq end, 6) as value from g""",
    "log", "markers",
)
def j1_marker_metrics(spark, d):
    """Two positions have LAeq, one LZeq alone, two neither."""
    rows = log(spark, d)
    of = lambda names, c: F.when(F.col("position").isin(names), F.col(c))
    levels = rows.select("position", "ms", "event_id", of(["click", "view"], "laeq").alias("laeq"), of(["view", "error"], "lafmax").alias("lzeq"))
    marks = rows.where("position = 'error'").select(F.col("event_id").alias("marker_id"), "ms").crossJoin(rows.select("position").distinct())
    return asof.marker_metrics(marks, levels).select("marker_id", "position", "at_ms", "parameter", "value")


@query(
    """, e as (select distinct vec_id as k, 'P' || ((label + 3) % 10) as position, vec_id * 1000 + 500 as ms from embeddings), t as (select distinct position, ms from spectra), a as (select e.*, (select max(t.ms) from t where t.position = e.position and t.ms <= e.ms) as at_ms from e)
 select a.k, a.position, count(*) as bands, round(sum(level), 6) as total from a join spectra s on s.position = a.position and s.ms = a.at_ms group by 1, 2""",
    "spectra",
)
def j1_marker_spectra(spark, d):
    """All bands of the last spectrum at or before each marker."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    points = e.select(F.col("vec_id").alias("k"), F.concat(F.lit("P"), (F.col("label") + 3) % 10).alias("position"), (F.col("vec_id") * 1000 + 500).alias("ms"))
    return spectrogram.spectrum_at(points, spectra(spark, d), 0, 100_000).groupBy("k", "position").agg(F.count(F.lit(1)).alias("bands"), F.sum("level").alias("total"))
