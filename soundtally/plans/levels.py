"""Queries over the level tables: metrics, joins, timelines, regions, spectrograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundtally.functions import levels as L
from soundtally.operators import asof, regions, spectrogram, timeline
from soundtally.plans.base import ENERGY, H, areas, extent, log, overview, query, spectra
from soundtally.streaming import streams


@query(f"select position, {ENERGY.format('laeq')} as laeq, round(max(lafmax), 6) as lafmax, round(quantile_cont(laeq, 0.1), 6) as la90 from log group by 1", "log")
def a_position_levels(spark, d):
    return log(spark, d).groupBy("position").agg(L.laeq(F.col("laeq")).alias("laeq"), L.lafmax(F.col("lafmax")).alias("lafmax"), L.l_n(F.col("laeq"), 90).alias("la90"))


@query(f"select position, freq_hz, {ENERGY.format('level')} as laeq from spectra group by 1, 2", "spectra")
def a4_mean_spectrum(spark, d):
    return spectrogram.mean_spectrum(spectra(spark, d), ["position"])


LEVELS = """, levels as (select position, 'log' as profile, ms, case when event_id % 3 = 0 then laeq end as laeq, lafmax, case when event_id % 4 = 0 then laeq - 3 end as laf90, case when event_id % 5 < 2 then lafmax end as value from log where position <> 'view'
 union all select position, 'overview', ms, laeq, lafmax, null, null from overview)"""


def both_profiles(rows):
    """A log with gaps, which one position lacks, and an overview of all."""
    some = lambda c, n, k: F.when(F.col("event_id") % n < k, c)
    logs = rows.where("position <> 'view'").select("position", F.lit("log").alias("profile"), "ms", some(F.col("laeq"), 3, 1).alias("laeq"), "lafmax", some(F.col("laeq") - 3, 4, 1).alias("laf90"), some(F.col("lafmax"), 5, 2).alias("value"))
    return logs.unionByName(overview(rows).withColumn("profile", F.lit("overview")), allowMissingColumns=True)


@query(
    LEVELS
    + """, src as (select *, start_ms - case position when 'click' then 600000 when 'view' then -3600000 else 0 end as s, end_ms - case position when 'click' then 600000 when 'view' then -3600000 else 0 end as e from areas),
 m as (select a.region_id, l.profile, l.laeq, l.lafmax, l.laf90 from src a join levels l on l.position = a.position and l.ms between a.s and a.e where a.s < a.e),
 g as (select region_id, profile, count(laeq) as n, 10 * log10(avg(pow(10.0, laeq / 10))) as laeq, max(lafmax) as lafmax, coalesce(quantile_cont(laf90, 0.1), quantile_cont(laeq, 0.1)) as la90 from m group by 1, 2 having count(laeq) > 0),
 c as (select * from g qualify row_number() over (partition by region_id order by profile) = 1)
 select a.region_id, a.position, a.end_ms - a.start_ms as duration_ms, coalesce(c.profile, 'none') as dataset, round(c.laeq, 6) as laeq, round(c.lafmax, 6) as lafmax, round(c.la90, 6) as la90, coalesce(c.profile = 'log' and c.la90 is not null, false) as la90_available from areas a left join c using (region_id)""",
    "log", "overview", "areas",
)
def a5_region_metrics(spark, d):
    rows = log(spark, d)
    # an offset beyond an hour counts as an hour
    offsets = spark.createDataFrame([("click", 600_000), ("view", -9_000_000)], "position string, chart_offset_ms long")
    return regions.region_metrics(both_profiles(rows), areas(rows), offsets)


@query(
    """, sp as (select position, case when substr(position, 2)::int % 3 = 0 then 'overview' else 'log' end as profile, 'LZeq' as param, ms, freq_hz, level from spectra
 union all select position, 'overview', 'LZFmax', ms, freq_hz, level + 1 from spectra where position in ('P1', 'P5', 'P9')
 union all select position, 'overview', 'LZeq', ms, freq_hz, level - 1 from spectra where position = 'P2'),
 b as (select position, profile, param from (select distinct position, profile, param from sp) qualify row_number() over (partition by position order by param = 'LZeq', profile) = 1),
 a as (select vec_id as region_id, 'P' || label as position, vec_id * 1000 as s, vec_id * 1000 + 5000 as e from embeddings)
 select a.region_id, sp.param, sp.profile as source, sp.freq_hz, round(10 * log10(avg(pow(10.0, level / 10))), 6) as laeq from a join b using (position) join sp on sp.position = a.position and sp.profile = b.profile and sp.param = b.param and sp.ms between a.s and a.e group by 1, 2, 3, 4""",
    "spectra",
)
def a5_region_spectra(spark, d):
    s = spectra(spark, d)
    kind = lambda df, profile, param, more=0: df.select("position", profile.alias("profile"), F.lit(param).alias("param"), "ms", "freq_hz", (F.col("level") + more).alias("level"))
    own = F.when(F.substring("position", 2, 9).cast("int") % 3 == 0, "overview").otherwise("log")
    sp = kind(s, own, "LZeq").unionByName(kind(s.where(F.col("position").isin("P1", "P5", "P9")), F.lit("overview"), "LZFmax", 1)).unionByName(kind(s.where("position = 'P2'"), F.lit("overview"), "LZeq", -1))
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    a = e.select(F.col("vec_id").alias("region_id"), F.concat(F.lit("P"), F.col("label")).alias("position"), (F.col("vec_id") * 1000).alias("start_ms"), (F.col("vec_id") * 1000 + 5000).alias("end_ms"))
    return regions.region_spectra(sp, a, "LZFmax")


@query(
    LEVELS
    + f""", sl as (select distinct ms // {H} as slice_id, ms // {H} * {H} as s, ms // {H} * {H} + {H - 1} as e from log), p as (select distinct position from log), grid as (select * from sl cross join p),
 g as (select slice_id, l.position, profile, count(laeq) as nl, count(value) as nv, 10 * log10(avg(pow(10.0, laeq / 10))) as laeq, 10 * log10(avg(pow(10.0, value / 10))) as value, max(lafmax) as lafmax, quantile_cont(laeq, 0.1) as ql, quantile_cont(value, 0.1) as qv
  from grid join levels l on l.position = grid.position and l.ms between s and e group by 1, 2, 3 having count(laeq) + count(value) > 0),
 c as (select * from g qualify row_number() over (partition by slice_id, position order by profile) = 1),
 r as (select grid.slice_id, grid.position, e - s as duration_ms, coalesce(profile, 'none') as dataset, case when nl > 0 then laeq else value end as laeq, case when nv > 0 or profile is null then 'LAFmax' else 'LAeq' end as parameter,
  case when nv > 0 then value else laeq end as broadband, lafmax, case when profile = 'log' then case when nl > 0 then ql else qv end end as la90 from grid left join c using (slice_id, position))
 select slice_id, position, duration_ms, dataset, round(laeq, 6) as laeq, parameter, round(broadband, 6) as broadband, round(lafmax, 6) as lafmax, round(la90, 6) as la90, la90 is not null as la90_available, bool_or(laeq is not null or broadband is not null or lafmax is not null) over (partition by slice_id) as has_data from r""",
    "log", "overview",
)
def a6_compare_positions(spark, d):
    rows = log(spark, d)
    slices = rows.select(F.floor(F.col("ms") / H).alias("slice_id")).distinct().select("slice_id", (F.col("slice_id") * H + H - 1).alias("start_ms"), (F.col("slice_id") * H).alias("end_ms"))
    return regions.compare_positions(both_profiles(rows), slices, rows, "LAFmax")


@query(
    """, sp as (select position, case when substr(position, 2)::int % 3 = 0 then 'overview' else 'log' end as profile, ms, freq_hz, level from spectra union all select position, 'overview', ms, freq_hz, level - 1 from spectra where position in ('P1', 'P2')),
 c as (select distinct ms // 20000 as slice_id, position, case (ms // 20000 + substr(position, 2)::int) % 3 when 0 then 'none' when 1 then 'log' else 'overview' end as dataset from spectra),
 k as (select c.*, case when dataset = 'log' and substr(position, 2)::int % 3 > 0 then 'log' else 'overview' end as source from c where dataset <> 'none')
 select k.slice_id, k.position, k.source, freq_hz, round(10 * log10(avg(pow(10.0, level / 10))), 6) as laeq from k join sp on sp.position = k.position and sp.profile = k.source and sp.ms between k.slice_id * 20000 and k.slice_id * 20000 + 19999 group by 1, 2, 3, 4""",
    "spectra",
)
def a6_compare_spectra(spark, d):
    s = spectra(spark, d)
    number = F.substring("position", 2, 9).cast("int")
    own = F.when(number % 3 == 0, "overview").otherwise("log")
    part = lambda df, profile, more: df.select("position", profile.alias("profile"), F.lit("LZeq").alias("param"), "ms", "freq_hz", (F.col("level") + more).alias("level"))
    sp = part(s, own, 0).unionByName(part(s.where(F.col("position").isin("P1", "P2")), F.lit("overview"), -1))
    each = s.select(F.floor(F.col("ms") / 20_000).alias("slice_id"), "position").distinct()
    k = (F.col("slice_id") + number) % 3
    compared = each.withColumn("dataset", F.when(k == 0, "none").when(k == 1, "log").otherwise("overview"))
    slices = each.select("slice_id").distinct().withColumns({"start_ms": F.col("slice_id") * 20_000, "end_ms": F.col("slice_id") * 20_000 + 19_999})
    return regions.compare_spectra(sp, compared, slices, "LZeq")


GRID = "(select distinct position, ms // 60000 * 60000 as ms from log)"


@query(
    f"""select position, round(m / 1000.0, 3) as period_s from (select position, delta as m, row_number() over (partition by position order by count(*) desc, delta) as r from
 (select position, ms - lag(ms) over w as delta, row_number() over w - 1 as i, count(*) over (partition by position) as n from {GRID} window w as (partition by position order by ms))
 where case when n = 2 then i = 1 when n - 2 > 20 then i > 5 and i <= n - 7 else i >= 1 and i <= n - 2 end group by 1, 2) where r = 1""",
    "log",
)
def a7_sample_period(spark, d):
    grid = log(spark, d).select("position", (F.floor(F.col("ms") / 60000) * 60000).alias("ms")).distinct()
    return timeline.sample_period(grid)


@query("select position, round(quantile_cont(delta, 0.5), 6) as step_ms from (select position, ms - lag(ms) over w as delta, row_number() over w as i from log window w as (partition by position order by ms)) where i <= 32 and delta > 0 group by 1", "log")
def a8_time_step(spark, d):
    return timeline.time_step(log(spark, d))


@query("select position, list_sort(list(delta))[count(*) // 2 + 1] as step_ms from (select position, ms - lag(ms) over w as delta, row_number() over w as i from log window w as (partition by position order by ms)) where i <= 4001 and delta > 0 group by 1", "log")
def a8_upper_median_step(spark, d):
    return timeline.upper_median_step(log(spark, d))


@query("select position, min(ms) as lo, max(ms) as hi, count(*) as n from (select position, ms from log union all select position, ms from overview) group by 1", "log", "overview")
def a10_timestamp_stats(spark, d):
    rows = log(spark, d)
    both = rows.select("position", "ms").unionByName(overview(rows).select("position", "ms"))
    return both.groupBy("position").agg(F.min("ms").alias("lo"), F.max("ms").alias("hi"), F.count(F.lit(1)).alias("n"))


@query(
    """, r as (select position, ms, event_id, laeq, lafmax from log union all select position || '-' || (ms // 86400000), ms, event_id, laeq, lafmax from log union all select position || '-flat', 5, event_id, laeq, lafmax from log),
 g as (select position, min(ms) as lo, max(ms) as hi, count(*) as n from r group by 1),
 k as (select r.*, case when n <= 500 then 'whole' when hi <= lo then 'first' else 'buckets' end as kind, lo // 86400000 * 86400000 as day0, greatest(1, ceil((hi - lo) / 500.0))::bigint as step, row_number() over (partition by position order by event_id) as i from r join g using (position))
 select position, ms, round(laeq, 6) as laeq, round(lafmax, 6) as lafmax from k where kind = 'whole' or (kind = 'first' and i <= 500)
 union all select position, (day0 + (ms - day0) // step * step)::bigint, round(max(laeq), 6), round(max(lafmax), 6) from k where kind = 'buckets' group by position, (day0 + (ms - day0) // step * step)""",
    "log",
)
def a11_downsample_max(spark, d):
    """Each position's series, each of its days, and its rows at one time."""
    rows = log(spark, d)
    days = rows.withColumn("position", F.concat_ws("-", "position", F.floor(F.col("ms") / L.DAY_MS).cast("string")))
    flat = rows.withColumn("position", F.concat("position", F.lit("-flat"))).withColumn("ms", F.lit(5).cast("long"))
    return timeline.downsample_max(rows.unionByName(days).unionByName(flat), ["laeq", "lafmax"], 500)


@query("select position, ms, event_id, round(laeq, 6) as laeq from (select *, row_number() over (partition by position, ms order by src, event_id) as r from (select position, ms // 1000 * 1000 as ms, event_id, laeq, 0 as src from log where event_id % 3 <> 0 union all select position, ms // 1000 * 1000, event_id, laeq, 1 from log)) where r = 1", "log")
def a18_merge_sources(spark, d):
    one = log(spark, d).withColumn("ms", F.floor(F.col("ms") / 1000) * 1000)
    both = one.where("event_id % 3 <> 0").withColumn("src", F.lit(0)).unionByName(one.withColumn("src", F.lit(1)))
    return timeline.merge_sources(both, ["position", "ms"], ["src", "event_id"]).select("position", "ms", "event_id", "laeq")


@query("select event_id, position, ms - lag(ms) over (partition by position order by ms, event_id) as delta from log", "log")
def w1_time_delta(spark, d):
    return timeline.deltas(log(spark, d)).select("event_id", "position", "delta")


@query(
    """, d as (select *, ms - lag(ms) over (partition by position order by ms, event_id) as delta from log), g as (select position, greatest(300000, 5 * quantile_cont(delta, 0.5)) as lim from d group by 1),
 s as (select d.*, sum(coalesce((delta > lim)::int, 0)) over (partition by position order by ms, event_id)::bigint as segment from d join g using (position))
 select position, segment, min(ms) as start_ms, max(ms) as end_ms, count(*) as n from s group by 1, 2""",
    "log",
)
def w2_segments(spark, d):
    return timeline.segments(log(spark, d))


@query("select event_id, coalesce(lead(ms) over (partition by position order by ms, event_id), ms + 1000) as end_ms from log", "log")
def w4_interval_end(spark, d):
    return timeline.interval_end(log(spark, d), 1000).select("event_id", "end_ms")


@query("select event_id, position, round(laeq, 6) as laeq from log where ms between (select min(ms) from log) + 3600000 and (select min(ms) from log) + 90000000", "log")
def f1_slice_time(spark, d):
    rows = log(spark, d)
    lo = rows.agg(F.min("ms").alias("lo"))
    # one row; the bounds are given the wrong way round
    return timeline.between(rows.join(F.broadcast(lo)), F.col("lo") + 90000000, F.col("lo") + 3600000).select("event_id", "position", "laeq")


@query("select position, count(*) as n, round(max(x), 6) as most from (select position, case event_id % 7 when 0 then 'nan'::double when 1 then 'inf'::double when 2 then '-inf'::double when 3 then null else laeq end as x from log) where x is not null and isfinite(x) group by 1", "log")
def f3_finite_only(spark, d):
    """Levels, of which some are missing, infinite or not numbers."""
    odd = F.col("event_id") % 7
    level = F.when(odd == 0, float("nan")).when(odd == 1, float("inf")).when(odd == 2, float("-inf")).when(odd > 3, F.col("laeq"))
    return log(spark, d).withColumn("x", L.finite(level)).where("x is not null").groupBy("position").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("most"))


@query("select a.region_id, count(*) as n, round(max(l.laeq), 6) as most from areas a join log l on l.position = a.position and l.ms between a.start_ms and a.end_ms group by 1", "log", "areas")
def j2_region_join(spark, d):
    rows = log(spark, d)
    met = asof.in_intervals(rows.select("position", "ms", "laeq"), areas(rows), "position")
    return met.groupBy("region_id").agg(F.count(F.lit(1)).alias("n"), F.max("laeq").alias("most"))


@query(
    """, p as (select marker_id, position, m.ms from markers m cross join (select distinct position from log))
 select p.marker_id, p.position, l.ms as at_ms, round(l.laeq, 6) as laeq from p left join lateral (select * from log l where l.position = p.position and l.ms <= p.ms order by l.ms desc, l.event_id desc limit 1) l on true""",
    "log", "markers",
)
def j1_asof_markers(spark, d):
    rows = log(spark, d)
    marks = rows.where("position = 'error'").select(F.col("event_id").alias("marker_id"), "ms")
    # the result has a row for each marker and position by definition
    points = marks.crossJoin(rows.select("position").distinct())
    return asof.last_at(points.select("position", "ms", "marker_id"), rows, "position", ["laeq"], order="event_id").select("marker_id", "position", "at_ms", "laeq")


@query(
    """, r as (select position, event_id as recording, ms as start_ms, ms + (laeq * 1000)::bigint as end_ms from log where event_id % 3 = 0),
 t as (select position, event_id, ms from log where event_id % 3 > 0), f as (select position, min(start_ms) as lo, min_by(recording, (start_ms, recording)) as first from r group by 1)
 select t.event_id, case when r.end_ms > t.ms then r.recording when t.ms < f.lo then f.first end as recording, case when r.end_ms > t.ms then t.ms - r.start_ms when t.ms < f.lo then 0 end as offset_ms
 from t left join f on f.position = t.position left join lateral (select * from r where r.position = t.position and r.start_ms <= t.ms order by start_ms desc, recording desc limit 1) r on true""",
    "log",
)
def j5_recording_at(spark, d):
    """A third of the rows are recordings, the others look for one of their position."""
    rows = log(spark, d).withColumnRenamed("position", "site")
    rec = rows.where("event_id % 3 = 0").select("site", F.col("event_id").alias("recording"), "ms", (F.col("ms") + F.round(F.col("laeq") * 1000).cast("long")).alias("end_ms"))
    points = rows.where("event_id % 3 > 0").select("site", "ms", "event_id")
    return asof.recording_at(points, rec.withColumnRenamed("ms", "start_ms"), "site").select("event_id", "recording", "offset_ms")


@query("select l.event_id, max_by(a.region_id, a.region_id) as region_id from log l join areas a on l.position = a.position and l.ms between a.start_ms and a.end_ms group by 1", "log", "areas")
def j8_region_at(spark, d):
    rows = log(spark, d)
    return asof.in_intervals(rows.select("position", "ms", "event_id"), areas(rows), "position").groupBy("event_id").agg(F.max("region_id").alias("region_id"))


@query("select a.region_id, p.position from areas a join (select distinct position from log) p on p.position <> a.position", "log", "areas")
def j10_copy_regions(spark, d):
    rows = log(spark, d)
    places = rows.select(F.col("position").alias("other")).distinct()
    # the result has a row for each region and other position by definition
    return areas(rows).crossJoin(places).where(F.col("other") != F.col("position")).select("region_id", F.col("other").alias("position"))


@query("select coalesce(a.position, b.position) as position, coalesce(a.k, b.k) as k, a.n as left_n, b.n as right_n from (select position, ms // 60000 as k, count(*) as n from log where event_id % 2 = 0 group by 1, 2) a full join (select position, ms // 60000 as k, count(*) as n from log where event_id % 2 = 1 group by 1, 2) b on a.position = b.position and a.k = b.k", "log")
def j7_align_reports(spark, d):
    rows = log(spark, d).withColumn("k", F.floor(F.col("ms") / 60000))
    side = lambda odd, n: rows.where(F.col("event_id") % 2 == odd).groupBy("position", "k").agg(F.count(F.lit(1)).alias(n))
    return timeline.aligned(side(0, "left_n"), side(1, "right_n"), ["position", "k"])


MERGED = """, o as (select *, case when start_ms <= max(end_ms) over (partition by position order by start_ms, end_ms rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from areas),
 i as (select *, sum(fresh) over (partition by position order by start_ms, end_ms rows unbounded preceding) as isl from o)""".replace("from areas)", "from areas where start_ms < end_ms)")


@query(MERGED + " select position, min(start_ms) as start_ms, max(end_ms) as end_ms from i group by position, isl", "log", "areas")
def u2_merge_intervals(spark, d):
    return regions.merged(areas(log(spark, d)), ["position"])


@query(MERGED + ", u as (select position, min(start_ms) as s, max(end_ms) as e from i group by position, isl) select position, sum(e - s)::bigint as duration_ms, count(*) as n from u group by 1", "log", "areas")
def a19_total_duration(spark, d):
    return regions.merged(areas(log(spark, d)), ["position"]).groupBy("position").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), F.count(F.lit(1)).alias("n"))


@query("select ms, min_by(event_id, event_id) as event_id from (select ms // 60000 * 60000 as ms, event_id from log where position = 'error') group by 1", "log")
def u5_dedupe_markers(spark, d):
    m = log(spark, d).where("position = 'error'").select((F.floor(F.col("ms") / 60000) * 60000).alias("ms"), "event_id")
    return timeline.merge_sources(m, ["ms"], ["event_id"])


ZONE = 19_800_000
NIGHTS = f""", z as (select position, lo, hi, (lo + {ZONE}) // 86400000 * 86400000 - {ZONE} as d0, (hi + {ZONE}) // 86400000 * 86400000 - {ZONE} as d1 from extent),
 d as (select position, lo, hi, unnest(range(d0, d1 + 1, 86400000)) as k from z),
 r as (select position, mode, greatest(k + a * 3600000, lo) as start_ms, least(k + b * 3600000, hi) as end_ms from d, (values ('daytime', 7, 23), ('nighttime', 23, 31)) as m(mode, a, b))"""
AREAS_TEXT = "string_agg(start_ms || '-' || end_ms, ',' order by start_ms)"


def areas_text(df):
    return df.select("position", "mode", "note", F.array_join(F.transform("areas", lambda a: F.concat_ws("-", a["start_ms"].cast("string"), a["end_ms"].cast("string"))), ",").alias("areas"))


@query(NIGHTS + f" select position, mode, upper(mode[1]) || mode[2:] || ' - ' || position as note, {AREAS_TEXT} as areas from r where start_ms < end_ms group by 1, 2", "log", "extent")
def r1_day_night_regions(spark, d):
    """One region a position and mode, in a zone five and a half hours ahead."""
    return areas_text(regions.auto_regions(extent(log(spark, d)), ["daytime", "nighttime"], zone="Asia/Kolkata"))


@query(NIGHTS + " select position, mode, 'Nighttime - ' || position || case when count(*) over (partition by position) > 1 then ' (' || row_number() over (partition by position order by start_ms) || ')' else '' end as note, start_ms || '-' || end_ms as areas from r where start_ms < end_ms and mode = 'nighttime'", "log", "extent")
def r1_night_regions(spark, d):
    return areas_text(regions.auto_regions(extent(log(spark, d)), ["nighttime"], zone="Asia/Kolkata"))


@query("select m.marker_id, l.position, count(*) as n, round(10 * log10(avg(pow(10.0, laeq / 10))), 6) as laeq from markers m join log l on l.ms between m.ms - 1800000 and m.ms + 1800000 group by 1, 2", "log", "markers")
def r4_event_windows(spark, d):
    rows = log(spark, d)
    return asof.window_levels(rows.where("position = 'error'").select(F.col("event_id").alias("marker_id"), "ms"), rows, "marker_id")


@query("select event_id, round(w, 6) as window_ms, case when s > 0 then ceil(round(w / s, 9))::bigint end as bins from (select event_id, s, case when s is null or s <= 0 then 900000 else least(greatest(900000 + (s - 100) / 900 * 2700000, 900000), 3600000) end as w from (select event_id, case when event_id % 7 = 0 then 0.0 when event_id % 11 = 0 then null else event_id * 1.0 end as s from log))", "log")
def v1_log_window(spark, d):
    step = F.when(F.col("event_id") % 7 == 0, 0.0).when(F.col("event_id") % 11 != 0, F.col("event_id") * 1.0)
    return log(spark, d).select("event_id", L.log_window_ms(step).alias("window_ms"), L.log_window_bins(step).alias("bins"))


@query("""select *, ratio >= 0.98 as adequate from (select a.region_id, round(case when a.end_ms > a.start_ms then greatest(0, least(a.end_ms, e.hi) - greatest(a.start_ms, e.lo)) / (a.end_ms - a.start_ms)::double else (a.start_ms between e.lo and e.hi)::int end, 6) as ratio
 from (select region_id, position, start_ms, case when region_id % 9 = 0 then start_ms else end_ms end as end_ms from areas) a join extent e using (position))""".replace("select *, ratio", "select region_id, ratio::double as ratio, ratio"), "log", "areas", "extent")
def v4_coverage_ratio(spark, d):
    rows = log(spark, d)
    a = areas(rows).withColumn("end_ms", F.when(F.col("region_id") % 9 == 0, F.col("start_ms")).otherwise(F.col("end_ms")))
    ratio = L.coverage(F.col("start_ms"), F.col("end_ms"), F.col("lo"), F.col("hi"))
    return a.join(extent(rows), "position").select("region_id", ratio.alias("ratio"), (F.round(ratio, 6) >= 0.98).alias("adequate"))


@query("select position, ms, freq_hz, round_even(level, 0)::smallint as level from spectra", "spectra")
def v6_quantise_levels(spark, d):
    return spectrogram.quantise(spectra(spark, d))


RASTER = """, t as (select distinct position, ms from spectra),
 n as (select *, lead(ms) over w as e, row_number() over w - 1 as i, count(*) over (partition by position) as n, min(ms) over (partition by position) as t0, (max(ms) over (partition by position) - min(ms) over (partition by position)) / 40.0 as w from t window w as (partition by position order by ms)),
 p as (select position, ms, unnest(case when n = 40 then range(i, i + 1) when n = 1 then range(40) else range(least(floor((ms - t0) / w)::bigint, 39), least(greatest(ceil((coalesce(e, ms + 1000) - t0) / w)::bigint, least(floor((ms - t0) / w)::bigint, 39) + 1), 40)) end) as bin from n),
 painted as (select position, freq_hz, bin, max(level) as level from spectra join p using (position, ms) group by 1, 2, 3),
 c as (select g.position, g.freq_hz, g.bin, greatest(level, 40.0::double) as level from (select distinct position, freq_hz, unnest(range(40)) as bin from spectra) g left join painted using (position, freq_hz, bin))"""


def canvas(spark, d):
    return spectrogram.rasterise(spectra(spark, d), 40, 1000, fill=40)


@query(RASTER + " select position, freq_hz, bin, round(level, 6) as level from c", "spectra")
def v7_rasterise(spark, d):
    return canvas(spark, d)


@query(RASTER + " select position, freq_hz, string_agg(round_even(level, 0)::int::varchar, ',' order by bin) as levels from c group by 1, 2", "spectra")
def v11_pack_spectrogram(spark, d):
    cells = canvas(spark, d).withColumn("level", F.rint("level").cast("int"))
    return spectrogram.pack(cells).withColumn("levels", F.array_join(F.col("levels").cast("array<string>"), ","))


@query(
    """select dir, count(*) as files, sum(bytes)::bigint as bytes, count(distinct ext)::bigint as kinds from (select regexp_extract(url, '^(.*)/[^/]*$', 1) as dir, coalesce(regexp_extract(url, '\\.([a-z]+)$', 1), '') as ext, strlen(html) as bytes from pages where url is not null) group by 1"""
)
def a16_folder_totals(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").where("url is not null")
    x = p.select(F.regexp_extract("url", "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("url", r"\.([a-z]+)$", 1).alias("ext"), F.octet_length("html").alias("bytes"))
    return x.groupBy("dir").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.countDistinct("ext").alias("kinds"))


@query(f"select position, window_start, {ENERGY.format('laeq')} as laeq, round(max(lafmax), 6) as lafmax, count(*) as n from (select *, ms // 300000 * 300000 as window_start from log) where window_start + 300000 <= (select max(ms) from log) - 3600000 group by 1, 2", "log")
def t2_stream_leq(spark, d):
    return streams.stream_leq(spark, d)
