"""Queries over listings of files: names, groups, visits, job configurations; clock times and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundtally.functions import levels as L
from soundtally.functions import texts as X
from soundtally.plans.base import areas, log, query, spectra
from soundtally.sources import annotations as A
from soundtally.sources import clock
from soundtally.sources import names as N
from soundtally.sources import inventory as I

# Paths of files made from the pages table's rows: the path, its visit and position.
CASES = [
    ("Job A/march_2031/K900/2024-05-13_SLM_00{d}_RTA_3rd_Log.txt", "march_2031", "K900", "session", "log", True),
    ("Round Two/44-{d}/2024-05-13_SLM_00{d}_123_Report.txt", "Round Two", "44-{d}", "session", "summary", False),
    ("Harbour Mews/Quay summary {d}/Quay_summary.csv", "Harbour Mews", "Quay summary {d}", "stem", "summary", None),
    ("K90{d}/Pier_log_1s.csv", "", "K90{d}", "stem", "log", None),
    ("2031 works/Dock {d}_log.csv", "2031 works", "Dock {d}", "stem", "log", None),
    ("audio/P{d}/R{n}.wav", "audio", "P{d}", None, None, None),
]


def listing(spark, d):
    """(path, bytes, lo, hi) of a file for every page."""
    p = spark.read.parquet(f"{d}/pages.parquet")
    n, digit = F.col("page_id"), (F.col("page_id") % 10).cast("string")
    path = F.lit(None).cast("string")
    for i, (text, *_) in enumerate(CASES):
        path = F.when(n % len(CASES) == i, F.replace(F.replace(F.lit(text), F.lit("{d}"), digit), F.lit("{n}"), n.cast("string"))).otherwise(path)
    return p.select("page_id", path.alias("path"), F.octet_length("html").cast("long").alias("bytes"), (n * 1000).alias("lo"), (n * 1000 + F.when(n % 3 == 0, n * 1000).otherwise(F.lit(7_200_000))).alias("hi"))


def case(i):
    def text(v):
        if v is None:
            return "null"
        return str(v).lower() if isinstance(v, bool) else "replace(replace('" + v + "', '{d}', (page_id % 10)::varchar), '{n}', page_id::varchar)"

    return f"case page_id % {len(CASES)} " + " ".join(f"when {k} then {text(c[i])}" for k, c in enumerate(CASES)) + " end"


FILES = f"(select page_id, {case(0)} as path, strlen(html) as bytes, page_id * 1000 as lo, page_id * 1000 + case when page_id % 3 = 0 then page_id * 1000 else 7200000 end as hi, {case(1)} as visit, {case(2)} as position, {case(3)} as instrument, {case(4)} as role, {case(5)} as spectral from pages)"
GROUPS = f"(select visit, position, case when instrument = 'session' then regexp_extract(path, '[^/]*_SLM_\\d+') else '' end as session, coalesce(string_agg(distinct role, ', ' order by role), '') as roles, coalesce(bool_or(spectral), false) as spectral, min(lo) as lo, max(hi) as hi, round(max(hi - lo) / 1000.0, 6) as duration_s, sum(bytes)::bigint as bytes, max(hi - lo) < 3600000 as spot from {FILES} group by 1, 2, 3)"


@query(f"select page_id, visit, position, instrument, role, spectral from {FILES}")
def s14_file_facts(spark, d):
    return I.facts(listing(spark, d)).select("page_id", "visit", "position", "instrument", "role", "spectral")


LISTED = f"""(select path, bytes, null as content from {FILES} union all select 'job/' || page_id || '.json', strlen(html), case when page_id % 3 = 0 then '{{"sources": []}}' when page_id % 3 = 1 then '{{"sourceConfigs": [1]}}' else '{{"other": 1}}' end from pages
 union all select 'notes/' || page_id || '.docx', strlen(html), null from pages)"""


@query(f"""select path, 1::bigint as files, bytes::bigint as bytes, case when path like '%.json' then 'config' else 'file' end as kind from {LISTED} where regexp_matches(path, '\\.(csv|txt|json)$') and (content is null or content like '%ources": [%' or content like '%sourceConfigs": [%')
 union all select regexp_extract(path, '^(.*)/[^/]*$', 1), count(*), sum(bytes)::bigint, 'audio' from {FILES} where path like '%.wav' group by 1""")
def s14_scan_listing(spark, d):
    """Besides the survey's files some JSON files, of which two thirds are configurations, and files of another kind."""
    p = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("n"), F.octet_length("html").cast("long").alias("bytes"))
    text = F.when(F.col("n") % 3 == 0, '{"sources": []}').when(F.col("n") % 3 == 1, '{"sourceConfigs": [1]}').otherwise('{"other": 1}')
    json = p.select(F.format_string("job/%d.json", "n").alias("path"), "bytes", text.alias("content"))
    odd = p.select(F.format_string("notes/%d.docx", "n").alias("path"), "bytes", F.lit(None).cast("string").alias("content"))
    return I.scanned(listing(spark, d).select("path", "bytes", F.lit(None).cast("string").alias("content")).unionByName(json).unionByName(odd))


def grouped(spark, d):
    return I.groups(I.facts(listing(spark, d)))


@query(f"select *, not spot as recommended from {GROUPS}")
def a13_survey_groups(spark, d):
    return grouped(spark, d).drop("instruments")


@query(f"select *, row_number() over (order by hi desc nulls last, visit) as place from (select visit, count(*) as positions, count(*) filter (not spot) as recommended, min(lo) as lo, max(hi) as hi from {GROUPS} group by 1)")
def a14_visit_summary(spark, d):
    return I.visits(grouped(spark, d))


@query(f"select visit, position, session, case roles when '' then 'data' when 'log, summary' then 'log + summary' else replace(roles, ', ', ' + ') end as contents from {GROUPS}")
def a13_group_contents(spark, d):
    return I.described(grouped(spark, d)).select("visit", "position", "session", "contents")


@query(f"select position, coalesce(role, 'audio') as kind, count(*) as n from {FILES} group by 1, 2")
def a15_source_counts(spark, d):
    return I.facts(listing(spark, d)).groupBy("position", F.coalesce("role", F.lit("audio")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"select position, coalesce(string_agg(distinct instrument, ',' order by instrument), '') as instruments, coalesce(string_agg(distinct role, ',' order by role), '') as roles from {FILES} group by 1")
def a17_position_facts(spark, d):
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",").alias(c + "s")
    return I.facts(listing(spark, d)).groupBy("position").agg(names("instrument"), names("role"))


@query(f"select row_number() over (order by spot, visit, position, session) as place, visit, position, session from {GROUPS} qualify place <= 10")
def o4_first_groups(spark, d):
    """The ten groups that a report lists first."""
    first = grouped(spark, d).orderBy("spot", "visit", "position", "session").limit(10)
    return first.agg(F.array_sort(F.collect_list(F.struct("spot", "visit", "position", "session"))).alias("g")).select(F.posexplode("g").alias("i", "g")).select((F.col("i") + 1).cast("long").alias("place"), "g.visit", "g.position", "g.session")


JOB = "page_id % 3 as c, case when page_id % 4 > 0 then 'LAeq' || case page_id % 4 when 2 then ',LAF90' else '' end end as columns, case when page_id % 2 = 0 then 'Level' end as axis"


@query(
    f"""select position, columns, profile, axis, low, coalesce(string_agg(distinct path, ',' order by path) filter (there), '') as paths, count(distinct path) filter (not there) as missing from
 (select position, coalesce(case when page_id % 4 > 0 then 'LAeq' || case page_id % 4 when 2 then ',LAF90' else '' end end, '') as columns, role as profile, case when page_id % 2 = 0 then 'Level' end as axis, case when page_id % 2 = 0 then 30.0::double end as low, 'job/' || path as path, 'job/' || path in (select 'job/' || path from {FILES} where role is not null and page_id % 10 <> 3) as there
  from {FILES} where page_id % 5 <> 2 and role is not null and path not like '%.wav') group by 1, 2, 3, 4, 5"""
)
def s15_read_job_config(spark, d):
    """A configuration for each ten pages, as JSON text; files of pages that end in 3 aren't listed."""
    f = I.facts(listing(spark, d)).where("role is not null")
    n = F.col("page_id")
    columns = F.when(n % 4 == 2, F.array(F.lit("LAeq"), F.lit("LAF90"))).when(n % 4 > 0, F.array(F.lit("LAeq")))
    source = F.struct("path", "position", F.col("role").alias("profile"), (n % 5 != 2).alias("enabled"), columns.alias("columns"), F.when(n % 2 == 0, "Level").alias("axis"), F.when(n % 2 == 0, 30.0).alias("low"))
    text = f.groupBy(F.floor(n / 10)).agg(F.to_json(F.struct(F.lit("job").alias("base"), F.collect_list(source).alias("sources"))).alias("json"))
    schema = "base string, sources array<struct<path string, position string, reader string, columns array<string>, profile string, axis string, low double, high double, enabled boolean>>"
    configs = text.select(F.from_json("json", schema).alias("c")).select("c.*")
    there = f.where("page_id % 10 <> 3").select(F.concat(F.lit("job/"), F.col("path")).alias("path"))
    return I.job_sources(configs, there).select("position", "columns", "profile", "axis", "low", F.array_join("paths", ",").alias("paths"), "missing")


@query(
    """select event_type as path, event_id as line_no, local, case when local < timestamp '2024-03-31 01:00:00' then local when local < timestamp '2024-03-31 02:00:00' then timestamp '2024-03-31 01:00:00' else local - interval 1 hour end as utc
 from (select *, ts + interval 70 day as local from events)"""
)
def w3_local_to_utc(spark, d):
    """The log's times, moved by 70 days to cross a change of the clock, taken for local ones."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("path"), F.col("event_id").alias("line_no"), (F.col("ts").cast("timestamp_ntz") + F.expr("interval 70 days")).alias("local"))
    return clock.to_utc(e, "Europe/London")


T = "strftime(epoch_ms({0}::bigint), '%Y-%m-%d %H:%M:%S.%g')"
CLOCK = "strftime(epoch_ms({0}::bigint), '%H:%M:%S.%g')"


@query(
    f"""select event_id, {T.format("ms")} as utc_text, ms as again_ms, case when s <= 0 then '0s' when s >= 60 then (s // 60) || 'm' || (s % 60) || 's' else s || 's' end as duration, round(floor(laeq * 1000 + 0.5) / 1000, 6) as laeq3,
 {CLOCK.format("least(ms, ms - 5000 + event_id * 7)")} || '-' || {CLOCK.format("greatest(ms, ms - 5000 + event_id * 7)")} as range_text, ms // 1000 * 1000 as comma_ms,
 case when x < 90 then round_even(x, 0)::bigint || ' s' when x < 5400 then round_even(x / 60, 0)::bigint || ' min' when x < 172800 then printf('%.1f', round_even(x / 3600, 1)) || ' h' else printf('%.1f', round_even(x / 86400, 1)) || ' d' end as span from (select *, event_id * 7 as s, event_id * 31.0 as x from log)""",
    "log",
)
def x_text_and_time(spark, d):
    rows = log(spark, d)
    text = A.utc_text(F.col("ms"))
    comma = F.date_format(F.timestamp_millis("ms"), " yyyy-MM-dd , HH:mm:ss")
    return rows.select(
        "event_id", text.alias("utc_text"), A.utc_ms(text).alias("again_ms"), L.duration_text(F.col("event_id") * 7000).alias("duration"), L.half_up3(F.col("laeq")).alias("laeq3"),
        X.time_range(F.col("ms"), F.col("ms") - 5000 + F.col("event_id") * 7).alias("range_text"), X.date_comma_time_ms(comma).alias("comma_ms"), L.span_text(F.col("event_id") * 31.0).alias("span"),
    )


@query(
    f"""select region_id, 'Region ' || region_id || ', ' || a.position || ', ' || {CLOCK.format("start_ms")} || '-' || {CLOCK.format("end_ms")} || ', ' || case when end_ms - start_ms <= 0 then '0s' when end_ms - start_ms >= 60000 then ((end_ms - start_ms) // 60000) || 'm' || ((end_ms - start_ms) // 1000 % 60) || 's' else ((end_ms - start_ms) // 1000) || 's' end
 || ', LAeq ' || printf('%.1f', x) || ' dB, LAF90 ' || case when region_id % 2 = 0 then printf('%.1f', x) else 'N/A' end || ', LAFmax N/A dB' as summary from (select *, region_id % 500 * 1.25 as x from areas) a""",
    "log", "areas",
)
def x_region_summary(spark, d):
    a = areas(log(spark, d)).withColumn("x", F.bround(F.col("region_id") % 500 * 1.25, 1))
    span = F.array(F.struct("start_ms", "end_ms"))
    return a.select("region_id", X.region_summary(F.col("region_id"), F.col("position"), span, F.col("end_ms") - F.col("start_ms"), F.col("x"), F.when(F.col("region_id") % 2 == 0, F.col("x")), F.lit(None).cast("double")).alias("summary"))


@query("select position, ms, 'Band' || chr(9) || 'LAeq (dB)' || chr(10) || string_agg(freq_hz || ' Hz' || chr(9) || case when freq_hz % 7 = 0 then 'N/A' else printf('%.1f', freq_hz * 1.5) end, chr(10) order by freq_hz) as text from spectra group by 1, 2", "spectra")
def x_spectrum_text(spark, d):
    level = F.when(F.col("freq_hz") % 7 == 0, float("nan")).otherwise(F.col("freq_hz") * 1.5)
    s = spectra(spark, d).groupBy("position", "ms").agg(F.array_sort(F.collect_list(F.struct("freq_hz", F.concat(F.col("freq_hz").cast("string"), F.lit(" Hz")).alias("label"), level.alias("level")))).alias("s"))
    return s.select("position", "ms", X.spectrum_text(F.transform("s", lambda b: F.struct(b["label"].alias("label"), b["level"].alias("level")))).alias("text"))


# Names of meter files made from the pages table's rows: the name, its position and kind.
METERS = [
    ("4410 K{d}_2033_09_27__06h05m40s_log.csv", "4410 K{d}", "sentry"),
    ("86 East Weir gate {d}_2032_12_30__21h50m15s_summary.csv", "86 East Weir gate {d}", "sentry"),
    ("L9{d}_log.csv", "L9{d}", "svan"),
    ("x{d}_summary.csv", None, "svan"),
    ("2033-02-19_SLM_01{d}_RTA_3rd_Log.txt", None, "nti"),
    ("R{d}.WAV", None, None),
]


def meter(i):
    text = lambda v: "null" if v is None else "replace('" + v + "', '{d}', (page_id % 10)::varchar)"
    return f"case page_id % {len(METERS)} " + " ".join(f"when {k} then {text(c[i])}" for k, c in enumerate(METERS)) + " end"


@query(f"select page_id, {meter(1)} as position, {meter(2)} as kind, case when page_id % 3 = 0 then (page_id + 100)::varchar when page_id % 3 = 1 then (page_id + 1000)::varchar end as job, case page_id % 3 when 0 then 'Ab Cd' when 1 then '9 ab' else '' end as cleaned from pages")
def x_names(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    n, digit = F.col("page_id"), (F.col("page_id") % 10).cast("string")
    name = F.lit(None).cast("string")
    for i, (text, *_) in enumerate(METERS):
        name = F.when(n % len(METERS) == i, F.replace(F.lit(text), F.lit("{d}"), digit)).otherwise(name)
    number = lambda more: (n + more).cast("string")
    path = F.when(n % 3 == 0, F.concat(F.lit("5555 job/"), number(100), F.lit(" part/12.csv"))).when(n % 3 == 1, F.concat(number(1000), F.lit("-x\\sub\\a.csv"))).otherwise("12 x/a100.csv")
    raw = F.when(n % 3 == 0, "  ab Cd ").when(n % 3 == 1, "9 ab")
    return p.select("page_id", X.meter_position(name).alias("position"), X.source_kind(name).alias("kind"), X.job_number(path).alias("job"), X.clean_position(raw).alias("cleaned"))


@query("select event_id, round(greatest(0, least(1, (laeq - lo) / greatest(hi - lo, 1))), 6) as heat from log join (select position, min(laeq) as lo, max(laeq) as hi from log group by 1) using (position)", "log")
def x_heat(spark, d):
    rows = log(spark, d)
    r = rows.groupBy("position").agg(F.min("laeq").alias("lo"), F.max("laeq").alias("hi"))
    return rows.join(r, "position").select("event_id", L.heat(F.col("laeq"), F.col("lo"), F.col("hi")).alias("heat"))


# Names of files made from the pages table's rows: the name, a reader that is asked for, its first lines, and what follows.
ROUTES = [
    ("Site_{n}_RTA_3rd_Log.txt", None, [], "nti", "log"),
    ("Site_{n}_123_Rpt_Report.txt", None, [], "nti", "overview"),
    ("P{n}_2024_05_13__09h00m00s.csv", None, [], "sentry", None),
    ("L{n} summary.csv", None, ["A", "P1 (TH)"], "svan", "log"),
    ("L{n}_SUMMARY.csv", None, ["P1 (TH)"], "svan", "overview"),
    ("L{n}_log_1s.csv", None, ["P1 (SR)"], "svan", "log"),
    ("my {n} overview.xlsx", None, ["B (SR)"], "svan", "overview"),
    ("L{n}.svl", None, ["B"], "svan", "unknown"),
    ("R{n}.wav", None, [], "audio", None),
    ("R{n}.wav", " Noise-Sentry", [], "sentry", None),
    ("x{n} overview.dat", "PLOT_LINES_only", [], "generic", "overview"),
    ("x{n}_log.dat", "line only", [], None, "log"),
    ("x{n}.dat", "generic", [], "generic", None),
    ("x{n}_Log.csv", "magic", ["A"], "svan", "log"),
]


def route(i):
    text = lambda v: "null" if v is None else "replace('" + v + "', '{n}', page_id::varchar)"
    return f"case page_id % {len(ROUTES)} " + " ".join(f"when {k} then {text(c[i])}" for k, c in enumerate(ROUTES)) + " end"


@query(f"select page_id, {route(0)} as path, {route(3)} as reader, coalesce({route(4)}, case when page_id % 120 > 60 then 'overview' else 'log' end) as profile from pages")
def s9_route_source(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    n = F.col("page_id")
    name, asked, top = F.lit(None).cast("string"), F.lit(None).cast("string"), F.array().cast("array<string>")
    for i, (text, forced, lines, *_) in enumerate(ROUTES):
        here = n % len(ROUTES) == i
        name = F.when(here, F.replace(F.lit(text), F.lit("{n}"), n.cast("string"))).otherwise(name)
        asked = F.when(here, F.lit(forced)).otherwise(asked)
        top = F.when(here, F.array(*map(F.lit, lines)).cast("array<string>")).otherwise(top)
    files = N.routed(p.select("page_id", name.alias("path"), asked.alias("forced"), top.alias("top")))
    return files.select("page_id", "path", "reader", N.profile(F.col("path"), F.col("reader"), F.col("top"), (n % 120).cast("double")).alias("profile"))


@query(
    """with f as (select page_id, 'a' || page_id % 4 || '/' || case page_id % 5 when 0 then 'R' || page_id || '.WAV' when 1 then 'run_Audio_x_' || lpad((page_id)::varchar, 6, '0') || '.wav' when 2 then 'r' || page_id || 'b.wav' when 3 then 'loud' || page_id || '.wav' else 'R' || page_id || '.txt' end as path, strlen(html) as bytes from pages),
 k as (select *, case when page_id % 5 < 2 then page_id end as no from f where page_id % 5 < 3 and page_id % 7 > 0)
 select path, regexp_extract(path, '^(.*)/', 1) as folder, no as recording_no, round(bytes / 1048576.0, 2) as size_mb, ((page_id * 1234 + 500) // 1000 * 1000)::bigint as end_ms, (page_id % 7)::double as duration_s, row_number() over (partition by regexp_extract(path, '^(.*)/', 1) order by no is null, no, path) as rank from k"""
)
def s8_list_recordings(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    n, t = F.col("page_id"), F.col("page_id").cast("string")
    name = F.when(n % 5 == 0, F.concat(F.lit("R"), t, F.lit(".WAV"))).when(n % 5 == 1, F.concat(F.lit("run_Audio_x_"), F.lpad(t, 6, "0"), F.lit(".wav"))).when(n % 5 == 2, F.concat(F.lit("r"), t, F.lit("b.wav"))).when(n % 5 == 3, F.concat(F.lit("loud"), t, F.lit(".wav"))).otherwise(F.concat(F.lit("R"), t, F.lit(".txt")))
    files = p.select(F.concat(F.lit("a"), (n % 4).cast("string"), F.lit("/"), name).alias("path"), F.octet_length("html").alias("bytes"), (n * 1234).alias("modified_ms"), (n % 7).cast("double").alias("duration_s"))
    return N.recordings(files)
