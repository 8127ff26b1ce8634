"""Queries that write trees of files from the supplied tables, list them, and read a few bytes of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundtally.plans.base import log, query
from soundtally.sources import added, folders
from soundtally.sources import lines as T
from soundtally.sources.place import shared_dir

# Paths of files made from the pages table's rows: the path, and its visit, position, session, instrument, role, whether it has bands, and reader.
TREE = [
    ("Yard B/april_2033/W{d}/2033-04-02_SLM_01{d}_RTA_3rd_Log.txt", "april_2033", "W{d}", "2033-04-02_SLM_01{d}", "session", "log", True, "nti"),
    ("Fourth round/7-{d}/2033-04-02_SLM_02{d}_123_Report.txt", "Fourth round", "7-{d}", "2033-04-02_SLM_02{d}", "session", "summary", False, "nti"),
    ("Mill lane/Gate {d}/Mill_summary.csv", "Mill lane", "Gate {d}", "", "stem", "summary", None, "svan"),
    ("W2{d}/Pump_log_1s.csv", "", "W2{d}", "", "stem", "log", None, "svan"),
    ("loud/Q{d}/R{e}.wav", "loud", "Q{d}", None, None, None, None, None),
    ("sheets/{d}.docx", None, None, None, None, None, None, None),
]


def in_sql(i: int) -> str:
    def text(v):
        if isinstance(v, bool) or v is None:
            return "null" if v is None else str(v).lower()
        return "replace(replace('" + v + "', '{d}', (page_id % 10)::varchar), '{e}', (page_id // 10 % 7)::varchar)"

    return f"case page_id % {len(TREE)} " + " ".join(f"when {k} then {text(c[i])}" for k, c in enumerate(TREE)) + " end"


def tree(spark, d):
    """A folder with a file for each path of the pages table: a header, a time, the page and a later time for each of its rows; and configurations that list pages."""
    p = spark.read.parquet(f"{d}/pages.parquet")
    n = F.col("page_id")
    path = F.lit(None).cast("string")
    for i, (text, *_) in enumerate(TREE):
        path = F.when(n % len(TREE) == i, F.replace(F.replace(F.lit(text), F.lit("{d}"), (n % 10).cast("string")), F.lit("{e}"), (F.floor(n / 10) % 7).cast("string"))).otherwise(path)
    stamp = lambda s: F.date_format(F.timestamp_millis(F.lit(1_900_000_000_000) + s * 1000), "yyyy-MM-dd HH:mm:ss")
    content = F.concat(F.lit("Date & time,LAeq\n"), stamp(n * 60), F.lit(",50\n"), F.coalesce("html", F.lit("")), F.lit("\n"), stamp(n * 60 + (n % 10) * 1000), F.lit(",51"))
    pages = p.select(path.alias("path"), n.alias("line_no"), content.alias("line"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(n)), lambda x: x.cast("string")), ",")
    key = F.when(F.col("k") % 3 == 0, "sources").when(F.col("k") % 3 == 1, "sourceConfigs").otherwise("other")
    jobs = p.groupBy((n % 20).alias("k")).agg(ids.alias("ids")).select(F.concat(F.lit("job/"), F.col("k").cast("string"), F.lit(".json")).alias("path"), F.lit(0).cast("long").alias("line_no"), F.concat(F.lit('{"'), key, F.lit('":['), F.col("ids"), F.lit("]}")).alias("line"))
    place = shared_dir(spark) + "/survey"
    T.write_lines(pages.unionByName(jobs), place)
    return place


STAMP = "strftime(epoch_ms(1900000000000 + ({0}) * 1000), '%Y-%m-%d %H:%M:%S')"
PAGE = f"'Date & time,LAeq' || chr(10) || {STAMP.format('page_id * 60')} || ',50' || chr(10) || coalesce(html, '') || chr(10) || {STAMP.format('page_id * 60 + page_id % 10 * 1000')} || ',51'"
BELOW = f"""with f as (select page_id, {in_sql(0)} as path, strlen({PAGE}) + 1 as bytes, {', '.join(f'{in_sql(i)} as {c}' for i, c in enumerate(('visit', 'position', 'session', 'instrument', 'role', 'spectral', 'reader'), 1))} from pages),
 j as (select 'job/' || k || '.json' as path, k, strlen(t) + 1 as bytes from (select page_id % 20 as k, '{{"' || case page_id % 20 % 3 when 0 then 'sources' when 1 then 'sourceConfigs' else 'other' end || '":[' || string_agg(page_id, ',' order by page_id) || ']}}' as t from pages group by page_id % 20)),
 t as (select path, sum(bytes)::bigint as bytes, any_value(visit) as visit, any_value(position) as position, any_value(session) as session, any_value(instrument) as instrument, any_value(role) as role, any_value(spectral) as spectral, any_value(reader) as reader,
  1900000000000 + 60000 * min(page_id) as a, 1900000000000 + 1000 * (max(page_id) * 60 + max(page_id) % 10 * 1000) as b from f group by 1)"""


@query(BELOW + " select path, bytes from t union all select path, bytes::bigint from j")
def s14_list_folder(spark, d):
    return folders.listing(spark, tree(spark, d)).select("path", "bytes")


@query(
    BELOW
    + """ select path, 'file' as kind, 1::bigint as files, bytes, reader, visit, position, session, instrument, role, spectral, a as start_ms, b as end_ms, (b - a) / 1000 as duration_s, b - a < 3600000 as spot, b - a >= 3600000 as recommended from t where reader is not null
 union all select regexp_extract(path, '^(.*)/[^/]*$', 1), 'audio', count(*), sum(bytes)::bigint, 'audio', any_value(visit), any_value(position), '', '', 'audio', null, null, null, null, false, true from t where path like '%.wav' group by 1
 union all select path, 'config', 1, bytes::bigint, 'config', null, null, null, null, null, null, null, null, null, false, true from j where k % 3 < 2"""
)
def s14_survey_folder(spark, d):
    """What a survey's folder has, found from its listing and from the ends of its files."""
    return folders.survey(spark, tree(spark, d))


def logs(spark, d):
    """The level log in files of a position and an hour of the day, in order of time; their headers name bands for positions of long names."""
    rows = log(spark, d).join(spark.read.parquet(f"{d}/events.parquet").select("event_id", "props"), "event_id")
    hour = F.floor(F.col("ms") / 3_600_000) % 24
    path = F.concat_ws("_", "position", hour.cast("string"))
    stamp = F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd HH:mm:ss")
    body = rows.select(path.alias("path"), F.struct("ms", "event_id").alias("line_no"), F.concat_ws(",", stamp, F.col("event_id").cast("string"), F.coalesce("props", F.lit(""))).alias("line"))
    name = F.when(F.length("position") > 5, F.concat(F.lit("LZeq_"), F.length("position").cast("string"))).otherwise("id")
    heads = rows.select(path.alias("path"), F.concat(F.lit("Date & time,"), name, F.lit(",props")).alias("line")).distinct()
    place = shared_dir(spark) + "/logs"
    T.write_lines(body.unionByName(heads.select("path", F.struct(F.lit(-1).cast("long").alias("ms"), F.lit(-1).cast("long").alias("event_id")).alias("line_no"), "line")), place)
    return place


LOGS = """, h as (select l.position || '_' || (ms // 3600000 % 24) as path, position, ms, event_id, strlen(strftime(epoch_ms(ms::bigint), '%Y-%m-%d %H:%M:%S') || ',' || event_id || ',' || coalesce(props, '')) + 1 as n from log l join events using (event_id)),
 k as (select path, 'Date & time,' || case when length(any_value(position)) > 5 then 'LZeq_' || length(any_value(position)) else 'id' end || ',props' as header, any_value(position) as position from h group by 1)"""


@query(LOGS + " select path, min(ms) // 1000 * 1000 as start_ms, max(ms) // 1000 * 1000 as end_ms, (sum(n) + strlen(any_value(header)) + 1)::bigint as bytes, case when sum(n) + strlen(any_value(header)) + 1 > 8192 then 16384 else sum(n) + strlen(any_value(header)) + 1 end::bigint as bytes_read from h join k using (path) group by 1", "log")
def s19_probe_spans(spark, d):
    """First and last time of each file, of which at most 8 KiB from each end are read."""
    found = folders.listing(spark, logs(spark, d))
    return folders.probed(folders.ends(found)).select("path", "start_ms", "end_ms", "bytes", "bytes_read")


@query(LOGS + """ , o as (select path, ms // 1000 * 1000 as s, row_number() over (partition by path order by ms, event_id) as i from h),
 g as (select path, s - lag(s) over (partition by path order by i) as g from o where i <= 32)
 select path, replace(header, ',', '|') as columns, length(position) > 5 as spectral, coalesce(median(g) filter (g > 0), 0)::double as step_ms from k left join g using (path) group by 1, 2, 3""", "log")
def s20_peek_headers(spark, d):
    """Columns, bands and cadence of each file from its head."""
    found = folders.listing(spark, logs(spark, d))
    return folders.peeked(folders.ends(found)).select("path", F.array_join("columns", "|").alias("columns"), "spectral", "step_ms")


def seconds_and_level():
    """The reader of a made-up layout: lines of milliseconds, a semicolon and a level."""

    def parse(head, lines):
        for line in lines:
            ms, _, level = line.partition(";")
            yield int(ms), "LAeq", None, float(level)

    return parse


@query("select position, ms, 'LAeq' as name, round(laeq, 6) as level from log", "log")
def s_added_block_reader(spark, d):
    """The level log in a layout of a user's own, read by an added data source in blocks of 64 KiB."""
    place = shared_dir(spark) + "/own"
    body = log(spark, d).select("position", F.concat_ws(";", F.col("ms").cast("string"), F.col("laeq").cast("string")).alias("value"))
    body.write.partitionBy("position").text(place)
    added.register(spark, added.block_source("own_logs", seconds_and_level(), ".txt"))
    rows = spark.read.format("own_logs").option("block", 1 << 16).load(place)
    return rows.select(F.regexp_extract("path", "position=([^/]*)/", 1).alias("position"), "ms", "name", "level")
