"""Queries that write the level log as files of a layout, read these files, and return what was read."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundtally.functions import levels as L
from soundtally.operators import timeline
from soundtally.plans.base import ENERGY, SQL, VIEWS, log, query
from soundtally.sources import headers
from soundtally.sources import lines as T
from soundtally.sources import overview
from soundtally.sources import readers
from soundtally.sources.place import shared_dir

DAY = L.DAY_MS
CUTOFF = "2024-01-15 00:00:00"
SECTIONS = ["# Hardware Configuration", "Serial number:\tA2", "Note: a: b", "# Measurement Setup", "Profile:\tFull"]


def files(spark, d):
    """The log with a file's name for each position and day, and date and time as text."""
    rows = log(spark, d)
    at = F.timestamp_millis("ms")
    return rows.withColumn("path", F.concat_ws("_", "position", (F.floor(F.col("ms") / DAY)).cast("string"))).withColumn("date", F.date_format(at, "yyyy-MM-dd")).withColumn("time", F.date_format(at, "HH:mm:ss.SSS"))


def reread(spark, rows, head, body, tail=()):
    """Files with these head and tail lines and a line for each row, written to the shared folder and read back."""
    paths = rows.select("path").distinct()
    fixed = lambda texts, first: paths.select("path", F.posexplode(F.array(*map(F.lit, texts))).alias("i", "line")).select("path", (F.col("i") + first).cast("long").alias("line_no"), "line")
    out = fixed(head, -100).unionByName(rows.select("path", F.col("event_id").alias("line_no"), body.alias("line")))
    if tail:
        out = out.unionByName(fixed(tail, 2**60))
    place = shared_dir(spark) + "/lines"
    T.write_lines(out, place)
    return T.read_lines(spark, place)


def tabbed(*cells):
    return F.concat_ws("\t", *[F.lit(c) if c == "" else F.col(c).cast("string") for c in cells])


def comma(*cells):
    return F.concat_ws(",", *[F.lit(c) if c == "" else F.col(c).cast("string") for c in cells])


def by_position(long):
    return long.select(F.substring_index("path", "_", 1).alias("position"), "ms", "name", "freq_hz", "level")


def union_sql(*parts):
    return " union all ".join(f"select position, ms, '{name}' as name, {hz}::double as freq_hz, round({x}, 6) as level from log" for name, hz, x in parts)


NONE = "null"


def three_rows(spark, d):
    head = ["Buffer,P1 (TH),P1 (A; Fast) (TH),1/3 Oct (TH),1/3 Oct (TH),", ",LAeq [dB],LAFmax,LZeq,LZeq,", "Date & time,,,31.5 Hz,1k Hz,"]
    rows = files(spark, d).withColumn("stamp", F.concat_ws(" ", "date", "time")).withColumn("low", F.col("laeq") + 1)
    return reread(spark, rows, ["Site", *head], comma("stamp", "laeq", "lafmax", "low", "lafmax", ""))


@query(union_sql(("LAeq", NONE, "laeq"), ("LAFmax", NONE, "lafmax"), ("LZeq", "31.5", "laeq + 1"), ("LZeq", "1000", "lafmax")), "log")
def s2_read_three_row_header(spark, d):
    return by_position(readers.three_row_header(three_rows(spark, d)))


@query(union_sql(("LAeq", NONE, "laeq"), ("LAF10", NONE, "lafmax")), "log")
def s3_read_plain_header(spark, d):
    rows = files(spark, d).withColumn("stamp", F.concat_ws("T", "date", "time"))
    return by_position(readers.plain_header(reread(spark, rows, ["Export", "Start time,LAeq,LA10,Note"], comma("stamp", "laeq", "lafmax", "position"))))


def sectioned(spark, d):
    head = [*SECTIONS, "# Broadband LOG Results", "Date\tTime\tTimer\tLAeq_dt\tLAFmax\tLAFmax", "[YYYY-MM-DD]\t[hh:mm:ss]\t[hh:mm:ss]\t[dB]\t[dB]\t[dB]"]
    return reread(spark, files(spark, d), head, tabbed("date", "time", "", "laeq", "lafmax", "laeq"), ["#CheckSum", "2024-01-01\t00:00:00\t\t1\t2\t3"])


@query(union_sql(("LAeq", NONE, "laeq"), ("LAFmax", NONE, "lafmax"), ("LAFmax_2", NONE, "laeq")), "log")
def s5_read_sectioned_broadband(spark, d):
    return by_position(readers.sectioned_broadband(sectioned(spark, d)))


@query(union_sql(("LZeq", "31.5", "laeq"), ("LZeq", "63", "lafmax")) + " union all " + union_sql(("LZFmax", "125", "laeq")), "log")
def s6_read_sectioned_bands(spark, d):
    titled = [*SECTIONS, "# RTA LOG Results LZeq_dt", "Date\tTime\tTimer\tBand [Hz]\t31.5\t63.0", "[YYYY-MM-DD]\t[hh:mm:ss]\t[hh:mm:ss]\t\t[dB]\t[dB]"]
    rows = files(spark, d)
    one = readers.sectioned_bands(reread(spark, rows, titled, tabbed("date", "time", "", "", "laeq", "lafmax"), ["#CheckSum", "x"]))
    untitled = [*SECTIONS, "# RTA LOG Results", "\t\t\tLZFmax_dt", "Date\tTime\tTimer\t125.0", "[YYYY-MM-DD]\t[hh:mm:ss]\t[hh:mm:ss]\t[dB]"]
    two = readers.sectioned_bands(reread(spark, rows, untitled, tabbed("date", "time", "", "laeq"), ["#CheckSum", "x"]))
    return by_position(one.unionByName(two))


@query(union_sql(("level", NONE, "laeq"), ("peak", NONE, "lafmax")), "log")
def s7_read_generic(spark, d):
    """Two kinds of files: a column named Timestamp and semicolons; a nameless text column of times and commas."""
    rows = files(spark, d).withColumn("stamp", F.concat_ws(" ", "date", "time"))
    odd = F.floor(F.col("ms") / DAY) % 2 == 1
    body = F.concat_ws(";", F.col("laeq").cast("string"), "stamp", "position", F.col("lafmax").cast("string"))
    one = readers.generic(reread(spark, rows.where(odd), ["level;Timestamp;site;peak"], body))
    two = readers.generic(reread(spark, rows.where(~odd), ["", "when,level,peak,site"], comma("stamp", "laeq", "lafmax", "position")))
    return by_position(one.unionByName(two))


#: What begins the files of each position's reader, by the day modulo 4.
HEADS = {
    "click": ("sentry", [["", "Exported by LEQ", "  Time (Date hh:mm:ss.ms),LEQ dB-A,Lmax dB-A,L10 dB-A,L90 dB-A"], ["Time\tLEQ"], ["Odd level", "Time"], [" ", ""]]),
    "error": ("svan", [["Site 4", "", "Date & time,LAeq,LAFmax,LZeq"], ["SvanPC", "Box 3"], ["Box 3", "Start time, LAeq"], ["Box 3", "Box 4", "no mark"]]),
    "purchase": ("nti", [SECTIONS, ["# RTA Results", "x", "", "y", "z", "w"], ["a", "b", "c", "d"], [" "]]),
    "signup": ("generic", [["", "Timestamp,LAeq"], ["when,LAeq", "date"], ["Start TIME;" + "LAeq;" * 50], [""]]),
    "view": (None, [["nothing"], ["Date"], ["Time"], ["x"]]),
}
TEXTS = lambda x: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in x) + "]"
HEAD_ROWS = ", ".join(f"('{p}', {k}, {TEXTS(h)})" for p, (_, heads) in HEADS.items() for k, h in enumerate(heads))
RULE_ROWS = ", ".join(f"('{p}', '{r}', {TEXTS(headers.RULES[r].words)}, {headers.RULES[r].likely}, {headers.RULES[r].some}, {headers.RULES[r].header}, {headers.RULES[r].excerpt}, {str(headers.RULES[r].anywhere).lower()}, {TEXTS(headers.RULES[r].reasons)})" for p, (r, _) in HEADS.items() if r)


@query(
    f""", h(position, kind, head) as (values {HEAD_ROWS}), r(position, reader, words, likely, part, header, excerpt, anywhere, texts) as (values {RULE_ROWS}),
 f as (select distinct position, (ms // {DAY})::bigint as day from log), l as (select f.*, r.* exclude position, list_filter(h.head, lambda x: trim(x) <> '') as lines from f join h on h.position = f.position and h.kind = f.day % 4 left join r on r.position = f.position),
 c as (select *, coalesce(list_filter(lines, lambda x: header > 0 and len(list_filter(words, lambda w: contains(lower(x), w))) >= header)[1], lines[1], '') as line from l),
 n as (select *, len(list_filter(words, lambda w: case when anywhere then len(list_filter(lines, lambda x: contains(lower(x), w))) > 0 else contains(lower(line), w) end)) as matches from c)
 select position, day, coalesce(reader, 'none') as reader, coalesce(matches, 0)::int as matches,
 case when reader is null then 'unknown' when len(lines) = 0 and texts[1] <> '' then 'unlikely_valid' when matches >= likely then 'likely_valid' else 'needs_review' end as status,
 case when reader is null then '' when len(lines) = 0 and texts[1] <> '' then texts[1] when matches >= likely then replace(texts[2], '%d', matches::varchar) when matches >= part or reader = 'svan' and contains(lower(array_to_string(lines[1:5], ' ')), 'svan') then texts[3] else texts[4] end as reason,
 case when reader is null then '' when excerpt > 0 then array_to_string(lines[1:excerpt], chr(10)) when reader = 'sentry' then trim(line) else line[1:200] end as excerpt from n""",
    "log",
)
def s10_header_hint(spark, d):
    """Files of four layouts and of none, that begin as they should, in part, not at all, or with blank lines."""
    rows = files(spark, d).select("path", "position", F.floor(F.col("ms") / DAY).alias("day")).distinct()
    head = F.lit(None).cast("array<string>")
    for p, (_, heads) in HEADS.items():
        for k, h in enumerate(heads):
            head = F.when((F.col("position") == p) & (F.col("day") % 4 == k), F.array(*map(F.lit, h))).otherwise(head)
    place = shared_dir(spark) + "/lines"
    T.write_lines(rows.select("path", F.posexplode(head).alias("line_no", "line")), place)
    reader = F.coalesce(*[F.when(F.col("position") == p, r) for p, (r, _) in HEADS.items()])
    h = headers.hints(rows.withColumn("reader", reader), T.read_lines(spark, place))
    return h.select("position", "day", F.coalesce("reader", F.lit("none")).alias("reader"), "matches", "status", "reason", "excerpt")


@query(f"select position, (ms // {DAY})::bigint as day, 'Broadband LOG Results' as section, count(*) + 2 as n from log group by 1, 2 union all select distinct position, (ms // {DAY})::bigint, m.section, m.n from log, (values ('Hardware Configuration', 2), ('Measurement Setup', 1)) as m(section, n)", "log")
def w7_fill_section(spark, d):
    n = T.sections(sectioned(spark, d)).groupBy("path", "section").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.substring_index("path", "_", 1).alias("position"), F.substring_index("path", "_", -1).cast("long").alias("day"), "section", "n")


@query(f"select p.*, m.* from (select distinct position, (ms // {DAY})::bigint as day from log) p, (values ('Hardware Configuration', 'Serial number', 'A2'), ('Hardware Configuration', 'Note', 'a: b'), ('Measurement Setup', 'Profile', 'Full')) as m(section, key, value)", "log")
def s11_section_metadata(spark, d):
    m = T.metadata(sectioned(spark, d), ["Hardware Configuration", "Measurement Setup"])
    return m.select(F.substring_index("path", "_", 1).alias("position"), F.substring_index("path", "_", -1).cast("long").alias("day"), "section", "key", "value")


def reports(spark, d):
    """A file for each position and day with its one measurement; those of 'view' have another header."""
    rows = files(spark, d)
    r = rows.groupBy("path").agg(F.min("event_id").alias("event_id"), F.min("ms").alias("s"), F.max("ms").alias("e"), L.laeq(F.col("laeq")).alias("laeq"))
    for c in ("s", "e"):
        r = r.withColumn(f"{c}d", F.date_format(F.timestamp_millis(c), "yyyy-MM-dd")).withColumn(f"{c}t", F.date_format(F.timestamp_millis(c), "HH:mm:ss.SSS"))
    r = r.withColumn("none", F.lit("-.-"))
    first = lambda name: [*SECTIONS, "# Broadband Results", f"\tStart Date\tStart Time\tEnd Date\tEnd Time\t{name}_dt\tLAF10.0%", "\t[YYYY-MM-DD]\t[hh:mm:ss]\t[YYYY-MM-DD]\t[hh:mm:ss]\t[dB]\t[dB]"]
    body = tabbed("", "sd", "st", "ed", "et", "laeq", "none")
    odd = F.col("path").startswith("view")
    one, two = (readers.single_reports(reread(spark, r.where(w), first(n), body, ["#CheckSum", "x"])) for w, n in ((~odd, "LAeq"), (odd, "LCSmax")))
    return one.unionByName(two)


def repeats(parts):
    return " union all ".join(f"select position, ms as start_ms, ms + 1000 as end_ms, '{name}' as name, {hz}::double as freq_hz, round({x}::double, 6) as level from log" for name, hz, x in parts)


@query(repeats([("LAeq", NONE, "laeq"), ("LAFmax", NONE, "0"), ("LZeq", "31.5", "laeq"), ("LZFmax", "1000", "lafmax")]), "log")
def s13_read_repeat_reports(spark, d):
    end = F.timestamp_millis(F.col("ms") + 1000)
    rows = files(spark, d).withColumn("ed", F.date_format(end, "yyyy-MM-dd")).withColumn("et", F.date_format(end, "HH:mm:ss.SSS")).withColumn("none", F.lit("-.-"))
    units = "[YYYY-MM-DD]\t[hh:mm:ss]\t[YYYY-MM-DD]\t[hh:mm:ss]"
    total = [*SECTIONS, "# Broadband Results", "\tStart\t\tStop", "Date\tTime\tDate\tTime\tLAeq_dt\tLAFmax", units + "\t[dB]\t[dB]"]
    one = readers.repeat_reports(reread(spark, rows, total, tabbed("", "date", "time", "ed", "et", "laeq", "none"), ["#CheckSum", "x"]))
    band = [*SECTIONS, "# RTA Results", "Start\t\tStop\t\t\tLZeq\tLZFmax", "Date\tTime\tDate\tTime\tBand [Hz]\t31.5\t1k", units + "\t\t[dB]\t[dB]"]
    two = readers.repeat_reports(reread(spark, rows, band, tabbed("", "date", "time", "ed", "et", "", "laeq", "lafmax"), ["#CheckSum", "x"]), bands=True)
    return one.unionByName(two).withColumn("position", F.substring_index("path", "_", 1)).drop("path")


DAILY = f"select position, (ms // {DAY})::bigint as day, min(ms) as start_ms, max(ms) as end_ms, {ENERGY.format('laeq')} as level from log group by 1, 2"


@query(f"select *, 0::double as other from ({DAILY})", "log")
def s12_read_single_reports(spark, d):
    r = reports(spark, d)
    return r.select(F.substring_index("path", "_", 1).alias("position"), F.substring_index("path", "_", -1).cast("long").alias("day"), "start_ms", "end_ms", F.col("values")[0].alias("level"), F.col("values")[1].alias("other"))


@query(f"select position, day, level, position <> 'view' as accepted from ({DAILY})", "log")
def k4_combine_reports(spark, d):
    c = readers.combined(reports(spark, d))
    return c.select(F.substring_index("path", "_", 1).alias("position"), F.substring_index("path", "_", -1).cast("long").alias("day"), F.col("values")[0].alias("level"), "accepted")


@query(
    f""", r as (select position as folder, (ms // {DAY})::bigint as day, ms // 1000 * 1000 as s, event_id, event_id % 3 as third, laeq, lafmax from log),
 side as (select *, event_id = min(event_id) over (partition by folder, day, third <> 1) as firsts, event_id = min(event_id) over (partition by folder, day, third <> 2) as firsts2 from r),
 a as (select folder, s, max_by(struct_pack(f := case when firsts then folder || '_' || day || '_SLM_123_Log.txt' end, x := laeq, y := case when event_id % 4 = 0 then 0 else lafmax end), event_id) as v from side where third <> 1 group by 1, 2),
 b as (select folder, s, max_by(struct_pack(f := case when firsts2 then folder || '_' || day || '_SLM_RTA_3rd_Log.txt' end, x := lafmax), event_id) as v from side where third <> 2 group by 1, 2)
 select coalesce(a.folder, b.folder) as folder, strftime(epoch_ms(coalesce(a.s, b.s)), '%Y-%m-%d') as date, strftime(epoch_ms(coalesce(a.s, b.s)), '%H:%M:%S') as time, a.v.f as left_file, b.v.f as right_file, round(a.v.x, 6) as "left_LAeq_dt", round(a.v.y, 6) as "left_LAFmax", round(b.v.x, 6) as "right_LZeq_dt_63_0"
 from a full join b on a.folder = b.folder and a.s = b.s""",
    "log",
)
def k5_overview_sheet(spark, d):
    """A sheet a position of its broadband and its third-octave logs, a file a day; each has rows that the other lacks, and rows in one second."""
    rows = files(spark, d).withColumn("time", F.substring("time", 1, 8)).withColumn("high", F.when(F.col("event_id") % 4 == 0, "-.-").otherwise(F.col("lafmax").cast("string")))
    name = lambda tail: F.concat("position", F.lit("/"), "path", F.lit(tail))
    total = [*SECTIONS, "# Broadband LOG Results", "Date\tTime\tTimer\tLAeq_dt\tLAFmax", "[YYYY-MM-DD]\t[hh:mm:ss]\t[hh:mm:ss]\t[dB]\t[dB]"]
    band = [*SECTIONS, "# RTA LOG Results LZF", "x", "y", "z", "\t2020-01-01\t00:00:00\t\t\t1", "# RTA LOG Results L*eq_dt", "\t\t\t\tLZeq_dt", "Date\tTime\tTimer\tBand [Hz]\t63.0", "[YYYY-MM-DD]\t[hh:mm:ss]\t[hh:mm:ss]\t\t[dB]"]
    one = reread(spark, rows.where("event_id % 3 <> 1").withColumn("path", name("_SLM_123_Log.txt")), total, tabbed("", "date", "time", "", "laeq", "high"), ["#CheckSum", "x"])
    two = reread(spark, rows.where("event_id % 3 <> 2").withColumn("path", name("_SLM_RTA_3rd_Log.txt")), band, tabbed("", "date", "time", "", "", "lafmax"), ["#CheckSum", "x"])
    (lh, left), (rh, right) = overview.block(one, "123 log"), overview.block(two, "rta log")
    out = overview.wide(overview.wide(overview.sheet(left, right), lh, "left"), rh, "right").drop("left_times", "right_times")
    return out.select("folder", "date", "time", "left_file", "right_file", *[F.col(c).cast("double").alias(c) for c in out.columns[5:]])


@query("select position, count(*) filter (ms < epoch_ms(timestamp '" + CUTOFF + f"')) + 4 * count(distinct ms // {DAY}) as n from log group by 1", "log")
def k6_truncate_before(spark, d):
    return readers.before(three_rows(spark, d), CUTOFF).groupBy(F.substring_index("path", "_", 1).alias("position")).agg(F.count(F.lit(1)).alias("n"))


@query(f"select position, (ms // {DAY})::bigint as day, min(ms) as lo, max(ms) as hi from log group by 1, 2", "log")
def s19_probe_span(spark, d):
    s = T.span(readers.three_row_header(three_rows(spark, d)))
    return s.select(F.substring_index("path", "_", 1).alias("position"), F.substring_index("path", "_", -1).cast("long").alias("day"), "lo", "hi")


@query(
    f"select position, day, round(median(delta), 6) as step_ms, true as spectral from (select position, (ms // {DAY})::bigint as day, ms - lag(ms) over w as delta, row_number() over w as i from log window w as (partition by position, ms // {DAY} order by ms)) where i <= 32 and delta > 0 group by 1, 2",
    "log",
)
def s20_peek_cadence(spark, d):
    long = readers.three_row_header(three_rows(spark, d))
    step = timeline.time_step(long.where("name = 'LAeq'"), by="path")
    spectral = long.groupBy("path").agg((F.count("freq_hz") > 0).alias("spectral"))
    return step.join(spectral, "path").select(F.substring_index("path", "_", 1).alias("position"), F.substring_index("path", "_", -1).cast("long").alias("day"), "step_ms", "spectral")


SHORT = union_sql(("LAeq", NONE, "laeq"), ("LAFmax", NONE, "lafmax"), ("LAF10", NONE, "laeq + 1"), ("LAF90", NONE, "laeq - 1"))


@query(f"select * from ({SHORT}) where position <> 'view' union all select position, ms, 'Odd_level' as name, null::double as freq_hz, round(laeq, 6) as level from log where position = 'view'", "log")
def s1_read_short_delimited(spark, d):
    """Files of real date and time texts and four levels, some between tabs, with blank lines and lines without a time; those of one position have no known header."""
    rows = files(spark, d).withColumn("stamp", F.concat_ws(" ", "date", "time")).withColumn("l10", F.col("laeq") + 1).withColumn("l90", F.col("laeq") - 1)
    head = ["", "Exported", "Time (Date hh:mm:ss.ms),LEQ dB-A,Lmax dB-A,L10 dB-A,L90 dB-A"]
    known, tabs, odd = F.col("position").isin("click", "error"), F.col("position").isin("purchase", "signup"), F.col("position") == "view"
    one = reread(spark, rows.where(known), head, comma("stamp", "laeq", "lafmax", "l10", "l90"), ["", "no time,1,2,3,4", ",,,,"])
    two = reread(spark, rows.where(tabs), [h.replace(",", "\t") for h in head], tabbed("stamp", "laeq", "lafmax", "l10", "l90"), ["\t\t\t\t"])
    three = reread(spark, rows.where(odd), ["", "Time (Date hh:mm:ss.ms),Odd level"], comma("stamp", "laeq"))
    return by_position(readers.short_delimited(one).unionByName(readers.short_delimited(two)).unionByName(readers.short_delimited(three)))


@query()
def s_read_files(spark, d):
    rows, _ = readers.read_files(*mixed_files(spark, d))
    return rows.select(F.substring_index("path", "_", 1).alias("position"), "reader", "profile", "name", "freq_hz", "ms", "level")


def mixed_files(spark, d):
    """Files of all kinds in one folder, with the readers that some are forced to: delimited and tabular ones, sectioned broadband and band tables, one kind without a known name, and empty ones."""
    rows = files(spark, d).withColumn("stamp", F.concat_ws(" ", "date", "time")).withColumn("day", F.floor(F.col("ms") / DAY).cast("string"))
    name = lambda tail: F.concat("position", F.lit("_"), "day", F.lit(tail))
    of = lambda p, tail, where=F.lit(True): rows.where((F.col("position") == p) & where).withColumn("path", name(tail))
    odd = F.col("day").cast("int") % 2 == 1
    lines = reread(spark, of("click", "_2024_01_01__00h00m00s.csv"), ["Time (Date hh:mm:ss.ms),LEQ dB-A,Lmax dB-A"], comma("stamp", "laeq", "lafmax"))
    head = ["Buffer,P1 (SR),P1 (A; Fast) (SR),", ",LAeq [dB],LAFmax,", "Date & time,,,"]
    lines = lines.unionByName(reread(spark, of("error", "_x.csv"), ["Site", *head], comma("stamp", "laeq", "lafmax", "")))
    total = [*SECTIONS, "# Broadband LOG Results", "Date\tTime\tTimer\tLAeq_dt\tLAFmax", "[YYYY-MM-DD]\t[hh:mm:ss]\t[hh:mm:ss]\t[dB]\t[dB]"]
    lines = lines.unionByName(reread(spark, of("purchase", "_SLM_123_Log.txt", ~odd), total, tabbed("date", "time", "", "laeq", "lafmax"), ["#CheckSum", "x"]))
    band = [*SECTIONS, "# RTA LOG Results LZeq_dt", "Date\tTime\tTimer\tBand [Hz]\t63.0", "[YYYY-MM-DD]\t[hh:mm:ss]\t[hh:mm:ss]\t\t[dB]"]
    lines = lines.unionByName(reread(spark, of("purchase", "_SLM_RTA_3rd_Log.txt", odd), band, tabbed("date", "time", "", "", "laeq"), ["#CheckSum", "x"]))
    lines = lines.unionByName(reread(spark, of("signup", "_overview.dat"), ["Timestamp,LAeq,LAFmax"], comma("stamp", "laeq", "lafmax")))
    lines = lines.unionByName(reread(spark, of("view", "_unknown.bin", odd), ["nothing"], F.lit("here")))
    lines = lines.unionByName(reread(spark, of("view", "_broken.csv", ~odd), ["no header"], F.lit("1,2,3")))
    forced = lines.where(F.col("path").contains("_overview.dat")).select("path", F.lit("Plot_Lines-Only").alias("forced")).distinct()
    return lines, forced


MIXED = f"""(select position, ms, laeq, lafmax, ms // {DAY} % 2 = 1 as odd, count(*) over (partition by position, ms // {DAY}) as n from log)"""
SQL["s_read_files"] = (
    "with log as (" + VIEWS["log"] + f"), g as (select *, case position when 'click' then 'sentry' when 'error' then 'svan' when 'purchase' then 'nti' when 'signup' then 'generic' end as reader, case position when 'purchase' then 'log' when 'click' then 'period' else 'overview' end as profile, ms // {DAY} as day from {MIXED}),"
    # the period is the smallest most frequent step of a file's distinct times but the ends, see a7
    + """ u as (select distinct position, day, ms from g where position = 'click'), dl as (select position, day, ms - lag(ms) over w as delta, row_number() over w - 1 as i, count(*) over (partition by position, day) as n from u window w as (partition by position, day order by ms)),
 md as (select position, day, delta from dl where case when n = 2 then i = 1 when n - 2 > 20 then i > 5 and i <= n - 7 else i >= 1 and i <= n - 2 end group by 1, 2, 3 qualify row_number() over (partition by position, day order by count(*) desc, delta) = 1),
 pr as (select g.*, case when profile = 'period' then case when round(delta / 1000.0, 3) > 60 then 'overview' else 'log' end else profile end as prof from g left join md using (position, day))
 select position, reader, prof as profile, 'LAeq' as name, null::double as freq_hz, ms, round(laeq, 6) as level from pr where reader is not null and not (position = 'purchase' and odd)
 union all select position, reader, prof, 'LAFmax', null, ms, round(lafmax, 6) from pr where reader is not null and not (position = 'purchase' and odd)
 union all select position, reader, prof, 'LZeq', 63, ms, round(laeq, 6) from pr where position = 'purchase' and odd"""
)


@query(f"select distinct (ms // {DAY})::bigint as day, case when ms // {DAY} % 2 = 0 then 'svan' end as reader, case when ms // {DAY} % 2 = 0 then 'no rows found' else 'no reader for this name' end as reason from log where position = 'view'", "log")
def s_rejected_files(spark, d):
    _, rejects = readers.read_files(*mixed_files(spark, d))
    return rejects.select(F.split("path", "_")[1].cast("long").alias("day"), "reader", "reason")


def band_reports(spark, d):
    """A third-octave report for each position and day; those of 'view' have other bands, of 'error' another order of metrics."""
    rows = files(spark, d)
    at = lambda c: F.date_format(F.timestamp_millis(c), "yyyy-MM-dd, HH:mm:ss")
    r = rows.groupBy("path").agg(F.min("event_id").alias("event_id"), F.min("ms").alias("s"), F.max("ms").alias("e"), L.laeq(F.col("laeq")).alias("laeq"), L.lafmax(F.col("lafmax")).alias("lafmax"))
    view, error = F.col("path").startswith("view"), F.col("path").startswith("error")
    text = lambda *c: F.concat_ws("\t", F.lit(""), *c)
    low, high = F.col("laeq").cast("string"), F.col("lafmax").cast("string")
    eq, top = text(F.lit("LZeq_dt"), low, F.lit("-.-")), text(F.lit("LZFmax"), high, low)
    parts = [F.lit("# Time"), F.concat(F.lit("Start:\t"), at("s")), F.concat(F.lit("End:\t"), at("e")), F.lit("# RTA Results"), text(F.lit("Band [Hz]"), F.when(view, "31.5").otherwise("63.0"), F.lit("125.0")), text(F.lit(""), F.lit("[dB]"), F.lit("[dB]")), F.when(error, top).otherwise(eq), F.when(error, eq).otherwise(top), F.lit("#CheckSum"), F.lit("x")]
    lines = r.select("path", F.posexplode(F.array(*parts)).alias("i", "line")).select("path", F.col("i").cast("long").alias("line_no"), "line")
    place = shared_dir(spark) + "/lines"
    T.write_lines(lines, place)
    return readers.single_band_reports(T.read_lines(spark, place))


DAILY_BANDS = f"select position, (ms // {DAY})::bigint as day, min(ms) // 1000 * 1000 as start_ms, max(ms) // 1000 * 1000 as end_ms, {ENERGY.format('laeq')} as e, round(max(lafmax), 6) as m from log group by 1, 2"


@query(f"select position, day, start_ms, end_ms, name, band, round(level, 6) as level from (select *, 'LZeq_dt' as name, 0 as i, e as level from ({DAILY_BANDS}) union all select *, 'LZeq_dt', 1, 0 from ({DAILY_BANDS}) union all select *, 'LZFmax', 0, m from ({DAILY_BANDS}) union all select *, 'LZFmax', 1, e from ({DAILY_BANDS})) cross join lateral (select case when i = 1 then '125.0' when position = 'view' then '31.5' else '63.0' end as band)", "log")
def s12_read_single_band_reports(spark, d):
    r = band_reports(spark, d).select("path", "start_ms", "end_ms", "header", F.explode("metrics").alias("m"))
    flat = r.select("path", "start_ms", "end_ms", F.col("m.name").alias("name"), F.explode(F.arrays_zip(F.col("header").alias("band"), F.col("m.values").alias("level"))).alias("v"))
    return flat.select(F.substring_index("path", "_", 1).alias("position"), F.substring_index("path", "_", -1).cast("long").alias("day"), "start_ms", "end_ms", "name", F.col("v.band").alias("band"), F.col("v.level").alias("level"))


@query(f"select distinct position, (ms // {DAY})::bigint as day, position not in ('view', 'error') as accepted from log", "log")
def k4_combine_band_reports(spark, d):
    c = readers.combined_bands(band_reports(spark, d))
    return c.select(F.substring_index("path", "_", 1).alias("position"), F.substring_index("path", "_", -1).cast("long").alias("day"), "accepted")
