"""Readers of logger files: lines (path, line_no, line) to long rows (path, ms, name, freq_hz, level).

Each reads all files of its kind in one job. A file without the expected header
gives no rows; a cell that isn't a number gives none.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundtally.functions.texts import date_comma_time_ms, number
from soundtally.functions.levels import band_hz, frequency_hz
from soundtally.operators import timeline
from soundtally.sources import names as N
from soundtally.sources import added
from soundtally.sources import lines as T
from soundtally.sources.place import cut, shared_dir

# Names of broadband levels that mark a header.
BROADBAND = "LAeq|LAFmax|LAF10|LAF90|LCSmax|LCFmax|LZSmax|LZFmax"
# Names of time columns, most explicit first.
TIME_NAMES = ["datetime", "date_time", "timestamp", "time_stamp", "start datetime", "start date time", "start time"]
SEPARATORS = [",", ";", "\t", "|"]
# Words of a short delimited log's header, and its column names with what they stand for.
SHORT_WORDS = ["time", "leq", "lmax", "l10", "l90"]
SHORT_NAMES = {"Time (Date hh:mm:ss.ms)": "Datetime", "LEQ dB-A": "LAeq", "LEQ dB -A": "LAeq", "Lmax dB-A": "LAFmax", "L-Max dB -A": "LAFmax", "L-Max dB-A": "LAFmax", "L10 dB-A": "LAF10", "L90 dB-A": "LAF90"}
LONG = ["path", "ms", "name", "freq_hz", "level"]


def times(name: Column) -> Column:
    return F.lower(name).rlike("date & time|^(start )?(date|time)$")


def levels(long: DataFrame, name: Column, freq_hz: Column) -> DataFrame:
    """Typed rows from stamped cells; those without a name, a time or a number go."""
    out = long.select("path", F.unix_millis(F.try_to_timestamp("ts_text")).alias("ms"), name.alias("name"), freq_hz.cast("double").alias("freq_hz"), number(F.col("text")).alias("level"))
    return out.dropna(subset=["ms", "name", "level"])


def three_row_name(raw: Column) -> Column:
    """(name, freq_hz) of a column named by three header rows; null where it is no known level."""
    c = F.regexp_replace(raw, r"(?i)\s*(\((SR|TH|Lin|Fast|Slow|SPL)\)|\[dB\]|Histogram)\s*", "")
    c = F.trim(F.regexp_replace(c, r"[ \-/_]+", "_"), F.lit("_"))
    total = F.lit(None).cast("string")
    for name, ending in (("LAeq", "LAeq"), ("LAFmax", "LAFmax"), ("LAFmin", "LAFmin"), ("LAF10", "LAeq_L10"), ("LAF90", "LAeq_L90")):
        total = F.coalesce(total, F.when(c.rlike(rf"(?i)^P\d_.*{ending}$"), name))
    low = F.lower(F.regexp_extract(c, r"(?i)(?:^|_)(L[a-z]\w*?)(?:_|$)", 1))
    upper = F.when(low.rlike("^l[acz]f"), 3).otherwise(2)
    param = F.when(low != "", F.concat(F.upper(F.substring(low, F.lit(1), upper)), F.substring(low, upper + 1, F.lit(99))))
    hz = band_hz(F.regexp_extract(c, r"(?i)_([\d.]+k?)(?:_?Hz)?$", 1))
    band = c.contains("Oct") & hz.isNotNull()
    return F.struct(F.coalesce(total, F.when(band, param)).alias("name"), F.when(total.isNull() & band, hz).alias("freq_hz"))


def three_row_header(lines: DataFrame) -> DataFrame:
    """Comma-separated files whose header is the row with 'date & time' and the two above it."""
    h = T.found(lines, 100, lambda x: F.lower(x).contains("date & time")).where("at >= 3")
    rows = F.transform(F.slice("top", F.col("at") - 2, F.lit(3)), lambda x: F.split(x["line"], ","))
    wide = F.array_max(F.transform("rows", lambda r: F.size(r)))
    name = lambda i: F.array_join(F.filter(F.transform("rows", lambda r: F.trim(F.get(r, i))), lambda x: x != ""), "_")
    named = F.transform(F.sequence(F.lit(0), wide - 1), lambda i: F.coalesce(F.nullif(name(i), F.lit("")), F.concat(F.lit("Unnamed_"), i.cast("string"))))
    heads = h.withColumn("rows", rows).select("path", "header_no", T.numbered(named, 1).alias("names"))
    known = lambda n: F.get(F.filter(F.array(three_row_name(n)), lambda k: k["name"].isNotNull()), F.lit(0))
    return levels(T.cells(lines, heads, ",", times, known), F.col("name.name"), F.col("name.freq_hz"))


def short_delimited(lines: DataFrame) -> DataFrame:
    """Delimited files of a time and up to four levels.

    The header is the first of 20 lines in which two of SHORT_WORDS occur in cells,
    else the first line that isn't blank; a tab separates where it has more tabs than
    commas. Known names are translated, others get underscores for spaces. A file
    with standard columns gives these alone, another all. Cells are cut as the header
    is; rows without a time, blank rows and cells that aren't numbers go.
    """
    words = lambda x: F.transform(F.split(F.lower(x), "[;\t,]"), lambda c: F.trim(c))
    has = lambda x, word: F.exists(words(x), lambda c: c.contains(word)).cast("int")
    marks = lambda x: sum((has(x, word) for word in SHORT_WORDS), F.lit(0))
    t = T.top(lines, 20)
    place = lambda test: F.array_position(F.transform("top", lambda x: test(x["line"])), F.lit(True)).cast("int")
    at = F.coalesce(F.nullif(place(lambda x: marks(x) >= 2), F.lit(0)), place(lambda x: F.trim(x) != ""))
    h = t.withColumn("at", at).where(F.col("at") > 0).withColumn("__h", F.element_at("top", F.col("at"))).select("path", F.trim("__h.line").alias("header"), F.col("__h.line_no").alias("header_no"))
    tabs = F.length("header") - F.length(F.replace("header", F.lit("\t"), F.lit("")))
    commas = F.length("header") - F.length(F.replace("header", F.lit(","), F.lit("")))
    tabbed = tabs > commas
    raw = F.filter(F.transform(F.split("header", F.when(tabbed, "[;\t,]").otherwise(",")), lambda c: F.trim(c)), lambda c: c != "")
    known = F.create_map(*[F.lit(x) for pair in SHORT_NAMES.items() for x in pair])
    canonical = F.transform(raw, lambda c: F.coalesce(F.element_at(known, c), F.replace(c, F.lit(" "), F.lit("_"))))
    heads = h.select("path", "header_no", F.when(tabbed, "\t").otherwise(",").alias("sep"), canonical.alias("names"))
    standard = F.exists("names", lambda c: c.isin("LAeq", "LAFmax", "LAF10", "LAF90"))
    heads = heads.withColumn("names", F.when(standard, F.transform("names", lambda c: F.when(c.isin("Datetime", "LAeq", "LAFmax", "LAF10", "LAF90"), c).otherwise(""))).otherwise(F.col("names")))
    long = T.cells(lines, heads, F.col("sep"), lambda n: n == "Datetime", lambda n: F.when(n != "", n))
    return levels(long, F.col("name"), F.lit(None))


def plain_header(lines: DataFrame) -> DataFrame:
    """Comma-separated files with one header row that has 'start time' and 'laeq'."""
    h = T.found(lines, 50, lambda x: F.lower(x).contains("start time") & F.lower(x).contains("laeq"))
    heads = h.select("path", "header_no", T.numbered(F.transform(F.split("header", ","), lambda x: F.trim(x)), 1).alias("names"))
    name = lambda n: F.when(F.lower(n) == "laeq", "LAeq").when(F.lower(n) == "la10", "LAF10").when(F.lower(n) == "la90", "LAF90").when(F.lower(n) == "lafmax", "LAFmax")
    return levels(T.cells(lines, heads, ",", times, name), F.col("name"), F.lit(None))


def clean(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(name, "_dt", ""), r"\.0%", ""))


def sectioned_broadband(lines: DataFrame, title: str = "Broadband LOG Results") -> DataFrame:
    """Tab-separated table below a section title, its header the first row with a broadband name; rows of units go."""
    body = T.sections(lines).where(F.col("section").startswith(title) & ~F.trim("line").startswith("["))
    h = T.found(body, 20, lambda x: x.rlike(BROADBAND))
    heads = h.select("path", "header_no", T.numbered(F.transform(F.split("header", "\t"), clean), 2).alias("names"))
    return levels(T.cells(body, heads, "\t", times, lambda n: F.when(n.rlike(r"^L\w+$"), n)), F.col("name"), F.lit(None))


def sectioned_bands(lines: DataFrame, title: str = "RTA LOG Results") -> DataFrame:
    """Tab-separated third-octave tables. The level's name is the section title's last word, over a row with 'Band [Hz]'; or a row of names stands over the frequencies and a row of units below."""
    body = T.sections(lines).where(F.col("section").startswith(title))
    of_title = clean(F.regexp_extract("section", r"\s(L\S+)$", 1))
    titled = body.where(of_title != "").withColumn("path", F.concat_ws("\n", "path", of_title))
    h = T.found(titled.where(~F.trim("line").startswith("[")), 20, lambda x: x.contains("Band [Hz]"))
    one = h.select("path", "header_no", T.numbered(F.transform(F.split("header", "\t"), lambda x: F.trim(x)), 2).alias("names"))
    long = T.cells(titled, one, "\t", times)
    first = levels(long, F.element_at(F.split("path", "\n"), -1), F.col("name").try_cast("double")).withColumn("path", F.element_at(F.split("path", "\n"), 1))
    untitled = body.where(of_title == "")
    u = T.found(untitled, 20, lambda x: x.contains("[dB]")).withColumn("rows", F.transform(F.slice("top", F.lit(1), F.col("at") - 1), lambda x: F.split(x["line"], "\t")))
    wide = F.array_max(F.transform("rows", lambda r: F.size(r)))
    joined = F.transform(F.sequence(F.lit(0), wide - 1), lambda i: F.array_join(F.filter(F.transform("rows", lambda r: clean(F.get(r, i))), lambda x: x != ""), "\n"))
    two = u.select("path", "header_no", T.numbered(joined, 2).alias("names"))
    pair = F.split("name", "\n")
    second = levels(T.cells(untitled, two, "\t", times), F.when(F.size(pair) == 2, pair[0]), F.get(pair, F.lit(1)).try_cast("double"))
    return first.where("freq_hz is not null").unionByName(second)


def generic(lines: DataFrame) -> DataFrame:
    """Any delimited files with a header. The time comes from the column of the most explicit name, else from Date and Time, else a name like them, else the first text column of which 80 % are times; all numeric columns are kept."""
    h = T.found(lines, 20, lambda x: F.trim(x) != "")
    count = lambda s: F.size(F.split("header", "[" + s + "]"))
    most = F.greatest(*[count(s) for s in SEPARATORS])
    sep = F.coalesce(*[F.when(count(s) == most, F.lit("[" + s + "]")) for s in SEPARATORS])
    h = h.withColumn("sep", sep)
    heads = h.select("path", "header_no", "sep", F.transform(F.split(F.col("header"), F.col("sep")), lambda x: F.trim(x)).alias("names"))
    long = T.cells(lines, heads, F.col("sep"), lambda n: F.lit(False))
    low = F.lower("name")
    stats = long.groupBy("path", "name").agg(F.count(F.lit(1)).alias("n"), F.count(number(F.col("text"))).alias("numbers"), F.count(F.try_to_timestamp("text")).alias("times"))
    named = F.array_position(F.array(*map(F.lit, TIME_NAMES)), low)
    rank = F.when(named > 0, named).when(low.isin("date", "time", "start date", "start time"), 10).when(low.rlike("datetime|timestamp"), 20).when(low.rlike("^time | time$"), 21).when((F.col("numbers") == 0) & (F.col("times") >= 0.8 * F.col("n")), 30)
    ranks = stats.withColumn("rank", rank).where("rank is not null")
    best = ranks.groupBy("path").agg(F.min("rank").alias("best"))
    chosen = ranks.join(best, "path").where("rank = best").groupBy("path").agg(F.collect_set("name").alias("chosen"))
    found = T.cells(lines, heads.join(chosen, "path"), F.col("sep"), lambda n: F.array_contains("chosen", n))
    return levels(found, F.col("name"), F.lit(None))


def single_reports(lines: DataFrame) -> DataFrame:
    """(path, header, start, end, values) of files with one measurement: a header row with a broadband name and a row of two dates with times and the values. '-.-' counts as 0."""
    body = T.sections(lines).where(F.col("section") == "Broadband Results")
    h = T.found(body, 20, lambda x: x.rlike(BROADBAND)).select("path", "header", "header_no")
    row = body.join(h, "path").where((F.col("line_no") > F.col("header_no")) & F.col("line").rlike(r"^\t?\d{4}-")).groupBy("path", "header").agg(F.min_by("line", "line_no").alias("line"))
    cut = row.withColumn("c", F.split("line", "\t")).withColumn("names", F.transform(F.split("header", "\t"), clean))
    number = lambda x: F.when(F.trim(x) == "-.-", 0.0).otherwise(x.try_cast("double"))
    stamp = lambda i: F.unix_millis(F.try_to_timestamp(F.concat_ws(" ", F.get("c", F.lit(i)), F.get("c", F.lit(i + 1)))))
    tail = lambda a: F.slice(a, 6, 9999)
    return cut.select("path", tail("names").alias("names"), stamp(1).alias("start_ms"), stamp(3).alias("end_ms"), F.transform(tail("c"), number).alias("values"))


def repeat_reports(lines: DataFrame, bands: bool = False) -> DataFrame:
    """(path, start_ms, end_ms, name, freq_hz, level) of files with a table of many measurements.

    Three rows of groups, names and units stand over rows of two dates with times and
    the values; a name stands one cell left of its values. Band tables have one more
    cell before the values, their levels' names in the first row and frequencies in
    the second. '-.-' counts as 0.
    """
    before = 6 if bands else 5
    body = T.sections(lines).where((F.col("section") == ("RTA Results" if bands else "Broadband Results")) & F.col("line").rlike(r"\S"))
    names = lambda i: F.transform(F.slice(F.split(F.get("top", F.lit(i))["line"], "\t"), before, 9999), clean)
    heads = T.top(body, 3).where(F.size("top") == 3).select("path", F.get("top", F.lit(2))["line_no"].alias("header_no"), names(0).alias("upper"), names(1).alias("lower"))
    rows = body.join(heads, "path").where(F.col("line_no") > F.col("header_no")).withColumn("c", F.split("line", "\t"))
    stamp = lambda i: F.unix_millis(F.try_to_timestamp(F.concat_ws(" ", F.get("c", F.lit(i)), F.get("c", F.lit(i + 1)))))
    cells = F.arrays_zip(F.col("upper").alias("upper"), F.col("lower").alias("lower"), F.slice("c", before + 1, 9999).alias("text"))
    long = rows.select("path", stamp(1).alias("start_ms"), stamp(3).alias("end_ms"), F.explode(cells).alias("v"))
    level = F.when(F.trim("v.text") == "-.-", 0.0).otherwise(F.col("v.text").try_cast("double"))
    named = long.select("path", "start_ms", "end_ms", F.col("v.upper" if bands else "v.lower").alias("name"), (frequency_hz(F.col("v.lower")) if bands else F.lit(None).cast("double")).alias("freq_hz"), level.alias("level"))
    return named.where("name <> '' and start_ms is not null and level is not null" + (" and freq_hz is not null" if bands else ""))


def combined(reports: DataFrame) -> DataFrame:
    """single_reports with accepted: whether a file has the names of the first file by name and as many values."""
    first = reports.agg(F.min_by("names", "path").alias("__names"))
    same = (F.col("names") == F.col("__names")) & (F.size("values") == F.size("names"))
    return reports.join(F.broadcast(first)).withColumn("accepted", F.coalesce(same, F.lit(False))).drop("__names")


def before(lines: DataFrame, cutoff: str) -> DataFrame:
    """Lines without a time, and those with one before the cutoff (text like 2024-01-15 00:00:00)."""
    ts = F.try_to_timestamp(F.regexp_extract("line", r"(\d{4}-\d{2}-\d{2}[ \tT]\d{2}:\d{2}:\d{2}(?:\.\d+)?)", 1))
    return lines.where(ts.isNull() | (ts < F.lit(cutoff).cast("timestamp")))


def single_band_reports(lines: DataFrame) -> DataFrame:
    """(path, header, units, start_ms, end_ms, metrics) of files with one third-octave measurement: metrics is an array of structs (name, values, texts) in order of the rows.

    Start and end stand as 'Start: YYYY-MM-DD, HH:MM:SS' before the table, whose rows
    are the bands, the units, and one row a metric. '-.-' counts as 0.
    """
    stamp = lambda word: F.max(F.when(F.col("line").rlike(rf"(?i)^\s*{word}\s*:"), date_comma_time_ms(F.regexp_replace("line", rf"(?i)^\s*{word}\s*:", ""))))
    when = T.sections(lines).where(F.col("section").startswith("Time")).groupBy("path").agg(stamp("Start").alias("start_ms"), stamp("End").alias("end_ms"))
    body = T.sections(lines).where((F.col("section") == "RTA Results") & (F.trim("line") != ""))
    number = lambda x: F.when(F.trim(x) == "-.-", 0.0).otherwise(x.try_cast("double"))
    # a table has a row a metric
    rows = F.array_sort(F.collect_list(F.struct("line_no", F.split("line", "\t").alias("c"))))
    table = body.groupBy("path").agg(rows.alias("rows")).where(F.size("rows") >= 3)
    cut = lambda c, first: F.slice(c, first, 9999)
    metric = F.transform(F.slice("rows", 3, 9999), lambda r: F.struct(F.trim(F.get(r["c"], F.lit(1))).alias("name"), F.transform(cut(r["c"], 3), number).alias("values"), cut(r["c"], 3).alias("texts")))
    metrics = F.filter(metric, lambda m: m["name"].isNotNull() & (m["name"] != ""))
    out = table.select("path", cut(F.get("rows", F.lit(0))["c"], 3).alias("header"), cut(F.get("rows", F.lit(1))["c"], 3).alias("units"), metrics.alias("metrics"))
    return out.where(F.size("metrics") > 0).join(when, "path")


def combined_bands(reports: DataFrame) -> DataFrame:
    """single_band_reports with accepted: whether a file has the header, the units and the metrics of the first file by name, and as many values in each row."""
    key = F.struct("header", "units", F.transform("metrics", lambda m: m["name"]).alias("names"))
    first = reports.agg(F.min_by(key, "path").alias("__k"), F.min_by(F.size(F.get("metrics", F.lit(0))["values"]), "path").alias("__n"))
    same = (key == F.col("__k")) & F.forall("metrics", lambda m: F.size(m["values"]) == F.col("__n"))
    return reports.join(F.broadcast(first)).withColumn("accepted", F.coalesce(same, F.lit(False))).drop("__k", "__n")


#: Section titles of one kind of recorder's files, by the kind of measurement and of file.
TITLES = {("rta", "log"): "RTA LOG Results", ("rta", "report"): "RTA Results", ("123", "log"): "Broadband LOG Results", ("123", "report"): "Broadband Results"}


def read_files(lines: DataFrame, forced: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Files of all layouts: rows (path, reader, profile, ms, name, freq_hz, level), and rejects (path, reader, reason) of those that gave none.

    Names decide on the reader, see ``names.routed``; forced (path, forced) overrides
    them. Lines are written once to a folder a layout, so that each layout's passes
    read no other's files, and added readers get theirs. A file that can't be read
    never fails the job.
    """
    files = lines.select("path").distinct()
    files = files.join(forced, "path", "left") if forced is not None else files.withColumn("forced", F.lit(None).cast("string"))
    routes = cut(N.routed(files))
    low = F.lower("path")
    layout = F.when(F.col("reader") != "nti", F.col("reader"))
    for kind, end in TITLES:
        layout = F.coalesce(layout, F.when(low.contains(f"_{kind}_") & low.rlike(rf"_{end}\.txt$"), f"{kind} {end}"))
    laid = routes.withColumn("layout", layout)
    own: dict[str, list[Callable[[DataFrame], DataFrame]]] = {"sentry": [short_delimited], "svan": [three_row_header, plain_header], "generic": [generic]}
    own |= {f"{kind} {end}": [partial(sectioned_bands if kind == "rta" else sectioned_broadband, title=title)] for (kind, end), title in TITLES.items()}
    own |= {r.name: [r.rows] for r in added.READERS.values()}
    place = shared_dir(lines.sparkSession)
    T.with_heads(lines.select("path", "line_no", "line"), laid.where(F.col("layout").isin(list(own))).select("path", "layout")).write.partitionBy("layout").parquet(place)
    there = {r["layout"] for r in laid.select("layout").distinct().collect()}  # a row a layout
    sent = lines.sparkSession.read.schema(lines.select("path", "line_no", "line").schema.add("layout", "string")).parquet(place)
    none = lines.sparkSession.createDataFrame([], "path string, ms long, name string, freq_hz double, level double")
    parts = [none] + [read(sent.where(F.col("layout") == name).drop("layout")).select(*LONG) for name, ways in own.items() if name in there for read in ways]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = cut(rows)
    periods = timeline.sample_period(rows.select("path", "ms").distinct(), "path")
    early = T.top(lines, 5).select("path", F.transform("top", lambda x: F.upper(x["line"])).alias("top"))
    facts = routes.join(periods, "path", "left").join(early, "path", "left").withColumn("profile", N.profile(F.col("path"), F.col("reader"), F.col("top"), F.col("period_s")))
    got = rows.select("path").distinct().withColumn("__got", F.lit(True))
    missing = facts.join(got, "path", "left").where("__got is null")
    reason = F.when(F.col("reader").isNull(), "no reader for this name").otherwise("no rows found")
    return T.with_heads(rows.withColumn("line_no", F.col("ms")), facts.select("path", "reader", "profile")).select("path", "reader", "profile", "ms", "name", "freq_hz", "level"), missing.select("path", "reader", reason.alias("reason"))
