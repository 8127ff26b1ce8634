"""Queries that write markers and regions to files and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from soundtally.operators import spectrogram
from soundtally.plans.base import areas, log, query, spectra
from soundtally.plans.matching import MERGES, united
from soundtally.sources import annotations as A
from soundtally.sources.place import shared_dir

NOTE = 'says "loud", then\nquiet'


def marks(spark, d):
    return log(spark, d).where("position = 'error'").select(F.col("event_id").alias("marker_id"), "ms", F.lit("error").alias("position"), F.lit(NOTE).alias("note"), F.lit("#f00").alias("color"), "laeq")


def written(spark, d):
    place = shared_dir(spark) + "/annotations"
    A.write_csv(A.annotation_rows(marks(spark, d), united(spark, d)), place)
    return A.read_annotations(spark, place)


@query("select nullif(marker_id, 0) as id, 'error' as position, m.ms, '" + NOTE.replace("\n", "' || chr(10) || '") + "' as note, '#f00' as color from markers m", "log", "markers")
def s16_read_annotation_markers(spark, d):
    return written(spark, d).where("type = 'marker'").select("id", "position", "ms", "note", "color")


@query(MERGES + " select nullif(region_id, 0) as id, position, start_ms, end_ms from u", "log", "areas")
def s16_read_annotation_regions(spark, d):
    return written(spark, d).where("type = 'region'").select("id", "position", F.explode("areas").alias("a")).select("id", "position", "a.start_ms", "a.end_ms")


@query("select nullif(event_id, 0) as id, ms, round(laeq, 6) as laeq from log where position = 'error'", "log")
def s17_read_markers(spark, d):
    place = shared_dir(spark) + "/markers"
    m = marks(spark, d).select(F.col("marker_id").alias("id"), "ms", "note", "color", F.struct("laeq").alias("metrics"))
    A.write_csv(A.marker_rows(m), place)
    return A.read_markers(spark, place, "laeq double").select("id", "ms", "metrics.laeq")


@query(MERGES + " select * from u", "log", "areas")
def s18_read_regions(spark, d):
    place = shared_dir(spark) + "/regions"
    A.write_regions(A.region_rows(united(spark, d)), place)
    return A.read_regions(spark, place)


@query("select event_id as id, ms as timestamp_ms, '" + NOTE.replace("\n", "' || chr(10) || '") + "' as note, '#f00' as color, round(laeq, 6) as laeq, '' as selected from log where position = 'error'", "log")
def k2_write_markers(spark, d):
    place = shared_dir(spark) + "/written_markers"
    m = marks(spark, d).select(F.col("marker_id").alias("id"), "ms", "note", "color", F.struct("laeq").alias("metrics"))
    A.write_csv(A.marker_rows(m), place)
    raw = spark.read.options(**A.CSV).csv(place)
    return raw.select(F.col("id").cast("long"), F.col("timestamp_ms").cast("long"), "note", "color", F.get_json_object("metrics_json", "$.laeq").cast("double").alias("laeq"), F.coalesce("selected", F.lit("")).alias("selected"))


@query(
    MERGES
    + """ select region_id as id, position as "positionId", min(start_ms) as start, max(end_ms) as "end", 300000 as "chartOffsetMs", 'of ' || region_id as note, count(*) as n,
 '[' || string_agg('{"start":' || start_ms - 300000 || ',"end":' || end_ms - 300000 || '}', ',' order by start_ms) || ']' as source from u group by 1, 2""",
    "log", "areas",
)
def k3_write_regions(spark, d):
    place, a = shared_dir(spark) + "/written_regions", united(spark, d)
    offsets = a.select("position").distinct().withColumn("chart_offset_ms", F.lit(300_000).cast("long"))
    facts = a.groupBy("region_id").agg(F.concat(F.lit("of "), F.col("region_id").cast("string")).alias("note"), F.lit("#0f0").alias("color"), F.struct(F.count(F.lit(1)).alias("n")).alias("metrics"))
    A.write_regions(A.region_rows(a, offsets, facts), place)
    text = F.col("value")
    field = lambda name, kind="long": F.get_json_object(text, f"$.{name}").cast(kind).alias(name)
    return spark.read.text(place).select(field("id"), field("positionId", "string"), field("start"), field("end"), field("chartOffsetMs", "int"), field("note", "string"), F.get_json_object(text, "$.metrics.n").cast("long").alias("n"), F.get_json_object(text, "$.sourceAreas").alias("source"))


TEXT = "strftime(epoch_ms({0}::bigint), '%Y-%m-%d %H:%M:%S.%g')"
NUMBER = "rtrim(rtrim(printf('%.3f', floor({0} * 1000 + 0.5) / 1000), '0'), '.')"


def facts(spark, d):
    """Markers and regions with metrics: every third region has none, every other one no L90."""
    a = united(spark, d)
    n = F.col("region_id")
    some = a.where("region_id % 3 > 0").groupBy("region_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))
    of = some.select("region_id", F.lit("LAeq").alias("parameter"), F.lit("log").alias("dataset"), "duration_ms", (n * 1.0625).alias("laeq"), F.lit(None).cast("double").alias("lafmax"), F.when(n % 2 == 0, n * 0.5).alias("la90"), (n % 2 == 0).alias("la90_available"), F.lit("log").alias("source"))
    m = marks(spark, d)
    values = m.select("marker_id", F.lit("LZeq").alias("parameter"), F.when(F.col("marker_id") % 2 == 0, F.col("marker_id") * 0.25).alias("value"), F.lit("P").alias("place"), (F.col("ms") - 500).alias("at_ms"))
    return m, a, values, of


@query(
    MERGES
    + f""", shown as (select region_id as id, position, min(start_ms) as s, max(end_ms) as e, sum(end_ms - start_ms) as w, '[' || string_agg('{{"startUtc":"' || {TEXT.format("start_ms")} || '","endUtc":"' || {TEXT.format("end_ms")} || '"}}', ',' order by start_ms) || ']' as areas from u group by 1, 2)
 select 'region' as type, id, position, {TEXT.format("s")} as start_utc, {TEXT.format("e")} as end_utc, {TEXT.format("s - 300000")} as source_start_utc, areas, '300000' as chart_offset_ms, '' as timestamp_utc, (case when id % 3 > 0 then w else e - s end)::bigint::varchar as duration_ms,
 case when id % 3 > 0 then 'LAeq' else '' end as metrics_parameter, '' as metrics_timestamp_utc, '' as metrics_broadband_value, '' as metrics_broadband_position, case when id % 3 > 0 then 'log' else '' end as metrics_data_resolution, case when id % 3 > 0 then w::bigint::varchar else '' end as metrics_duration_ms,
 case when id % 3 > 0 then {NUMBER.format("id * 1.0625")} else '' end as metrics_laeq, case when id % 3 > 0 and id % 2 = 0 then {NUMBER.format("id * 0.5")} else '' end as metrics_la90, case when id % 3 > 0 and id % 2 = 0 then 'true' else '' end as metrics_la90_available, case when id % 3 > 0 then 'log' else '' end as metrics_spectrum_source from shown
 union all select 'marker', marker_id, 'error', {TEXT.format("ms")}, '', '', '', '', {TEXT.format("ms")}, '', 'LZeq', {TEXT.format("ms - 500")}, case when marker_id % 2 = 0 then {NUMBER.format("marker_id * 0.25")} else '' end, case when marker_id % 2 = 0 then 'P' else '' end, '', '', '', '', '', '' from markers""",
    "log", "areas", "markers",
)
def k1_annotation_rows(spark, d):
    m, a, values, of = facts(spark, d)
    offsets = a.select("position").distinct().withColumn("chart_offset_ms", F.lit(300_000))
    rows = A.annotation_rows(m, a, offsets, values, of)
    return rows.select("type", "id", F.col("positionId").alias("position"), "start_utc", "end_utc", "source_start_utc", "areas", "chart_offset_ms", *[c for c in A.METRICS if c != "metrics_lafmax"])


#: The labels of 64 bands; one is in two cases and one has two forms that give one column name.
LABELS = {i: "31.5 Hz" if i == 31 else f"{i} Hz" for i in range(1, 65)}
BAND_NAMES = {i: "band_8_HZ" if i == 8 else "band_" + label.replace(".", "_").replace(" ", "_") for i, label in LABELS.items()}


@query(
    "select position as id, " + ", ".join(f'{NUMBER.format(f"a{i}")} as "{n}"' for i, n in BAND_NAMES.items()) + f""", {NUMBER.format("a16")} as "band_16_Hz_2" from
 (select position, """ + ", ".join(f"10 * log10(avg(pow(10.0, level / 10)) filter (freq_hz = {i})) as a{i}" for i in LABELS) + " from spectra group by 1)",
    "spectra",
)
def k1_band_columns(spark, d):
    """Labels in natural order, one in two cases, two of which give one column name."""
    mean = spectrogram.mean_spectrum(spectra(spark, d), ["position"])
    label = F.when((F.col("freq_hz") == 8) & (F.col("position") == "P3"), "8 HZ").when(F.col("freq_hz") == 31, "31.5 Hz").otherwise(F.concat(F.col("freq_hz").cast("string"), F.lit(" Hz")))
    one = mean.select(F.col("position").alias("id"), label.alias("label"), F.col("laeq").alias("level"))
    two = one.where("label = '16 Hz'").withColumn("label", F.lit("16-Hz"))
    return A.with_bands(one.select("id").distinct(), one.unionByName(two), ["id"])


@query(
    """, a as (select region_id, position, start_ms as s, end_ms as e from areas where region_id > 0 and end_ms > start_ms),
 x as (select region_id, position, s, e from a where region_id % 5 <> 3 union all select region_id, position, e, e + 1000 from a where region_id % 5 < 3 union all select region_id, position, s, e from a where region_id % 5 = 3)
 select region_id as id, position, s as start_ms, e as end_ms from x""",
    "log", "areas",
)
def s16_read_area_forms(spark, d):
    """Areas as objects, pairs, texts between bars, one bare object, and unreadable ones, for which the region's own ends count."""
    a = areas(log(spark, d)).where("region_id > 0 and end_ms > start_ms")
    s, e, more = A.utc_text(F.col("start_ms")), A.utc_text(F.col("end_ms")), A.utc_text(F.col("end_ms") + 1000)
    two = lambda form: F.format_string("[" + form + "," + form + "]", s, e, e, more)
    n = F.col("region_id") % 5
    text = F.when(n == 0, two('{"start":"%s","end":"%s"}')).when(n == 1, two('["%s","%sZ"]')).when(n == 2, two('"%s | %s"')).when(n == 3, "[{bad").otherwise(F.format_string('{"start_utc":"%s","endUtc":"%s"}', e, s))
    rows = a.select(F.lit("Region ").alias("type"), F.col("region_id").alias("id"), F.col("position").alias("positionId"), e.alias("start_utc"), s.alias("end_utc"), F.lit("").alias("note"), F.lit("").alias("color"), text.alias("areas"))
    place = shared_dir(spark) + "/area_forms"
    A.write_csv(rows, place)
    return A.read_annotations(spark, place).select("id", "position", F.explode("areas").alias("a")).select("id", "position", "a.start_ms", "a.end_ms")
