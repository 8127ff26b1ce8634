"""Queries on column names and shapes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from soundtally.functions import columns as C
from soundtally.functions import levels as L
from soundtally.functions import texts as X
from soundtally.plans.base import log, query, spectra
from soundtally.sources import lines, options, readers


def wide(spark, d):
    """Spectra with a column for each of their 64 bands, of two levels, and columns that are no band between 20 Hz and 20 kHz."""
    s = spectra(spark, d)
    band = lambda i: F.max(F.when(F.col("freq_hz") == i, F.col("level"))).alias(f"{'LZFmax' if i % 4 == 3 else 'LZeq'}_{i * 20.5}")
    return s.groupBy("position", "ms").agg(*[band(i) for i in range(1, 65)], F.lit(1.0).alias("LZeq_10"), F.lit(1.0).alias("LZeq_25000"), F.lit(1.0).alias("Battery"))


@query("select event_id, round(lafmax, 6) as \"LAFmax\", round(laeq, 6) as \"LAeq\" from log", "log")
def p1_standardise(spark, d):
    rows = log(spark, d).select("event_id", F.col("laeq").alias("LAeq"), F.lit("x").alias("Note"), F.col("lafmax").alias("LAFmax"))
    return C.standardised(rows, ["event_id"])


NOMINAL = "case when hz in (6.3, 8, 10, 12.5, 16, 20, 25, 31, 31.5, 40, 50, 63, 80, 100, 125, 160, 200, 250, 315, 400, 500, 630, 800, 1000, 1250, 1600, 2000, 2500, 3150, 4000, 5000, 6300, 8000, 10000, 12500, 16000, 20000) then hz end"


@query(f"select position, ms, freq_hz, hz, {NOMINAL} as band_hz from (select position, ms, freq_hz, (freq_hz * case when freq_hz % 3 = 0 then 1000 else 1 end)::double as hz from spectra)", "spectra")
def p3_normalise_frequency(spark, d):
    s = spectra(spark, d)
    unit = F.when(F.col("freq_hz") % 3 == 0, "k").when(F.col("freq_hz") % 3 == 1, " Hz").otherwise("_Hz")
    label = F.concat(F.col("freq_hz").cast("string"), unit)
    return s.select("position", "ms", "freq_hz", L.frequency_hz(label).alias("hz"), L.band_hz(label).alias("band_hz"))


@query("select label, row_number() over (order by k) as place from (select distinct freq_hz || ' Hz' as label, freq_hz as k from spectra)", "spectra")
def o3_band_order(spark, d):
    """Labels by the value of their numbers: one row a band."""
    labels = spectra(spark, d).select(F.concat(F.col("freq_hz").cast("string"), F.lit(" Hz")).alias("label")).distinct()
    return labels.withColumn("place", F.row_number().over(Window.orderBy(X.natural_key(F.col("label")))).cast("long"))


@query("select position, ms, 'LAeq' as name, round(laeq, 6) as level from log union all select position, ms, 'LAFmax', round(lafmax, 6) from log union all select position, ms, 'LAF90', round(laeq - 1, 6) from log", "log")
def p2_map_columns(spark, d):
    """Levels under three-row names; names of no level go."""
    rows = log(spark, d)
    names = {"P1 (A; Fast) (TH)_LAeq [dB]": "laeq", "P2 (A, Slow)_LAFmax (SR)": "lafmax", "P1_Histogram LAeq_L90": "low", "P1_Battery": "low"}
    wide = rows.withColumn("low", F.col("laeq") - 1)
    long = wide.select("position", "ms", F.explode(F.array(*[F.struct(readers.three_row_name(F.lit(n))["name"].alias("name"), F.col(c).alias("level")) for n, c in names.items()])).alias("v")).select("position", "ms", "v.*")
    return long.where("name is not null").select("position", "ms", "name", "level")


@query("select event_id, round(case when event_id % 3 = 1 then laeq end, 6) as level, event_id % 3 = 1 as was_number from log", "log")
def p9_safe_numeric(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, "-.-").when(F.col("event_id") % 3 == 1, F.concat(F.lit(" "), F.col("laeq").cast("string"))).otherwise("")
    return log(spark, d).select("event_id", text.try_cast("double").alias("level")).withColumn("was_number", F.col("level").isNotNull())


@query("select event_id, round(laeq, 6) as laeq from log", "log")
def p4_select_columns(spark, d):
    return C.selected(log(spark, d), ["laeq", "absent"], ["event_id"])


OPTIONS = [("click", ["Datetime", "LAFmax", "LAF10"], "overview"), ("error", ["LAF90", None], None), ("purchase", [], "log"), ("signup", None, "")]
OPTION_ROWS = """, r as (select position, ms, 'LAeq' as name, null::double as freq_hz, laeq as level from log union all select position, ms, 'LAFmax', null, lafmax from log union all select position, ms, 'LZeq', 63, laeq from log),
 o(position, columns, profile) as (values ('click', ['LAFmax', 'LAF10'], 'overview'), ('error', ['LAF90'], null), ('purchase', null, 'log')),
 m as (select r.*, columns, coalesce(profile, 'file') as profile, freq_hz is null and columns is not null as selects from r left join o using (position))"""


def optioned(spark, d):
    """Two broadband levels and a band of each row, and what is asked of four positions."""
    level = lambda n, hz, c: F.struct(F.lit(n).alias("name"), F.lit(hz).cast("double").alias("freq_hz"), F.col(c).alias("level"))
    rows = log(spark, d).select(F.col("position").alias("path"), F.lit("file").alias("profile"), "ms", F.explode(F.array(level("LAeq", None, "laeq"), level("LAFmax", None, "lafmax"), level("LZeq", 63, "laeq"))).alias("v"))
    return rows.select("path", "profile", "ms", "v.*"), spark.createDataFrame(OPTIONS, "path string, columns array<string>, forced_profile string")


@query(OPTION_ROWS + " select position, profile, ms, name, freq_hz, round(level, 6) as level from m where not selects or list_contains(columns, name) union all select distinct position, profile, ms, null, null, null from m where position = 'error' and selects", "log")
def p4_source_options(spark, d):
    """One position keeps a level and gets a profile, one has none of those asked for, one only a profile, two are left alone."""
    return options.with_options(*optioned(spark, d)).withColumnRenamed("path", "position")


@query(OPTION_ROWS + " select position, array_to_string(list_sort(list_filter(columns, lambda c: not list_contains(names, c))), ',') as missing from (select position, columns, list(distinct name) as names from m where selects group by 1, 2)", "log")
def p4_missing_columns(spark, d):
    return options.missing(*optioned(spark, d)).select(F.col("path").alias("position"), F.array_join(F.array_sort("missing"), ",").alias("missing"))


@query("select position, ms, case freq_hz % 4 when 3 then 'LZFmax' else 'LZeq' end as param, freq_hz * 20.5::double as freq_hz, round(max(level), 6) as level from spectra group by 1, 2, 3, 4", "spectra")
def p6_unpivot_bands(spark, d):
    return C.unpivot_bands(wide(spark, d), ["position", "ms"])


@query("select distinct case freq_hz % 4 when 3 then 'LZFmax' else 'LZeq' end as param from spectra", "spectra")
def p7_spectral_params(spark, d):
    return C.unpivot_bands(wide(spark, d), ["position", "ms"]).select("param").distinct()


@query("select distinct position, freq_hz, case when freq_hz % 2 = 0 then (freq_hz // 2) || ' Hz' else printf('%.1f Hz', freq_hz / 2) end as label from spectra", "spectra")
def p8_frequency_labels(spark, d):
    return spectra(spark, d).select("position", "freq_hz", L.frequency_label(F.col("freq_hz") / 2).alias("label")).distinct()


@query(
    """with p as (select page_id, unnest(string_split(url, '/')) as part, generate_subscripts(string_split(url, '/'), 1) as idx from pages where url is not null)
 select page_id, idx, part || case when n > 1 then '_' || n else '' end as name from (select *, row_number() over (partition by page_id, part order by idx) as n from p)"""
)
def p10_unique_headers(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").where("url is not null")
    names = lines.numbered(F.split("url", "/"), 2)
    return p.select("page_id", F.posexplode(names).alias("i", "name")).select("page_id", (F.col("i") + 1).cast("long").alias("idx"), "name")
