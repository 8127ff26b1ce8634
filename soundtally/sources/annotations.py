"""Markers and regions as CSV and JSON text: written and read."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from soundtally.functions.levels import half_up3
from soundtally.functions.texts import natural_key, number

CSV = {"header": True, "multiLine": True, "escape": '"', "ignoreLeadingWhiteSpace": False}
# Spellings of an area's two ends in JSON.
STARTS, ENDS = ["startUtc", "start", "start_utc"], ["endUtc", "end", "end_utc"]


def utc_text(ms: Column) -> Column:
    """YYYY-MM-DD HH:mm:ss.SSS"""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss.SSS")


def utc_ms(text: Column) -> Column:
    """Milliseconds from a number, or from a date and time with a space or T between and perhaps a Z; null for anything else."""
    t = F.trim(text)
    return F.coalesce(number(t).cast("long"), F.unix_millis(F.try_to_timestamp(F.regexp_replace(t, "[zZ]$", ""))))


# Columns of an annotation file after type and id, in order; bands follow.
BASE = ["type", "id", "positionId", "start_utc", "end_utc", "note", "color", "areas"]
PROVENANCE = ["chart_offset_ms", "source_start_utc", "source_end_utc", "source_areas"]
METRICS = ["timestamp_utc", "duration_ms", "metrics_parameter", "metrics_data_resolution", "metrics_duration_ms", "metrics_laeq", "metrics_lafmax", "metrics_la90", "metrics_la90_available", "metrics_broadband_value", "metrics_broadband_position", "metrics_timestamp_utc", "metrics_spectrum_source"]


def number_text(x: Column) -> Column:
    """A number with up to three places, halves up, without trailing zeros; empty where it is missing."""
    y = half_up3(x)
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.3f", y), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.coalesce(F.when(x.isNotNull() & ~F.isnan(x), text), F.lit(""))


def whole_text(x: Column) -> Column:
    return F.coalesce(F.floor(x + 0.5).cast("long").cast("string"), F.lit(""))


def band_columns(labels: DataFrame) -> list[tuple[str, str]]:
    """(key, column) of each distinct label of labels (label), in natural order. The columns of a table are named, so the labels come to the driver: bands, of which more than 1,000 are refused."""
    key = F.lower(F.trim("label"))
    named = labels.where(key != "").groupBy(key.alias("key")).agg(F.min("label").alias("label")).withColumn("order", natural_key(F.col("label")))
    rows = named.orderBy("order", "key").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1,000 band labels")
    out: list[tuple[str, str]] = []
    for r in rows:
        base = "band_" + (re.sub("_+", "_", re.sub("[^0-9A-Za-z_]+", "_", re.sub(r"\s+", "_", r["label"].strip()))).strip("_") or "value")
        name, n = base, 2
        while name in {c for _, c in out}:
            name, n = f"{base}_{n}", n + 1
        out.append((r["key"], name))
    return out


def annotation_rows(markers: DataFrame, areas: DataFrame, offsets: DataFrame | None = None, marker_facts: DataFrame | None = None, region_facts: DataFrame | None = None) -> DataFrame:
    """One row a marker of markers (marker_id, ms, position, note, color) and a region of areas (region_id, position, start_ms, end_ms), in BASE, PROVENANCE and METRICS columns, all text but id.

    A region's areas are JSON in order of time; its source times lie chart_offset_ms
    (offsets: position, chart_offset_ms) before the shown ones. marker_facts
    (marker_id, parameter, value, place, at_ms) and region_facts (region_id, parameter,
    dataset, duration_ms, laeq, lafmax, la90, la90_available, source) fill the metrics;
    without them a region's duration is that from its start to its end.
    """
    empty = lambda df, cols: df.select(*df.columns, *[F.lit("").alias(c) for c in cols if c not in df.columns])
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    known = markers if marker_facts is None else markers.join(marker_facts, "marker_id", "left")
    for c, t in (("parameter", "string"), ("value", "double"), ("place", "string"), ("at_ms", "long")):
        known = known if c in known.columns else known.withColumn(c, F.lit(None).cast(t))
    fine = F.col("value").isNotNull() & ~F.isnan("value")
    m = known.where("ms is not null").select(
        F.lit("marker").alias("type"), F.col("marker_id").alias("id"), text("position").alias("positionId"), utc_text(F.col("ms")).alias("start_utc"), utc_text(F.col("ms")).alias("timestamp_utc"), text("note").alias("note"), text("color").alias("color"),
        text("parameter").alias("metrics_parameter"), F.coalesce(utc_text(F.col("at_ms")), F.lit("")).alias("metrics_timestamp_utc"), number_text(F.col("value")).alias("metrics_broadband_value"), F.when(fine, text("place")).otherwise("").alias("metrics_broadband_position"),
    )
    shift = areas.withColumn("chart_offset_ms", F.lit(0)) if offsets is None else areas.join(offsets, "position", "left").fillna(0, ["chart_offset_ms"])
    span = F.array_sort(F.collect_list(F.struct("start_ms", "end_ms")))
    g = shift.groupBy("region_id", "position", "chart_offset_ms").agg(span.alias("a"), F.min("start_ms").alias("s"), F.max("end_ms").alias("e"))
    g = g if region_facts is None else g.join(region_facts, "region_id", "left")
    for c, t in (("parameter", "string"), ("dataset", "string"), ("duration_ms", "long"), ("laeq", "double"), ("lafmax", "double"), ("la90", "double"), ("la90_available", "boolean"), ("source", "string"), ("note", "string"), ("color", "string")):
        g = g if c in g.columns else g.withColumn(c, F.lit(None).cast(t))
    js = lambda off: F.to_json(F.transform("a", lambda x: F.struct(utc_text(x["start_ms"] - off).alias("startUtc"), utc_text(x["end_ms"] - off).alias("endUtc"))))
    length = whole_text(F.coalesce("duration_ms", F.col("e") - F.col("s")))
    r = g.select(
        F.lit("region").alias("type"), F.col("region_id").alias("id"), text("position").alias("positionId"), utc_text(F.col("s")).alias("start_utc"), utc_text(F.col("e")).alias("end_utc"), text("note").alias("note"), text("color").alias("color"), js(F.lit(0)).alias("areas"),
        text("chart_offset_ms").alias("chart_offset_ms"), utc_text(F.col("s") - F.col("chart_offset_ms")).alias("source_start_utc"), utc_text(F.col("e") - F.col("chart_offset_ms")).alias("source_end_utc"), js(F.col("chart_offset_ms")).alias("source_areas"),
        length.alias("duration_ms"), text("parameter").alias("metrics_parameter"), text("dataset").alias("metrics_data_resolution"), whole_text(F.col("duration_ms")).alias("metrics_duration_ms"),
        *[number_text(F.col(c)).alias(f"metrics_{c}") for c in ("laeq", "lafmax", "la90")], F.when(F.col("la90_available"), "true").otherwise("").alias("metrics_la90_available"), text("source").alias("metrics_spectrum_source"),
    )
    order = BASE + PROVENANCE + METRICS
    return empty(m, order).select(*order).unionByName(empty(r, order).select(*order))


def with_bands(rows: DataFrame, spectra: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, ...) and a column for each label of spectra (keys, label, level), as text of up to three places; labels differ whatever their case."""
    columns = band_columns(spectra)
    if not columns:
        return rows
    low = F.lower(F.trim("label"))
    wide = spectra.groupBy(*keys).agg(*[F.max(F.when(low == key, F.col("level"))).alias(name) for key, name in columns])
    return rows.join(wide, keys, "left").select(*rows.columns, *[number_text(F.col(f"`{n}`")).alias(n) for _, n in columns])


def write_csv(rows: DataFrame, place: str) -> None:
    rows.write.options(header=True, escape='"', quoteAll=False, emptyValue="").csv(place)


def area_ends(text: Column) -> Column:
    """An array of structs (a, b) of the areas in a JSON text: one or a list of objects, pairs, or texts of two times with a comma, semicolon or bar between. What isn't two times has null ends."""
    t = F.trim(text)
    entries = F.from_json(F.when(t.startswith("["), t).otherwise(F.concat(F.lit("["), t, F.lit("]"))), "array<string>")
    field = lambda x, keys: F.coalesce(*[F.get_json_object(x, f"$.{k}") for k in keys])
    part = lambda x, i: F.get(F.split(F.trim(x), r"\s*[,;|]\s*"), F.lit(i))
    end = lambda x, keys, i: F.when(x.startswith("{"), field(x, keys)).when(x.startswith("["), F.get_json_object(x, f"$[{i}]")).otherwise(part(x, i))
    texts = F.transform(entries, lambda x: F.struct(end(x, STARTS, 0).alias("a"), end(x, ENDS, 1).alias("b")))
    # texts first, so that no entry is parsed for each use of its ends
    return F.transform(texts, lambda x: F.struct(utc_ms(x["a"]).alias("a"), utc_ms(x["b"]).alias("b")))


def read_annotations(spark: SparkSession, place: str) -> DataFrame:
    """(type, id, position, note, color, ms, areas) of annotation files. Rows of another type, markers without a time, regions without a position or length are left out.

    Areas are read in all forms of ``area_ends``; a region without usable ones has its
    own start and end. Reversed ends are swapped.
    """
    raw = spark.read.options(**CSV).csv(place)
    s, e = utc_ms(F.col("start_utc")), utc_ms(F.col("end_utc"))
    tidy = F.transform(F.filter(area_ends(F.col("areas")), lambda x: x["a"].isNotNull() & x["b"].isNotNull() & (x["a"] != x["b"])), lambda x: F.struct(F.least(x["a"], x["b"]).alias("start_ms"), F.greatest(x["a"], x["b"]).alias("end_ms")))
    own = F.array(F.struct(F.least("__s", "__e").alias("start_ms"), F.greatest("__s", "__e").alias("end_ms")))
    kind, number = F.lower(F.trim("type")), F.col("id").try_cast("bigint")
    r = raw.withColumns({"kind": kind, "__s": s, "__e": e, "__a": tidy, "number": F.when(number > 0, number), "place": F.nullif(F.trim("positionId"), F.lit(""))})
    good = ((F.col("kind") == "marker") & F.col("__s").isNotNull()) | ((F.col("kind") == "region") & F.col("place").isNotNull() & (F.col("__s") != F.col("__e")))
    chosen = F.when(F.col("kind") == "region", F.when(F.size("__a") > 0, F.col("__a")).otherwise(own))
    return r.where(good).select(F.col("kind").alias("type"), F.col("number").alias("id"), F.col("place").alias("position"), F.coalesce("note", F.lit("")).alias("note"), F.nullif(F.trim("color"), F.lit("")).alias("color"), F.when(F.col("kind") == "marker", F.col("__s")).alias("ms"), chosen.alias("areas"))


def marker_rows(markers: DataFrame) -> DataFrame:
    """markers (id, ms, note, color, metrics) in the columns of a marker file."""
    return markers.select("id", F.col("ms").alias("timestamp_ms"), "note", "color", F.to_json("metrics").alias("metrics_json"), F.lit("").alias("selected"))


def read_markers(spark: SparkSession, place: str, metrics: str) -> DataFrame:
    """(id, ms, note, color, metrics) of marker files; rows without a finite time go, ids up to 0 are null. metrics: schema of their JSON."""
    raw = spark.read.options(**CSV).csv(place)
    t, n = F.col("timestamp_ms").try_cast("double"), F.col("id").try_cast("bigint")
    ok = t.isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf"))
    return raw.where(ok).select(F.when(n > 0, n).alias("id"), t.cast("long").alias("ms"), F.coalesce("note", F.lit("")).alias("note"), F.coalesce("color", F.lit("")).alias("color"), F.from_json("metrics_json", metrics).alias("metrics"))


def region_rows(areas: DataFrame, offsets: DataFrame | None = None, facts: DataFrame | None = None) -> DataFrame:
    """Regions of areas (region_id, position, start_ms, end_ms) in the fields of a region file.

    Source areas lie chart_offset_ms (offsets: position, chart_offset_ms) before the
    shown ones. facts (region_id, note, color, metrics) has a row for each region at most.
    """
    shift = areas.withColumn("chart_offset_ms", F.lit(0).cast("long")) if offsets is None else areas.join(offsets, "position", "left").fillna(0, ["chart_offset_ms"])
    g = shift.groupBy("region_id", "position", "chart_offset_ms").agg(F.array_sort(F.collect_list(F.struct(F.col("start_ms").alias("start"), F.col("end_ms").alias("end")))).alias("areas"))
    source = F.transform("areas", lambda x: F.struct((x["start"] - F.col("chart_offset_ms")).alias("start"), (x["end"] - F.col("chart_offset_ms")).alias("end")))
    g = g.withColumns({"start": F.col("areas")[0]["start"], "end": F.array_max(F.transform("areas", lambda x: x["end"])), "source": source})
    known = g.withColumns({"note": F.lit(""), "color": F.lit(None).cast("string"), "metrics": F.lit(None).cast("string")}) if facts is None else g.join(facts, "region_id", "left").fillna("", ["note"])
    return known.select(F.col("region_id").alias("id"), F.col("position").alias("positionId"), "areas", "start", "end", F.col("chart_offset_ms").alias("chartOffsetMs"), F.col("source").alias("sourceAreas"), "note", "metrics", "color")


def write_regions(regions: DataFrame, place: str) -> None:
    """region_rows as JSON lines."""
    regions.write.json(place)


def read_regions(spark: SparkSession, place: str) -> DataFrame:
    """Areas (region_id, position, start_ms, end_ms) of region files, from their areas or from start and end; those without length go."""
    raw = spark.read.schema("id long, positionId string, start double, end double, areas array<struct<start double, end double>>").json(place)
    areas = F.when(F.size("areas") > 0, F.col("areas")).otherwise(F.array(F.struct("start", "end")))
    long = raw.select(F.col("id").alias("region_id"), F.col("positionId").alias("position"), F.explode(areas).alias("x"))
    out = long.select("region_id", "position", F.least("x.start", "x.end").cast("long").alias("start_ms"), F.greatest("x.start", "x.end").cast("long").alias("end_ms"), F.col("x.start").isNotNull().alias("__a"), F.col("x.end").isNotNull().alias("__b"))
    return out.where("__a and __b and start_ms < end_ms").drop("__a", "__b")
