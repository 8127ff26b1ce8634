"""Column functions that read and write the texts of names, times and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from soundtally.functions.levels import duration_text

# Roles of a survey's files, in the order in which they are named.
ROLES = ["log", "summary", "audio", "raw", "voice_note"]


def file_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)


def clean_position(name: Column) -> Column:
    """Without surrounding blanks, a leading small letter made a capital; the rest as it is. Null gives an empty text."""
    t = F.regexp_replace(F.coalesce(name, F.lit("")), r"^\s+|\s+$", "")
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))


def job_number(path: Column) -> Column:
    """The number of three digits or more that begins the path's file or, from the innermost on, a folder; null without one."""
    parts = F.reverse(F.split(F.regexp_replace(path, r"\\", "/"), "/"))
    return F.get(F.filter(F.transform(parts, lambda p: F.regexp_extract(p, r"^(\d{3,})\b", 1)), lambda n: n != ""), F.lit(0))


def date_comma_time_ms(text: Column) -> Column:
    """Milliseconds of 'YYYY-MM-DD, HH:MM:SS'; null for anything else."""
    form = r"^\s*(\d{4}-\d{2}-\d{2})\s*,\s*(\d{2}:\d{2}:\d{2})\s*$"
    both = F.concat_ws(" ", F.regexp_extract(text, form, 1), F.regexp_extract(text, form, 2))
    return F.unix_millis(F.try_to_timestamp(F.when(text.rlike(form), both), F.lit("yyyy-MM-dd HH:mm:ss")))


def meter_position(name: Column) -> Column:
    """The position in a meter file's name: a four-digit meter and a word before a date, all before a full stamp, or L and a number before _log or _summary; null for others."""
    forms = (r"^(\d{4}\s+\w+)_\d{4}_\d{2}_\d{2}", r"^(.+?)_\d{4}_\d{2}_\d{2}__\d{2}h\d{2}m\d{2}s_(?:log|summary)\.csv$", r"^(L\d+)_(?:log|summary)\.csv$")
    return F.coalesce(*[F.nullif(F.regexp_extract(name, f, 1), F.lit("")) for f in forms])


def source_kind(name: Column) -> Column:
    """sentry, svan or nti where a file's name tells it, else null."""
    low = F.lower(name)
    sectioned = low.rlike("_123_|_rta_3rd_") & low.rlike(r"(_log|_rpt_report)\.txt$")
    return F.when(low.rlike(r"_\d{4}_\d{2}_\d{2}__\d{2}h\d{2}m\d{2}s_(log|summary)\.csv$"), "sentry").when(low.rlike(r"(_log|_summary)\.csv$"), "svan").when(sectioned, "nti")


def contents(roles: Column) -> Column:
    """'log + summary + audio' of an array of roles: the known ones in their order, then others by name; 'data' where there are none."""
    known = F.array(*map(F.lit, ROLES))
    have = F.filter(roles, lambda r: r.isNotNull() & (r != ""))
    ordered = F.filter(known, lambda r: F.array_contains(have, r))
    return F.coalesce(F.nullif(F.array_join(F.concat(ordered, F.array_sort(F.array_except(have, known))), " + "), F.lit("")), F.lit("data"))


def one_place(x: Column) -> Column:
    """A level with one decimal place, N/A where it is missing."""
    fine = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(fine, F.format_string("%.1f", x)).otherwise("N/A")


def time_range(start: Column, end: Column) -> Column:
    """'HH:mm:ss.SSS-HH:mm:ss.SSS' of two times in milliseconds, the earlier first; N/A where one is missing."""
    clock = lambda ms: F.date_format(F.timestamp_millis(ms), "HH:mm:ss.SSS")
    return F.when(start.isNull() | end.isNull(), "N/A").otherwise(F.concat(clock(F.least(start, end)), F.lit("-"), clock(F.greatest(start, end))))


def region_summary(region_id: Column, position: Column, areas: Column, duration_ms: Column, laeq: Column, la90: Column, lafmax: Column) -> Column:
    """One line on a region; areas is an array of structs of start_ms and end_ms, la90 null where it isn't available."""
    spans = F.coalesce(F.nullif(F.array_join(F.transform(areas, lambda a: time_range(a["start_ms"], a["end_ms"])), " + "), F.lit("")), F.lit("N/A"))
    return F.concat(
        F.lit("Region "), region_id.cast("string"), F.lit(", "), position, F.lit(", "), spans, F.lit(", "), duration_text(duration_ms),
        F.lit(", LAeq "), one_place(laeq), F.lit(" dB, LAF90 "), one_place(la90), F.lit(", LAFmax "), one_place(lafmax), F.lit(" dB"),
    )


def spectrum_text(spectrum: Column) -> Column:
    """A header and a line for each band of an array of structs (label, level); empty where there are none."""
    lines = F.transform(spectrum, lambda b: F.concat(b["label"], F.lit("\t"), one_place(b["level"])))
    return F.when(F.size(spectrum) > 0, F.concat(F.lit("Band\tLAeq (dB)\n"), F.array_join(lines, "\n"))).otherwise("")


def natural_key(label: Column) -> Column:
    """Sorts labels without case and their numbers by value: digits before the point are filled up with zeros."""
    low = F.lower(F.trim(label))
    return F.array_join(F.transform(F.regexp_extract_all(low, F.lit(r"(\d+|\D+)"), F.lit(1)), lambda t: F.when(t.rlike(r"^\d") & (F.length(t) < 20), F.lpad(t, 20, "0")).otherwise(t)), "")


def number(text: Column) -> Column:
    """The number in a text, or null. What begins like a date isn't one and isn't tried: a failed cast costs Spark an exception, many times a good one's time."""
    return F.when(~text.rlike(r"^\s*\d{4}-\d\d?-\d"), text.try_cast("double"))
