"""Column functions on levels in dB, and scalar helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS, DAY_MS = 3_600_000, 86_400_000
# Nominal third-octave bands in Hz, 31.5 also as 31.
BANDS = [6.3, 8, 10, 12.5, 16, 20, 25, 31, 31.5, 40, 50, 63, 80, 100, 125, 160, 200, 250, 315, 400, 500, 630, 800, 1000, 1250, 1600, 2000, 2500, 3150, 4000, 5000, 6300, 8000, 10000, 12500, 16000, 20000]


def finite(x: Column) -> Column:
    """x, or null where it is missing: null, NaN or infinite."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def laeq(x: Column) -> Column:
    """Energy mean of the finite levels; null where there are none or the energy vanishes."""
    energy = F.sum(F.pow(F.lit(10.0), finite(x) / 10))
    return F.when(energy > 1e-12, 10 * F.log10(energy / F.count(finite(x))))


def lafmax(x: Column) -> Column:
    return F.max(finite(x))


def l_n(x: Column, n: int, accuracy: int | None = None) -> Column:
    """Level exceeded for n percent of the time: the (100 - n)th percentile, interpolated; with an accuracy an approximate one, for groups of very many distinct levels."""
    share = (100 - n) / 100
    return F.percentile(finite(x), share) if accuracy is None else F.percentile_approx(finite(x), share, accuracy)


def quantised(x: Column, low: Column, high: Column) -> Column:
    """Level as a small integer, half to even; missing is 20 below the lowest, infinities lie 10 outside the range."""
    y = F.when(x.isNull() | F.isnan(x), low - 20).when(x == float("inf"), high + 10).when(x == float("-inf"), low - 10).otherwise(x)
    return F.rint(y).cast("smallint")


def half_up3(x: Column) -> Column:
    return F.floor(x * 1000 + 0.5) / 1000


def log_window_ms(step_ms: Column) -> Column:
    """Window of a spectrogram: 15 minutes up to 100 ms steps, 60 minutes from 1 s, linear between; 15 for a bad step."""
    inner = 900_000 + (step_ms - 100) / 900 * 2_700_000
    return F.when(step_ms.isNull() | (step_ms <= 0), F.lit(900_000.0)).otherwise(F.least(F.greatest(inner, F.lit(900_000.0)), F.lit(3_600_000.0)))


def log_window_bins(step_ms: Column) -> Column:
    """Time bins of that window; null for a bad step."""
    return F.when(step_ms > 0, F.ceil(log_window_ms(step_ms) / step_ms))


def coverage(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    """Share of a window that the data's extent overlaps; of a window without width 1 where it lies inside, else 0."""
    over = F.greatest(F.lit(0), F.least(end, hi) - F.greatest(start, lo))
    return F.when(end > start, F.try_divide(over, end - start)).otherwise(((start >= lo) & (start <= hi)).cast("double"))


def heat(x: Column, lo: Column, hi: Column) -> Column:
    """x within its range as 0 to 1; a range below 1 dB counts as 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / F.greatest(hi - lo, F.lit(1.0))))


def frequency_label(hz: Column) -> Column:
    return F.when(hz == F.floor(hz), F.format_string("%d Hz", hz.cast("long"))).otherwise(F.format_string("%.1f Hz", hz))


def frequency_hz(label: Column) -> Column:
    """'1k', '1 kHz', '31.5_Hz' as a number; null for anything else."""
    low = F.lower(F.regexp_replace(label, "[ _]", ""))
    number = F.regexp_extract(low, r"^(\d+(?:\.\d+)?)k?(?:hz)?$", 1)
    value = F.when(number != "", number).cast("double")
    return F.when(low.rlike(r"^\d+(\.\d+)?k(hz)?$"), value * 1000).otherwise(value)


def band_hz(label: Column) -> Column:
    """frequency_hz of a nominal third-octave band; null for other frequencies."""
    hz = frequency_hz(label)
    return F.when(hz.isin([float(b) for b in BANDS]), hz)


def duration_text(ms: Column) -> Column:
    """'62m5s' from milliseconds, whole seconds; 0s where there is no length."""
    s = F.floor(ms / 1000).cast("long")
    m, r = F.floor(s / 60).cast("long"), s % 60
    return F.when(ms.isNull() | (ms <= 0), "0s").when(m > 0, F.format_string("%dm%ds", m, r)).otherwise(F.format_string("%ds", r))


def span_text(seconds: Column) -> Column:
    """'45 s', '12 min', '3.5 h' or '2.0 d'; empty for null. Halves go to the even neighbour."""
    whole = lambda x, unit: F.concat(F.rint(x).cast("long").cast("string"), F.lit(unit))
    tenth = lambda x, unit: F.concat(F.format_string("%.1f", F.bround(x, 1)), F.lit(unit))
    return (
        F.when(seconds.isNull(), "").when(seconds < 90, whole(seconds, " s")).when(seconds < 5400, whole(seconds / 60, " min"))
        .when(seconds < 172_800, tenth(seconds / 3600, " h")).otherwise(tenth(seconds / 86_400, " d"))
    )


def day(ms: Column) -> Column:
    return F.floor(ms / DAY_MS).cast("long")


def shifted(ms: Column, offset_ms: Column) -> Column:
    """Time moved by an offset of at most an hour either way."""
    return ms + F.greatest(F.lit(-HOUR_MS), F.least(F.lit(HOUR_MS), offset_ms))
