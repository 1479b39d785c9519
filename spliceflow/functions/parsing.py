"""Column expressions over caller text fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MISSING = ("", "NA", "NAN", "NULL")


def _parts(value: Column, sep: str = ",") -> Column:
    return F.transform(F.split(F.coalesce(value, F.lit("")), sep), lambda x: F.trim(F.translate(x, '"', "")))


def float_or_null(value: Column) -> Column:
    """The number; null for missing marks, other text, NaN and infinities."""
    text = F.trim(F.translate(value, '"', ""))
    number = F.when(~F.upper(text).isin(*_MISSING), text.try_cast("double"))
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def count_vector(value: Column) -> Column:
    """array<int> of "10,12,"; null where a gap stands before a value, or a part isn't a whole number of at least 0."""
    parts = _parts(value)
    filled = F.transform(parts, lambda x: ~x.isin("", "NA"))
    used = F.coalesce(F.size(parts) - F.array_position(F.reverse(filled), True).cast("int") + 1, F.lit(0))
    head = F.when(F.array_position(filled, True) > 0, F.slice(parts, 1, used)).otherwise(F.array().cast("array<string>"))
    numbers = F.transform(head, lambda x: x.try_cast("int"))
    return F.when(F.forall(numbers, lambda x: x.isNotNull() & (x >= 0)), numbers)


def inclusion_mean(value: Column) -> Column:
    """Mean of the finite parts; null without any."""
    numbers = F.filter(F.transform(_parts(value), float_or_null), lambda x: x.isNotNull())
    return F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x) / F.size(numbers))


def most_changing(dpsi: Column, probability: Column) -> Column:
    """struct(dpsi, probability) of the junction with the largest change, the first of equals; fields are ;- or ,-separated."""
    d = F.transform(_parts(F.translate(dpsi, ",", ";"), ";"), float_or_null)
    p = F.transform(_parts(F.translate(probability, ",", ";"), ";"), float_or_null)
    pick = F.aggregate(
        F.sequence(F.lit(0), F.size(d) - 1),
        F.lit(-1),
        lambda best, i: F.when(F.get(d, i).isNotNull() & ((best < 0) | (F.abs(F.get(d, i)) > F.abs(F.get(d, best)))), i).otherwise(best),
    )
    return F.struct(F.when(pick >= 0, F.get(d, pick)).alias("dpsi"), F.when((pick >= 0) & (pick < F.size(p)), F.get(p, pick)).alias("probability"))


def gene_name(symbol: Column, gene_id: Column) -> Column:
    """The symbol unless it is empty or NA, else the id, without quotes."""
    strip = lambda c: F.trim(F.translate(F.coalesce(c, F.lit("")), '"', ""))
    return F.when(~strip(symbol).isin("", "NA"), strip(symbol)).otherwise(strip(gene_id))


def event_type_of_tag(event_id: Column) -> Column:
    """Event type from an id such as GENE;A3:chr1:...; SE where no tag is known."""
    tag = F.upper(F.regexp_extract(event_id, r";([A-Za-z0-9]+):", 1))
    known = {"SE": "SE", "A3": "A3SS", "A5": "A5SS", "MX": "MXE", "RI": "RI", "AF": "AFE", "AL": "ALE"}
    out = F.lit("SE")
    for short, full in known.items():
        out = F.when(tag == short, full).otherwise(out)
    return out


def interval_std(low: Column, high: Column) -> Column:
    """Standard deviation implied by a 95 % interval; null unless low <= high."""
    return F.when(low <= high, (high - low) / (2 * 1.959963984540054))


def safe_cell(value: Column) -> Column:
    """Text for a spreadsheet: an apostrophe goes before a leading = + - @, tab, line break or apostrophe."""
    return F.when(value.rlike(r"^[=+\-@\t\r\n']"), F.concat(F.lit("'"), value)).otherwise(value)


def restored_cell(value: Column) -> Column:
    """What safe_cell() was given: one leading apostrophe goes."""
    return F.regexp_replace(value, r"^'", "")


def region(value: Column) -> Column:
    """struct(chrom, s, e) of chrom:start-end, thousands separated or not, starts 1-based; null where it can't be read."""
    text = F.translate(value, ",", "")
    part = lambda k: F.regexp_extract(text, r"^(.+):(\d+)-(\d+)$", k)
    return F.when(part(1) != "", F.struct(part(1).alias("chrom"), (part(2).try_cast("long") - 1).alias("s"), part(3).try_cast("long").alias("e")))


def event_id(event_type: Column, chrom: Column, strand: Column, *coordinates: Column) -> Column:
    return F.concat_ws(":", event_type, chrom, F.concat_ws("-", *(c.cast("string") for c in coordinates)), strand)
