"""Dates, scores, vectors and dotted ids as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(text: Column) -> Column:
    """A date of the form YYYY-MM-DD, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def date_prefix(text: Column) -> Column:
    """The first ten characters if they have the form of a date, else null."""
    head = F.substring(F.trim(text), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head)


def any_timestamp(text: Column) -> Column:
    """ISO or US locale date text as a timestamp, else null."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]X", "yyyy-MM-dd'T'HH:mm:ss[.SSS]X", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy, h:mm:ss a")))


def us_date(text: Column) -> Column:
    return F.date_format(any_timestamp(text), "MM/dd/yyyy")


def clock(text: Column) -> Column:
    return F.date_format(any_timestamp(text), "HH:mm")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0 or the lengths differ."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def literal_vector(v: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def relevance(distance: Column) -> Column:
    """0 to 100, higher is better."""
    return F.round(F.greatest(F.lit(0.0), F.when(distance < 1, (1 - distance) * 100).otherwise(100 / (1 + distance))), 2)


def distance_to_cosine(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance * distance / 2)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, 2)).otherwise(0.0)


def cluster_color(dx: Column, dy: Column) -> Column:
    """Hue by direction from the global centroid; grey without a centroid, a fixed hue at the centre."""
    hue = F.bround(F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0))).cast("int")
    return (
        F.when(dx.isNull() | dy.isNull() | F.isnan(dx) | F.isnan(dy), "#6b7280")
        .when((F.abs(dx) < 1e-12) & (F.abs(dy) < 1e-12), "hsl(210, 75%, 45%)")
        .otherwise(F.format_string("hsl(%d, 75%%, 45%%)", hue))
    )


def argmax(values: Column) -> Column:
    """Place of the first largest value, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("long")


def dotted_key(topic: Column) -> Column:
    """Orders dotted ids part by part as numbers; what is no number comes last."""
    return F.transform(F.split(topic, r"\."), lambda p: F.coalesce(p.try_cast("long"), F.lit(10**9)))


def dotted_parts(topic: Column) -> Column:
    """Orders dotted ids part by part: numbers before texts, a prefix before what goes on from it."""
    def part(p: Column) -> Column:
        number = p.rlike(r"^-*\d+$")
        return F.struct(F.when(number, 0).otherwise(1).alias("kind"), F.coalesce(F.when(number, p.try_cast("long")), F.lit(0)).alias("number"), F.when(number, "").otherwise(p).alias("text"))

    return F.transform(F.split(topic, r"\."), part)


def natural_key(label: Column) -> Column:
    """Orders texts in any case, and the numbers within them by value."""
    return F.transform(F.regexp_extract_all(F.lower(label), F.lit(r"(\d+|\D+)")), lambda x: F.when(x.rlike(r"^\d+$"), F.lpad(x, 12, "0")).otherwise(x))


def dotted_prefix(topic: Column, parts: Column | int) -> Column:
    return F.array_join(F.slice(F.split(topic, r"\."), 1, parts), ".")


def cluster_id_order(topic: Column) -> list[Column]:
    """Numbers first, then -1, then the rest."""
    number = topic.try_cast("long")
    return [F.when(number.isNull(), 2).when(topic == "-1", 1).otherwise(0), F.coalesce(number, F.lit(0)), topic]
