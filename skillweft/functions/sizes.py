"""Company size labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skillweft.dictionaries import (
    SIZE_LABELS_COMMA, SIZE_RANGES, SIZE_TEXT_PATTERNS, SIZE_WORDINGS,
)
from skillweft.functions.text import first_pair, let, strip

VALID_SIZES = [label for _, _, label in SIZE_RANGES]


def size_dimension(spark: SparkSession) -> DataFrame:
    """(ord, lo, hi, label, label_comma): the eight size classes in order."""
    rows = [(i, lo, hi, label, comma) for i, ((lo, hi, label), comma)
            in enumerate(zip(SIZE_RANGES, SIZE_LABELS_COMMA, strict=True), 1)]
    return spark.createDataFrame(rows, "ord INT, lo BIGINT, hi BIGINT, label STRING, label_comma STRING")


def size_label(number: Column, comma: bool = False) -> Column:
    """Head count -> label; negative numbers have none."""
    chain = F.when(number < 0, None)
    for (_, hi, label), other in zip(SIZE_RANGES, SIZE_LABELS_COMMA, strict=True):
        text = F.lit(other if comma else label)
        chain = chain.when(number <= hi, text) if hi is not None else chain.when(number.isNotNull(), text)
    return chain


def range_label(start: Column, end: Column) -> Column:
    """Label of a (start, end) range: by its start, open ranges are at least 10001."""
    is_open = end.isNull() | (end == 0)
    return size_label(F.when(is_open, F.greatest(start, F.lit(10001))).otherwise(
        F.when(start > 0, start).otherwise(F.lit(1))
    ))


def size_order(label: Column) -> Column:
    """Ordinal of a label in either style; NULL for unknown labels."""
    plain = F.replace(label, F.lit(","), F.lit(""))
    return F.coalesce(*[F.when(plain == name, F.lit(i)) for i, name in enumerate(VALID_SIZES, 1)])


def valid_or_null(label: Column) -> Column:
    return F.when(label.isin(*VALID_SIZES), label)


def _nonzero(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def normalize_size(raw: Column) -> Column:
    """Size text -> label with thousands commas; a lone number is classed by its value."""
    return let(strip(raw), _label_of)


def _label_of(text: Column) -> Column:
    anchored = [(f"(?i)^(?:{p})", label) for p, label in SIZE_TEXT_PATTERNS]
    by_pattern = first_pair(anchored, lambda p: F.rlike(text, p))

    def by_number(digits: Column) -> Column:
        number = digits.try_cast("decimal(38,0)")
        # more digits than fit a number are still more than the largest class
        too_long = number.isNull() & digits.isNotNull()
        return F.when(too_long, SIZE_LABELS_COMMA[-1]).when(number > 0, size_label(number, comma=True))

    digits = _nonzero(F.regexp_replace(text, r"[^\d]", ""))
    return F.coalesce(F.when(text.isin(*SIZE_LABELS_COMMA), text), by_pattern, let(digits, by_number))


def size_from_text(text: Column) -> Column:
    """First wording that yields a label, else the whole text as a size."""
    found = F.array(*[_nonzero(F.regexp_extract(text, p, 1)) for p in SIZE_WORDINGS], strip(text))
    labels = F.transform(found, _label_of)
    return F.get(F.filter(labels, lambda label: label.isNotNull()), F.lit(0))


def largest_number_label(text: Column) -> Column:
    """Label of the largest number in the text; '5rb' means 5000."""
    lowered = F.regexp_replace(strip(F.lower(text)), r"(\d+)rb", "$1000")
    numbers = F.transform(
        F.regexp_extract_all(lowered, F.lit(r"(\d{1,3}(?:[,.]\d{3})*|\d+)"), F.lit(1)),
        lambda n: F.regexp_replace(n, "[,.]", "").try_cast("decimal(38,0)"),
    )
    return size_label(F.array_max(numbers), comma=True)


def plain_size_text(value: Column) -> Column:
    """Drop a trailing 'employees' or 'karyawan' and spaces around '+'."""
    text = F.trim(F.regexp_replace(value, r"(?U)\s+", " "))
    text = F.trim(F.regexp_replace(text, r"(?i)\s+employees?$", ""))
    text = F.trim(F.regexp_replace(text, r"(?i)\s+karyawan$", ""))
    return _nonzero(F.trim(F.regexp_replace(text, r"\s*\+\s*$", "+")))
