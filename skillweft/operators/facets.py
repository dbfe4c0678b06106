"""Optional AND-ed facet filters and the job selection they describe."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def _ints(value) -> tuple[int, ...]:
    """A number, a list of numbers or a comma list; zero and blanks mean 'no facet'."""
    if isinstance(value, str):
        value = [part.strip() for part in value.split(",")]
    if not isinstance(value, Iterable):
        value = [value]
    return tuple(int(v) for v in value if v not in (None, "", 0))


def _texts(value, split: bool = False) -> tuple[str, ...]:
    if isinstance(value, str):
        value = [part.strip() for part in value.split(",")] if split else [value]
    return tuple(v for v in (value or ()) if v)


@dataclass(frozen=True)
class Facets:
    """Filters on jobs; an empty tuple leaves that facet out."""

    keyword_ids: tuple[int, ...] = ()
    keywords: tuple[str, ...] = ()
    locations: tuple[str, ...] = ()
    companies: tuple[str, ...] = ()
    sizes: tuple[str, ...] = ()
    months: tuple[int, ...] = ()
    years: tuple[int, ...] = ()
    skill_types: tuple[str, ...] = ()
    fanout: bool = field(default=False)

    @classmethod
    def of(
        cls, *, keyword_id=None, keyword=None, location=None, company=None, employee_size=None,
        month=None, year=None, skill_type=None, multi=False, guarded=False, fanout=False,
    ) -> Facets:
        """Facets as request parameters: falsy values are skipped.

        ``multi`` splits text on commas; ``guarded`` ignores impossible months and years.
        """
        months, years = _ints(month), _ints(year)
        if guarded:
            months = tuple(m for m in months if 1 <= m <= 12)
            years = tuple(y for y in years if y > 1900)
        return cls(
            _ints(keyword_id), _texts(keyword), _texts(location, multi), _texts(company),
            _texts(employee_size), months, years, _texts(skill_type), fanout,
        )

    def touches_jobs(self) -> bool:
        return any((self.keyword_ids, self.keywords, self.locations, self.companies, self.sizes,
                    self.months, self.years))


def date_predicate(column: str, months: tuple[int, ...], years: tuple[int, ...]) -> Column | None:
    """Month/year test; years become date ranges so that scans and partitions are pruned."""
    tests = []
    if years:
        tests.append(reduce(
            lambda a, b: a | b,
            [(F.col(column) >= F.lit(dt.date(y, 1, 1))) & (F.col(column) < F.lit(dt.date(y + 1, 1, 1)))
             for y in sorted(set(years))],
        ))
    if months and len(set(years)) == 1:
        year = years[0]
        spans = []
        for month in sorted(set(months)):
            low = dt.date(year, month, 1)
            high = dt.date(year + month // 12, month % 12 + 1, 1)
            spans.append((F.col(column) >= F.lit(low)) & (F.col(column) < F.lit(high)))
        return reduce(lambda a, b: a | b, spans)
    if months:
        tests.append(F.month(column).isin(*months))
    return reduce(lambda a, b: a & b, tests) if tests else None


def all_of(tests: Iterable[Column | None]) -> Column | None:
    present = [t for t in tests if t is not None]
    return reduce(lambda a, b: a & b, present) if present else None


def any_of(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def is_one_of(column: str, values: tuple) -> Column | None:
    return F.col(column).isin(*values) if values else None


def filter_rows(df: DataFrame, facets: Facets, date_column: str = "posted_date") -> DataFrame:
    """Facets that are columns of ``df`` itself."""
    test = all_of([
        is_one_of("keyword_id", facets.keyword_ids),
        is_one_of("keyword", facets.keywords),
        is_one_of("company", facets.companies),
        is_one_of("employee_size", facets.sizes),
        date_predicate(date_column, facets.months, facets.years),
    ])
    return df.filter(test) if test is not None else df


def select_jobs(jobs: DataFrame, analysis: DataFrame, facets: Facets) -> DataFrame:
    """Jobs that pass the facets.

    The location facet looks at the analysed rows.  A job analysed twice still
    counts once, unless ``fanout`` asks for one row per analysis.
    """
    picked = filter_rows(jobs, facets)
    if facets.locations:
        places = analysis.filter(is_one_of("location", facets.locations)).select("job_id")
        how = "inner" if facets.fanout else "left_semi"
        picked = picked.join(places, F.col("id") == F.col("job_id"), how).select(*picked.columns)
    return picked


def select_links(
    links: DataFrame, jobs: DataFrame, analysis: DataFrame, facets: Facets
) -> DataFrame:
    """(job, skill) rows of the selected jobs; no join when no job facet is set."""
    if not facets.touches_jobs():
        return links
    picked = select_jobs(jobs, analysis, facets).select(F.col("id").alias("job_id"))
    how = "inner" if facets.fanout and facets.locations else "left_semi"
    return links.join(picked, "job_id", how)


def present(column: str, *sentinels: str) -> Column:
    """Not NULL, not blank and none of the sentinel texts."""
    return F.col(column).isNotNull() & ~F.col(column).isin("", *sentinels)


def blank(column: str) -> Column:
    return F.col(column).isNull() | (F.col(column) == "")


def contains_any(column: str, patterns: Iterable[str]) -> Column:
    """Case-insensitive containment of any text; ``%`` and ``_`` are ordinary characters."""
    return any_of([F.contains(F.lower(column), F.lit(p.lower())) for p in patterns])


def any_column_contains(df: DataFrame, term: str) -> DataFrame:
    """Rows with the term in any column, compared as lower-case text."""
    needle = F.lit(term.lower())
    cells = F.array(*[F.lower(F.col(c).cast("string")) for c in df.columns])
    return df.filter(F.exists(cells, lambda cell: F.contains(cell, needle)))


def or_default(column: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit(default))


def long_enough(column: str, minimum: int) -> Column:
    return F.coalesce(F.length(column) >= minimum, F.lit(False))
