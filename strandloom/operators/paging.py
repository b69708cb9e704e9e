"""Pages: offset, rank windows, and positions over a list of counted groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_SIZE = 5000
MOST_PAGES = 100


def total_pages(n: int, size: int = PAGE_SIZE) -> int:
    pages = max(1, math.ceil(n / size))
    if pages > MOST_PAGES:
        raise ValueError(f"{pages} pages; at most {MOST_PAGES} are served")
    return pages


def page_count(n: Column, size: int = PAGE_SIZE) -> Column:
    """total_pages() of a column: null where more would be asked for than are served."""
    pages = F.greatest(F.lit(1), F.ceil(n / size)).cast("int")
    return F.when(pages <= MOST_PAGES, pages)


def page(df: DataFrame, order: list[Column], number: int = 0, size: int = PAGE_SIZE) -> DataFrame:
    """Page number (from 0) in an order that must be total. Only MOST_PAGES are served: a later one would sort and skip without a bound."""
    if not 0 <= number < MOST_PAGES:
        raise ValueError(f"page {number}; the first {MOST_PAGES} are served")
    return df.orderBy(*order).offset(number * size).limit(size)


def rank_window(df: DataFrame, by: list[str], order: list[Column], after: int, upto: int) -> DataFrame:
    """Rows of each group with after < rank <= upto."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where((F.col("rank") > after) & (F.col("rank") <= upto))


def page_slices(counts: DataFrame, key: str, n: str, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """Which rows of which groups make up a page over groups in falling order of their counts: key, from (inclusive) and to. counts has a row for each requested track: at most a few hundred."""
    order = Window.orderBy(F.desc(n), key)
    upto = F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0))
    low, high = number * size, (number + 1) * size
    rows = counts.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col(n))
    inside = rows.where((F.col("_before") < high) & (F.col("_upto") > low))
    return inside.select(key, F.greatest(F.lit(0), low - F.col("_before")).cast("long").alias("first_row"), F.least(F.col(n), high - F.col("_before")).cast("long").alias("end_row"))


CONTENT = {"IDS": ["track_id"], "URLS": ["track_id", "url"], "BRIEF": None, "FULL": None}


def project(df: DataFrame, content: str, brief: list[str]) -> DataFrame:
    """The columns that a response content asks for."""
    if content == "COUNTS":
        return df.agg(F.count("*").alias("num_tracks"))
    wanted = brief if content == "BRIEF" else CONTENT[content]
    return df.select(*wanted) if wanted else df


def check_format(content: str, format: str, view: str = "DEFAULT") -> None:
    """VCF and BED need full content; views need full or brief."""
    if format in ("VCF", "BED") and content != "FULL":
        raise ValueError(f"{format} needs content FULL")
    if view != "DEFAULT" and content not in ("FULL", "BRIEF"):
        raise ValueError("a view needs content FULL or BRIEF")
