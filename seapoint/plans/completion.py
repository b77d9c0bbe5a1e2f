"""From answers per question back to one row per request, and the top-1 aggregate."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seapoint.plans.skew import HOT_ROWS, PART, most_crowded, split_join


def first_by(rows: DataFrame, keys: tuple[str, ...], order: list[Column], name: str) -> DataFrame:
    """The first row per group in the order of the given columns, as a struct.

    A minimum over a struct compares field by field and combines before the shuffle, so no group
    is held as a whole. Spark may plan it as a sort aggregate, which sorts the rows by key and
    spills. NULL sorts first: filter what must not win.
    """
    return rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias(name))


def per_request(
    requests: DataFrame,
    asked: DataFrame,
    answers: DataFrame,
    keys: tuple[str, ...],
    how: str = "left",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Give every request the answer to its question; without one, the answer is NULL.

    ``asked`` holds the number of copies per question. A question repeated by very many requests
    is cut into parts, so its requests are completed by several tasks.
    """
    hot = most_crowded(asked, list(keys), "n_copies", hot_rows)
    return split_join(requests, answers, list(keys), ["request_id"], hot, how).drop(PART)
