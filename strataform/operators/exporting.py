"""Exporting document bodies: retries, failures apart from results, limits on parallel calls."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Attempts, first delay in seconds, and calls at a time.
ATTEMPTS, BASE_DELAY, POOL = 5, 0.5, 4
#: Reasons in the body of a refusal (403) that pass with time.
PASSING = ("ratelimitexceeded", "quotaexceeded")


class Fatal(Exception):
    """An error that no other document would escape, such as lost access."""


class Refused(Exception):
    """An answer that isn't a success, with the seconds after which the server wants to be asked again, if it says so."""

    def __init__(self, status: int, body: str = "", retry_after: float | None = None):
        super().__init__(f"{status} {body}".strip())
        self.status, self.body, self.retry_after = status, body, retry_after

    def __reduce__(self):
        return Refused, (self.status, self.body, self.retry_after)


def is_retriable(status: Column, body: Column) -> Column:
    """Too many requests, server errors, and refusals that name a rate or a quota."""
    text = F.lower(F.coalesce(body, F.lit("")))
    limited = F.contains(text, F.lit(PASSING[0])) | F.contains(text, F.lit(PASSING[1]))
    return F.coalesce((status == 429) | (status >= 500) | ((status == 403) & limited), F.lit(False))


def passes(error: Exception) -> bool:
    """The same of an exception; a connection that broke counts as one that passes."""
    if isinstance(error, Refused):
        return error.status == 429 or error.status >= 500 or (error.status == 403 and any(x in (error.body or "").lower() for x in PASSING))
    return isinstance(error, (ConnectionError, TimeoutError))


def backoff(attempt: int, retry_after: float | None = None, chance: Callable[[], float] = random.random) -> float:
    """Seconds before the next attempt; a server's own wish goes first."""
    return retry_after if retry_after is not None else BASE_DELAY * 2**attempt * (1 + chance())


def with_retries(call: Callable[[], object], retriable: Callable[[Exception], bool] = passes, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep):
    for attempt in range(attempts):
        try:
            return call()
        except Fatal:
            raise
        except Exception as e:
            if attempt + 1 == attempts or not retriable(e):
                raise
            sleep(backoff(attempt, getattr(e, "retry_after", None)))


def export_documents(docs: DataFrame, fetch: Callable[[str], str], pool: int = POOL, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``doc_id, markdown, error`` of every document, at most ``pool`` calls at a time.

    A call that fails for a passing reason is made again.  A document that
    fails in the end has its error and no body; :class:`Fatal` ends the job.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc_id in part["doc_id"]:
                try:
                    rows.append((doc_id, with_retries(lambda d=doc_id: fetch(d), passes, attempts, sleep), None))
                except Fatal:
                    raise
                except Exception as e:
                    rows.append((doc_id, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "markdown", "error"])

    return docs.select("doc_id").repartition(pool).mapInPandas(run, "doc_id string, markdown string, error string")


def split_failures(exported: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results, and a table of failures from which the next run starts again."""
    return exported.where("error is null").select("doc_id", "markdown"), exported.where("error is not null").select("doc_id", "error")


def export_report(exported: DataFrame) -> DataFrame:
    """``exported, failed, total_chars``, one row."""
    return exported.agg(F.sum(F.col("error").isNull().cast("int")).alias("exported"), F.count("error").alias("failed"), F.coalesce(F.sum(F.length("markdown")), F.lit(0)).alias("total_chars"))
