"""Context and prompts from search results, temporal filters, and pluggable generation."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def context(results: DataFrame, sep: str = "\n") -> DataFrame:
    """One row ``context`` of results ``(rank, score, text)``: ``[Document i] (score: x.xxxx):`` and the text, in order of rank."""
    part = F.format_string("[Document %d] (score: %.4f):\n%s\n", F.col("rank").cast("int"), F.col("score"), F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct("rank", part.alias("p"))))
    return results.agg(F.array_join(F.transform(rows, lambda x: x["p"]), sep).alias("context"))


def prompt(results: DataFrame, question: str) -> DataFrame:
    """One row ``prompt``: instruction, context, question."""
    head = "Answer the question from the documents below.\n\n"
    return context(results).select(F.concat(F.lit(head), F.col("context"), F.lit(f"\nQuestion: {question}\nAnswer:")).alias("prompt"))


def generated(prompts: DataFrame, generate: Callable[[list[str]], list[str]], col: str = "prompt") -> DataFrame:
    """Adds ``answer`` by a function from prompts to answers, called once for each Arrow batch."""
    import pandas as pd

    @F.pandas_udf("string")
    def answer(texts: pd.Series) -> pd.Series:
        return pd.Series(generate(texts.tolist()))

    return prompts.withColumn("answer", answer(col))


def simulated(prompts: list[str]) -> list[str]:
    """A stand-in for a language model, the same in every run."""
    return [f"(simulated answer to a prompt of {len(p)} characters)" for p in prompts]


class Chat:
    """Questions in turn, with the history of ``(role, text)``."""

    def __init__(self, search: Callable[[str, int], DataFrame], generate: Callable[[list[str]], list[str]] = simulated, k: int = 5):
        self.search, self.generate, self.k = search, generate, k
        self.history: list[tuple[str, str]] = []

    def ask(self, question: str) -> str:
        results = self.search(question, self.k)
        if results.isEmpty():
            raise LookupError("nothing was found to answer from")
        text = prompt(results, question).first().prompt
        before = "\n".join(f"{role}: {said}" for role, said in self.history)
        answer = self.generate([f"{before}\n{text}" if before else text])[0]
        self.history += [("user", question), ("assistant", answer)]
        return answer


_UNITS = {"minute": 1 / 1440, "hour": 1 / 24, "day": 1, "week": 7, "month": 30, "year": 365}
_TIME = re.compile(r"(?i)\b(around|about|roughly|approximately)?\s*(\d+)\s+(minute|hour|day|week|month|year)s?(?:\s+ago)?\b")


def time_range(query: str, now: datetime) -> tuple[str, datetime | None, datetime | None]:
    """The query without its first time expression, and the range that this names.

    ``3 days ago`` is from then until now; with ``around`` it is a fifth of the distance either way of then. A month has 30
    days and a year 365.
    """
    m = _TIME.search(query)
    if m is None:
        return query, None, None
    days = int(m[2]) * _UNITS[m[3].lower()]
    at = now - timedelta(days=days)
    rest = " ".join((query[: m.start()] + query[m.end() :]).split())
    slack = timedelta(days=days * 0.2)
    return (rest, at - slack, at + slack) if m[1] else (rest, at, now)


def within(meta_dates: Column, start: Column, end: Column) -> Column:
    """Whether a date written as text or timestamp lies in the range, ends included; unreadable ones don't."""
    return F.coalesce(F.try_to_timestamp(meta_dates.cast("string")).between(start, end), F.lit(False))
