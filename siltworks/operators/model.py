"""Answers of a model: recorded ones by the key of their request, or new ones by a function that the caller gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def request_key(columns: Sequence[str]) -> Column:
    """A key of the request's parts: equal for equal values, whatever the order in which the columns are named."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def answer(requests: DataFrame, recorded: DataFrame, key: str, scorer: Callable[[pd.Series], pd.Series] | None = None, prompt: str = "prompt") -> DataFrame:
    """Requests with `answer` and `source`: recorded, model or none.

    Recorded answers (key, answer) come first. What they lack goes to `scorer`, batch by batch on the executors,
    once per distinct key; without a scorer it stays unanswered.
    """
    held = recorded.select(key, "answer").where(F.col(key).isNotNull()).dropDuplicates([key])
    out = requests.join(held, key, "left").withColumn("source", F.when(F.col("answer").isNotNull(), "recorded").otherwise("none"))
    if scorer is None:
        return out

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["__key"]].assign(__new=scorer(pdf["__prompt"]))

    open_ = out.where("source = 'none'").select(F.col(key).alias("__key"), F.col(prompt).alias("__prompt")).dropDuplicates(["__key"])
    new = open_.mapInPandas(ask, "__key string, __new string")
    asked = out.join(new, F.col(key) == F.col("__key"), "left")
    return asked.withColumns({"answer": F.coalesce("answer", "__new"), "source": F.when(F.col("source") == "recorded", "recorded").when(F.col("__new").isNotNull(), "model").otherwise("none")}).drop("__key", "__new")
