"""Filling containers of fixed capacity: vector best fit over shards of bounded size.

An item uses three capacities of its container: tokens, number of documents, and attention cost (the square
of its tokens). An item that by itself exceeds a capacity other than tokens has a container of its own. Items are dealt by hash into shards of about `shard_items`; within a shard, items go largest
first into the feasible bin that best fits in all three. Bins that are full enough are final; the items of the
others are dealt again into fewer shards, round by round, so that the space left over is that of a few bins
whatever the number of shards. No step collects an unbounded group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.tokens import DEFAULT_VOCABULARY, piece_sizes
from siltworks.session import materialize, widen

_ITEM = "container string, capacity int, doc_id bigint, piece int, start_token bigint, tokens int"
_PACKED = _ITEM + ", shard bigint, bin int, bin_tokens bigint"


@dataclass(frozen=True)
class Fit:
    """How bins are chosen: `norm` takes the least weighted norm of what would remain, `dot` the largest weighted
    product of need and residual. Weights are for tokens, documents and attention cost."""

    rule: str = "norm"
    weights: tuple[float, float, float] = (1.0, 0.02, 0.02)
    #: documents that a container takes per token of capacity, and at least
    documents_per_token: float = 1 / 32
    least_documents: int = 8
    #: attention cost that a container takes, as a share of the square of its capacity
    attention_share: float = 0.9

    def limits(self, capacity: int) -> tuple[float, float, float]:
        """Tokens, documents and attention cost that a container of this capacity takes."""
        return float(capacity), max(self.least_documents, capacity * self.documents_per_token), self.attention_share * float(capacity) ** 2


def items_of(documents: DataFrame, containers: Sequence[tuple[str, int]], vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """An item per text and container, or several where the text exceeds the capacity. Null texts give none."""
    sized = widen(documents.select(F.col("doc_id").cast("bigint"), "text")).where(F.col("text").isNotNull())
    sized = sized.select("doc_id", piece_sizes(F.col("text"), [c for _, c in containers], vocabulary).alias("sizes"))
    each = F.array(*[F.struct(F.lit(n).alias("container"), F.lit(c).alias("capacity"), F.col("sizes")[i].alias("sizes")) for i, (n, c) in enumerate(containers)])
    one = sized.select("doc_id", F.explode(each).alias("e")).select("doc_id", "e.*")
    rows = one.select("container", "capacity", "doc_id", "sizes", F.posexplode("sizes").alias("piece", "tokens"))
    start = F.aggregate(F.slice("sizes", F.lit(1), F.col("piece")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select("container", "capacity", "doc_id", "piece", start.alias("start_token"), "tokens")


def best_fit(tokens: np.ndarray, capacity: int, fit: Fit = Fit()) -> np.ndarray:
    """The bin of each item. Items are tried in the order given; each goes into the best open bin that it fits."""
    n = len(tokens)
    cap = fit.limits(capacity)
    need = np.stack([tokens / cap[0], np.full(n, 1 / cap[1]), np.minimum(tokens.astype(float) ** 2 / cap[2], 1.0)], axis=1)
    w = np.array(fit.weights)
    smallest = np.minimum.accumulate(tokens[::-1])[::-1] / cap[0]
    left, ids = np.empty((64, 3)), np.empty(64, dtype=np.int64)
    out, used, bins = np.empty(n, dtype=np.int64), 0, 0
    for i in range(n):
        if i % 256 == 255:  # bins that not even the smallest item still to come fits into
            keep = np.flatnonzero((left[:used, 0] + 1e-9 >= smallest[i]) & (left[:used, 1] + 1e-9 >= 1 / cap[1]))
            left[: len(keep)], ids[: len(keep)], used = left[keep], ids[keep], len(keep)
        rest = left[:used] - need[i]
        ok = (rest > -1e-9).all(axis=1)
        if ok.any():
            cost = (rest * rest) @ w if fit.rule == "norm" else -(left[:used] * need[i]) @ w
            k = int(np.where(ok, cost, np.inf).argmin())
        else:
            if used == len(left):
                left, ids = np.concatenate([left, np.empty_like(left)]), np.concatenate([ids, np.empty_like(ids)])
            k, left[used], ids[used] = used, 1.0, bins
            used, bins = used + 1, bins + 1
        left[k] -= need[i]
        out[i] = ids[k]
    return out


def pack(items: DataFrame, fit: Fit = Fit(), shard_items: int = 4096, full: float = 0.99, rounds: int = 5, seed: int = 7) -> DataFrame:
    """The items with their `bin` (unique per container) and the bin's tokens.

    No bin exceeds its capacity in tokens or documents, nor that in attention cost but for bins of one item. Items of equal size are placed in the
    order of their ids and pieces. Repeated rows are items of their own. An empty input gives an empty result.
    `full` is the share of the capacity from which a bin is final before the last round.
    """

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        bins = best_fit(pdf["tokens"].to_numpy(), int(pdf["capacity"].iloc[0]), fit)
        return pdf.assign(bin=bins.astype(np.int32), bin_tokens=np.bincount(bins, weights=pdf["tokens"]).astype(np.int64)[bins])

    done: DataFrame | None = None
    left, before = items, None
    for r in range(rounds):
        counts = {row["container"]: row["n"] for row in left.groupBy("container").agg(F.count("*").alias("n")).collect()}
        n = sum(counts.values())
        last = r == rounds - 1 or all(c <= shard_items for c in counts.values()) or (before is not None and n > 0.9 * before)
        shards = F.lit(1)
        for c, k in counts.items():
            shards = F.when(F.col("container").eqNullSafe(c), F.lit(max(1, -(-k // shard_items)))).otherwise(shards)
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(seed + r)), shards).cast("bigint"))
        packed = dealt.groupBy("container", "shard").applyInPandas(place, _PACKED)
        if not last:
            packed = materialize(packed)
        final = packed if last else packed.where(F.col("bin_tokens") >= F.floor(F.lit(full) * F.col("capacity")))
        named = final.select(*_ITEM_COLUMNS, F.concat_ws("-", F.lit(r), "shard", "bin").alias("bin"), "bin_tokens")
        done = named if done is None else done.unionByName(named)
        if last:
            return done
        left, before = packed.where(F.col("bin_tokens") < F.floor(F.lit(full) * F.col("capacity"))).select(*_ITEM_COLUMNS), n
    return done


_ITEM_COLUMNS = [c.split()[0] for c in _ITEM.split(", ")]


def fill_report(packed: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """Per container: bins used, tokens placed, the share of the bins' capacity that is used, and the bins at their limits
    of documents and of attention cost (97 % and more of it)."""
    tokens = F.col("tokens").cast("bigint")
    bins = packed.groupBy("container", "capacity", "bin").agg(F.count("*").alias("n"), F.sum(tokens).alias("t"), F.sum(tokens * tokens).alias("a"))
    documents = F.greatest(F.lit(fit.least_documents), F.floor(F.col("capacity") * F.lit(fit.documents_per_token)))
    attention = F.col("capacity").cast("double") ** 2 * F.lit(0.97 * fit.attention_share)
    totals = bins.groupBy("container", "capacity").agg(
        F.count("*").alias("bins"), F.sum("n").alias("items"), F.sum("t").alias("tokens"),
        F.count_if(F.col("n") >= documents).alias("bins_full_of_documents"), F.count_if(F.col("a") >= attention).alias("bins_full_of_attention"),
    )
    return totals.withColumn("least_bins", F.ceil(F.col("tokens") / F.col("capacity"))).withColumn("fill", F.round(F.col("tokens") / (F.col("bins") * F.col("capacity")), 6))


def placement_report(packed: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """Per container: the documents placed, and what must be none: bins over a capacity, texts cut needlessly or with gaps."""
    tokens = F.col("tokens").cast("bigint")
    bins = packed.groupBy("container", "capacity", "bin").agg(F.count("*").alias("n"), F.sum(tokens).alias("t"), F.sum(tokens * tokens).alias("a"))
    most = F.greatest(F.lit(float(fit.least_documents)), F.col("capacity") * F.lit(fit.documents_per_token))
    over = (F.col("t") > F.col("capacity")) | (F.col("n") > most) | ((F.col("n") > 1) & (F.col("a") > F.col("capacity").cast("double") ** 2 * F.lit(fit.attention_share)))
    texts = packed.groupBy("container", "capacity", "doc_id").agg(F.count("*").alias("n"), F.sum(tokens).alias("t"), F.max(F.col("start_token") + tokens).alias("end"), F.max("piece").alias("last"))
    odd = ((F.col("n") > 1) & (F.col("t") <= F.col("capacity"))) | (F.col("end") != F.col("t")) | (F.col("last") + 1 != F.col("n"))
    bad = bins.groupBy("container").agg(F.count_if(over).alias("overfull_bins"))
    return texts.groupBy("container").agg(F.count("*").alias("documents"), F.count_if(odd).alias("badly_cut")).join(bad, "container")
