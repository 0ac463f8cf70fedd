"""Whole groups from a sorted partition, and connected components by joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialise


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], least: int = 2_000) -> Iterator[pd.DataFrame]:
    """Frames of whole groups (rows of one key are never torn apart) from the batches of a partition sorted by keys."""
    held: list[pd.DataFrame] = []
    size = 0
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        size += len(pdf)
        if size < least:
            continue
        pdf = pd.concat(held, ignore_index=True) if len(held) > 1 else pdf
        last = np.ones(len(pdf), bool)
        for k in keys:
            last &= (pdf[k] == pdf[k].iloc[-1]).to_numpy()
        cut = len(pdf) - int(last[::-1].argmin()) if not last.all() else 0
        if cut:
            yield pdf.iloc[:cut].reset_index(drop=True)
        held, size = [pdf.iloc[cut:]], len(pdf) - cut
    if size:
        yield pd.concat(held, ignore_index=True)


def starts_of(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """First row of each group of a sorted frame."""
    new = np.zeros(len(pdf), bool)
    new[:1] = True
    for k in keys:
        v = pdf[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a-b: the smallest node of each node's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        label = label[label]
        if (label == before).all():
            break
    return label


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each node's component, for the nodes of the links (a, b).

    Alternates a large-star and a small-star step, each a group-by-minimum and a join, until nothing changes. That takes
    few rounds, about the logarithm of the longest chain, and no bound ends it early. A hub's neighbours are never gathered.
    Each round is written to the shared folder, which cuts the lineage.
    """
    links = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    state = None
    while True:
        before = links
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written first, so that both sides of the join are plain shuffles, of which Spark can split a hub's partition
        low = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")), "low")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        large = materialise(large, "large")
        down = materialise(large.groupBy("a").agg(F.min("b").alias("low")), "down")
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(down.withColumnRenamed("low", "b"))
        links = materialise(small.where("a <> b").distinct(), "links")
        discard(before, low, large, down)  # nothing reads them again
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return links.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
