"""Re-ranking by a scorer that the caller brings, and the place that an incomplete but covering candidate may take."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import search


def scored(rows: DataFrame, query: str, entry: str, scorer: Callable[[list[tuple[str, str]]], list[float]], batch: int = 16) -> DataFrame:
    """``rows`` with ``rerank_score``: the scorer gets pairs of texts, ``batch`` at a time; scores are rounded to 6 digits."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pairs = list(zip(frame[query].fillna(""), frame[entry].fillna("")))
            got = [round(float(s), 6) for at in range(0, len(pairs), batch) for s in scorer(pairs[at : at + batch])]
            if len(got) != len(pairs):
                raise ValueError(f"the scorer gave {len(got)} scores for {len(pairs)} pairs")
            yield frame.assign(rerank_score=got)

    return rows.mapInPandas(run, f"{rows.schema.simpleString()[7:-1]}, rerank_score double")


def swap_in(rows: DataFrame, query: str, identity: str, place: str, limit: int) -> DataFrame:
    """(query, slot, key): the first ``limit`` rows of each query, where rows that deserve a place replace the weakest.

    A row deserves it if it lacks a required group but covers the query
    (``search.should_retain``) and its identity is not chosen yet. It replaces
    that row behind the first which does not deserve it itself and covers
    least; of equal ones the earliest. ``rows`` holds a query's candidates, a
    bounded number.
    """
    named = rows.select(F.col(query).alias("query"), F.col(identity).alias("identity"), F.col(place).alias("place"), "key", "query_coverage", F.col("primary_count").alias("n"), search.should_retain().alias("retain"))

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        found = frame.sort_values("place").to_dict("records")
        chosen = found[:limit]
        for row in found[limit:]:
            taken = {c["identity"] for c in chosen}
            if not row["retain"] or row["identity"] is None or row["identity"] in taken:
                continue
            weakest = min(range(1 if len(chosen) > 1 else 0, len(chosen)), key=lambda i: (chosen[i]["retain"], chosen[i]["query_coverage"], chosen[i]["n"], i))
            if not chosen[weakest]["retain"] and chosen[weakest]["query_coverage"] < row["query_coverage"]:
                chosen[weakest] = row
        return pd.DataFrame({"query": frame["query"].iloc[0], "slot": range(1, len(chosen) + 1), "key": [c["key"] for c in chosen]})

    return named.groupBy("query").applyInPandas(choose, "query long, slot int, key long")
