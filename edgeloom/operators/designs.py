"""Covariate designs of outcomes that different subjects have: a full-rank set of columns for each one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _kept(gram: np.ndarray, candidates: list[int]) -> list[int]:
    """Candidates, in order, that are no combination of a constant and those kept before. gram: centred cross products."""
    kept: list[int] = []
    for i in candidates:
        left = gram[i, i]
        if kept:
            left = left - gram[i, kept] @ np.linalg.solve(gram[np.ix_(kept, kept)], gram[kept, i])
        if left > 1e-10 * max(gram[i, i], np.finfo(float).tiny):
            kept.append(i)
    return kept


def outcome_designs(rows: DataFrame, indicators: dict[int, str], others: list[str]) -> DataFrame:
    """(outcome, n, reference_study, columns, rank): the design that each outcome's subjects allow.

    rows: (outcome, study_id, the indicators, the others), one row a subject that has the outcome. The lowest study present is the reference; candidates are the indicators
    (study to column) of the other studies present, ascending, then `others`. Constant and redundant columns go; rank counts the constant. An indicator that disagrees
    with the study, a study without one (but the reference) and a NULL cell are refused. One aggregate gives each outcome's cross products; what follows has one row an outcome.
    """
    columns = [indicators[s] for s in sorted(indicators)] + others
    agree = [F.col(c).eqNullSafe((F.col("study_id") == s).cast("int")) for s, c in indicators.items()]
    bad = F.greatest(F.col("study_id").isNull(), *(F.col(c).isNull() for c in columns), *(~a for a in agree)) if columns else F.col("study_id").isNull()
    cells = [F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")) for i, a in enumerate(columns) for b in columns[: i + 1]]
    summed = rows.groupBy("outcome").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.sort_array(F.collect_set("study_id")).alias("studies"), F.array(*cells).cast("array<double>").alias("cells"))
    known = sorted(indicators)

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lower = np.tril_indices(len(columns))
        for f in frames:
            found = []
            for outcome, n, wrong, studies, flat in zip(f["outcome"], f["n"], f["bad"], f["studies"], f["cells"], strict=True):
                present = [int(s) for s in studies]
                if wrong or not set(present[1:]) <= set(known):
                    raise ValueError(f"outcome {outcome}: indicators and studies do not agree")
                gram = np.zeros((len(columns), len(columns)))
                gram[lower] = flat
                gram = gram + np.tril(gram, -1).T
                candidates = [known.index(s) for s in present[1:]] + list(range(len(known), len(columns)))
                kept = _kept(gram, candidates)
                found.append((outcome, n, present[0], [columns[i] for i in kept], 1 + len(kept)))
            yield pd.DataFrame(found, columns=["outcome", "n", "reference_study", "columns", "rank"])

    kind = rows.schema["outcome"].dataType.simpleString()
    return summed.mapInPandas(choose, f"outcome {kind}, n long, reference_study int, columns array<string>, rank int")
