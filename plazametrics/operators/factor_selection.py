"""The number of factors by four votes, the final fit, and where its loadings come from."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import iterated
from . import composition, factor_model
from .venue import dense_counts

#: Seeds of the compared models and of the final fit.
COMPARED_SEED, FINAL_SEED = 0, 17


@dataclass
class Selection:
    """Votes, tables and the chosen factors. ``scope`` is empty where no count model was fitted."""

    votes: dict[str, int]
    selected: int
    fitted: int
    source: str
    scope: str
    loadings: np.ndarray
    scores: DataFrame
    table: DataFrame
    comparison: DataFrame | None
    parallel: DataFrame


def split_vectors(rows: DataFrame, venue: str, category: str, labels: Sequence, row_key: Column) -> DataFrame:
    """train and test: dense counts per venue, each row drawn by the hash of its key."""
    cells = composition.split_counts(rows, venue, category, row_key)
    dense = [dense_counts(cells, venue, category, name, labels, name) for name in ("train", "test")]
    return dense[0].join(dense[1], venue)


def with_source(scores: DataFrame, source: str) -> DataFrame:
    return scores.withColumn("factor_source", F.lit(source))


def select_factors(
    rows: DataFrame, venue: str, category: str, labels: Sequence, row_key: Column, max_factors: int = 4, count_model: bool = True
) -> Selection:
    """Median of parallel analysis, hold-out error and stability; with the count model also its held-out log score.

    Models are compared on nine tenths of the rows and the chosen one is fitted again on all. Without the chosen number
    the nearest one that could be fitted is taken; where the last fit fails, the compared one stays. Without the count
    model, factors are log-ratio components.
    """
    vectors = iterated(dense_counts(rows.groupBy(venue, category).agg(F.count("*").alias("n")), venue, category, "n", labels, "counts"))
    parallel = composition.parallel_analysis(vectors, venue)
    holdout = composition.holdout_reconstruction(vectors, venue)
    stability = composition.loading_stability(vectors, venue, max_k=min(4, len(labels)))
    votes = {
        "parallel": composition.suggested_factors(parallel),
        "holdout": composition.best_holdout(holdout),
        "stable": stability.where("stable").count(),
    }
    table = composition.selection_table(holdout, stability)
    selected, compared, usable = composition.consensus(*votes.values()), None, []
    if count_model:
        split = iterated(split_vectors(rows, venue, category, labels, row_key))
        fits = factor_model.fit(split, "train", range(1, min(max_factors, len(labels)) + 1), COMPARED_SEED)
        usable = [m for m in fits if np.isfinite(m.bound)]
    if usable:
        compared = factor_model.comparison(split, usable)
        votes["likelihood"] = compared.orderBy(F.desc_nulls_last("holdout_mean_log_score"), "n_factors").first()["n_factors"]
        selected = composition.consensus(*votes.values())
        fitted = composition.nearest_fitted(selected, [m.k for m in usable])
        last, scope = factor_model.fit(vectors, "counts", [fitted], FINAL_SEED)[0], "full_data_refit"
        if not np.isfinite(last.bound):
            last, scope = next(m for m in usable if m.k == fitted), "training_split_fallback"
        source, loadings = f"bayesian_lnm_K{fitted}", last.loadings
        scored = factor_model.score_table(vectors, venue, "counts", last)
        scores = scored.select(venue, *[F.col("factors")[i].alias(f"factor{i + 1}") for i in range(fitted)])
    else:
        fitted, scope, source = selected, "", f"clr_pca_K{selected}"
        loadings, scores = composition.clr_factors(vectors, venue, selected)
    return Selection(votes, selected, fitted, source, scope, loadings, with_source(scores, source), table, compared, parallel)
