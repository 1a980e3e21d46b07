"""Scaling and scoring of feature rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sqltext as sq
from ..schemas import DEFAULT_EVENTS


def scaler_stats(df: DataFrame, columns: Sequence[str] = DEFAULT_EVENTS) -> DataFrame:
    """Mean and population deviation per column, one row per column, in one pass."""
    wide = df.agg(
        *[F.expr(f"struct({sq.text(c)} AS feature, avg({sq.name(c)}) AS mean, stddev_pop({sq.name(c)}) AS std) AS {sq.name(c)}") for c in columns]
    )
    return wide.select(F.inline(F.array(*columns)))


@dataclass(frozen=True)
class Scaler:
    """Fitted means and deviations; a constant column scales to 0."""

    columns: tuple[str, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str] = DEFAULT_EVENTS) -> Scaler:
        rows = {r["feature"]: r for r in scaler_stats(df, columns).collect()}
        return cls(
            tuple(columns),
            tuple(float(rows[c]["mean"] or 0.0) for c in columns),
            tuple(float(rows[c]["std"] or 0.0) for c in columns),
        )

    def expressions(self) -> dict[str, str]:
        """SQL text of every scaled column, by column."""
        return {
            c: f"(coalesce(cast(`{c}` as double), 0D) - ({m!r}D)) / ({s!r}D)" if s else "0D"
            for c, m, s in zip(self.columns, self.means, self.stds)
        }

    def apply(self, df: DataFrame, prefix: str = "z_") -> DataFrame:
        return df.withColumns({prefix + c: F.expr(e) for c, e in self.expressions().items()})


@dataclass(frozen=True)
class Network:
    """Weights of a feed-forward net: one ``(matrix, bias)`` per layer, rectified inside, sigmoid at the end."""

    layers: tuple[tuple[tuple[tuple[float, ...], ...], tuple[float, ...]], ...]

def network_score(inputs: Sequence[Column], net: Network) -> Column:
    """Probability of the positive class (M10), as matrix products over Arrow batches; a null input scores null."""
    return _arrow_score(net)(F.array(*[c.cast("double") for c in inputs]))


def _arrow_score(net: Network):
    weights = [(np.array(m, dtype=float), np.array(b, dtype=float)) for m, b in net.layers]

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.stack(batch.to_numpy()).astype(float) if len(batch) else np.zeros((0, weights[0][0].shape[0]))
            for depth, (matrix, bias) in enumerate(weights):
                x = x @ matrix + bias
                if depth < len(weights) - 1:
                    x = np.maximum(x, 0.0)
            yield pd.Series(1.0 / (1.0 + np.exp(-x[:, 0])))

    return score


def linear_score(weights: dict[str, float], bias: float, digits: int | None = 6) -> Column:
    """Sigmoid of a weighted sum of event counts."""
    total = sum((F.col(e) * F.lit(w) for e, w in weights.items()), F.lit(bias))
    score = 1 / (1 + F.exp(-total))
    return F.round(score, digits) if digits is not None else score
