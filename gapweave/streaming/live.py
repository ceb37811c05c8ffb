"""The stateless operators applied to a stream of observations.

Range screening, scaling, clipping and calendar labels need no state, so the same functions that
serve the batch panel run on ``readStream`` frames. Gap filling itself is retrospective (it needs
the observation after the gap) and stays a batch job.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from gapweave.operators.grid import calendar_features, group_labels
from gapweave.operators.scaling import transform_minmax
from gapweave.operators.shape import range_screen


def prepare_stream(obs: DataFrame, bounds: Mapping[str, tuple[float, float]], scaler: DataFrame) -> DataFrame:
    """(site, variable, ts, value) stream -> screened, scaled and labelled stream; static scaler side."""
    d = range_screen(obs, bounds)
    d = transform_minmax(d, scaler)
    return group_labels(calendar_features(d))
