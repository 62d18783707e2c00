"""Named metrics over two frame tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame

from framescope.operators import gradients, logs, relational, scoring
from framescope.operators.pairing import pair


@dataclass(frozen=True)
class Metric:
    """A configured metric: m(reference, distorted) is its score table."""

    feature: str
    options: dict = field(default_factory=dict)
    on_mismatch: str = "error"

    def __call__(self, reference: DataFrame, distorted: DataFrame) -> DataFrame:
        return scoring.score(pair(reference, distorted, self.on_mismatch), self.feature, **self.options)

    def loss(self, reference: DataFrame, distorted: DataFrame) -> DataFrame:
        """The table of the metric's loss; GMSD's is that of its mean, GMS."""
        if self.feature in ("mse", "psnr", "ssimulacra2"):
            raise ValueError(f"{self.feature} has no loss")
        feature = "gms" if self.feature == "gmsd" else self.feature
        return scoring.losses(Metric(feature, self.options, self.on_mismatch)(reference, distorted))

    def gradients(self, reference: DataFrame, distorted: DataFrame, upstream: DataFrame | float = 1.0) -> DataFrame:
        """Stripes of the score's gradients by both frames: ssim and ms_ssim have them."""
        return gradients.gradients(pair(reference, distorted, self.on_mismatch), self.feature, upstream, **self.options)

    def map(self, reference: DataFrame, distorted: DataFrame) -> DataFrame:
        return scoring.similarity_map(pair(reference, distorted, self.on_mismatch), self.feature, **self.options)


def score_frames(reference: DataFrame, distorted: DataFrame, feature: object, *, on_mismatch: str = "error", reduction: str = "none", log_path: str | None = None, log_format: str = "json", impl: str = "arrow", **options) -> DataFrame:
    """Pair two frame tables and score every pair. reduction "mean": one row over all frames. With
    log_path the scores are written there as a log first, and computed once for both: they stay cached for the
    caller, who may unpersist the result. impl "sql": by pixel relations (operators/relational.py), for one
    color_family, "GRAY" if none is given."""
    if impl not in ("arrow", "sql"):
        raise ValueError(f"impl is 'arrow' or 'sql', not {impl!r}")
    if reduction not in ("none", "mean"):
        raise ValueError(f"reduction is 'none' or 'mean', not {reduction!r}")
    if log_format not in logs.FORMATS:
        raise ValueError(f"a log format is one of {logs.FORMATS}, not {log_format!r}")
    scores = (relational if impl == "sql" else scoring).score(pair(reference, distorted, on_mismatch), feature, **options)
    if log_path is not None:
        scores = scores.persist()
        logs.write(scores, log_path, log_format)
    return scoring.batch(scores, options.get("data_range")) if reduction == "mean" else scores


def _single(name: str) -> Callable[..., DataFrame]:
    def metric(reference: DataFrame, distorted: DataFrame, **options) -> DataFrame:
        return score_frames(reference, distorted, name, **options)

    metric.__name__, metric.__doc__ = name, f"score_frames of {name} alone."
    return metric


psnr, mse, l1, charbonnier, huber, ssim, ms_ssim, gms, gmsd, lpips, ssimulacra2 = map(_single, "psnr mse l1 charbonnier huber ssim ms_ssim gms gmsd lpips ssimulacra2".split())


def engine_status() -> dict[str, str]:
    """Versions of what computes the scores."""
    return {"engine": "spark", "spark": pyspark.__version__, "kernels": f"numpy {np.__version__}, float64", "transfer": f"arrow {pa.__version__}", "impl": "arrow, sql"}
