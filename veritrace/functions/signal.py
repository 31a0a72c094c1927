"""Audio operations on arrays of samples that need no more than array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mono(frames: Column) -> Column:
    """Mean over the channels of an array of frames."""
    return F.transform(frames, lambda f: F.aggregate(f, F.lit(0.0), lambda acc, x: acc + x) / F.size(f))


def peak_normalize(samples: Column, peak: float = 0.95) -> Column:
    """Scale down to the peak, where a sample is beyond it."""
    top = F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double"))))
    return F.when(top > peak, F.transform(samples, lambda x: x.cast("double") * (peak / top))).otherwise(samples.cast("array<double>"))


def echo(samples: Column, delay: int, decay: float) -> Column:
    """Add the signal of `delay` samples ago, times decay; peak-normalised."""
    doubles = samples.cast("array<double>")
    return peak_normalize(F.transform(doubles, lambda x, i: x + F.when(i >= delay, F.get(doubles, i - delay) * decay).otherwise(0.0)))


def clip(samples: Column, threshold: float = 0.25) -> Column:
    """Hard clipping, then back to the peak of 0.95."""
    cut = F.transform(samples.cast("array<double>"), lambda x: F.least(F.greatest(x, F.lit(-threshold)), F.lit(threshold)))
    return peak_normalize(F.transform(cut, lambda x: x / threshold))


def extract(samples: Column, rate: int, start: Column, end: Column, pad: float = 0.0) -> Column:
    """Samples from start to end (seconds), with padding, cut at the ends of the recording."""
    first = F.greatest(F.floor((start - pad) * rate), F.lit(0)).cast("int")
    last = F.least(F.floor((end + pad) * rate), F.size(samples)).cast("int")
    return F.when(last > first, F.slice(samples, first + 1, last - first)).otherwise(F.array().cast("array<double>"))


def to_pcm(samples: Column) -> Column:
    """16-bit samples: clipped to [-1, 1], times 32767, cut off."""
    return F.transform(samples, lambda x: (F.least(F.greatest(x.cast("double"), F.lit(-1.0)), F.lit(1.0)) * 32767).cast("int"))
