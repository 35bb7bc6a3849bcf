"""Dense twins over strips: whole rows of an image as arrays, for throughput.

One row holds one image (or one strip with the rows its kernel needs around it), so the
filters are matrix products inside Arrow batches, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.kernels import Interpolator, blur_weights, weights


def matrix(rows, osize: int, isize: int) -> np.ndarray:
    m = np.zeros((osize, isize))
    for o, i, w in rows:
        m[o, i] = w
    return m


def apply_axes(images: DataFrame, key: str, value: str, isize: tuple[int, int], mx: np.ndarray, my: np.ndarray) -> DataFrame:
    """images: a key and an array of height * width numbers; the result keeps the key and has the scaled array."""
    w, h = isize

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1)
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, h, w)
            out = (my @ flat @ mx.T).reshape(b.num_rows, -1)
            offsets = np.arange(b.num_rows + 1, dtype=np.int32) * out.shape[1]
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))], [key, value])

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, value).mapInArrow(run, f"{key} {kind}, {value} array<double>")


def resample(images: DataFrame, key: str, value: str, isize: tuple[int, int], osize: tuple[int, int], f: Interpolator) -> DataFrame:
    mx = matrix(weights(isize[0], osize[0], f), osize[0], isize[0]) if isize[0] != osize[0] else np.eye(isize[0])
    my = matrix(weights(isize[1], osize[1], f), osize[1], isize[1]) if isize[1] != osize[1] else np.eye(isize[1])
    return apply_axes(images, key, value, isize, mx, my)


def gaussian_blur(images: DataFrame, key: str, value: str, size: tuple[int, int], radius: float) -> DataFrame:
    return apply_axes(images, key, value, size, *(matrix(blur_weights(n, radius), n, n) for n in size))
