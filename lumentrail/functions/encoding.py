"""Vectors of texts and pictures, by an encoder that the caller brings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class VectorEncoder(Protocol):
    """What turns items into unit vectors of ``dims`` components, a batch at a time. It must pickle."""

    dims: int

    def encode(self, items: Sequence[str | bytes]) -> np.ndarray: ...


def encoded(items: Column, encoder: VectorEncoder) -> Column:
    """A column of texts (or bytes) as vectors of floats, null for null; Arrow batches go to the encoder whole."""
    dims = encoder.dims

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            known = batch.notna().to_numpy()
            rows: Iterator = iter(())
            if known.any():
                found = np.asarray(encoder.encode(batch[known].tolist()), np.float32)
                if found.shape != (int(known.sum()), dims):
                    raise ValueError(f"the encoder gave {found.shape}, not {(int(known.sum()), dims)}")
                rows = iter(found)
            yield pd.Series([next(rows) if k else None for k in known], dtype=object)

    return run(items)


def to_blob(a: Column) -> Column:
    """A vector as little-endian floats of four bytes; null stays null, a null component makes it null."""

    @F.pandas_udf("binary")
    def packed(vectors: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or any(x is None for x in v) else np.asarray(v, "<f4").tobytes() for v in vectors], dtype=object)

    return packed(a.cast("array<float>"))


def from_blob(blob: Column) -> Column:
    """The vector of such bytes; null for a length that is no multiple of four."""

    @F.pandas_udf("array<float>")
    def read(blobs: pd.Series) -> pd.Series:
        return pd.Series([None if b is None or len(b) % 4 else np.frombuffer(bytes(b), "<f4") for b in blobs], dtype=object)

    return read(blob)
