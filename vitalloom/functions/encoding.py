"""Encoders: a user's model from texts to vectors as a column function."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import c

_LOADED: dict[str, Callable[[list[str]], Any]] = {}


def _model(name: str, load: Callable[[], Callable[[list[str]], Any]]) -> Callable[[list[str]], Any]:
    """The model of an encoder, loaded at the first call in this process."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def encoder(load: Callable[[], Callable[[list[str]], Any]], step: int = 256) -> Callable[[str | Column], Column]:
    """Column function from texts to ``array<double>``.

    ``load()`` runs once in each Python worker, not per task or batch, and returns a function from a list of texts to
    one vector each (a 2-d array or a list of lists). It is asked for ``step`` texts at a time, so its memory does not
    follow Spark's batch size. A null text has a null vector and never reaches the model.
    """
    name = uuid.uuid4().hex

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(name, load)
        for texts in batches:
            out = pd.Series([None] * len(texts), dtype=object)
            there = texts.notna().to_numpy().nonzero()[0]
            for at in range(0, len(there), step):
                part = there[at:at + step]
                vectors = model(texts.iloc[part].tolist())
                if len(vectors) != len(part):
                    raise ValueError(f"the encoder gave {len(vectors)} vectors for {len(part)} texts")
                for i, x in zip(part, vectors, strict=True):
                    out.iloc[i] = [float(v) for v in x]
            yield out

    return lambda text: encode(c(text))
