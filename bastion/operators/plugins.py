"""Model plug-ins (V3 embedder, V8 pair scorer) as Arrow-batched iterator pandas UDFs.

A model is given as a zero-argument *loader*; it is called once per Python worker
process (cached at module level) and then applied to whole Arrow batches. Scorer
failures turn into NULL scores, which the rerank operator treats as "keep the
retrieval order" — the service's fallback.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

_MODELS: dict[bytes, object] = {}


def _model(load: Callable[[], object]):
    """The loaded model, cached per worker by the loader's serialized form.

    (Object ids are reused after garbage collection in a long-lived worker, so
    they cannot identify a loader.)
    """
    import hashlib

    from pyspark import cloudpickle

    key = hashlib.sha256(cloudpickle.dumps(load)).digest()
    if key not in _MODELS:
        _MODELS[key] = load()
    return _MODELS[key]


def model_embedder(load: Callable[[], Callable[[list[str]], "np.ndarray"]]):
    """Return ``embed(df, text, out)`` applying the loaded model to Arrow batches of ``text``."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(load)
        for s in batches:
            vecs = model(s.fillna("").tolist())
            yield pd.Series([np.asarray(v, dtype=np.float64).tolist() for v in vecs])

    def embed(df: DataFrame, text: str, out: str = "vec") -> DataFrame:
        return df.withColumn(out, _embed(F.col(text)))

    return embed


def pair_scorer(load: Callable[[], Callable[[list[tuple[str, str]]], "np.ndarray"]], query: str = "safe_query",
                text: str = "text"):
    """Return ``score(df)`` adding ``score`` from the loaded (query, passage) model; NULL on failure."""

    @F.pandas_udf(DoubleType())
    def _score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        try:
            model = _model(load)
        except Exception:  # noqa: BLE001 — a model that cannot load gives the fallback order
            model = None
        for q, t in batches:
            if model is None:
                yield pd.Series([None] * len(q), dtype="float64")
                continue
            try:
                yield pd.Series(np.asarray(model(list(zip(q.fillna(""), t.fillna("")))), dtype=np.float64))
            except Exception:  # noqa: BLE001
                yield pd.Series([None] * len(q), dtype="float64")

    def score(df: DataFrame) -> DataFrame:
        return df.withColumn("score", _score(F.col(query), F.col(text)))

    return score
