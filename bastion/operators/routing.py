"""Route a query to a model through a (provider, complexity) dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import libraries as L
from ..functions.routing import complexity as complexity_col
from ..functions.text import col_of


def routing_dim(spark: SparkSession, overrides: dict[str, str] | None = None) -> DataFrame:
    """6-row dimension: provider, complexity -> model_name, rationale, router_rate.

    ``overrides`` maps a complexity class to a model; a blank value is ignored.
    """
    overrides = {k: v.strip() for k, v in (overrides or {}).items() if v and v.strip()}
    labels = dict(L.PROVIDER_LABELS)
    why = dict(L.RATIONALES)
    rows = [
        (prov, cx, overrides.get(cx, model), why[cx].format(label=labels[prov]), float(rate))
        for prov, cx, model, rate in L.ROUTING_DEFAULTS
    ]
    return spark.createDataFrame(
        rows, "provider string, complexity string, model_name string, rationale string, router_rate double")


def route(df: DataFrame, query: str = "query", role: str = "role", provider: Column | str | None = None,
          overrides: dict[str, str] | None = None, override_map: str | None = None) -> DataFrame:
    """T1 + T2. Adds complexity, provider, model_name, rationale, router_rate.

    ``provider`` is a column name/Column or None for the default provider. An
    ``override_map`` column (map complexity -> model) wins over the dimension per row.
    The dimension has a fixed size (2 providers x 3 classes), so broadcasting it is safe.
    """
    spark = df.sparkSession
    prov = F.lit(L.DEFAULT_PROVIDER) if provider is None else col_of(provider)
    out = df.withColumn("complexity", complexity_col(query, role)).withColumn(
        "provider", F.lower(F.trim(prov)))
    dim = routing_dim(spark, overrides)
    out = out.join(F.broadcast(dim), ["provider", "complexity"], "left")
    if override_map is not None:
        o = F.trim(F.col(override_map)[F.col("complexity")])
        out = out.withColumn("model_name", F.coalesce(F.when(o != "", o), F.col("model_name")))
    return out

