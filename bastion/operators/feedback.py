"""Feedback intake, eligibility and summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import libraries as L
from .monitoring import in_window, latest_ts


def intake(requests: DataFrame, rating: str = "rating", comment: str = "comment") -> tuple[DataFrame, DataFrame]:
    """A5: split into (valid, rejects). Valid needs rating +1/-1; comment cut to 500 chars."""
    ok = F.col(rating).isin(1, -1) & F.col("chat_id").isNotNull()
    valid = requests.where(ok).withColumn(
        comment, F.substring(F.coalesce(F.col(comment), F.lit("")), 1, L.FEEDBACK_COMMENT_CHARS))
    rejects = requests.where(~ok | F.col(rating).isNull()).withColumn(
        "reject_reason",
        F.when(F.col("chat_id").isNull(), F.lit("chat_id is required"))
        .otherwise(F.concat(F.lit("rating must be +1 or -1, got "), F.coalesce(F.col(rating).cast("string"),
                                                                                F.lit("None")))))
    return valid, rejects


def eligible(feedback: DataFrame, chats: DataFrame, chat_id: str = "chat_id",
             blocked: str = "guardrail_triggered", order_by: str = "ts") -> DataFrame:
    """Only ratings of non-blocked answers with a chat id; one per (chat, user), the first.

    A left-semi join against the eligible chat ids (a shuffle on chat_id; AQE turns
    it into a broadcast when the eligible side is small), then a row_number per
    (chat, user) — partitioned, never global.
    """
    ok = chats.where(~F.col(blocked) & F.col(chat_id).isNotNull()).select(chat_id)
    fb = feedback.join(ok, chat_id, "left_semi")
    w = Window.partitionBy(chat_id, "username").orderBy(F.col(order_by), F.col("id"))
    return fb.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def summary(feedback: DataFrame, hours: int = 24, as_of=None, rating: str = "rating") -> DataFrame:
    """A2: total, up, down (0 when empty), satisfaction % to 1 dp (NULL when empty)."""
    as_of = latest_ts(feedback) if as_of is None else as_of
    up = F.sum(F.when(F.col(rating) == 1, 1).otherwise(0))
    down = F.sum(F.when(F.col(rating) == -1, 1).otherwise(0))
    a = in_window(feedback, hours, as_of).agg(F.count(F.lit(1)).alias("total_ratings"),
                                              F.coalesce(up, F.lit(0)).cast("long").alias("thumbs_up"),
                                              F.coalesce(down, F.lit(0)).cast("long").alias("thumbs_down"))
    return a.withColumn("satisfaction_pct", F.round(
        F.lit(100.0) * F.col("thumbs_up") / F.when(F.col("total_ratings") != 0, F.col("total_ratings")), 1))
