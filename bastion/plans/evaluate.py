"""Evaluation — samples (+ retrieved answers) -> metrics -> gate -> JSON report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import libraries as L
from ..operators.evaluation import attach_answers, per_question, report
from ..sources.sinks import write_report


def evaluate(samples: DataFrame, answers: DataFrame | None = None, threshold: float = L.EVAL_THRESHOLD,
             report_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(one-row report, per-question rows); both written below ``report_path`` when given."""
    per_q = per_question(attach_answers(samples, answers))
    rep = report(per_q, threshold, "dry_run" if answers is None else "live")
    if report_path:
        write_report(rep, per_q, report_path)
    return rep, per_q
