"""Lexical overlap metrics as array set algebra on token sets.

Tokens are the distinct whitespace tokens of the lower-cased text, punctuation
kept. All metrics are plain Column expressions (array_intersect / size), so they
run in codegen on each row with no shuffle. Rounding is half-even (``bround``),
the rule Python's ``round`` applies to exactly representable ties.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_of, token_set


def f1_of_sets(a: Column, b: Column) -> Column:
    """Harmonic mean of precision and recall of two token sets; 0 if either is empty."""
    inter = F.size(F.array_intersect(a, b)).cast("double")
    na, nb = F.size(a).cast("double"), F.size(b).cast("double")
    p = inter / F.when(na > 0, na)
    r = inter / F.when(nb > 0, nb)
    return (F.when((na == 0) | (nb == 0), F.lit(0.0))
            .when(p + r == 0, F.lit(0.0))
            .otherwise(F.lit(2.0) * p * r / (p + r)))


def token_f1(a: Column | str, b: Column | str) -> Column:
    """E1 (unrounded)."""
    return f1_of_sets(token_set(a), token_set(b))


def share_of_set(answer: Column | str, context: Column | str) -> Column:
    """E2 on token sets: share of answer tokens present in the context; 0 for an empty answer; 3 dp."""
    a, c = col_of(answer), col_of(context)
    na = F.size(a).cast("double")
    return F.bround(F.when(na == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, c)) / na), 3)


def mean_f1_of_sets(question: Column | str, contexts: Column | str) -> Column:
    """E4 on token sets: mean of E1(question, c) over contexts; 0 when there are none; 3 dp."""
    q, ctx = col_of(question), col_of(contexts)
    total = F.aggregate(ctx, F.lit(0.0), lambda acc, c: acc + f1_of_sets(q, c))
    n = F.size(ctx)
    return F.bround(F.when(F.coalesce(n, F.lit(0)) <= 0, F.lit(0.0)).otherwise(total / n), 3)


def recall_of_sets(truth: Column | str, joined: Column | str, contexts: Column | str) -> Column:
    """E5 on token sets: E1(truth, all contexts joined); 0 when there are none; 3 dp."""
    n = F.coalesce(F.size(col_of(contexts)), F.lit(0))
    return F.bround(F.when(n <= 0, F.lit(0.0)).otherwise(f1_of_sets(col_of(truth), col_of(joined))), 3)


def faithfulness(answer: Column | str, context: Column | str) -> Column:
    """E2."""
    return share_of_set(token_set(answer), token_set(context))


def answer_relevancy(question: Column | str, answer: Column | str) -> Column:
    """E3."""
    return F.bround(token_f1(question, answer), 3)


def context_precision(question: Column | str, contexts: Column | str) -> Column:
    """E4."""
    return mean_f1_of_sets(token_set(question), F.transform(col_of(contexts), token_set))


def context_recall(ground_truth: Column | str, contexts: Column | str) -> Column:
    """E5."""
    return recall_of_sets(token_set(ground_truth), token_set(F.array_join(col_of(contexts), " ")), contexts)
