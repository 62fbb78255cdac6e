"""T1, T3, T4 as Column builders: complexity class, token estimate, cost."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import libraries as L
from .guards import any_keyword
from .text import col_of, memo_column, norm_role, strip, word_count


@memo_column
def complexity(query: Column | str, role: Column | str) -> Column:
    """T1: 'simple' | 'moderate' | 'complex'.

    The service's >40-word and multi-question tests also yield 'moderate', like the
    default, so they are folded into ``otherwise``.
    """
    q = strip(F.lower(col_of(query)))
    wc = word_count(q)
    starts = None
    for p in L.SIMPLE_PREFIXES:
        s = q.startswith(F.lit(p))
        starts = s if starts is None else (starts | s)
    return (
        F.when(norm_role(role).isin(*L.POWER_ROLES), F.lit("complex"))
        .when(any_keyword(q, L.COMPLEX_KEYWORDS), F.lit("complex"))
        .when(wc <= L.SIMPLE_MAX_WORDS, F.lit("simple"))
        .when(starts & (wc <= L.SIMPLE_PREFIX_MAX_WORDS), F.lit("simple"))
        .otherwise(F.lit("moderate"))
    )


@memo_column
def estimate_tokens(text: Column | str) -> Column:
    """``max(1, int(words * 1.3))`` in exact integer arithmetic."""
    words = word_count(text).cast("long")
    return F.greatest(F.lit(1), F.floor(words * L.TOKENS_PER_WORD_NUM / L.TOKENS_PER_WORD_DEN).cast("int"))


@memo_column
def rate_e8(model: Column | str) -> Column:
    """Cost per 1k tokens of ``model`` in 1e-8 USD; unknown model -> 0."""
    m = col_of(model)
    chain = None
    for name, r in L.MODEL_RATES_E8:
        chain = F.when(m == name, F.lit(r)) if chain is None else chain.when(m == name, F.lit(r))
    return chain.otherwise(F.lit(0)).cast("long")


def cost_usd(tokens: Column | str, model: Column | str) -> Column:
    """T4: ``round(tokens / 1000 * rate, 6)``, half up, exact (integer micro-dollars)."""
    micro_x100k = col_of(tokens).cast("long") * rate_e8(model) + F.lit(50000)
    return F.floor(micro_x100k / F.lit(100000)).cast("long") / F.lit(1_000_000.0)
