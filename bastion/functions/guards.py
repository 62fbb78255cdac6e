"""Text guardrails as Column builders (PII, prompt injection, scope).

Every builder returns a Column, so the checks run inside whole-stage codegen on
whatever text column they are given: documents, chat messages, answers, a stream.
Ordered pattern lists become CASE WHEN chains, which short-circuit like the
original loops. Each regex is evaluated once per row: callers that need several
views of a result project the struct once and read its fields.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import libraries as L
from .text import col_of, memo_column, py_regex, word_count

NEVER = "(?!)"  # a regex that matches nothing


# ---------------------------------------------------------------------------
# PII
# ---------------------------------------------------------------------------

@memo_column
def pii_any(text: Column | str, unicode: bool = True) -> Column:
    """True iff any PII pattern matches: one combined scan (alternation of all types).

    "Some alternative matches somewhere" is exactly "some pattern matches", so this
    is a safe prefilter; clean rows — nearly all of them — skip the per-type scans.
    """
    combined = "|".join(f"(?:{p})" for _, p in L.PII_PATTERNS)
    return col_of(text).rlike(py_regex(combined, unicode))


@memo_column
def pii_hits(text: Column | str, unicode: bool = True) -> Column:
    """Struct of one boolean per PII type: at least one match in ``text``."""
    t = col_of(text)
    anyhit = pii_any(t, unicode)
    return F.struct(*[F.when(anyhit, t.rlike(py_regex(p, unicode))).otherwise(F.lit(False)).alias(name)
                      for name, p in L.PII_PATTERNS])


def pii_detected(hits: Column) -> Column:
    """G1: array of PII types with a match, in library order."""
    return F.array_compact(F.array(*[F.when(hits[name], F.lit(name)) for name, _ in L.PII_PATTERNS]))


def pii_redact(text: Column | str, hits: Column, unicode: bool = True) -> Column:
    """Replace matches type by type, in library order, on the running text.

    A type is replaced only if it matched the *original* text (``hits``), which is
    what makes a 10-digit number starting 6-9 show only the PHONE_US token. The
    condition picks the pattern (a never-matching one otherwise) instead of
    branching on the running text, so the expression stays linear in the number
    of types rather than doubling per type. Rows with no hit skip the chain.
    """
    cur = col_of(text)
    anyhit = None
    for name, p in L.PII_PATTERNS:
        pat = F.when(hits[name], F.lit(py_regex(p, unicode))).otherwise(F.lit(NEVER))
        cur = F.regexp_replace(cur, pat, F.lit(f"[REDACTED_{name}]"))
        anyhit = hits[name] if anyhit is None else (anyhit | hits[name])
    return F.when(anyhit, cur).otherwise(col_of(text))


@memo_column
def pii_findings(text: Column | str, unicode: bool = True) -> Column:
    """array<struct<type, match>> — every match, by type then position."""
    t = col_of(text)
    def tag(name):
        return lambda m: F.struct(F.lit(name).alias("type"), m.alias("match"))

    per_type = [F.transform(F.regexp_extract_all(t, F.lit(py_regex(p, unicode)), 0), tag(name))
                for name, p in L.PII_PATTERNS]
    return F.flatten(F.array(*per_type))


# ---------------------------------------------------------------------------
# Prompt injection
# ---------------------------------------------------------------------------

@memo_column
def detect_injection(text: Column | str, unicode: bool = True) -> Column:
    """struct(is_injection, attack_type, matched_pattern); first pattern wins.

    One combined scan comes first, so a clean row is scanned once and not 21 times.
    """
    t = col_of(text)
    combined = "|".join(f"(?:{p})" for _, p in L.INJECTION_PATTERNS)
    chain = None
    for attack, p in L.INJECTION_PATTERNS:
        hit = t.rlike(py_regex(p, unicode))
        val = F.struct(F.lit(True).alias("is_injection"), F.lit(attack).alias("attack_type"),
                       F.lit(p).alias("matched_pattern"))
        chain = F.when(hit, val) if chain is None else chain.when(hit, val)
    miss = F.struct(F.lit(False).alias("is_injection"), F.lit("").alias("attack_type"),
                    F.lit("").alias("matched_pattern"))
    return F.when(~t.rlike(py_regex(combined, unicode)), miss).otherwise(chain.otherwise(miss))


@memo_column
def injection_class(text: Column | str, unicode: bool = True) -> Column:
    """Class-only variant of G4: adjacent patterns of one class OR-ed into one regex."""
    t = col_of(text)
    groups: list[tuple[str, list[str]]] = []
    for attack, p in L.INJECTION_PATTERNS:
        if groups and groups[-1][0] == attack:
            groups[-1][1].append(p)
        else:
            groups.append((attack, [p]))
    chain = None
    for attack, pats in groups:
        hit = reduce(lambda a, b: a | b, [t.rlike(py_regex(p, unicode)) for p in pats])
        chain = F.when(hit, F.lit(attack)) if chain is None else chain.when(hit, F.lit(attack))
    return chain.otherwise(F.lit(""))


# ---------------------------------------------------------------------------
# scope
# ---------------------------------------------------------------------------

def trie_pattern(keywords: list[str]) -> str:
    """A regular expression that matches, at a place where keywords begin, the one that comes first in the list.

    Common beginnings are factored out, so a place is left at the first letter that no keyword goes on with. Keywords
    that differ in a letter exclude each other there, so only the order against a keyword that ends before matters:
    those after it in the list can never be the answer and are left out, those before it are tried first.
    """
    if "" in keywords:
        keywords = keywords[:keywords.index("")]
        ends = True
    else:
        ends = False
    branches: dict[str, list[str]] = {}
    for k in keywords:
        branches.setdefault(k[0], []).append(k[1:])
    parts = [(re.escape(c) if ord(c) < 128 else c) + trie_pattern(rest) for c, rest in branches.items()]
    if not parts:
        return ""
    if len(parts) == 1 and not ends:
        return parts[0]
    return "(?:" + "|".join(parts) + ")" + ("?" if ends else "")


def first_keyword(lower_text: Column, keywords: list[str]) -> Column:
    """First keyword (list order) contained in ``lower_text``; NULL when none. One scan, whatever the number of keywords."""
    listed = F.array(*[F.lit(k) for k in keywords])
    found = F.array_distinct(F.regexp_extract_all(lower_text, F.lit(f"(?=({trie_pattern(keywords)}))"), F.lit(1)))
    at = F.array_min(F.transform(found, lambda k: F.array_position(listed, k)))
    return F.get(listed, (at - 1).cast("int"))


def any_keyword(lower_text: Column, keywords: list[str]) -> Column:
    return lower_text.rlike(trie_pattern(keywords))


@memo_column
def out_of_scope_category(text: Column | str, unicode: bool = True) -> Column:
    """Category of the first out-of-scope pattern matching the raw text, else NULL."""
    t = col_of(text)
    chain = None
    for cat, p in L.OUT_OF_SCOPE_PATTERNS:
        hit = t.rlike(py_regex(p, unicode))
        chain = F.when(hit, F.lit(cat)) if chain is None else chain.when(hit, F.lit(cat))
    return chain


@memo_column
def scope_check(text: Column | str, company: str = L.DEFAULT_COMPANY,
                assistant: str = L.DEFAULT_ASSISTANT, unicode: bool = True) -> Column:
    """struct(in_scope, reason, matched_keyword). The role is not consulted."""
    t = col_of(text)
    cat = out_of_scope_category(t, unicode)
    kw = first_keyword(F.lower(t), L.in_scope_keywords(company))
    short = word_count(t) <= L.SHORT_QUERY_MAX_WORDS
    cat_text = F.lower(F.regexp_replace(cat, "_", " "))
    cat_reason = F.concat(F.lit("Query appears to be about "), cat_text,
                          F.lit(f", which is outside {assistant}'s scope."))
    return (
        F.when(cat.isNotNull(), F.struct(F.lit(False).alias("in_scope"), cat_reason.alias("reason"),
                                         F.lit("").alias("matched_keyword")))
        .when(kw.isNotNull(), F.struct(F.lit(True).alias("in_scope"), F.lit("").alias("reason"),
                                       kw.alias("matched_keyword")))
        .when(short, F.struct(F.lit(True).alias("in_scope"), F.lit(L.MSG_SCOPE_SHORT).alias("reason"),
                              F.lit("").alias("matched_keyword")))
        .otherwise(F.struct(F.lit(False).alias("in_scope"), F.lit(L.MSG_SCOPE_DEFAULT).alias("reason"),
                            F.lit("").alias("matched_keyword")))
    )
