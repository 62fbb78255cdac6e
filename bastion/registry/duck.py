"""DuckDB SQL fragments for the oracle side of the registered queries.

They restate the same pattern libraries in SQL (RE2 regex, CASE chains), so the
driver can compare a Spark result with an independent engine.
"""

from __future__ import annotations

from ..functions import libraries as L


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows: list[tuple], cols: list[str]) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return q(v)
        return str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS v({', '.join(cols)})"


def words(col: str) -> str:
    return f"len(regexp_extract_all({col}, '\\S+'))"


def strip(col: str) -> str:
    return f"regexp_replace({col}, '^\\s+|\\s+$', '', 'g')"


def pii_hit(col: str, name: str) -> str:
    return f"regexp_matches({col}, {q(dict(L.PII_PATTERNS)[name])})"


def pii_detected(col: str) -> str:
    parts = ", ".join(f"CASE WHEN {pii_hit(col, n)} THEN '{n}' END" for n, _ in L.PII_PATTERNS)
    return f"concat_ws(', ', {parts})"


def pii_count(col: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {pii_hit(col, n)} THEN 1 ELSE 0 END" for n, _ in L.PII_PATTERNS) + ")"


def pii_redact_ctes(src: str, text: str, prefix: str) -> tuple[str, str]:
    """CTE chain redacting ``text`` of relation ``src`` type by type; returns (ctes, last name).

    The last CTE carries all columns of ``src`` plus ``{prefix}_red``.
    """
    ctes = [f"{prefix}0 AS (SELECT *, {text} AS {prefix}_red FROM {src})"]
    for i, (n, p) in enumerate(L.PII_PATTERNS, start=1):
        ctes.append(
            f"{prefix}{i} AS (SELECT * REPLACE (CASE WHEN regexp_matches({text}, {q(p)}) "
            f"THEN regexp_replace({prefix}_red, {q(p)}, '[REDACTED_{n}]', 'g') ELSE {prefix}_red END "
            f"AS {prefix}_red) FROM {prefix}{i - 1})")
    return ",\n".join(ctes), f"{prefix}{len(L.PII_PATTERNS)}"


def injection_type(col: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, {q(p)}) THEN '{a}'"
                              for a, p in L.INJECTION_PATTERNS) + " ELSE '' END"


def injection_pattern(col: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, {q(p)}) THEN {q(p)}"
                              for a, p in L.INJECTION_PATTERNS) + " ELSE '' END"


def scope_category(col: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, {q(p)}) THEN '{c}'"
                              for c, p in L.OUT_OF_SCOPE_PATTERNS) + " END"


def first_keyword(lower_col: str, keywords: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN contains({lower_col}, {q(k)}) THEN {q(k)}" for k in keywords) + " END"


def any_keyword(lower_col: str, keywords: list[str]) -> str:
    return "(" + " OR ".join(f"contains({lower_col}, {q(k)})" for k in keywords) + ")"


def scope_cols(col: str, assistant: str = L.DEFAULT_ASSISTANT, company: str = L.DEFAULT_COMPANY) -> dict[str, str]:
    cat = scope_category(col)
    kw = first_keyword(f"lower({col})", L.in_scope_keywords(company))
    short = f"{words(col)} <= {L.SHORT_QUERY_MAX_WORDS}"
    cat_reason = (f"'Query appears to be about ' || lower(replace({cat}, '_', ' ')) || "
                  f"{q(', which is outside ' + assistant + chr(39) + 's scope.')}")
    return {
        "in_scope": f"CASE WHEN {cat} IS NOT NULL THEN false WHEN {kw} IS NOT NULL THEN true "
                    f"WHEN {short} THEN true ELSE false END",
        "reason": f"CASE WHEN {cat} IS NOT NULL THEN {cat_reason} WHEN {kw} IS NOT NULL THEN '' "
                  f"WHEN {short} THEN {q(L.MSG_SCOPE_SHORT)} ELSE {q(L.MSG_SCOPE_DEFAULT)} END",
        "matched_keyword": f"CASE WHEN {cat} IS NOT NULL THEN '' ELSE coalesce({kw}, '') END",
    }


def norm_role(col: str) -> str:
    return strip(f"lower({col})")


def complexity(query: str, role: str) -> str:
    ql = strip(f"lower({query})")
    wc = words(ql)
    starts = " OR ".join(f"starts_with({ql}, {q(p)})" for p in L.SIMPLE_PREFIXES)
    power = ", ".join(q(r) for r in L.POWER_ROLES)
    return (f"CASE WHEN {norm_role(role)} IN ({power}) THEN 'complex' "
            f"WHEN {any_keyword(ql, L.COMPLEX_KEYWORDS)} THEN 'complex' "
            f"WHEN {wc} <= {L.SIMPLE_MAX_WORDS} THEN 'simple' "
            f"WHEN ({starts}) AND {wc} <= {L.SIMPLE_PREFIX_MAX_WORDS} THEN 'simple' ELSE 'moderate' END")


def tokens(text: str) -> str:
    return f"CAST(greatest(1, ({words(text)} * 13) // 10) AS INTEGER)"


def roles_dim() -> str:
    rows = ", ".join(f"({q(r)}, {lvl})" for r, lvl in L.ROLE_LEVELS)
    return f"(VALUES {rows}) AS rl(role, level)"


def role_ns_dim() -> str:
    rows = ", ".join(f"({q(r)}, {q(ns)})" for r, nss in L.ROLE_NAMESPACES for ns in nss)
    return f"(VALUES {rows}) AS rn(role, namespace)"
