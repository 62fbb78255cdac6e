"""Pattern libraries, keyword lists and dimension values.

FIXED VALUES. Everything in this module must equal the values the guarded
question-answering service uses, in the same order, because results (first match
wins, redaction order, routing) depend on both content and order. Do not reorder.

Patterns are Java/RE2 compatible. The only rewrite is SSN: the original uses a
look-ahead, which RE2 (the DuckDB oracle) rejects; the form below accepts the same
language (area 001-899 except 666) without look-around.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: PII patterns, in library order (detected list and redaction order)
# ---------------------------------------------------------------------------
PII_PATTERNS: list[tuple[str, str]] = [
    ("SSN", r"\b(?:00[1-9]|0[1-9]\d|[1-5]\d{2}|6[0-57-9]\d|66[0-57-9]|[78]\d{2})[- ]?\d{2}[- ]?\d{4}\b"),
    ("CREDIT_CARD", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|6(?:011|5[0-9]{2})[0-9]{12})\b"),
    ("EMAIL", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("PHONE_US", r"\b(?:\+1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("PHONE_IN", r"\b(?:\+91[-.\s]?)?[6-9]\d{9}\b"),
    ("AADHAAR", r"\b[2-9]\d{3}\s?\d{4}\s?\d{4}\b"),
    ("PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"),
    ("PASSPORT", r"\b[A-Z][0-9]{7}\b"),
    ("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("DATE_OF_BIRTH", r"\b(?:0[1-9]|[12]\d|3[01])[-/.](?:0[1-9]|1[0-2])[-/.](?:19|20)\d{2}\b"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: prompt-injection patterns, in order (first match wins)
# ---------------------------------------------------------------------------
INJECTION_PATTERNS: list[tuple[str, str]] = [
    ("INSTRUCTION_OVERRIDE", r"(?i)ignore\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|context|rules?)"),
    ("INSTRUCTION_OVERRIDE", r"(?i)disregard\s+(all\s+)?(your\s+)?(instructions?|system\s+prompt|previous)"),
    ("INSTRUCTION_OVERRIDE", r"(?i)forget\s+(everything|all)\s+(you|i|we)\s+(told|said|wrote|instructed)"),
    ("INSTRUCTION_OVERRIDE", r"(?i)override\s+(your\s+)?(instructions?|rules?|guidelines?)"),
    ("JAILBREAK", r"(?i)\bdan\s+mode\b"),
    ("JAILBREAK", r"(?i)\bact\s+as\s+(dan|jailbreak|evil|unrestricted|uncensored)\b"),
    ("JAILBREAK", r"(?i)\bpretend\s+(you\s+have\s+no\s+(rules?|restrictions?|ethics?)|you\s+are\s+(free|unfiltered|evil))"),
    ("JAILBREAK", r"(?i)\byou\s+are\s+no\s+longer\s+(an?\s+)?(ai|assistant|chatbot)\b"),
    ("JAILBREAK", r"(?i)\bdo\s+anything\s+now\b"),
    ("JAILBREAK", r"(?i)\bjailbreak\b"),
    ("ROLE_HIJACK", r"(?i)you\s+are\s+now\s+(a|an|my)?\s+(hacker|attacker|adversary|evil|unrestricted)"),
    ("ROLE_HIJACK", r"(?i)(from\s+now\s+on|starting\s+now)\s*[,:]?\s*you\s+(will|must|should|are)\s+(act|behave|respond|answer)"),
    ("ROLE_HIJACK", r"(?i)your\s+(new\s+)?(role|persona|identity|instructions?|rules?)\s+(is|are|will\s+be)"),
    ("PROMPT_EXTRACTION", r"(?i)(print|repeat|show|reveal|tell\s+me|output|display)\s+(your\s+)?(system\s+prompt|initial\s+instructions?|original\s+prompt|full\s+instructions?)"),
    ("PROMPT_EXTRACTION", r"(?i)what\s+(are|were)\s+your\s+(original|initial|exact|full|original)\s+instructions?"),
    ("PROMPT_EXTRACTION", r"(?i)leak\s+(your\s+)?(system|internal|hidden)\s+(prompt|message|instructions?)"),
    ("SEPARATOR_INJECTION", r"(?i)(---+|===+|\*\*\*+)\s*\n\s*(system|human|assistant|user|instruction)\s*:"),
    ("SEPARATOR_INJECTION", r"\[INST\]|\[\/INST\]|<\|im_start\|>|<\|im_end\|>|<\|system\|>"),
    ("SEPARATOR_INJECTION", r"(?i)##\s*(system|instruction|override)\s*:"),
    ("CREDENTIAL_FISHING", r"(?i)(show|list|print|tell\s+me)\s+(all\s+)?(user|admin|system)\s+(passwords?|credentials?|login\s+info)"),
    ("CREDENTIAL_FISHING", r"(?i)what\s+(is|are)\s+(the\s+)?(admin|root|master)\s+password"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: scope filter — in-scope keywords (order: first contained wins)
# ---------------------------------------------------------------------------
IN_SCOPE_KEYWORDS: list[str] = [
    "revenue", "budget", "expense", "profit", "loss", "invoice", "payroll",
    "salary", "cost", "financial", "quarter", "fiscal", "accounting", "audit",
    "balance sheet", "cash flow", "tax", "investment", "valuation",
    "leave", "vacation", "policy", "employee", "hire", "onboard", "offboard",
    "performance review", "appraisal", "benefit", "insurance", "hr", "human resource",
    "resignation", "termination", "training", "learning",
    "system", "architecture", "api", "deployment", "incident", "bug", "feature",
    "sprint", "release", "codebase", "infrastructure", "database", "microservice",
    "pipeline", "devops", "kubernetes", "docker", "cloud",
    "campaign", "marketing", "brand", "lead", "conversion", "ctr", "roi",
    "social media", "seo", "content", "customer acquisition", "funnel",
    "company", "{company}", "department", "meeting", "report", "team", "manager",
    "project", "deadline", "roadmap", "strategy", "vision", "mission", "quarter",
]

# Parameters: company and assistant name used in the keyword list and in messages
DEFAULT_COMPANY = "Acme"
DEFAULT_ASSISTANT = "Acme-AI"

# FIXED VALUES: out-of-scope patterns, in order (first match wins), run on raw text
OUT_OF_SCOPE_PATTERNS: list[tuple[str, str]] = [
    ("GENERAL_TRIVIA", r"(?i)(what\s+is\s+the\s+(capital|population|area)\s+of|who\s+(invented|discovered|wrote)|which\s+year\s+was\s+.{1,50}\s+(born|founded|built))"),
    ("PERSONAL_ADVICE", r"(?i)(advise\s+me\s+on\s+my\s+(relationship|life|health)|what\s+should\s+i\s+(eat|wear|do\s+for\s+fun)|how\s+do\s+i\s+lose\s+weight)"),
    ("ENTERTAINMENT", r"(?i)(recommend\s+(a\s+)?(movie|show|book|song|game|restaurant)|best\s+(netflix|spotify|youtube)|top\s+10\s+(movies|songs|games))"),
    ("RELIGION_POLITICS", r"(?i)(which\s+(religion|political\s+party)\s+is\s+better|is\s+(god|allah|jesus|modi|biden|trump)\s+(real|good|bad|right))"),
    ("ILLEGAL_ACTIVITY", r"(?i)(how\s+to\s+(hack|crack|pirate|steal|bypass\s+security|launder\s+money))"),
    ("MEDICAL_ADVICE", r"(?i)(diagnose\s+(my|the)\s+(symptom|disease|illness)|what\s+(medicine|drug)\s+should\s+i\s+take)"),
]

# FIXED VALUES: guardrail messages (text of the blocked_reason / scope reason strings)
MSG_INJECTION = (
    "Your message contains patterns associated with prompt injection attacks ({attack}). "
    "This request has been blocked and logged."
)
MSG_PII = (
    "Your message appears to contain sensitive personal information ({types}). "
    "Please remove PII before continuing."
)
MSG_SCOPE = "{assistant} is an enterprise assistant and can only answer questions related to company operations. {reason}"
MSG_SCOPE_SHORT = "Short query, allowing by default."
MSG_SCOPE_DEFAULT = (
    "Query does not appear to relate to company operations, finance, HR, engineering, or marketing."
)
MSG_OUTPUT_PII = "Output contained PII ({types}), auto-redacted."
MSG_NO_DOCUMENTS = "No relevant documents found for your role and query."
SHORT_QUERY_MAX_WORDS = 5

# ---------------------------------------------------------------------------
# FIXED VALUES: roles — privilege level and namespace permissions
# ---------------------------------------------------------------------------
ROLE_LEVELS: list[tuple[str, int]] = [
    ("c-levelexecutives", 100),
    ("finance", 70),
    ("hr", 60),
    ("engineering", 50),
    ("marketing", 40),
    ("employee", 10),
]
ROLE_NAMESPACES: list[tuple[str, list[str]]] = [
    ("c-levelexecutives", ["finance", "hr", "engineering", "marketing", "general", "c-levelexecutives"]),
    ("finance", ["finance", "general"]),
    ("hr", ["hr", "general"]),
    ("engineering", ["engineering", "general"]),
    ("marketing", ["marketing", "general"]),
    ("employee", ["general"]),
]
UNRESTRICTED_ROLE = "c-levelexecutives"
DEFAULT_NAMESPACES = ["general"]
UNKNOWN_ROLE_LEVEL = 0
UNKNOWN_ROLE = "unknown"

# ---------------------------------------------------------------------------
# FIXED VALUES: complexity routing
# ---------------------------------------------------------------------------
COMPLEX_KEYWORDS: list[str] = [
    "compare", "contrast", "analyze", "analyse", "explain why", "reason",
    "calculate", "forecast", "predict", "evaluate", "assess", "strategy",
    "recommend", "justify", "pros and cons", "trade-off", "risk", "impact",
    "difference between", "how does", "why did", "what caused",
    "break down", "deep dive", "comprehensive", "step by step",
]
SIMPLE_PREFIXES: list[str] = [
    "what is", "who is", "when is", "where is", "define", "list",
    "name", "tell me", "show me", "give me the", "what are the",
]
POWER_ROLES: list[str] = ["c-levelexecutives"]
SIMPLE_MAX_WORDS = 8
SIMPLE_PREFIX_MAX_WORDS = 20

# FIXED VALUES: default models per provider and complexity; per-class rate of the router
ROUTING_DEFAULTS: list[tuple[str, str, str, float]] = [
    # provider, complexity, model, router rate per 1k tokens
    ("groq", "simple", "llama-3.1-8b-instant", 0.00005),
    ("groq", "moderate", "llama-3.3-70b-versatile", 0.00079),
    ("groq", "complex", "llama-3.3-70b-versatile", 0.00027),
    ("ollama", "simple", "llama3.2:1b", 0.0),
    ("ollama", "moderate", "llama3.2", 0.0),
    ("ollama", "complex", "mistral", 0.0),
]
PROVIDER_LABELS: list[tuple[str, str]] = [("groq", "Groq"), ("ollama", "Ollama")]
RATIONALES: list[tuple[str, str]] = [
    ("simple", "Short factual query - routed to the fast {label} model."),
    ("moderate", "Standard analytical query - routed to the balanced {label} model."),
    ("complex", "Complex reasoning query - routed to the strongest {label} model."),
]
DEFAULT_PROVIDER = "groq"

# ---------------------------------------------------------------------------
# FIXED VALUES: cost per 1k tokens by model (the logged cost uses this table).
# Stored as integer units of 1e-8 USD so rounding is exact in every engine.
# ---------------------------------------------------------------------------
MODEL_RATES_E8: list[tuple[str, int]] = [
    ("llama-3.1-8b-instant", 5_000),
    ("llama-3.3-70b-versatile", 79_000),
    ("mixtral-8x7b-32768", 27_000),
    ("llama3.2:1b", 0),
    ("llama3.2", 0),
    ("mistral", 0),
    ("gpt-3.5-turbo", 150_000),
    ("gpt-4o-mini", 15_000),
    ("gpt-4o", 500_000),
    ("claude-3-haiku", 25_000),
    ("claude-3-sonnet", 300_000),
    ("claude-3-opus", 1_500_000),
]
TOKENS_PER_WORD_NUM, TOKENS_PER_WORD_DEN = 13, 10  # 1.3 tokens per word, as integers

# ---------------------------------------------------------------------------
# FIXED VALUES: retrieval, cache and evaluation settings
# ---------------------------------------------------------------------------
RERANK_TOP_K = 4
RERANK_CANDIDATES = 8
CONTEXT_SEPARATOR = "\n\n-----\n\n"
CACHE_TTL_SECONDS = 3600
CACHE_THRESHOLD = 0.95
CACHE_MAX_SIZE = 500
EVAL_THRESHOLD = 0.3
EVAL_ANSWER_CHARS = 200
FEEDBACK_COMMENT_CHARS = 500
QUERY_HASH_HEX_CHARS = 16
CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
DASHBOARD_HOURS = [1, 6, 12, 24, 48, 168]
TREND_BUCKET = "5 minutes"
RECENT_EVENTS_LIMIT = 50
RECENT_CHATS_LIMIT = 100

# FIXED VALUES: answer prompt and hypothesis prompt templates
ANSWER_PROMPT = """You are {assistant}, an enterprise assistant for {company} company.
Your task is to give long, detailed, well-structured answers using ONLY the context provided.

Instructions:
- Provide a clear, multi-paragraph answer.
- Include explanations, examples, and reasoning steps when the context supports them.
- Never guess beyond the provided context.
- Write in a professional, easy-to-understand tone.
- Minimum length: 6-10 sentences.

User Role: {role}

Context:
{context}

Question:
{query}

Final Answer:"""

HYPOTHESIS_PROMPT = """You are a document expert. Write a concise, factual passage (2-4 sentences) \
that would directly answer the following question. \
Use professional, domain-specific language as if it came from an internal company document.

Question: {query}

Passage:"""


def in_scope_keywords(company: str = DEFAULT_COMPANY) -> list[str]:
    """Keyword list with the company name filled in (lower case, as tested)."""
    return [k.replace("{company}", company.lower()) for k in IN_SCOPE_KEYWORDS]
