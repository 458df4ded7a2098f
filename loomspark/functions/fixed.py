"""Lists, patterns and texts that results depend on literally."""

# Question types in order of precedence, with the substrings that signal them.
COMPARISON_WORDS = ["compare", "versus", "vs", "difference", "differ", "contrast", "better", "worse", "advantage", "disadvantage", "pros", "cons"]
CAUSAL_WORDS = ["why", "cause", "because", "reason", "result", "effect", "impact", "consequence", "lead to", "due to"]
TEMPORAL_WORDS = ["when", "before", "after", "during", "timeline", "history", "first", "last", "recent", "earliest", "latest", "evolution"]
AGGREGATION_WORDS = ["all", "every", "list", "summarize", "overview", "main themes", "what are the", "how many", "enumerate"]
# Patterns of questions over several hops.
MULTI_HOP_SIGNALS = ["and also", "in addition", "furthermore", "as well as", "both", "relationship between", "how does.*relate", "connection between"]

# Injection patterns, matched without regard to case.
INJECTION_PATTERNS = [
    r"ignore\s+(all\s+)?(previous|above|prior)\s+(instructions?|prompts?|rules?)",
    r"disregard\s+(all\s+)?(previous|above|prior)\s+(instructions?|prompts?)",
    r"forget\s+(all\s+)?(previous|above|prior)\s+(instructions?|context)",
    r"(print|show|reveal|display|output|repeat)\s+(your\s+)?(system\s+)?(prompt|instructions?|rules?)",
    r"what\s+(are|is)\s+your\s+(system\s+)?(prompt|instructions?|rules?)",
    r"you\s+are\s+now\s+(a|an|the)\s+",
    r"act\s+as\s+(a|an|the)\s+",
    r"pretend\s+(to\s+be|you\s+are)\s+",
    r"switch\s+to\s+.*mode",
    r"DAN\s+mode",
    r"developer\s+mode",
    r"do\s+anything\s+now",
    r"bypass\s+(your\s+)?(safety|filter|restriction|guard)",
    r"base64\s*:",
    r"\\x[0-9a-fA-F]{2}",
    r"<\|.*\|>",
    r"\[INST\]",
    r"\[/INST\]",
    r"<<SYS>>",
    r"<</SYS>>",
]
# Suspicious tokens, matched without regard to case.
SUSPICIOUS_TOKENS = ["```system", "```instruction", "<system>", "</system>", "ADMIN:", "ROOT:", "OVERRIDE:", "SUDO:"]

# Personal data patterns in order of precedence, and what replaces a match. (?i) where case does not matter.
PII_PATTERNS = {
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "PHONE_US": r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "SSN": r"\b\d{3}[-.\s]?\d{2}[-.\s]?\d{4}\b",
    "CREDIT_CARD": r"\b(?:\d{4}[-.\s]?){3}\d{4}\b",
    "IP_ADDRESS": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "DATE_OF_BIRTH": r"(?i)\b(?:DOB|date of birth|born on)[:\s]*\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b",
    "AWS_KEY": r"\bAKIA[0-9A-Z]{16}\b",
    "API_KEY": r"(?i)\b(?:sk-|pk_|rk_|api[_-]?key[=:\s]+)[A-Za-z0-9_-]{20,}\b",
}
REDACTIONS = {
    "EMAIL": "[EMAIL_REDACTED]",
    "PHONE_US": "[PHONE_REDACTED]",
    "SSN": "[SSN_REDACTED]",
    "CREDIT_CARD": "[CARD_REDACTED]",
    "IP_ADDRESS": "[IP_REDACTED]",
    "DATE_OF_BIRTH": "[DOB_REDACTED]",
    "AWS_KEY": "[AWS_KEY_REDACTED]",
    "API_KEY": "[API_KEY_REDACTED]",
}

# Document types by file suffix; files of other suffixes are not scanned.
DOCUMENT_TYPES = {".md": "markdown", ".txt": "plaintext", ".pdf": "pdf", ".html": "html", ".json": "json", ".py": "code", ".js": "code", ".ts": "code"}
SCANNED_SUFFIXES = [".txt", ".md", ".html", ".json", ".py", ".js", ".ts", ".csv"]

# Drafting strategies by partition number.
DRAFT_STRATEGIES = ["step_by_step", "evidence_first", "contrarian_check"]

# Recommendations by failure type.
RECOMMENDATIONS = {
    "wrong_entity": "WRONG_ENTITY: Improve entity disambiguation in graph retriever. Consider adding entity descriptions to the fuzzy matching.",
    "missing_context": "MISSING_CONTEXT: Expand corpus or enable web search fallback. Check if relevant docs exist but aren't being retrieved.",
    "hallucination": "HALLUCINATION: Tighten Self-RAG support threshold. Consider increasing CRAG confidence threshold.",
    "no_retrieval": "NO_RETRIEVAL: Check index coverage. Enable HyDE for better recall on unusual queries.",
    "wrong_reasoning": "WRONG_REASONING: Improve CoT decomposition. Consider adding more reasoning strategies to Speculative RAG.",
}

# Warnings of a response.
WARN_INCORRECT = "Retrieval quality was low; web search fallback was used"
WARN_AMBIGUOUS = "Retrieved context may not fully cover the query"
WARN_SUPPORT = "Some claims may not be fully supported by sources"
WARN_SOURCES = "No sources were found for this query"

# Metrics that are averaged and compared with a baseline.
RETRIEVAL_METRICS = ["precision@10", "recall@10", "mrr", "ndcg@10", "hit_rate", "entity_coverage"]
GENERATION_METRICS = ["faithfulness", "answer_relevance", "context_precision", "answer_similarity"]
