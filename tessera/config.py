"""All defaults in one place."""

from __future__ import annotations

from dataclasses import dataclass

# Prompt parts and markers that results must equal.
REFUSAL = "The provided documents do not contain enough information to answer this question."
REFUSAL_MARKERS = ["do not contain enough information", "does not contain enough information", "not enough information", "insufficient information", "not mentioned in the provided"]
TOO_LONG = "Query length (%d) exceeds maximum limit of %d characters."
TRIM_MARKER = " [trimmed for token budget]"
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
CODENAMES = ["Phoenix", "Titan", "Aurora", "Nebula", "Valkyrie"]
STRATEGIES = ["character", "structure", "semantic"]
EXTENSIONS = [".pdf", ".docx", ".txt", ".md"]


@dataclass(frozen=True)
class Settings:
    k1: float = 1.5
    b: float = 0.75
    rrf_k: int = 60
    dense_weight: float = 1.0
    sparse_weight: float = 1.0
    retrieve_k: int = 20
    final_k: int = 3
    chunk_size: int = 500
    chunk_overlap: int = 50
    section_size: int = 1000
    table_flush: int = 200
    semantic_threshold: float = 0.65
    semantic_min_chars: int = 300
    router_threshold: float = 0.55
    router_top: int = 3
    token_budget: int = 3072
    trim_floor: int = 40
    context_window: int = 4096
    max_tokens: int = 512
    max_query_chars: int = 4096
    max_messages: int = 100
    max_message_chars: int = 32_768
    limiter_requests: int = 60
    limiter_seconds: int = 60


DEFAULTS = Settings()
