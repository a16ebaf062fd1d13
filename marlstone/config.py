"""Typed parameters of the engine."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    chunk_tokens: int = 512
    min_tokens: int = 50
    dense_weight: int = 7  # tenths, so that fused scores stay whole numbers
    sparse_weight: int = 3
    candidates: int = 20
    broad_candidates: int = 30
    context_chunks: int = 4
    confidence: float = 0.3
    source_gate: float = 0.4
    buckets: int = 100_000
    history_turns: int = 6
    rewrite_turns: int = 2
    client_turns: int = 10
    max_references: int = 10
    max_questions: int = 3
    dimension: int = 64
    broadcast_bytes: int = 64 << 20
    name_block: int = 2 << 20  # characters of an automaton
    refresh_weeks: int = 13
    question_chars: int = 500
    today: str = "2024-01-01"
    version: str = "1"

    def validate(self) -> list[str]:
        """Names of parameters that are out of range; empty when all is well."""
        bad = [f.name for f in fields(self) if isinstance(getattr(self, f.name), (int, float)) and getattr(self, f.name) < 0]
        if self.min_tokens > self.chunk_tokens:
            bad.append("min_tokens")
        if self.candidates > self.broad_candidates:
            bad.append("candidates")
        return bad


DEFAULTS = Settings()
