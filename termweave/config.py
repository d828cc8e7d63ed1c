"""Settings of the engine, from the environment (TERMWEAVE_*) or given."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    artifact_path: str = "artifacts/dictionary"
    source_terms_path: str = "data/source_terms.csv"
    audit_path: str = "artifacts/audit"
    review_threshold: float = 0.55
    suspect_threshold: float = 0.30
    force_review_margin: float = 0.12
    max_span_tokens: int = 5

    @classmethod
    def from_env(cls) -> Settings:
        given = {f.name: os.environ[key] for f in fields(cls) if (key := f"TERMWEAVE_{f.name.upper()}") in os.environ}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{k: kinds[k](v) for k, v in given.items()})
