"""Typed settings out of the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Each field is read from the upper-case variable of its name, if set."""

    chunk_size: int = 512
    chunk_overlap: int = 50
    top_k_results: int = 5
    max_conversation_length: int = 50
    temperature: float = 0.7
    max_tokens: int = 2048
    enable_mfa: bool = True
    enable_monitoring: bool = True
    log_level: str = "INFO"
    default_model: str = "echo"
    database_url: str = ""
    vector_db_path: str = "./data/vectordb/"
    university_url: str = ""
    scraping_interval_hours: int = 24
    cli_history_file: str = ".cli_history"
    secret_key: str = ""
    encryption_key: str = ""

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        out = {}
        for f in fields(cls):
            raw = env.get(f.name.upper())
            if raw is not None:
                kind = type(f.default)
                out[f.name] = raw.lower() == "true" if kind is bool else kind(raw)
        return cls(**out)
