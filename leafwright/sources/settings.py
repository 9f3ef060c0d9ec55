"""Settings of the external classifier from the environment."""

from __future__ import annotations

import os
from pathlib import Path

from ..operators.delegate import Settings
from ..plans.rulepack import load_rules


def read_env_file(path: str | Path) -> dict[str, str]:
    """``NAME=value`` lines of a file; comments, ``export`` and quotes are taken off; a missing file is empty."""
    found = {}
    try:
        lines = Path(path).read_text(encoding="utf-8").splitlines()
    except FileNotFoundError:
        return found
    for line in lines:
        line = line.strip().removeprefix("export ").strip()
        if line and not line.startswith("#") and "=" in line:
            name, _, value = line.partition("=")
            value = value.strip()
            if value[:1] in "'\"" and value[:1] and value.endswith(value[0]) and len(value) > 1:
                value = value[1:-1]
            else:
                value = value.split(" #")[0].rstrip()
            found[name.strip()] = value
    return found


def load_settings(env_path: str | Path = ".env") -> Settings:
    """Settings from ``LLM_*`` variables, which go before the file's; enabled if a key is there. The key itself isn't kept.

    The excerpt limit comes from the default rules, the batch size is the default one.
    """
    for name, value in read_env_file(env_path).items():
        os.environ.setdefault(name, value)
    kinds = {"provider": ("LLM_PROVIDER", str), "model": ("LLM_MODEL", str), "temperature": ("LLM_TEMPERATURE", float), "timeout_seconds": ("LLM_TIMEOUT_SECONDS", int), "max_retries": ("LLM_MAX_RETRIES", int)}
    given = {name: kind(os.environ[variable]) for name, (variable, kind) in kinds.items() if variable in os.environ}
    return Settings(enabled=bool(os.environ.get("LLM_API_KEY", "").strip()), max_excerpt_chars=load_rules().excerpt_chars, **given)
