"""Settings of a run from the environment, with their bounds."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


def clamped(text: str | None, default: int, low: int, high: int | None = None) -> int:
    """A whole number within bounds; blank or unreadable is the default."""
    try:
        n = int((text or "").strip() or default)
    except ValueError:
        n = default
    return max(low, n if high is None else min(high, n))


def optional_float(text: str | None) -> float | None:
    """Blank is no number."""
    return float(text) if text and text.strip() else None


def flag(text: str | None) -> bool:
    return (text or "").strip().lower() in ("1", "true", "yes", "on")


@dataclass(frozen=True)
class Settings:
    provider: str = "lookup"
    concurrency: int = 5
    retries: int = 3
    base_delay_seconds: float = 1.0
    timeout_ms: int = 600_000
    dpi: int = 200
    upload_limit: int = 30 * 1024 * 1024
    debug: bool = False

    @staticmethod
    def load(env: Mapping[str, str] | None = None, prefix: str = "PACKETFLOW_") -> Settings:
        e = os.environ if env is None else env
        get = lambda name: e.get(prefix + name)
        delay = optional_float(get("BASE_DELAY_SECONDS"))
        return Settings(
            provider=(get("PROVIDER") or "lookup").strip().lower(), concurrency=clamped(get("CONCURRENCY"), 5, 1), retries=clamped(get("RETRIES"), 3, 0), base_delay_seconds=1.0 if delay is None else max(0.0, delay),
            timeout_ms=clamped(get("TIMEOUT_MS"), 600_000, 30_000), dpi=clamped(get("DPI"), 200, 150, 200), upload_limit=clamped(get("UPLOAD_LIMIT"), 30 * 1024 * 1024, 1), debug=flag(get("DEBUG")),
        )
