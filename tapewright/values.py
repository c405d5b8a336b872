"""Plain values: canonical JSON and fingerprints, rounding of published numbers, and keys that look like credentials."""

from __future__ import annotations

import hashlib
import json
import math
import re
from decimal import Decimal
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys that name a credential by themselves, endings that do, and an ending that does not.
SECRET_KEYS = (
    "api_key", "api_secret", "auth_token", "bearer_token", "client_secret", "credential", "credentials", "password",
    "private_key", "refresh_token", "secret", "seed_phrase", "session_token", "token", "wallet_key",
)
SECRET_ENDINGS = ("_password", "_secret", "_credential", "_token", "_api_key", "_private_key", "_wallet_key", "_seed_phrase")


def canonical_value(value, floats: bool = False):
    """What canonical JSON may hold: decimals as plain text, enums by value, mappings with text keys. Floats are refused
    unless asked for, and must be finite then."""
    if isinstance(value, Enum):
        return canonical_value(value.value, floats)
    if isinstance(value, Decimal):
        if not value.is_finite():
            raise ValueError("a decimal must be finite")
        return format(value, "f")
    if isinstance(value, float):
        if not floats:
            raise TypeError("a float has no canonical text: give a decimal")
        if not math.isfinite(value):
            raise ValueError("a number must be finite")
        return value
    if value is None or isinstance(value, (str, bool, int)):
        return value
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise TypeError("keys must be text")
        return {k: canonical_value(v, floats) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [canonical_value(v, floats) for v in value]
    raise TypeError(f"{type(value).__name__} has no canonical form")


def canonical_json(value, floats: bool = True) -> str:
    """Sorted keys, ASCII, no spaces."""
    return json.dumps(canonical_value(value, floats), sort_keys=True, ensure_ascii=True, separators=(",", ":"))


def fingerprint(value, floats: bool = True) -> str:
    return hashlib.sha256(canonical_json(value, floats).encode()).hexdigest()


def round12(value: float | None) -> float | None:
    """Twelve significant digits, and no negative zero: how published metrics are rounded."""
    return None if value is None else float(f"{value:.11e}") + 0.0


def round12_column(value: Column) -> Column:
    """round12() as an expression."""
    return F.format_string("%.11e", value.cast("double")).cast("double") + F.lit(0.0)


def _plain(key: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", key.casefold()).strip("_")


def is_secret_key(key) -> bool:
    """Whether a key names a credential. Ids of tokens are none: "token_id" does not end like one."""
    k = _plain(str(key))
    return k in SECRET_KEYS or k.endswith(SECRET_ENDINGS)


def is_secret_column(key: Column) -> Column:
    """is_secret_key() as an expression."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(key), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return plain.isin(*SECRET_KEYS) | plain.rlike("(" + "|".join(SECRET_ENDINGS) + ")$")


def secret_paths(value, at: str = "$") -> list[str]:
    """Where a document holds keys that name credentials."""
    out: list[str] = []
    if isinstance(value, dict):
        for k, v in value.items():
            out += [f"{at}.{k}"] if is_secret_key(k) else secret_paths(v, f"{at}.{k}")
    elif isinstance(value, (list, tuple)):
        for i, v in enumerate(value):
            out += secret_paths(v, f"{at}[{i}]")
    return out


def redacted(value):
    """The document with what such keys hold replaced."""
    if isinstance(value, dict):
        return {k: "***" if is_secret_key(k) else redacted(v) for k, v in value.items()}
    return [redacted(v) for v in value] if isinstance(value, (list, tuple)) else value
