"""Settings from the environment: where stores live, who administers them, and how users sign in."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass

from .auth import Verifier
from .operators.validate import API_KEY
from .sources.store import CHECKPOINT_COMMITS

PREFIX = "QUILLON_"


class SettingsError(ValueError):
    """A setting that is missing or can't be read."""


@dataclass(frozen=True)
class Settings:
    """admin_key: the API key of the administrating store. verifier: None where users need not sign in."""

    admin_key: str
    directory: str = "./data"
    port: int = 3000
    checkpoint_commits: int = CHECKPOINT_COMMITS
    verifier: Verifier | None = None

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Settings:
        """ADMIN_KEY is needed; DIRECTORY, PORT, CHECKPOINT_COMMITS, and JWT_SECRET or JWT_PUBLIC_KEY may be given."""
        get = lambda name: env.get(PREFIX + name)

        def number(name: str, default: int, low: int, high: int) -> int:
            text = get(name)
            if text is None:
                return default
            if not re.fullmatch(r"[0-9]{1,9}", text) or not low <= int(text) <= high:
                raise SettingsError(f"{PREFIX}{name}={text!r}: a number from {low} to {high} is needed")
            return int(text)

        admin = get("ADMIN_KEY")
        if admin is None:
            raise SettingsError(f"{PREFIX}ADMIN_KEY is not set")
        if not re.fullmatch(API_KEY.strip("^$"), admin):
            raise SettingsError(f"{PREFIX}ADMIN_KEY={admin!r}: 1 to 256 letters, digits, _ or - are needed")
        secret, public = get("JWT_SECRET"), get("JWT_PUBLIC_KEY")
        if secret is not None and public is not None:
            raise SettingsError("a secret and a public key can't both be set")
        verifier = Verifier("HS256", secret) if secret is not None else Verifier("RS256", public) if public is not None else None
        return cls(admin, get("DIRECTORY") or cls.directory, number("PORT", cls.port, 0, 65_535), number("CHECKPOINT_COMMITS", CHECKPOINT_COMMITS, 1, 10**6), verifier)
