"""Sign-in by signed web tokens (HS256 or RS256), checked on the driver when a connection is opened.

Only the configured algorithm counts, whatever a token's header says. The subject is the user's id; an expiry is
optional, and a token may be LEEWAY seconds late.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import time
from dataclasses import dataclass

LEEWAY = 60
#: What stands before a SHA-256 digest in an RSA signature: the fixed encoding of the algorithm's name.
_SHA256_PREFIX = bytes.fromhex("3031300d060960864801650304020105000420")


class AuthError(ValueError):
    """A token that isn't accepted, or a key that can't be used."""


def _raw(part: str) -> bytes:
    try:
        return base64.b64decode(part + "=" * (-len(part) % 4), altchars=b"-_", validate=True)
    except ValueError:
        raise AuthError("malformed token") from None


def _object(part: str) -> dict:
    try:
        found = json.loads(_raw(part))
    except ValueError:
        raise AuthError("malformed token") from None
    if not isinstance(found, dict):
        raise AuthError("malformed token")
    return found


def _tlv(der: bytes, at: int) -> tuple[int, int, int]:
    """Tag, and where the contents of a DER element begin and end."""
    if at + 2 > len(der):
        raise AuthError("malformed key")
    size, start = der[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        size, start = int.from_bytes(der[start : start + n], "big"), start + n
    if start + size > len(der):
        raise AuthError("malformed key")
    return der[at], start, start + size


def rsa_numbers(pem: str) -> tuple[int, int]:
    """Modulus and exponent of a PEM public key, in either of its usual forms."""
    lines = [x.strip() for x in pem.strip().splitlines()]
    if len(lines) < 3 or not lines[0].startswith("-----BEGIN ") or "PUBLIC KEY" not in lines[0]:
        raise AuthError("malformed key")
    try:
        der = base64.b64decode("".join(lines[1:-1]), validate=True)
    except ValueError:
        raise AuthError("malformed key") from None
    _, at, _ = _tlv(der, 0)
    if der[at] == 0x30:  # an algorithm's name first, then the key as a bit string
        _, at, end = _tlv(der, _tlv(der, at)[2])
        der = der[at + 1 : end]
        _, at, _ = _tlv(der, 0)
    _, start, end = _tlv(der, at)
    _, second, last = _tlv(der, end)
    return int.from_bytes(der[start:end], "big"), int.from_bytes(der[second:last], "big")


@dataclass(frozen=True)
class Verifier:
    """Checks tokens: HS256 with a secret, or RS256 with a PEM public key."""

    algorithm: str
    key: str | bytes

    def __post_init__(self):
        if self.algorithm not in ("HS256", "RS256"):
            raise AuthError(f"unknown algorithm {self.algorithm!r}")
        if not self.key:
            raise AuthError("a key must not be empty")
        if self.algorithm == "RS256":
            rsa_numbers(self.key if isinstance(self.key, str) else self.key.decode())

    def _signed(self, message: bytes, signature: bytes) -> bool:
        key = self.key.encode() if isinstance(self.key, str) else self.key
        if self.algorithm == "HS256":
            return hmac.compare_digest(hmac.new(key, message, hashlib.sha256).digest(), signature)
        n, e = rsa_numbers(key.decode())
        size = (n.bit_length() + 7) // 8
        if len(signature) != size or size < 11 + len(_SHA256_PREFIX) + 32 or int.from_bytes(signature, "big") >= n:
            return False
        tail = b"\x00" + _SHA256_PREFIX + hashlib.sha256(message).digest()
        want = b"\x00\x01" + b"\xff" * (size - 2 - len(tail)) + tail
        return hmac.compare_digest(pow(int.from_bytes(signature, "big"), e, n).to_bytes(size, "big"), want)

    def user(self, token: str, now: float | None = None) -> str:
        """The user a token stands for."""
        parts = token.split(".")
        if len(parts) != 3:
            raise AuthError("malformed token")
        header, claims = _object(parts[0]), _object(parts[1])
        if header.get("alg") != self.algorithm:
            raise AuthError("the token names another algorithm")
        if not self._signed(f"{parts[0]}.{parts[1]}".encode(), _raw(parts[2])):
            raise AuthError("the signature doesn't fit")
        expires = claims.get("exp")
        if expires is not None:
            if isinstance(expires, bool) or not isinstance(expires, int | float):
                raise AuthError("malformed token")
            if expires < (time.time() if now is None else now) - LEEWAY:
                raise AuthError("the token has expired")
        subject = claims.get("sub")
        if not isinstance(subject, str) or not subject:
            raise AuthError("the token has no subject")
        return subject
