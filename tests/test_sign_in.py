"""Tokens made here by the rules of the signature schemes, and settings from the environment."""

import base64
import hashlib
import hmac
import json
import random

import pytest

from quillon.auth import AuthError, Verifier, rsa_numbers
from quillon.session import Engine
from quillon.settings import Settings, SettingsError


def b64(raw):
    return base64.urlsafe_b64encode(raw).rstrip(b"=").decode()


def token(claims, sign, alg="HS256"):
    body = f"{b64(json.dumps({'alg': alg, 'typ': 'JWT'}).encode())}.{b64(json.dumps(claims).encode())}"
    return f"{body}.{b64(sign(body.encode()))}"


def hs(secret):
    return lambda m: hmac.new(secret.encode(), m, hashlib.sha256).digest()


def prime(r, bits):
    while True:
        n = r.getrandbits(bits) | 1 | 3 << bits - 2
        if all(n % p for p in (3, 5, 7, 11, 13)) and n % 65537 != 1 and all(pow(a, n - 1, n) == 1 for a in (2, 3, 5, 7)):
            return n


def der(tag, raw):
    size = bytes([len(raw)]) if len(raw) < 128 else bytes([0x82]) + len(raw).to_bytes(2, "big")
    return bytes([tag]) + size + raw


@pytest.fixture(scope="module")
def rsa():
    r = random.Random(8)
    p, q = prime(r, 512), prime(r, 512)
    n, e = p * q, 65537
    d = pow(e, -1, (p - 1) * (q - 1))
    number = lambda x: der(2, b"\0" + x.to_bytes((x.bit_length() + 7) // 8, "big"))
    bare = der(0x30, number(n) + number(e))
    named = der(0x30, der(0x30, bytes.fromhex("06092a864886f70d0101010500")) + der(3, b"\0" + bare))
    pem = lambda raw, name: f"-----BEGIN {name}-----\n{base64.encodebytes(raw).decode()}-----END {name}-----\n"

    def sign(m):
        tail = b"\0" + bytes.fromhex("3031300d060960864801650304020105000420") + hashlib.sha256(m).digest()
        size = (n.bit_length() + 7) // 8
        block = b"\0\1" + b"\xff" * (size - 2 - len(tail)) + tail
        return pow(int.from_bytes(block, "big"), d, n).to_bytes(size, "big")

    return (n, e), pem(named, "PUBLIC KEY"), pem(bare, "RSA PUBLIC KEY"), sign


def test_secrets():
    v = Verifier("HS256", "s3cret")
    assert v.user(token({"sub": "u1"}, hs("s3cret"))) == "u1"
    assert v.user(token({"sub": "u1", "exp": 1000}, hs("s3cret")), now=1059) == "u1"
    good = token({"sub": "u1"}, hs("s3cret"))
    for bad in (
        token({"sub": "u1"}, hs("other")), token({"sub": ""}, hs("s3cret")), token({}, hs("s3cret")), token({"sub": 7}, hs("s3cret")), token({"sub": "u", "exp": "soon"}, hs("s3cret")),
        token({"sub": "u1"}, hs("s3cret"), "none"), token({"sub": "u1"}, lambda m: b"", "none"), token({"sub": "u1"}, hs("s3cret"), "RS256"), "", "a.b", "a.b.c", good + "x", good[:-1], good.replace(".", "..", 1), token(["sub"], hs("s3cret")),
    ):
        with pytest.raises(AuthError):
            v.user(bad)
    with pytest.raises(AuthError, match="expired"):
        v.user(token({"sub": "u1", "exp": 1000}, hs("s3cret")), now=1061)
    for how, key in (("HS256", ""), ("HS512", "x"), ("RS256", "not a key")):
        with pytest.raises(AuthError):
            Verifier(how, key)


def test_public_keys(rsa):
    numbers, named, bare, sign = rsa
    assert rsa_numbers(named) == rsa_numbers(bare) == numbers
    for pem in (named, bare):
        v = Verifier("RS256", pem)
        assert v.user(token({"sub": "u2"}, sign, "RS256")) == "u2"
        for bad in (token({"sub": "u2"}, lambda m: sign(m + b"x"), "RS256"), token({"sub": "u2"}, hs(pem), "HS256"), token({"sub": "u2"}, lambda m: b"\0" * 128, "RS256"), token({"sub": "u2"}, lambda m: b"\xff" * 128, "RS256")):
            with pytest.raises(AuthError):
                v.user(bad)


def test_connections(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}", Verifier("HS256", "k"))
    me = engine.connect()
    with pytest.raises(AuthError):
        me.open("app")
    with pytest.raises(AuthError):
        me.open("app", token({"sub": "u"}, hs("z")))
    assert me.open("app", token({"sub": "u"}, hs("k"))).user == "u"


def test_settings(rsa):
    get = lambda **env: Settings.from_env({f"QUILLON_{k}": v for k, v in env.items()})
    assert get(ADMIN_KEY="a") == Settings("a", "./data", 3000) and get(ADMIN_KEY="a", PORT="0", DIRECTORY="/d").port == 0
    assert get(ADMIN_KEY="a", JWT_SECRET="s").verifier == Verifier("HS256", "s") and get(ADMIN_KEY="a", JWT_PUBLIC_KEY=rsa[1]).verifier.algorithm == "RS256"
    for bad in ({}, {"ADMIN_KEY": ""}, {"ADMIN_KEY": "a b"}, {"ADMIN_KEY": "a", "PORT": "65536"}, {"ADMIN_KEY": "a", "PORT": "x"}, {"ADMIN_KEY": "a", "PORT": "-1"}, {"ADMIN_KEY": "a", "CHECKPOINT_COMMITS": "0"}, {"ADMIN_KEY": "a", "JWT_SECRET": "s", "JWT_PUBLIC_KEY": rsa[1]}):
        with pytest.raises(SettingsError):
            get(**bad)
