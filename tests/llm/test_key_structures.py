"""Which encodings count as secrets, and where their spans end."""

from __future__ import annotations

import base64

import pytest

from scholarflow.llm import op2_secrets

from .test_operators import _der

NUMBER = [_der(2, bytes([k]) * 64) for k in range(1, 10)]
ZERO, ONE = _der(2, b"\0"), _der(2, b"\1")
RSA_OID, EC_OID = _der(6, b"\x2a\x86\x48\x86\xf7\x0d\1\1\1"), _der(6, b"\x2a\x86\x48\xce\x3d\2\1")
PKCS1 = _der(0x30, ZERO + b"".join(NUMBER[:8]))
DSA = _der(0x30, ZERO + b"".join(NUMBER[:5]))
SEC1 = _der(0x30, ONE + _der(4, bytes(range(32))) + _der(0xA0, EC_OID))
PKCS8 = _der(0x30, ZERO + _der(0x30, RSA_OID + _der(5, b"")) + _der(4, PKCS1))
ED25519 = _der(0x30, ZERO + _der(0x30, _der(6, b"\x2b\x65\x70")) + _der(4, _der(4, bytes(range(200, 232)))))
SIGNATURE = _der(0x30, _der(2, bytes([5]) * 32) + _der(2, bytes([6]) * 32))
PUBLIC = _der(0x30, _der(0x30, RSA_OID + _der(5, b"")) + _der(3, b"\0" + _der(0x30, NUMBER[0] + _der(2, b"\1\0\1"))))
PKCS1_PUBLIC = _der(0x30, NUMBER[0] + _der(2, b"\1\0\1"))
b64 = lambda x: base64.b64encode(x).decode()


def spans(text):
    return [(k, text[a:b]) for k, a, b in op2_secrets.find(text)[1]]


@pytest.mark.parametrize("key", [PKCS1, DSA, SEC1, PKCS8, ED25519])
def test_private_keys_in_every_alphabet(key):
    assert spans(f"key {b64(key)} end") == [("der", b64(key))]
    url = base64.urlsafe_b64encode(key).decode().rstrip("=")
    assert spans(f"key {url}\nHello World and more") == [("der", url)]
    assert spans(f"key {key.hex()} end") == [("der", key.hex())]
    pem = "-----BEGIN PRIVATE KEY-----\n" + "\n".join(b64(key)[i : i + 64] for i in range(0, len(b64(key)), 64)) + "\n-----END PRIVATE KEY-----\n"
    (kind, span), = spans(pem)
    assert kind == "der" and op2_secrets._base64(span) == key
    assert spans(f"data: {b64(pem.encode())} end") == [("der", b64(pem.encode()))]


@pytest.mark.parametrize("data", [SIGNATURE, PUBLIC, PKCS1_PUBLIC, PKCS1[:-1], _der(0x30, _der(2, b"\7") + b"".join(NUMBER[:8])), _der(0x30, ZERO + b"".join(NUMBER[:3])), _der(0x30, ZERO + _der(0x30, b"\6\x7f" + bytes(20)) + _der(4, PKCS1))])
def test_other_structures_are_no_secrets(data):
    for text in (b64(data), base64.urlsafe_b64encode(data).decode(), data.hex().upper(), b64(b"-----BEGIN X-----\n" + base64.b64encode(data))):
        assert spans(f"x {text} y") == []
        # hex digits are a base kind of their own
        assert op2_secrets.find(text)[0] or op2_secrets.redact(f"x {text} y")[1] == f"x {text} y"


def test_a_span_ends_with_its_structure():
    bare = b64(PKCS1).rstrip("=")
    assert spans(f"{bare}\nHello there") == [("der", bare)]
    assert op2_secrets.redact(f"a {bare}\nHello there")[1] == "a [SECRET]\nHello there"


def test_overlaps_are_replaced_once():
    text = f"token={b64(PKCS8)} tail"
    assert op2_secrets.redact(text)[1] == "[SECRET] tail"
    assert op2_secrets.redact("") == ([], "") and op2_secrets.redact(None) == ([], None)
