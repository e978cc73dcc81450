"""Keys in JSON or source strings, and encrypted keys."""

from __future__ import annotations

import base64
import json

import pytest

from scholarflow.llm import op2_secrets

from .test_operators import _der

BODY = bytes(i * 7 % 256 for i in range(400))
PRIVATE = _der(0x30, _der(2, b"\0") + _der(0x30, _der(6, b"\x2a\x86\x48\x86\xf7\x0d\1\1\1") + _der(5, b"")) + _der(4, BODY))
ENCRYPTED = _der(0x30, _der(0x30, _der(6, b"\x2a\x86\x48\x86\xf7\x0d\1\5\x0d") + _der(0x30, _der(4, b"12345678"))) + _der(4, BODY))
OPENSSH = op2_secrets.MAGIC + b"\0\0\0\4none" * 2 + b"\0\0\0\0" + b"\0\0\0\1" + b"\0\0\1\x90" + BODY


def pem(data, end="\n"):
    body = base64.b64encode(data).decode()
    return end.join(["-----BEGIN PRIVATE KEY-----", *[body[i : i + 64] for i in range(0, len(body), 64)], "-----END PRIVATE KEY-----", ""])


@pytest.mark.parametrize("data", [PRIVATE, ENCRYPTED, OPENSSH])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("escapes", [0, 1, 2])
def test_wrapped_and_escaped_keys_are_redacted(data, end, escapes):
    text = pem(data, end)
    for _ in range(escapes):
        text = json.dumps({"private_key": text})
    _, more = op2_secrets.find(text)
    assert [k for k, _, _ in more] == ["openssh" if data == OPENSSH else "der"]
    _, a, b = more[0]
    assert op2_secrets._base64(text[a:b]) == data
    body = base64.b64encode(data).decode()
    redacted = op2_secrets.redact(text)[1]
    assert not any(body[i : i + 20] in redacted for i in range(0, len(body) - 20, 4))
