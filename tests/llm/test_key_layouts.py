"""Keys in layouts that one meets in configuration files."""

from __future__ import annotations

import base64

import pytest

from scholarflow.llm import op2_secrets

from .test_escaped_keys import ENCRYPTED, OPENSSH, PRIVATE, pem
from .test_key_structures import PKCS1, PKCS8, PUBLIC, SEC1, SIGNATURE, b64, spans
from .test_operators import _der


@pytest.mark.parametrize("data", [PRIVATE, ENCRYPTED, OPENSSH])
@pytest.mark.parametrize("layout", ["indented", "tabs", "joined", "indented crlf", "escaped and indented"])
def test_indented_and_joined_bodies(data, layout):
    text = {
        "indented": "key: |\n" + pem(data, "\n    "), "tabs": pem(data, "\n\t"), "joined": pem(data, " "), "indented crlf": pem(data, "\r\n  "), "escaped and indented": pem(data, "\\n  "),
    }[layout]
    text = f"before {text} after it more words follow here"
    (kind, a, b), = op2_secrets.find(text)[1]
    assert kind == ("openssh" if data == OPENSSH else "der")
    assert op2_secrets._base64(text[a:b]) == data
    body, redacted = base64.b64encode(data).decode(), op2_secrets.redact(text)[1]
    assert not any(body[i : i + 20] in redacted for i in range(0, len(body) - 20, 4))
    assert redacted.endswith("after it more words follow here")


def test_keys_on_consecutive_lines():
    keys = [b64(k).rstrip("=") for k in (PKCS8, SEC1, PKCS1, PKCS8)]
    assert spans("\n".join(keys)) == [("der", k) for k in keys]
    assert spans(" ".join(keys)) == [("der", k) for k in keys]
    # a candidate that is no key doesn't hide the next line
    assert spans(f"{b64(PUBLIC).rstrip('=')}\n{keys[0]}") == [("der", keys[0])]


@pytest.mark.parametrize("upper", [False, True])
@pytest.mark.parametrize("before", ["ab", "abc", "00ff30", "3082", "f" * 33])
def test_hex_keys_after_other_hex(before, upper):
    for kind, key in (("der", SEC1), ("der", PKCS8), ("openssh", OPENSSH)):
        text = f"x {before}{key.hex()} y"
        text = text.upper() if upper else text
        assert [(k, t.lower()) for k, t in spans(text)] == [(kind, key.hex())]


def test_two_hex_keys_in_one_run_and_what_is_none():
    assert spans(f"{SEC1.hex()}{PKCS8.hex()}") == [("der", SEC1.hex()), ("der", PKCS8.hex())]
    certificate = _der(0x30, _der(0x30, _der(0xA0, _der(2, b"\2")) + PUBLIC) + _der(0x30, _der(6, b"\x2a\x86\x48\x86\xf7\x0d\1\1\x0b")) + _der(3, bytes(65)))
    for data in (certificate, SIGNATURE, PUBLIC):
        lines = [b64(data)[i : i + 64] for i in range(0, len(b64(data)), 64)]
        for text in (data.hex(), f"ab{data.hex()}", "\n  ".join(lines), " ".join(lines)):
            assert spans(f"x {text} y") == []


def test_many_failing_candidates_take_linear_time():
    assert op2_secrets.find(("M" + "A" * 60 + " ") * 20000)[1] == []
    assert op2_secrets.find("3082ffff30" * 20000)[1] == []
