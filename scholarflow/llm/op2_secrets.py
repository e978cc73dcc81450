"""Secret scans with structural confirmation.

Four kinds are found by pattern alone (assign, access, hex). The other kinds are reported only after
their structure has been confirmed: runs of base64, base64url or hex are decoded, and the bytes must parse as

* `der`: an ASN.1 SEQUENCE whose nested lengths all agree, level by level, with the whole field sequence of a private
  key: PKCS#1 (version 0 or 1 and eight more INTEGERs), DSA (version and five), SEC 1 (version 1, OCTET STRING),
  PKCS#8 (version 0 or 1, algorithm with an OID, OCTET STRING) or encrypted PKCS#8;
* `openssh`: the OpenSSH private key container, with all its length-prefixed fields inside the data;
* `token`: three base64url parts joined by dots, whose first two decode to JSON objects, the first
  with a known signing algorithm, and whose signature decodes to bytes.

Public keys, signatures and certificates are no secrets and are not reported. A span ends where the decoded
structure ends, and the search goes on there. PEM bodies may be wrapped over lines, indented or not; a line break may
be escaped (a backslash and n), as in JSON, or have become blanks; a PEM file may itself be base64, and is then
reported as the kind that it holds. A key in hex may have other hex digits before it.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import table, with_columns_from

KINDS = ("assign", "access", "hex", "der", "openssh", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# greedy runs: asking for the least length in the pattern finds the same runs as dropping short ones
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
HEX_ANY = re.compile(r"[0-9A-Fa-f]{48,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]{16,})")
#: What starts in hex like the DER of a private key (a SEQUENCE, its length, and a version 0 or 1 or another SEQUENCE), or is the OpenSSH magic.
HEX_START = re.compile(r"30(?=(?:[0-7][0-9a-f]|81[0-9a-f]{2}|82[0-9a-f]{4}|83[0-9a-f]{6}|84[0-9a-f]{8})(?:02010[01]|30))|6f70656e7373682d6b65792d763100", re.IGNORECASE)
#: The next line of a wrapped body after a break, real or escaped, and its indentation; and after blanks that took a break's place.
LINE = re.compile(r"(?:\r?\n|(?:\\+r)?\\+n)[ \t]*([A-Za-z0-9+/_-]+)")
JOINED_LINE = re.compile(r"[ \t]+([A-Za-z0-9+/_-]+)")
#: Characters of a line that can be followed by another without a break.
FULL = 40
#: The first line of base64 that starts like a DER SEQUENCE, the OpenSSH magic or a PEM header.
KEY = re.compile(r"(?:(?<![A-Za-z0-9+/])|(?<=\\[nr]))(?:M[A-P]|b3BlbnNzaC1rZXktdj|LS0tLS1CRUdJTi)[A-Za-z0-9+/_-]{38,}")
PADDING = re.compile("={0,2}")
ALGORITHMS = {"HS256", "HS384", "HS512", "RS256", "RS384", "RS512", "ES256", "ES384", "ES512", "PS256", "PS384", "PS512", "EdDSA", "none"}
#: Most fields of a private key.
FIELDS = 10
MAGIC = b"openssh-key-v1\x00"

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the contents of the DER element at `at`; None if it doesn't fit before `end`."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n >= 128:
        k = n & 127
        if not 1 <= k <= 4 or at + k > end or data[at] == 0:
            return None
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if n < 128:
            return None
    return (tag, at, at + n) if at + n <= end else None


def _elements(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the up to `FIELDS` DER elements that fill data[start:end], constructed ones filled in turn; else None."""
    out, todo = None, [(start, end)]
    while todo:
        at, stop = todo.pop()
        found = []
        while at < stop:
            part = _tlv(data, at, stop)
            if not part:
                return None
            found.append(part)
            if out is None and len(found) > FIELDS:
                return None
            if part[0] & 0x20:
                todo.append(part[1:])
            at = part[2]
        out = found if out is None else out
    return out


def _filled(data: bytes) -> bool:
    """True if `data` is one DER element, filled exactly by the up to `FIELDS` elements of its first level."""
    part = _tlv(data, 0, len(data))
    if not part or part[2] != len(data):
        return False
    at = part[1]
    for _ in range(FIELDS):
        inner = _tlv(data, at, part[2])
        if not inner:
            return False
        at = inner[2]
        if at == part[2]:
            return True
    return False


def der_key(data: bytes) -> int:
    """Bytes of the ASN.1 private key that `data` starts with, 0 if there is none."""
    top = _tlv(data, 0, len(data))
    if not top or top[0] != 0x30 or top[2] - top[1] < 16:
        return 0
    parts = _elements(data, top[1], top[2])
    if not parts:
        return 0
    tags = [t for t, _, _ in parts]
    body = lambda k: data[parts[k][1] : parts[k][2]]
    has_oid = lambda k: (x := _elements(data, *parts[k][1:])) and x[0][0] == 0x06
    ok = False
    if tags[0] == 0x02 and body(0) in (b"\0", b"\1"):
        if tags[1:2] == [0x02]:
            numbers = all(t == 0x02 and 0 < b - a and data[a] < 128 for t, a, b in parts[:9])
            ok = numbers and (tags in ([0x02] * 9, [0x02] * 6) or body(0) == b"\1" and tags == [0x02] * 9 + [0x30])
        elif tags[1:2] == [0x04]:
            ok = body(0) == b"\1" and len(body(1)) >= 16 and tags[2:] in ([], [0xA0], [0xA1], [0xA0, 0xA1])
        elif tags[1:3] == [0x30, 0x04]:
            ok = bool(has_oid(1)) and len(body(2)) >= 16 and tags[3:] in ([], [0xA0], [0x81], [0xA1], [0xA0, 0x81], [0xA0, 0xA1])
    elif tags == [0x30, 0x04]:
        ok = bool(has_oid(0)) and len(body(1)) >= 16
    return top[2] if ok else 0


def openssh_key(data: bytes) -> int:
    """Bytes of the OpenSSH key container that `data` starts with, 0 if there is none.

    Its fields: cipher, kdf, kdf options, number of keys, that many public keys, and, if it is whole, the private part.
    """
    if not data.startswith(MAGIC):
        return 0

    def field(at: int) -> int | None:
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        return end if at + 4 <= end <= len(data) else None

    at: int | None = len(MAGIC)
    for _ in range(3):
        at = None if at is None else field(at)
    if at is None or at + 4 > len(data) or not 1 <= (keys := int.from_bytes(data[at : at + 4], "big")) <= 16:
        return 0
    at += 4
    for _ in range(keys):
        at = None if at is None else field(at)
    if at is None:
        return 0
    private = field(at)
    return private if private and (private - at - 4) % 8 == 0 else at


def _base64(s: str) -> bytes:
    s = re.sub(r"\\+[nr]|\s", "", s).rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        s = s[:-1]
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4))
    except (binascii.Error, ValueError):
        return b""


def signed_token(header: str, payload: str, signature: str) -> bool:
    try:
        head, body = json.loads(_base64(header)), json.loads(_base64(payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and head.get("alg") in ALGORITHMS and len(signature) % 4 != 1


def _lines(text: str, start: int, end: int, wanted: int | None, joined: bool) -> list[tuple[int, int]]:
    """(start, end) of the lines of a wrapped body whose first is given, up to `wanted` letters if that is known."""
    lines, letters = [(start, end)], end - start
    while wanted is None or letters < wanted:
        m = LINE.match(text, lines[-1][1])
        if not m and joined and lines[-1][1] - lines[-1][0] >= FULL:
            m = JOINED_LINE.match(text, lines[-1][1])
        if not m:
            break
        lines.append(m.span(1))
        letters += m.end(1) - m.start(1)
    return lines


def _key_at(text: str, start: int, end: int, depth: int = 0) -> tuple[str, int] | None:
    """Kind of the key whose base64 starts with the line text[start:end], and its end; breaks within it count, its padding too."""
    head = text[start:end]
    if head.startswith("LS0t"):
        lines = _lines(text, start, end, None, False)
        inner = _base64("".join(text[a:b] for a, b in lines)).decode("utf-8", "replace") if depth == 0 else ""
        kinds = [k for k, _, _ in _base64_keys(inner, 1)]
        return (kinds[0], PADDING.match(text, lines[-1][1]).end()) if kinds else None
    if head.startswith("M"):
        first = _base64(head[:12])
        top = _tlv(first + b"\0" * 8, 0, 1 << 32) if len(first) > 8 else None
        if not top:
            return None
        need = -(-top[2] * 8 // 6)
        lines = _lines(text, start, end, need, True)
        letters = "".join(text[a:b] for a, b in lines)
        if need > len(letters):
            return None
        kind, n = "der", der_key(_base64(letters[:need]))
    else:
        lines = _lines(text, start, end, None, True)
        kind, n = "openssh", openssh_key(_base64(re.split("[_-]", "".join(text[a:b] for a, b in lines))[0]))
    if not n:
        return None
    need = -(-n * 8 // 6)
    for a, b in lines:
        if need <= b - a:
            end = a + need
            return kind, end + min(len(PADDING.match(text, end)[0]), -(-n // 3) * 4 - -(-n * 8 // 6))
        need -= b - a
    return None


def _base64_keys(text: str, depth: int = 0) -> list[tuple[str, int, int]]:
    """Keys in base64. The search goes on where a confirmed key ends, or after the first line of what is none."""
    out, at = [], 0
    while m := KEY.search(text, at):
        found = _key_at(text, m.start(), m.end(), depth)
        if found:
            out.append((found[0], m.start(), found[1]))
        at = max(found[1], m.start() + 1) if found else m.end()
    return out


def _hex_keys(text: str) -> list[tuple[str, int, int]]:
    """Keys in hexadecimal, wherever they start in a run of it."""
    out = []
    for run in HEX_ANY.finditer(text):
        at, first = run.start(), run.start()
        halves: dict[int, memoryview] = {}  # the run's bytes, if they begin at its first or second digit
        while m := HEX_START.search(text, at, run.end()):
            at = m.start()
            odd = (at - first) & 1
            if odd not in halves:
                halves[odd] = memoryview(bytes.fromhex(text[first + odd : run.end() - (run.end() - first - odd) % 2]))
            data = halves[odd][(at - first) // 2 :]
            if text.startswith("30", at):
                top = _tlv(data, 0, len(data))
                kind, data = "der", data[: top[2] if top else 0]
                n = der_key(data)
            else:
                kind, n = "openssh", openssh_key(bytes(data))
            if n:
                out.append((kind, at, at + 2 * n))
            # what is DER but no key is not searched within
            at += 2 * n or (2 * len(data) if kind == "der" and _filled(data) else 1)
    return out


def find(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and confirmed spans (kind, start, end in code points, end exclusive); null is empty."""
    text = text or ""
    low = text.lower() if text.isascii() else text.encode("utf-8", "replace").lower().decode("utf-8")
    base = []
    if any(word in low for word in ("passw", "secret", "token", "api")):
        base += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [("access", *m.span()) for m in ACCESS.finditer(text)]
    base += [("hex", *m.span()) for m in HEX.finditer(text)]
    more = []
    if "eyJ" in text:
        more += [("token", *m.span()) for m in TOKEN.finditer(text) if signed_token(*m.groups())]
    more += _base64_keys(text)
    more += _hex_keys(text) if "30" in text or "6f70656e737368" in low else []
    return base, more


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


DIGEST = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_confirmed", T.LongType())]
)
FOUND = T.StructType([T.StructField("spans", T.ArrayType(SPAN)), T.StructField("redacted", T.StringType())])


def digest(text: str | None) -> tuple:
    base, more = find(text)
    n = [sum(s[0] == k for s in base) for k in KINDS[:3]]
    return (*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more), len(more))


def redact(text: str | None) -> tuple:
    """All spans, and the text with each maximal covered run replaced by `[SECRET]` (null stays null)."""
    base, more = find(text)
    spans = sorted(base + more, key=lambda s: (s[1], s[2]))
    if text is None:
        return [], None
    out, at = [], 0
    for _, a, b in spans:
        if a > at or not out:
            out += [text[at:a], "[SECRET]"]
        elif a == at:
            pass  # touches the run before
        at = max(at, b)
    return spans, "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with a struct `_out`: spans (array of kind, start, end) and the redacted text.

    A null text has no spans and stays null; an empty one stays empty. Spans may overlap: what they cover
    together is replaced once. Equal texts give equal rows; other columns stay, but for `_out`, which is replaced.
    """
    return with_columns_from(docs, text, FOUND, lambda: lambda values: [redact(v) for v in values])


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    """One row per document. A null or empty text has no spans; its base_sha256 is that of the empty string."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_columns_from(docs, "text", DIGEST, lambda: lambda values: [digest(v) for v in values]).select("doc_id", "_out.*")
