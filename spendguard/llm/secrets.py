"""Secret scans with structural confirmation.

Patterns name candidates; what decodes as a secret's own format is confirmed before it is reported:
a signed token must have a JSON header that names its algorithm, and base64 or hex text must hold a
key encoding whose nested lengths add up (DER private and public keys, OpenSSH keys). The plain
kinds (an assignment, an access key id, a long hex run) are reported as they match.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, text_of

#: Plain kinds in the order in which equal starts are listed, then those that are confirmed.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "key")
MIN_ASSIGNED, MIN_ACCESS, MIN_HEX = 8, 16, 32

_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Greedy runs: a shorter one is no match of the pattern with + that the length would keep.
_HEX = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)
#: The segments after the first are looked ahead at, so that one that fails is tried as a header.
_JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.(?=([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*))")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}")
_HEX_ANY = re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{64,}(?![A-Za-z0-9])")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*)KEY-----\s*([A-Za-z0-9+/=\s]*?)-----END \1KEY-----")

_SEQUENCE, _INTEGER, _OCTETS, _BITS, _OID = 0x30, 0x02, 0x04, 0x03, 0x06


def _der(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, and start and end of the content, of the DER element at ``at`` if it ends by ``end``."""
    if end - at < 2:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n >= 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or end - at < k:
            return None
        n = int.from_bytes(data[at:at + k], "big")
        if n < 0x80 or (k > 1 and n >> (8 * (k - 1)) == 0):
            return None
        at += k
    return (tag, at, at + n) if at + n <= end else None


def _children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill [start, end) exactly."""
    out = []
    while start < end:
        x = _der(data, start, end)
        if x is None:
            return None
        out.append(x)
        start = x[2]
    return out


def is_der_key(data: bytes) -> bool:
    """An RSA, EC, PKCS#8 or X.509 public key: one sequence over all of the data whose parts have
    the tags of that key and nested lengths that add up."""
    top = _der(data, 0, len(data))
    if top is None or top[0] != _SEQUENCE or top[2] != len(data):
        return False
    parts = _children(data, top[1], top[2])
    if not parts:
        return False
    tags = [p[0] for p in parts]
    if tags[0] == _INTEGER and parts[0][2] - parts[0][1] == 1 and data[parts[0][1]] <= 1:
        if len(tags) >= 9 and all(t == _INTEGER for t in tags[:9]):  # RSA private key
            return True
        if data[parts[0][1]] == 1 and len(tags) >= 2 and tags[1] == _OCTETS and parts[1][2] - parts[1][1] >= 16:  # EC private key
            return True
        if len(tags) >= 3 and tags[1:3] == [_SEQUENCE, _OCTETS]:  # PKCS#8
            inner = _children(data, parts[1][1], parts[1][2])
            return bool(inner) and inner[0][0] == _OID
    if tags[:2] == [_SEQUENCE, _BITS] and len(tags) == 2:  # X.509 public key
        inner = _children(data, parts[0][1], parts[0][2])
        return bool(inner) and inner[0][0] == _OID
    return False


def is_openssh_key(data: bytes) -> bool:
    """An OpenSSH private key: its magic, then strings whose lengths lie within the data; or a
    public key: a known type's name, then at least one such string, to the end."""
    magic = b"openssh-key-v1\0"
    at, count, first = (len(magic), 0, b"") if data.startswith(magic) else (0, 0, b"")
    private = at > 0
    while at + 4 <= len(data) and not (private and count == 3):
        n = int.from_bytes(data[at:at + 4], "big")
        if n > len(data) - at - 4:
            return False
        first = first or data[at + 4:at + 4 + n]
        at, count = at + 4 + n, count + 1
    if private:
        return count == 3 and len(data) - at > 4
    return count >= 2 and at == len(data) and bool(re.fullmatch(rb"ssh-(rsa|dss|ed25519)|ecdsa-sha2-nistp\d{3}", first))


def _unbase64(text: str, url: bool = False) -> bytes | None:
    text = text.rstrip("=")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(header: str, payload: str) -> bool:
    """A header that decodes to a JSON object with an algorithm, before a payload that decodes."""
    raw = _unbase64(header, url=True)
    if raw is None or not raw.lstrip().startswith(b"{") or _unbase64(payload, url=True) is None:
        return False
    try:
        head = json.loads(raw)
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def _is_key(data: bytes | None) -> bool:
    return data is not None and len(data) >= 30 and (is_der_key(data) or is_openssh_key(data))


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then in the order of ``KINDS``. Spans of one
    kind do not overlap; those of different kinds may."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "key" in low:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if text.count(".") >= 2:
        last = -1
        for m in _JWT.finditer(text):
            if m.start() >= last and is_signed_token(m[1], m[2]):
                last = m.end(3)
                found.append((m.start(), 3, last))
    keys = []
    if "-----BEGIN" in text:
        keys += [(m.start(), m.end()) for m in _PEM.finditer(text) if _is_key(_unbase64("".join(m[2].split())))]
    keys += [(m.start(), m.end()) for m in _BASE64.finditer(text) if _is_key(_unbase64(m[0]))]
    keys += [(m.start(), m.end()) for m in _HEX_ANY.finditer(text) if len(m[0]) % 2 == 0 and _is_key(bytes.fromhex(m[0]))]
    last = -1
    for start, end in sorted(keys, key=lambda k: (k[0], -k[1])):
        if start >= last:
            found.append((start, 4, end))
            last = end
    return [(KINDS[kind], start, end) for start, kind, end in sorted(found)]


def mask(text: str, replacement: str) -> str:
    """The text with each stretch that spans cover replaced once."""
    out, at = [], 0
    for start, end in sorted((s, e) for _, s, e in find_spans(text)):
        if start >= at:
            out += [text[at:start], replacement]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and ``spans`` (array of kind, start, end).

    A null text is the empty text and has no spans. Repeated rows and null ids stay as they are;
    other columns are ignored.
    """
    @F.pandas_udf("array<struct<kind:string,start:long,end:long>>")
    def spans(text: pd.Series) -> pd.Series:
        return text.map(find_spans)

    return docs.select(column(id_col), spans(text_of(text_col)).alias("spans"))


def mask_secrets(docs: DataFrame, *, text_col: str = "text", replacement: str = "<secret>") -> DataFrame:
    """``docs`` with the secrets of ``text_col`` replaced; null texts stay null."""
    @F.pandas_udf("string")
    def masked(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else mask(t, replacement))

    return docs.withColumn(text_col, masked(column(text_col)))


def span_digests(found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The row of ``op10``: counts of the plain kinds, a hash of their spans, and all spans as text."""
    def listed(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        column(id_col),
        *map(count, BASE_KINDS),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
