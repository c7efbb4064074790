"""Secret scan with structural confirmation.

Plain patterns report assignments, access keys and long hex runs. Beyond these, runs of base64 or hex that may begin a key
are decoded and parsed: a span is reported only if the nested lengths of its encoding add up to the last byte and the
fields are those of a private key (PKCS#1, PKCS#8, SEC 1, DSA, OpenSSH), or if a token's header and payload are JSON
objects and its signature is as long as the named algorithm makes it. A key may run over several lines, stand in a quoted
string with escaped line ends, or be armoured text that was encoded once more.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.llm.common import read

# The base patterns and the least lengths of what they must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

BASE = ("assign", "access", "hex")
#: All kinds, in the order in which spans of one start are listed.
KINDS = (*BASE, "pkcs1", "pkcs8", "pkcs8_encrypted", "sec1", "dsa", "openssh", "signed_token")

# Bytes of a signature by algorithm; RSA signatures are as long as their key.
SIGNATURE_BYTES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}
RSA_SIGNATURES, RSA_BYTES = ("RS256", "RS384", "RS512", "PS256", "PS384", "PS512"), (128, 2048)

# Object identifiers, encoded.
OID_RSA, OID_DSA, OID_EC = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce380401"), bytes.fromhex("2a8648ce3d0201")
OID_EDWARDS, OID_PASSWORD = bytes.fromhex("2b65"), (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
OPENSSH = b"openssh-key-v1\0"

#: Bytes of a key's encoding at most: the largest keys in use (RSA of 16,384 bits) take a sixth of it.
MOST_BYTES = 65_536

_RUN = r"[A-Za-z0-9+/_-]"
_BREAK = r"(?:(?:\\r)?\\n|[ \t\r\n]{1,80})"
#: Where base64 may begin a key: a DER sequence, the OpenSSH magic, or armour that was encoded again.
_BASE64 = re.compile(rf"(?:(?<!{_RUN})|(?<=\\n)|(?<=-----))(?:M[A-I]{_RUN}{{2}}|b3Bl|LS0t){_RUN}{{12}}")
_BLOCK = re.compile(rf"{_RUN}+(?:{_BREAK}{_RUN}+)*")
_PIECE = re.compile(rf"{_BREAK}|{_RUN}+")
_ARMOUR_END = re.compile(r"\s*-----END [A-Z ]+-----\s?|", re.ASCII)
_HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])(?:30|6[fF]70656[eE])[0-9A-Fa-f]{30,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_.-])e[yw][A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]{20,}")

#: What a text must hold before a pattern is tried on it, for Arrow's linear matcher; a superset of what can match.
_FLAGS = {
    "assign": r"(?i)(?:password|passwd|secret|token|api_?key)", "access": r"AKIA[A-Z0-9]", "hex": r"[0-9a-f]{32}",
    "base64": r"(?:M[A-I]|b3Bl|LS0t)[A-Za-z0-9+/_-]{14}", "hex_key": r"(?:30|6[fF]70656[eE])[0-9A-Fa-f]{30}", "token": r"e[yw][A-Za-z0-9_-]{8}",
}

Item = tuple[int, int, int]
Span = tuple[str, int, int, str]


def items(data: bytes, at: int, end: int) -> list[Item] | None:
    """(tag, first byte, end) of the DER items that fill data[at:end] exactly; None where a length is not minimal, is not
    definite or leaves that range."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, length = data[at], data[at + 1]
        at += 2
        if length >= 0x80:
            wide = length & 0x7F
            length = int.from_bytes(data[at : at + wide])
            if not 1 <= wide <= 3 or length < max(0x80, 1 << 8 * (wide - 1)):
                return None
            at += wide
        if at + length > end:
            return None
        out.append((tag, at, at + length))
        at += length
    return out


def _numbers(data: bytes, found: list[Item]) -> list[int] | None:
    return [int.from_bytes(data[a:b], signed=True) for _, a, b in found] if all(t == 2 and b > a for t, a, b in found) else None


def _sequence(data: bytes, found: list[Item]) -> tuple[str, str] | None:
    """Kind and detail of the private key whose sequence has these items."""
    tags = [t for t, _, _ in found]
    value = lambda i: data[found[i][1] : found[i][2]]
    if tags[:9] == [2] * 9 and tags[9:] in ([], [0x30]):
        version, n, e, d, p, q, *_ = _numbers(data, found[:9]) or [-1] * 9
        sound = version == len(tags) - 9 and n.bit_length() >= 512 and e % 2 and 0 < d < n and (version or p * q == n)
        return ("pkcs1", f"RSA {n.bit_length()}") if sound else None
    if tags == [2] * 6:
        version, p, q, g, y, x = _numbers(data, found) or [-1] * 6
        sound = version == 0 and p.bit_length() >= 512 and q > 1 and (p - 1) % q == 0 and 1 < g < p and 0 < y < p and 0 < x < q
        return ("dsa", f"DSA {p.bit_length()}") if sound else None
    if tags[:2] == [2, 4] and tags[2:] in ([], [0xA0], [0xA1], [0xA0, 0xA1]):
        size = found[1][2] - found[1][1]
        inner = [items(data, a, b) for _, a, b in found[2:]]
        whole = all(i is not None and len(i) == 1 and i[0][0] == (6 if t == 0xA0 else 3) for t, i in zip(tags[2:], inner, strict=True))
        return ("sec1", f"EC {8 * size}") if value(0) == b"\1" and 16 <= size <= 66 and whole else None
    if tags[:3] == [2, 0x30, 4] and set(tags[3:]) <= {0xA0, 0x81, 0xA1}:
        method, key = items(data, *found[1][1:]), items(data, *found[2][1:])
        if value(0) not in (b"\0", b"\1") or not method or method[0][0] != 6 or not key or len(key) != 1:
            return None
        oid, (tag, a, b) = data[method[0][1] : method[0][2]], key[0]
        inside = _sequence(data, items(data, a, b) or []) if tag == 0x30 else None
        sound = (
            oid == OID_RSA and inside is not None and inside[0] == "pkcs1"
            or oid == OID_EC and inside is not None and inside[0] == "sec1"
            or oid == OID_DSA and tag == 2
            or oid[:2] == OID_EDWARDS and len(oid) == 3 and tag == 4 and b - a in (32, 56, 57)
        )
        return ("pkcs8", inside[1] if inside else f"{8 * (b - a)} bits") if sound else None
    if tags == [0x30, 4]:
        method = items(data, *found[0][1:])
        sound = method and method[0][0] == 6 and data[method[0][1] : method[0][2]].startswith(OID_PASSWORD) and found[1][2] - found[1][1] >= 32
        return ("pkcs8_encrypted", "password") if sound else None
    return None


def _openssh(data: bytes) -> tuple[str, str, int] | None:
    """Kind, detail and length of an OpenSSH key that ``data`` begins with: its strings carry their lengths."""
    at, read_ = len(OPENSSH), []

    def number() -> int:
        nonlocal at
        at += 4
        return int.from_bytes(data[at - 4 : at]) if at <= len(data) else MOST_BYTES

    def text() -> bytes:
        nonlocal at
        n = number()
        at += n
        read_.append(n)
        return data[at - n : at] if at <= len(data) else b""

    cipher, derive, _ = text(), text(), text()
    keys = number()
    if at > len(data) or not 1 <= keys <= 16:
        return None
    for _ in range(keys):
        text()
    secret = text()
    if at > len(data) or len(secret) < 16 or len(secret) % 8 or (cipher == b"none") != (derive == b"none"):
        return None
    if cipher == b"none" and secret[:4] != secret[4:8]:
        return None
    return "openssh", cipher.decode("ascii", "replace"), at


def parse_key(data: bytes) -> tuple[str, str, int] | None:
    """Kind, detail and length of the private key that ``data`` begins with."""
    if data.startswith(OPENSSH):
        return _openssh(data)
    if len(data) < 2 or data[0] != 0x30:
        return None
    wide = data[1] & 0x7F if data[1] >= 0x80 else 0
    end = 2 + wide + (int.from_bytes(data[2 : 2 + wide]) if wide else data[1])
    whole = items(data, 0, end) if wide <= 3 and end <= len(data) else None
    inner = items(data, *whole[0][1:]) if whole else None
    kind = _sequence(data, inner) if inner else None
    return (*kind, end) if kind else None


def _decoded(text: str) -> bytes:
    text = text[: len(text) - (len(text) % 4 == 1)].replace("-", "+").replace("_", "/")
    return base64.b64decode(text + "=" * (-len(text) % 4))


def _may_begin(head: bytes) -> bool:
    """Whether the first 12 bytes may begin a key: else no more is read."""
    if head[0] != 0x30:
        return head.startswith((OPENSSH[:12], b"-----BEGIN "))
    wide = head[1] & 0x7F if head[1] >= 0x80 else 0
    return wide <= 3 and head[2 + wide] in (2, 0x30)


def _base64_keys(text: str, nested: bool = False) -> Iterator[Span]:
    at = 0
    while m := _BASE64.search(text, at):
        start, at = m.start(), m.start() + 1
        if not _may_begin(_decoded(m[0])):
            continue
        block = _BLOCK.match(text, start, start + 2 * MOST_BYTES)[0]
        pieces = [p.span() for p in _PIECE.finditer(block) if p[0][0] not in " \t\r\n\\"]
        data = _decoded("".join(block[a:b] for a, b in pieces))
        if data.startswith(b"---"):  # armour that was encoded again: one level
            plain = data.decode("latin-1")
            inner = None if nested else next(_base64_keys(plain, True), None)
            found = inner and (inner[0], inner[3], _ARMOUR_END.match(plain, inner[2]).end())
        else:
            found = parse_key(data)
        if not found:
            continue
        chars = -(-found[2] * 4 // 3)
        for a, b in pieces:
            if chars <= b - a:
                at = start + a + chars
                break
            chars -= b - a
        while text.startswith("=", at):
            at += 1
        yield found[0], start, at, found[1]


def _hex_keys(text: str) -> Iterator[Span]:
    for m in _HEX_KEY.finditer(text):
        run = m[0][: 2 * MOST_BYTES]
        if found := parse_key(bytes.fromhex(run[: len(run) // 2 * 2])):
            yield found[0], m.start(), m.start() + 2 * found[2], found[1]


def _object(part: str) -> dict | None:
    try:
        found = json.loads(_decoded(part))
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _tokens(text: str) -> Iterator[Span]:
    for m in _TOKEN.finditer(text):
        header, payload, signature = m[0].split(".")
        head = _object(header)
        name = head.get("alg") if head else None
        size = len(_decoded(signature))
        fit = isinstance(name, str) and (SIGNATURE_BYTES.get(name) == size or name in RSA_SIGNATURES and RSA_BYTES[0] <= size <= RSA_BYTES[1])
        if fit and _object(payload) is not None:
            yield "signed_token", m.start(), m.end(), name


def scan_text(text: str, flags: frozenset[str] = frozenset(_FLAGS)) -> list[Span]:
    """(kind, start, end, detail) of all secrets, in code points, by start and kind. ``flags`` are the patterns to try."""
    out: list[Span] = []
    if "assign" in flags:
        out += [("assign", *m.span(), m[1].lower()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "access" in flags:
        out += [("access", *m.span(), "") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    if "hex" in flags:
        out += [("hex", *m.span(), "") for m in HEX.finditer(text)]
    for flag, find in (("base64", _base64_keys), ("hex_key", _hex_keys), ("token", _tokens)):
        if flag in flags:
            out += find(text)
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("detail", pa.string())])


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, secrets): of every row of ``docs`` its secrets, an array of (kind, start, end, detail) in code points with
    exclusive ends, by start, then kind as in KINDS.

    A null text is empty, and an empty one has no secrets; keys go through as they are, null and repeated ones too; an empty
    table gives no rows; other columns do not matter. Texts are scanned whole, whatever their length, each in the task
    that reads it: nothing is shuffled."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            marks = {name: pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False) for name, p in _FLAGS.items()}
            found = []
            for i in range(len(texts)):
                flags = frozenset(name for name, mark in marks.items() if mark[i])
                found.append([dict(zip(("kind", "start", "end", "detail"), s, strict=True)) for s in scan_text(texts[i].as_py(), flags)] if flags else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(_SPAN))], ["key", "secrets"])

    narrow = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    found = narrow.mapInArrow(scan, f"key {kind}, secrets array<struct<kind: string, start: bigint, end: bigint, detail: string>>")
    return found.withColumnRenamed("key", key)


def joined(spans: F.Column) -> F.Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents", "doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s.kind.isin(*BASE))
    confirmed = F.size("secrets").cast("long") - F.size(base)
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), confirmed.alias("n_confirmed"))
