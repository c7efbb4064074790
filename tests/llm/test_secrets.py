import base64
import hashlib
import json
import random
import re

import pytest

from regolith.llm import secrets

P = 2**521 - 1  # primes
Q = 2**607 - 1


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8)
    return bytes([tag]) + size + body


def number(i):
    return der(2, i.to_bytes(i.bit_length() // 8 + 1))


def rsa():
    e = 65537
    d = pow(e, -1, (P - 1) * (Q - 1))
    return der(0x30, *map(number, (0, P * Q, e, d, P, Q, d % (P - 1), d % (Q - 1), pow(Q, -1, P))))


def ec():
    return der(0x30, number(1), der(4, bytes(range(32))), der(0xA0, der(6, bytes.fromhex("2a8648ce3d030107"))))


def pkcs8(oid, key):
    return der(0x30, number(0), der(0x30, der(6, oid), der(5)), der(4, key))


def text(b):
    return len(b).to_bytes(4) + b


def openssh():
    secret = b"abcdabcd" + text(b"ssh-ed25519") + bytes(64)
    secret += bytes(range(1, 9))[: -len(secret) % 8]
    return secrets.OPENSSH + text(b"none") + text(b"none") + text(b"") + (1).to_bytes(4) + text(text(b"ssh-ed25519") + text(bytes(32))) + text(secret)


def plain64(data):
    return base64.b64encode(data).decode()


def url64(data):
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def wrapped(data, end="\n", wide=64):
    s = plain64(data)
    return end.join(s[i : i + wide] for i in range(0, len(s), wide))


def token(header, payload, size):
    return ".".join((url64(json.dumps(header).encode()), url64(payload), url64(bytes(range(size)))))


KEYS = {"pkcs1": rsa(), "sec1": ec(), "pkcs8": pkcs8(secrets.OID_RSA, rsa()), "openssh": openssh()}
KEYS["pkcs8_encrypted"] = der(0x30, der(0x30, der(6, bytes.fromhex("2a864886f70d01050d")), der(0x30)), der(4, bytes(64)))
KEYS["dsa"] = der(0x30, *map(number, (0, P, 2, 3, 5, 1)))


@pytest.mark.parametrize("kind", KEYS)
def test_keys_in_every_dress(kind):
    key = KEYS[kind]
    armour = f"-----BEGIN PRIVATE KEY-----\n{wrapped(key)}\n-----END PRIVATE KEY-----\n"
    dresses = [plain64(key), wrapped(key), wrapped(key, "\r\n", 76), wrapped(key, "\\n"), wrapped(key, " "), wrapped(key, "\n    "), url64(key), plain64(armour.encode())]
    dresses += [key.hex(), key.hex().upper()]
    for shown in dresses:
        for before, after in (("", ""), ("see: ", " and more words\nof text"), ('"', '"'), ("é€😀\n", "\n-----END PRIVATE KEY-----")):
            found = [s for s in secrets.scan_text(before + shown + after) if s[0] not in secrets.BASE]
            assert [s[:3] for s in found] == [(kind, len(before), len(before) + len(shown))], (shown[:40], before)


@pytest.mark.parametrize("kind", KEYS)
def test_broken_lengths_are_not_reported(kind):
    key = KEYS[kind]
    rng = random.Random(3)
    for cut in (1, 8, len(key) // 2):
        assert not [s for s in secrets.scan_text(plain64(key[:-cut])) if s[0] not in secrets.BASE]
    at = {"openssh": 22}.get(kind, 3 if len(key) > 130 else 1)  # a length
    for _ in range(5):
        bad = bytearray(key)
        bad[at] ^= rng.randrange(1, 100)
        assert not [s for s in secrets.scan_text(plain64(bytes(bad))) if s[0] not in secrets.BASE]


def test_public_keys_certificates_and_noise_are_not_reported():
    public = der(0x30, der(0x30, der(6, secrets.OID_RSA), der(5)), der(3, b"\0" + der(0x30, number(P * Q), number(65537))))
    other = pkcs8(secrets.OID_EC, rsa())  # the key is not that of the method
    wrong = der(0x30, *map(number, (0, P * Q + 2, 65537, 3, P, Q, 1, 1, 1)))
    rng = random.Random(5)
    noise = [bytes([0x30, 0x82, 1, 0]) + rng.randbytes(256) for _ in range(200)] + [rng.randbytes(80) for _ in range(200)]
    for data in (public, other, wrong, *noise):
        for shown in (plain64(data), data.hex()):
            assert not [s for s in secrets.scan_text(shown) if s[0] not in secrets.BASE]


def test_signed_tokens():
    good = [({"alg": "HS256"}, b'{"a": 1}', 32), ({"typ": "JWT", "alg": "RS256"}, b"{}", 256), ({"alg": "ES512"}, b"{}", 132)]
    bad = [({"alg": "HS256"}, b'{"a": 1}', 33), ({"alg": "none"}, b"{}", 32), ({"alg": ["HS256"]}, b"{}", 32), ({"typ": "JWT"}, b"{}", 32), ({"alg": "HS256"}, b"[1]", 32), ({"alg": "HS256"}, b"\xff\xfe", 32)]
    for case in good:
        s = "Bearer " + token(*case) + "."
        assert [x for x in secrets.scan_text(s) if x[0] == "signed_token"] == [("signed_token", 7, 7 + len(token(*case)), case[0]["alg"])]
    for case in bad:
        assert not [x for x in secrets.scan_text("Bearer " + token(*case)) if x[0] == "signed_token"]


def base(t):
    """The contract's patterns, tried at every place by hand."""
    out = []
    for kind, pattern, fit in (
        ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    ):
        p, at = re.compile(pattern), 0
        while at <= len(t):
            m = p.match(t, at)
            if m and fit(m):
                out.append((m.start(), secrets.BASE.index(kind), m.end(), kind))
            at = m.end() if m else at + 1
    return [(k, a, b) for a, _, b, k in sorted(out)]


def texts():
    rng = random.Random(11)
    bits = ["token", "TOKEN", "apiKey", "api_key", "password", "passwd", "secret", "toKen", "paſsword", "=", ":", " ", "  ", '"', "'", "abc", "abcdefgh", "x.y=z-1+/_9", "AKIA", "ABCDEFGHIJKL", "A1B2", "é", "😀", "\n"]
    bits += ["0123456789abcdef", "deadbeef" * 4, "DEADBEEF" * 4, "f", plain64(ec()), token({"alg": "HS256"}, b"{}", 32)]
    made = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 30))) for _ in range(1500)]
    return [*made, "secret:token:abcdefgh", "token=token=abcdefghij", "", None, "x " * 500_000 + 'token: "' + "k" * 40 + '"', made[0]]


def test_query_as_brute_force(spark, tmp_path):
    rows = [(i, t, "token", 1) for i, t in enumerate(texts())] + [(None, "secret=12345678", "", 2), (3, "secret=12345678", "", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, spans string, n_hex int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, secrets.op11_secrets(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        plain = base(t or "")
        every = secrets.scan_text(t or "")
        assert [s[:3] for s in every if s[0] in secrets.BASE] == plain
        name = lambda s: ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        counts = [sum(s[0] == k for s in plain) for k in secrets.BASE]
        want.append((i, *counts, hashlib.sha256(name(plain).encode()).hexdigest(), name([s[:3] for s in every]), len(every) - len(plain)))
    assert got == sorted(want, key=str)
    assert sum(w[-1] for w in want) > 100


def test_real_output_and_empty_table(spark):
    df = spark.createDataFrame([("a", "my " + plain64(rsa()))], "name string, body string")
    row = secrets.find_secrets(df, "name", "body").first()
    assert (row.name, [s.asDict() for s in row.secrets]) == ("a", [{"kind": "pkcs1", "start": 3, "end": 3 + len(plain64(rsa())), "detail": f"RSA {(P * Q).bit_length()}"}])
    assert secrets.find_secrets(df.limit(0), "name", "body").collect() == []
