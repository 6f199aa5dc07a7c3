"""Private key blocks of the usual kinds."""

import base64
import json
import random
import time

import numpy as np

from ambersift.llm import secrets

from .conftest import frame


def block(label, body, head=""):
    text = base64.b64encode(body).decode()
    lines = "\n".join(text[k : k + 64] for k in range(0, len(text), 64))
    return f"-----BEGIN {label}-----\n{head}{lines}\n-----END {label}-----"


def openssh(cipher=b"none", check=b"abcdabcd", tail=b"", keys=1):
    def part(x):
        return len(x).to_bytes(4, "big") + x

    private = part(check + bytes(range(56)))
    return (
        b"openssh-key-v1\0" + part(cipher) + part(b"none") + part(b"") + keys.to_bytes(4, "big")
        + part(b"\0\0\0\x0bssh-ed25519" + bytes(36)) * keys + private + tail
    )


HEAD = "Proc-Type: 4,ENCRYPTED\nDEK-Info: {}\n\n"
AES, DES = "AES-256-CBC,00112233445566778899AABBCCDDEEFF", "DES-EDE3-CBC,0011223344556677"


def test_private_keys_of_every_kind(spark):
    cipher = random.Random(1).randbytes(96)
    ssh, rsa = "OPENSSH PRIVATE KEY", "RSA PRIVATE KEY"
    der = b"\x30\x03\x02\x01\x07"
    whole = [
        block(ssh, openssh()), block(ssh, openssh(keys=2)), block(ssh, openssh(b"aes256-ctr")),
        block(ssh, openssh(b"aes256-gcm@openssh.com", tail=bytes(16))),
        block(rsa, cipher, HEAD.format(AES)), block(rsa, cipher[:-8], HEAD.format(DES)),
        block("EC PRIVATE KEY", cipher, HEAD.format(AES)).replace("\n", "\r\n"),
        block(rsa, cipher, HEAD.format(AES).replace("\n\n", "\nComment: a\n  b c\n\n")),
        block(rsa, cipher, HEAD.format(AES)).replace("\n", "\n    "),
        block(rsa, der, "Comment: of no cipher\n\n"), block("PRIVATE KEY", der),
    ]
    broken = [
        block(ssh, openssh()[:-1]), block(ssh, openssh(tail=b"x")), block(ssh, openssh(check=b"abcdabce")), block(ssh, der),
        block(ssh, b"openssh-key-v1\0"), block(ssh, openssh(keys=0)), block(rsa, openssh()), block(rsa, cipher),
        block(rsa, cipher[:-1], HEAD.format(AES)), block(rsa, cipher, HEAD.format("AES-256-CBC,XY")),
        block(rsa, cipher, "Proc-Type: 4,ENCRYPTED\n\n"), block(rsa, cipher, "Comment: of no cipher\n\n"),
    ]
    rows = [(i, f"é {x} y") for i, x in enumerate(whole + broken)]
    got = {
        r.doc_id: [(s.kind, s.start, s.value) for s in r.spans if s.kind == "pem"]
        for r in secrets.find_secrets(frame(spark, rows)).collect()
    }
    assert got == {i: [("pem", 2, x)] if i < len(whole) else [] for i, x in enumerate(whole + broken)}


def test_unended_headers_are_read_once():
    text = b"-----BEGIN RSA PRIVATE KEY-----\n" + b"A: b\n  c\n" * 200_000 + b"\n" + b"A\n" * 200_000
    assert secrets.EXPRESSIONS["pem"].match(text) is None


def jwt_spans(text):
    data = np.frombuffer(text.encode(), np.uint8)
    found = secrets.spans_of(data, np.array([0, len(data)]), secrets.keyword_automaton())
    return sorted((s, e) for s, kind, e in found.get(0, []) if kind == secrets.KINDS.index("jwt"))


def test_token_runs_without_dots_are_read_once():
    """Ten times the text takes about ten times as long, not a hundred times."""
    took = []
    for n in (20_000, 200_000):
        start = time.process_time()
        assert jwt_spans("eyJ" * n) == []
        took.append(time.process_time() - start)
    assert took[1] < 40 * took[0] + 0.5


def test_tokens_are_found_whatever_stands_before_them():
    """The same as an attempt at every place."""
    rng = random.Random(8)

    def part(body):
        return base64.urlsafe_b64encode(json.dumps(body).encode()).decode().rstrip("=")

    good = f"{part({'alg': 'HS256'})}.{part({'sub': 'x'})}.c2ln"
    pieces = ["eyJ", "EYJ", "eyJab", ".", "..", "-", " ", "x", good, part({"alg": 1}), part({"b": 2}), "eyj"]
    for _ in range(400):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14)))
        want, free = [], 0
        for at in range(len(text)):
            m = secrets.EXPRESSIONS["jwt"].match(text.encode(), at) if at >= free else None
            if m:
                free = m.end()
                if secrets.valid("jwt", m):
                    want.append(m.span())
        assert jwt_spans(text) == want, text
