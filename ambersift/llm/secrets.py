"""Secrets in whole texts: keywords first, anchored expressions near hits, then checksums.

One Aho-Corasick automaton runs over the lower-cased bytes of a batch and reports
where a keyword starts. Only there an expression is tried, anchored at the hit.
Runs of hex digits have no keyword; a byte-class table finds them. Formats that
carry a checksum or a decodable structure count only if it holds.

Kinds, in the order in which equal starts are listed:

* ``assign``: a credential word, ``:`` or ``=``, and a value of 12 or more characters
* ``access``: ``AKIA`` and capitals or digits, 18 or more characters in all
* ``hex``: 16 or more lower-case hex digits
* ``github``, ``npm``: prefixed tokens whose last six characters are the CRC-32 of the
  rest, in base 62
* ``jwt``: three base64url parts, the first two of which decode to JSON objects and the
  first of which names an algorithm
* ``pem``: a private key block whose body is base64 of a DER sequence of the right length,
  of an OpenSSH key whose length fields fit (``OPENSSH``), or, below RFC 1421 header lines
  that say so, of whole blocks of the cipher they name

Matches of a kind are leftmost and do not overlap; a match that is too short or whose
checksum fails is consumed but not reported. Positions are code points, end exclusive.
Null and empty texts have no spans. Rows are independent, so repeated rows give
repeated results, an empty table an empty one, and other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import CHUNK, row_chunks, table, text_bytes

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE_KINDS = KINDS[:3]

# Keywords of each kind, lower case, and the expression tried at a hit.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "pem": ("-----begin ",),
}
EXPRESSIONS = {
    "assign": re.compile(
        rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    ),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "github": re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
    "npm": re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
    "jwt": re.compile(rb"(eyJ[0-9A-Za-z_-]++)\.(eyJ[0-9A-Za-z_-]++)\.([0-9A-Za-z_-]++)"),
    "pem": re.compile(
        # Header lines with their continuations up to a blank line; possessive, so that no text is read twice.
        rb"-----BEGIN ([A-Z ]*PRIVATE KEY)-----"
        rb"((?>\s*(?:[A-Za-z][A-Za-z0-9-]*+:[^\r\n]*+(?:\r\n?|\n)"
        rb"[\x20\t]*+(?:(?<=[\x20\t])(?![A-Za-z][A-Za-z0-9-]*+:)[^\s][^\r\n]*+(?:\r\n?|\n)[\x20\t]*+)*+)++(?:\r\n?|\n))?+)"
        rb"([0-9A-Za-z+/=\s]+)-----END \1-----"
    ),
}
SHORTEST_VALUE, SHORTEST_ACCESS, SHORTEST_HEX = 12, 18, 16
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_OPENSSH = b"openssh-key-v1\0"
_ENCRYPTED = re.compile(rb"(?im)^[\x20\t]*Proc-Type:[\x20\t]*4[\x20\t]*,[\x20\t]*ENCRYPTED")
_CIPHER = re.compile(rb"(?im)^[\x20\t]*DEK-Info:[\x20\t]*([A-Z0-9-]+)[\x20\t]*,[\x20\t]*((?:[0-9A-F]{16}){1,2})(?![0-9A-F])")
#: The run of characters that a token's first part is: what fails from one place of it fails from all later ones.
_TOKEN_RUN = re.compile(rb"eyJ[0-9A-Za-z_-]*+")
_IS_HEX = table(b"0123456789abcdef")


def base62_crc(body: bytes) -> bytes:
    """CRC-32 of ``body`` as six base-62 digits."""
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _BASE62[d] + out
    return out.encode()


def _json_part(part: bytes) -> object:
    try:
        return json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4)))
    except ValueError:
        return None


def _der_sequence(der: bytes) -> bool:
    """Whether ``der`` is one DER sequence whose length field fits."""
    if len(der) < 2 or der[0] != 0x30:
        return False
    if der[1] < 0x80:
        return len(der) == 2 + der[1]
    n = der[1] & 0x7F
    return 0 < n <= 4 and len(der) == 2 + n + int.from_bytes(der[2 : 2 + n], "big")


def _openssh_key(key: bytes) -> bool:
    """Whether ``key`` is a file of the openssh-key-v1 format: cipher, key derivation and its
    options, number of keys, public keys, private part; all lengths must fit."""
    if not key.startswith(_OPENSSH):
        return False
    at, parts, left = len(_OPENSSH), [], 4
    while left:
        if len(parts) == 3:
            left = int.from_bytes(key[at : at + 4], "big") + 1
            at += 4
            if not 1 < left <= len(key):
                return False
        n = int.from_bytes(key[at : at + 4], "big")
        if at + 4 + n > len(key):
            return False
        parts.append(key[at + 4 : at + 4 + n])
        at, left = at + 4 + n, left - 1
    cipher, private = parts[0], parts[-1]
    if cipher == b"none":  # the private part begins with a number, twice
        return at == len(key) and len(private) > 8 and private[:4] == private[4:8]
    return bool(cipher) and len(private) > 0 and len(private) % 8 == 0 and len(key) - at in (0, 16)  # some ciphers add a tag


def _pem_key(label: bytes, head: bytes, body: bytes) -> bool:
    try:
        key = base64.b64decode(b"".join(body.split()), validate=True)
    except ValueError:
        return False
    if label == b"OPENSSH PRIVATE KEY":
        return _openssh_key(key)
    if _ENCRYPTED.search(head):
        m = _CIPHER.search(head)
        block = len(m[2]) // 2 if m else 0
        return block > 0 and len(key) > 0 and (len(key) % block == 0 or not m[1].upper().endswith(b"-CBC"))
    return _der_sequence(key)


def valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[1]) >= SHORTEST_VALUE
    if kind == "access":
        return len(m[0]) >= SHORTEST_ACCESS
    if kind in ("github", "npm"):
        return base62_crc(m[1]) == m[2]
    if kind == "jwt":
        head, body = _json_part(m[1]), _json_part(m[2])
        return isinstance(head, dict) and "alg" in head and isinstance(body, dict)
    return _pem_key(m[1], m[2], m[3])


def keyword_automaton() -> ahocorasick.Automaton:
    """Keywords as byte strings read as Latin-1, each with its kind and length."""
    out = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            out.add_word(w, (kind, len(w)))
    out.make_automaton()
    return out


def _hex_runs(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Starts and ends of runs of at least ``SHORTEST_HEX`` hex digits within a row."""
    edge = np.zeros(len(data) + 2, np.int8)
    edge[1:-1] = _IS_HEX[data]
    step = np.diff(edge)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    # Where rows touch without a break, the run is cut at the row's start.
    inner = rows[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    cut = np.unique(inner[_IS_HEX[data[inner]] & _IS_HEX[data[inner - 1]]]) if len(inner) else inner
    start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    keep = end - start >= SHORTEST_HEX
    return np.stack([start[keep], end[keep]], 1)


def spans_of(data: np.ndarray, rows: np.ndarray, automaton: ahocorasick.Automaton) -> dict[int, list[tuple]]:
    """By row number: (start, kind's place, end) in bytes of the row, unsorted."""
    raw = data.tobytes()
    found: dict[int, list[tuple]] = {}
    hits = sorted((end + 1 - n, kind) for end, (kind, n) in automaton.iter(raw.lower().decode("latin-1")))
    if hits:
        row_of = np.searchsorted(rows, [h[0] for h in hits], "right") - 1
        free: dict[tuple[int, str], int] = {}
        for (at, kind), row in zip(hits, row_of.tolist()):
            if at < free.get((row, kind), 0):
                continue
            first, stop = int(rows[row]), int(rows[row + 1])
            m = EXPRESSIONS[kind].match(raw, at, stop)
            if m:
                free[row, kind] = m.end()
                if valid(kind, m):
                    found.setdefault(row, []).append((at - first, KINDS.index(kind), m.end() - first))
            elif kind == "jwt" and (run := _TOKEN_RUN.match(raw, at, stop)):
                free[row, kind] = run.end()
    runs = _hex_runs(data, rows)
    for (a, b), row in zip(runs.tolist(), (np.searchsorted(rows, runs[:, 0], "right") - 1).tolist()):
        first = int(rows[row])
        found.setdefault(row, []).append((a - first, KINDS.index("hex"), b - first))
    return found


SCHEMA = "doc_id long, spans array<struct<kind:string, start:long, end:long, value:string>>"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and ``spans``, an array of (kind, start, end, value)
    ordered by start, then kind."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = keyword_automaton()
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for a, b in row_chunks(at, 4 * CHUNK):
                part, rows = data[at[a] : at[b]], at[a : b + 1] - at[a]
                for row, spans in spans_of(part, rows, automaton).items():
                    text = part[rows[row] : rows[row + 1]]
                    before = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])  # code points before a byte
                    out[a + row] = [
                        {
                            "kind": KINDS[k], "start": int(before[s]), "end": int(before[e]),
                            "value": text[s:e].tobytes().decode("utf-8", "replace"),
                        }
                        for s, k, e in sorted(spans)
                    ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(span))], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, SCHEMA)


def span_digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their span list, and all spans as text."""

    def joined(spans):
        parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(parts, ",")

    def n(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id", *[n(k) for k in BASE_KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
