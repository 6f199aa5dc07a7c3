"""Secrets, token counts, packing, licences against brute force, tokenizers and SQL."""

import base64
import hashlib
import json
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from check import compare, duck
from conftest import SF

from ambersift.llm import licenses, packing, queries, secrets, token_counts
from ambersift.llm.tables import tokenizer

from .conftest import awkward_rows, frame, sentence

BASE = (
    ("assign", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 12, 1),
    ("access", re.compile("AKIA[A-Z0-9]+"), 18, 0),
    ("hex", re.compile("[0-9a-f]+"), 16, 0),
)


def base_spans(text):
    out = []
    for k, (kind, rx, least, group) in enumerate(BASE):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in rx.finditer(text or "") if len(m[group]) >= least]
    return [s[2] for s in sorted(out)]


def random_secret_text(rng):
    parts = []
    for _ in range(rng.randint(0, 12)):
        parts.append(rng.choice([
            f"{rng.choice(['password', 'PassWd', 'api_key', 'APIKEY', 'Secret', 'token'])}{rng.choice(['', '\"'])}{' ' * rng.randint(0, 2)}"
            f"{rng.choice([':', '=', ''])} {rng.choice(['', chr(39)])}{'aB3/+_.=-'[: rng.randint(1, 9)] * rng.randint(1, 3)}",
            "AKIA" + "Z9" * rng.randint(1, 12), "AKIAAKIA" * 3, "%x" % rng.getrandbits(rng.choice([40, 64, 160])),
            "token=token=token=abcdefghijkl", "é" * rng.randint(1, 4), "Key ſecret=aaaaaaaaaaaaaa", sentence(rng, 5),
        ]))
    return rng.choice([" ", "", "\n"]).join(parts)


def test_base_secrets(spark):
    rng = random.Random(9)
    rows = [(i, random_secret_text(rng)) for i in range(400)] + awkward_rows()
    got = queries.span_digest(secrets.find_secrets(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        want.setdefault(i, set()).add(hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest())
    assert all(r.base_sha256 in want[r.doc_id] for r in got)
    assert sum(r.n_assign + r.n_access + r.n_hex for r in got) > 800


def test_checksums_decide(spark):
    body = "0123456789klmnopqrstABCDEFGHIJ"
    good = f"ghp_{body}{secrets.base62_crc(body.encode()).decode()}"
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    jwt = f"{part({'alg': 'HS256'})}.{part({'sub': 'é'})}.c2ln"
    der = base64.b64encode(b"\x30\x03\x02\x01\x07").decode()
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{der}\n-----END RSA PRIVATE KEY-----"
    rows = [(1, f"é {good}."), (2, good[:-1] + "0"), (3, f"x {jwt} y"), (4, part({"no": 1}) + "." + part({}) + ".c2ln"),
            (5, pem), (6, pem.replace(der, "AAAA")), (7, f"npm_{good[4:]}")]
    got = {r.doc_id: [(s.kind, s.start, s.value) for s in r.spans] for r in secrets.find_secrets(frame(spark, rows)).collect()}
    assert got == {1: [("github", 2, good)], 2: [], 3: [("jwt", 2, jwt)], 4: [], 5: [("pem", 0, pem)], 6: [], 7: [("npm", 0, f"npm_{good[4:]}")]}


def test_token_counts_follow_the_tokenizer(spark, no_rows):
    import sentencepiece
    from tokenizers import models

    path = tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    vocabulary = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not sp.is_control(i)]
    model = models.Unigram(vocabulary, unk_id=0, byte_fallback=True)
    rng = random.Random(6)
    odd = ["▁", "▁▁x", "naïve", "日本語テキスト", "́", "áé", "😀x", "ﬁ", " ", "x" * 3000]
    rows = [(i, " ".join(rng.choice([sentence(rng, 1), rng.choice(odd)]) for _ in range(40))) for i in range(60)]
    rows += [(i, t) for i, t in awkward_rows() if i not in (4, 5, 13)]
    cache = {}
    want = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for w in words:
            if w not in cache:
                cache[w] = len(model.tokenize("▁" + w))
        want.setdefault(i, set()).add((len(words), sum(cache[w] for w in words)))
    got = token_counts.token_counts(frame(spark, rows), path).collect()
    assert len(got) == len(rows) and all((r.n_words, r.n_tokens) in want[r.doc_id] for r in got)
    assert token_counts.token_counts(no_rows, path).count() == 0


def test_ties_go_to_the_longest_piece():
    automaton = token_counts.Automaton(["▁".encode(), b"a", b"b", b"ab", b"bc", b"c"], np.array([0.0, -1, -1, -2, -1, -1.0]))
    grid = np.frombuffer("▁abc".encode(), np.uint8)[None]
    count, score = automaton.cut(grid, np.array([6]))
    assert (count[0], score[0]) == (3, -2.0)  # mark, a, bc
    count, score = automaton.cut(grid[:, :5], np.array([5]))
    assert (count[0], score[0]) == (2, -2.0)  # mark, ab: as good as mark, a, b, and starts first


def test_packing_round_trip(spark, awkward, no_rows):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    rng = random.Random(8)
    rows = [(100 + i, sentence(rng, rng.randint(0, 900))) for i in range(300)]
    rows += [(600, "It's <|endoftext|> o'Neil's.'s x.'y <|startoftext|>a"), (601, "É,é.É!ß–x .'s")]
    docs = frame(spark, rows).unionByName(awkward)
    pieces = packing.token_pieces(docs, path, most=512, with_ids=True).collect()
    tok, texts = Tokenizer.from_file(path), {i: t for i, t in rows} | {i: t for i, t in awkward_rows() if i is not None}
    held = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id is None, p.doc_id, p.piece)):
        assert p.ids_crc32 == zlib.crc32(p.ids) and p.length == len(p.ids) // 4
        if p.doc_id is not None and p.doc_id != 9:
            assert p.start == len(held.setdefault(p.doc_id, []))
            held[p.doc_id] += np.frombuffer(p.ids, "<u4").tolist()
    for i, ids in held.items():
        assert ids == tok.encode(texts[i] or "", add_special_tokens=False).ids + [0]
    plan = packing.pack_documents(docs, path, most=512, deme_size=64, epochs=1).collect()
    assert len(plan) == len(pieces)
    bins = {}
    for p in plan:
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(p.length for p in plan)
    assert len(bins) <= 1.03 * -(-total // 512)
    assert packing.pack_documents(no_rows, path).count() == 0


def test_crossover_keeps_every_piece_and_capacity():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 400, 300)
    a, b = (packing.seedling(lengths, rng, 512, n) for n in (0.0, 0.3))
    for _ in range(20):
        a = packing.crossover(lengths, a, b, rng, 512)
        assert len(a) == 300 and packing.fill(lengths, a).max() <= 512


def test_migration_never_adds_sequences(spark):
    pieces = spark.range(2000).selectExpr("id AS uid", "1 + pmod(xxhash64(id), 700) AS length")
    one, more = (
        packing.pack(pieces, most=1024, deme_size=256, epochs=e).select("sequence_id").distinct().count() for e in (1, 3)
    )
    assert more <= one


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, name):
    why, n = compare(spark, duck(SF), queries.QUERIES[name], queries.ORACLES[name], SF)
    assert not why and n, why


APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License."""


def test_license_rules(spark, awkward, no_rows):
    s = [f"{x}." for x in licenses.SENTENCES]
    rows = [
        (1, f"Header text.\n{APACHE}\nimport x"), (2, "Intro without stop\nReleased under the MIT License.\nMore"),
        (3, " ".join(s[9:11])), (4, f"* {s[9]}\n* {s[10]}\n* {s[11]}"), (5, f"{s[10]} {s[9]}"),
        (6, f"{s[12]} {s[2]} {s[14]} unknown words. {s[15]}"), (7, APACHE.replace("AS IS", "AS WAS")),
    ]
    got = {r.doc_id: list(r.licenses) for r in licenses.find_licenses(frame(spark, rows)).collect()}
    assert got == {
        1: ["Apache-2.0"], 2: ["MIT"], 3: ["BSD-2-Clause"], 4: ["BSD-3-Clause"], 5: [], 6: ["GPL-3.0-or-later", "MIT"], 7: [],
    }
    assert licenses.find_licenses(awkward).filter("size(licenses) > 0").count() == 0
    assert licenses.find_licenses(no_rows).count() == 0


PERMISSION = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{0} Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer.

{1} Redistributions in binary form must reproduce the above copyright notice,
  this list of conditions and the following disclaimer in the documentation
  and/or other materials provided with the distribution.
"""
THIRD = """
{0} Neither the name of the copyright holder nor the names of its
  contributors may be used to endorse or promote products derived from
  this software without specific prior written permission.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""


def test_whole_license_files(spark):
    """Files as projects carry them: titles, copyright lines and list marks without a full stop."""
    line = "Copyright (c) 2024 Jane Doe"
    apache = APACHE.replace("# ", "").replace("#", "")
    texts = [
        (f"MIT License\n\n{line}\n\n{PERMISSION}", ["MIT"]), (f"The MIT License (MIT)\n\n{PERMISSION}", ["MIT"]),
        (f"MIT License\r\n\r\n{line}\r\n\r\n" + PERMISSION.replace("\n", "\r\n"), ["MIT"]),
        (f"{line}\n(c) 2020 Others\n© 2019 More\n\n{PERMISSION}", ["MIT"]),
        (f"BSD 3-Clause License\n\n{line}\nAll rights reserved.\n\n" + BSD.format("1.", "2.") + THIRD.format("3."), ["BSD-3-Clause"]),
        (f"{line}\n\n" + BSD.format("*", "*") + THIRD.format("*"), ["BSD-3-Clause"]),
        (f"{line}\n\n" + BSD.format("-", "-"), ["BSD-2-Clause"]), (f"{line}\n\n" + BSD.format("(a)", "(b)"), ["BSD-2-Clause"]),
        (f"Copyright 2024 The Authors\n\n{apache}", ["Apache-2.0"]), (f"# Copyright 2024 The Authors\n#\n{APACHE}", ["Apache-2.0"]),
        (f"A tool that does things\nCopyright (C) 2024  Jane Doe\n\n{GPL}", ["GPL-3.0-or-later"]),
        ("/*\n * Copyright (C) 2024 Jane\n *\n" + "".join(f" * {x}\n" for x in GPL.splitlines()) + " */", ["GPL-3.0-or-later"]),
        (f"Header notice\n\n{MPL}", ["MPL-2.0"]), (f"ISC License\n\n{line}\n\n{ISC}", ["ISC"]),
        ("MIT License\n\n" + line + "\n\n" + PERMISSION.replace("free of charge", "for a fee"), []),
    ]
    docs = frame(spark, list(enumerate(t for t, _ in texts)))
    got = {r.doc_id: list(r.licenses) for r in licenses.find_licenses(docs).collect()}
    assert got == {i: want for i, (_, want) in enumerate(texts)}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(t for t, _ in texts)))
    sql = {r[0]: [x for x in r[1].split(",") if x] for r in con.execute(licenses.license_sql()).fetchall()}
    assert sql == got


def test_every_sentence_is_hinted_at(spark):
    rows = [(k, s.upper() if k % 2 else s) for k, s in enumerate(licenses.SENTENCES)]
    got = {r.doc_id: r.sentences for r in licenses.find_licenses(frame(spark, rows)).collect()}
    assert got == {k: str(k) for k in range(len(rows))}
