"""Licences by sentence rules, in Spark functions only.

A text is cut into sentences, each is normalised and mapped to the identifier of a known
licence sentence, and the sequence of identifiers is matched against licence rules:
identifiers that must occur in this order, with other known sentences between them or
not. Texts are read in four ways: line ends as blanks (wrapped notices); line ends as
sentence ends (one-line notices); copyright lines left out and lines without letters as
sentence ends (titles without a full stop, also in comments); and list marks as sentence
ends, too (conditions of whole licence files). A rule that holds in any holds.

* Sentences end at ``.``, ``!`` or ``?`` before white space. Normal form: A-Z in lower
  case, runs of other than a-z and 0-9 as one blank; so comment marks do not matter.
* A rule that another found rule contains is not reported (``CONTAINED``).
* Null and empty texts have no licences; repeated rows repeat their result; an empty
  table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence sentences in normal form; a sentence's identifier is its place.
SENTENCES = (
    "this work is licensed under the gnu general public license version 3",
    "licensed under cc by nc 4 0",
    "released under the mit license",
    "licensed under the apache license version 2 0",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or "
    "agreed to in writing software distributed under the license is distributed on an as is basis without warranties or "
    "conditions of any kind either express or implied",
    "see the license for the specific language governing permissions and limitations under the license",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
    "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
    "merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
    "furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be "
    "included in all copies or substantial portions of the software",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties "
    "of merchantability fitness for a particular purpose and noninfringement",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
    "disclaimer in the documentation and or other materials provided with the distribution",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
    "as published by the free software foundation either version 3 of the license or at your option any later version",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
    "as published by the free software foundation either version 2 of the license or at your option any later version",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty "
    "of merchantability or fitness for a particular purpose",
    "see the gnu general public license for more details",
    "this source code form is subject to the terms of the mozilla public license v",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
    "provided that the above copyright notice and this permission notice appear in all copies",
    "this is free and unencumbered software released into the public domain",
    "this work is licensed under a creative commons attribution 4 0 international license",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "spdx license identifier mit",
    "spdx license identifier apache 2 0",
    "spdx license identifier gpl 3 0 or later",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
    "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
    "merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
    "furnished to do so subject to the following conditions",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
    "basis without warranties or conditions of any kind either express or implied",
)
# Licence rules, each with the sentence identifiers that it needs in order.
RULES = (
    ("Apache-2.0", (3,)),
    ("Apache-2.0", (4, 5, 6)),
    ("Apache-2.0", (23,)),
    ("Apache-2.0", (4, 27, 6)),
    ("BSD-2-Clause", (9, 10)),
    ("BSD-3-Clause", (9, 10, 11)),
    ("CC-BY-4.0", (20,)),
    ("CC-BY-NC-4.0", (1,)),
    ("CC-BY-SA-4.0", (21,)),
    ("GPL-2.0-or-later", (13, 14, 15)),
    ("GPL-3.0", (0,)),
    ("GPL-3.0-or-later", (12, 14, 15)),
    ("GPL-3.0-or-later", (24,)),
    ("ISC", (18,)),
    ("MIT", (2,)),
    ("MIT", (7, 8)),
    ("MIT", (22,)),
    ("MIT", (25, 26, 8)),
    ("MPL-2.0", (16, 17)),
    ("Unlicense", (19,)),
)
CONTAINED = {"BSD-2-Clause": "BSD-3-Clause"}


def hint_words(sentences: tuple[str, ...]) -> list[str]:
    """Words of which every sentence holds at least one, few of them: each time the longer
    word that most of the remaining sentences hold."""
    left, out = [set(s.split()) for s in sentences], []
    while left:
        words = {w for s in left for w in s if len(w) > 5 or s <= {x for x in s if len(x) <= 5}}
        out.append(max(sorted(words), key=lambda w: sum(w in s for s in left)))
        left = [s for s in left if out[-1] not in s]
    return out


#: Texts that hold no word of any known sentence are not cut at all.
HINTS = "(?i)" + "|".join(hint_words(SENTENCES))

_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MARK = "\x01"
# A copyright line with its line end before it, a list mark, a line without letters.
_COPYRIGHT = "\\n[^a-z0-9\\n]*(copyright[ \\t]*([(]c[)]|©|[0-9]|by[ \\t]|<)|[(]c[)][ \\t]*[0-9]|©)[^\\n]*"
_LIST_MARK = "\\n[ \\t]*([*•-]|[(]?[0-9a-z][0-9a-z]?[.)])[ \\t]+"
_BLANK_LINE = "\\n[^a-z0-9\\n]*\\n"


READINGS = ("wrapped", "lined", "headed", "itemed")


def rule_pattern(ids: tuple[int, ...]) -> str:
    """Regular expression over ``,3,7,8,``: the identifiers in this order."""
    return "," + ",([0-9]+,)*".join(str(i) for i in ids) + ","


def _readings(low: Column) -> dict[str, Column]:
    """The text with the marks of each way to read it."""
    unix = F.concat(F.lit("\n"), F.regexp_replace(low, "\\r\\n?", "\n"))
    headed = F.regexp_replace(unix, _COPYRIGHT, _MARK)
    return {
        "wrapped": low, "lined": F.regexp_replace(low, "[\\r\\n]+", _MARK),
        "headed": F.regexp_replace(headed, _BLANK_LINE, _MARK),
        "itemed": F.regexp_replace(F.regexp_replace(headed, _LIST_MARK, _MARK), _BLANK_LINE, _MARK),
    }


def _sequence(text: Column) -> Column:
    """``,id,id,`` of the known sentences in order."""
    cut = F.split(F.regexp_replace(text, "([.!?])[\\x20\\x09-\\x0D]+", "$1" + _MARK), _MARK)
    known = F.create_map(*[F.lit(v) for i, s in enumerate(SENTENCES) for v in (s, str(i))])
    ids = F.transform(cut, lambda s: F.try_element_at(known, F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))))
    return F.concat(F.lit(","), F.array_join(F.filter(ids, lambda i: i.isNotNull()), ","), F.lit(","))


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ``licenses`` (array of names, sorted) and ``sentences``
    (identifiers of the known sentences, in order, as the text's lines give them)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("hinted", F.col("text").rlike(HINTS))
    low = F.translate("text", _UPPER, _LOW)
    rows = rows.select(
        "doc_id",
        *[
            F.when(F.col("hinted"), _sequence(text)).otherwise(F.lit(",,")).alias(name)
            for name, text in _readings(low).items()
        ],
    )
    names = sorted({name for name, _ in RULES})
    found = {}
    for name in names:
        held = F.lit(False)
        for ids in (ids for n, ids in RULES if n == name):
            pattern = rule_pattern(ids)
            for reading in READINGS:
                held = held | F.col(reading).rlike(pattern)
        found[name] = held
    for small, large in CONTAINED.items():
        found[small] = found[small] & ~found[large]
    listed = F.filter(F.array(*[F.when(found[n], F.lit(n)) for n in names]), lambda x: x.isNotNull())
    return rows.select(
        "doc_id", F.array_sort(listed).alias("licenses"), F.trim(F.regexp_replace("lined", ",+", " ")).alias("sentences")
    )


def license_sql(table: str = "documents") -> str:
    """The same for DuckDB: doc_id, licenses (comma-joined), sentences."""

    def sequence(text: str) -> str:
        cut = rf"string_split(regexp_replace({text}, '([.!?])[\x20\x09-\x0D]+', '\1' || chr(1), 'g'), chr(1))"
        normal = f"[trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')) for s in {cut}]"
        keys = ", ".join(f"'{s}'" for s in SENTENCES)
        ids = f"[list_position([{keys}], s) - 1 for s in {normal} if list_contains([{keys}], s)]"
        return f"',' || array_to_string({ids}, ',') || ','"

    names = sorted({name for name, _ in RULES})
    found = {}
    for name in names:
        tests = [
            f"regexp_matches({c}, '{rule_pattern(ids)}')" for n, ids in RULES if n == name for c in READINGS
        ]
        found[name] = "(" + " OR ".join(tests) + ")"
    for small, large in CONTAINED.items():
        found[small] = f"({found[small]} AND NOT {found[large]})"
    listed = ", ".join(f"CASE WHEN {found[n]} THEN '{n}' END" for n in names)
    return f"""
    WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOW}') AS low FROM {table}),
    u AS (SELECT *, regexp_replace(chr(10) || regexp_replace(low, '\\r\\n?', chr(10), 'g'), '{_COPYRIGHT}', chr(1), 'g') AS marked FROM t),
    s AS (SELECT doc_id, {sequence("low")} AS wrapped,
                 {sequence("regexp_replace(low, '[\\r\\n]+', chr(1), 'g')")} AS lined,
                 {sequence(f"regexp_replace(marked, '{_BLANK_LINE}', chr(1), 'g')")} AS headed,
                 {sequence(f"regexp_replace(regexp_replace(marked, '{_LIST_MARK}', chr(1), 'g'), '{_BLANK_LINE}', chr(1), 'g')")} AS itemed FROM u)
    SELECT doc_id, array_to_string([x for x in [{listed}] if x IS NOT NULL], ',') AS licenses,
           trim(regexp_replace(lined, ',+', ' ', 'g')) AS sentences
    FROM s
    """
