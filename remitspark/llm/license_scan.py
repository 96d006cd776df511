"""License scans by conditional compression.

Words that speak of licensing are triggers. The block of ``AROUND`` words on both sides of a trigger, across lines and
blank lines, is compressed alone and with each template as zstandard raw dictionary; templates are ranked by the bytes
they take off. Winners, in order of rank, are confirmed word by word: around the trigger the stretch of text that
follows one of the template's notices best is found, nearly all its words must be the notice's, the words that set the
license apart (name and version) must all be there, and none that sets another apart may be among the rest.

Cases: null and empty texts hold no license; repeated rows are scanned row by row; ties between templates go to
the first name; an empty table gives an empty result; extra columns are ignored; long texts are scanned whole, the
work for a trigger is bounded whatever the length of its line.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from remitspark.llm.common import bounded_batches

#: What may belong to a license notice.
TRIGGER = re.compile(r"licen[cs]e|copyright|permission is hereby|redistribution and use|public domain|all rights reserved|warrant(?:y|ies)|released under|\bcc0|\bcc by|permission to use", re.I)
WORDS = re.compile(r"[^\W_]+(?:\.\d+)*")
#: Words of a block on each side of its trigger; fewest bytes that a template must take off a block.
AROUND, SAVES = 24, 8
#: Least share of a stretch's words that follow the template's wording, and fewest words of a stretch.
WORDING, SHORTEST = 0.9, 3
#: What a word that is not the notice's costs, against one for a word that is, when a stretch is chosen.
STRAY = 3

#: License names, the words that set them apart, and notices in use. Public license wording.
TEMPLATES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("AGPL-3.0", "affero general public license", (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
    )),
    ("Apache-2.0", "apache license 2.0", (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
        "This work is licensed under the Apache License, Version 2.0.",
    )),
    ("BSD-3-Clause", "redistributions binary endorse", (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    )),
    ("BSD", "bsd license", ("Released under the BSD License.", "Licensed under the BSD License.", "This work is licensed under the BSD 3-Clause License.")),
    ("CC-BY-4.0", "cc by 4.0", ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.")),
    ("CC-BY-NC-4.0", "cc by nc 4.0", ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "Released under CC BY-NC 4.0.")),
    ("CC-BY-SA-4.0", "cc by sa 4.0", ("Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.")),
    ("CC-BY-4.0", "creative commons attribution 4.0", ("This work is licensed under a Creative Commons Attribution 4.0 International License.",)),
    ("CC0-1.0", "cc0 1.0", ("To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.", "Released into the public domain under CC0 1.0.")),
    ("GPL-2.0", "gnu general public license 2", (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 2.",
    )),
    ("GPL-3.0", "gnu general public license 3", (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License, version 3.",
    )),
    ("LGPL-2.1", "gnu lesser general public license 2.1", (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
    )),
    ("LGPL-3.0", "gnu lesser general public license 3", (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.",
    )),
    ("ISC", "permission use copy modify distribute fee", (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    )),
    ("MIT", "permission hereby granted sublicense", (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    )),
    ("MIT", "mit license", ("Released under the MIT License.", "Licensed under the MIT License.", "This work is licensed under the MIT License.")),
    ("MPL-2.0", "mozilla public license 2.0", (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
    )),
    ("Unlicense", "free unencumbered public domain", ("This is free and unencumbered software released into the public domain.",)),
)


def words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


@dataclass(frozen=True)
class Template:
    name: str
    apart: frozenset[str]
    foreign: frozenset[str]
    wordings: tuple[tuple[str, ...], ...]
    compressor: object

    def size(self, block: bytes) -> int:
        """Compressed size with the template as dictionary."""
        return len(self.compressor.compress(block))


@cache
def templates() -> tuple[tuple[Template, ...], object]:
    """Compressors are made once a Python worker."""
    import zstandard as z

    bare = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    params = z.ZstdCompressionParameters.from_level(9, **bare)
    out = []
    names = frozenset(w for _, apart, _ in TEMPLATES for w in apart.split())
    for name, apart, notices in TEMPLATES:
        d = z.ZstdCompressionDict("\n".join(notices).encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
        out.append(Template(name, frozenset(apart.split()), names - frozenset(w for n in notices for w in words(n)), tuple(tuple(words(n)) for n in notices), z.ZstdCompressor(dict_data=d, compression_params=params)))
    return tuple(out), z.ZstdCompressor(compression_params=params)


def stretch(block: list[str], at: int, notice: tuple[str, ...]) -> tuple[int, int, list[str]]:
    """The part [i, j) of the block that has word ``at`` and follows the notice best, and its words that do not."""
    follows = [False] * len(block)
    # a notice quoted from its middle is as good; one shuffled is not: matches come in order by construction
    for m in SequenceMatcher(None, block, notice, autojunk=False).get_matching_blocks():
        follows[m.a : m.a + m.size] = [True] * m.size
    i = j = at
    best = total = 0
    for k in range(at, len(block)):
        total += 1 if follows[k] else -STRAY
        if total > best:
            best, j = total, k + 1
    best = total = 0
    for k in range(at - 1, -1, -1):
        total += 1 if follows[k] else -STRAY
        if total > best:
            best, i = total, k
    return i, j, [block[k] for k in range(i, j) if not follows[k]]


def confirmed(tokens: list[str], at: int, t: Template) -> tuple[int, int, float, list[str]] | None:
    """Words [i, j) around word ``at`` that are one of the template's notices, their share that is, and the rest."""
    best = None
    for notice in t.wordings:
        low = max(0, at - len(notice) - AROUND)
        block = tokens[low : at + len(notice) + AROUND]
        if not t.apart <= set(block):
            continue
        i, j, other = stretch(block, at - low, notice)
        share = 1 - len(other) / max(j - i, 1)
        fine = j - i >= SHORTEST and share >= WORDING and t.apart <= set(block[i:j]) and not t.foreign & set(other)
        if fine and (best is None or (j - i, share) > (best[1] - best[0], best[2])):
            best = low + i, low + j, share, other
    return best


def scan(text: str) -> tuple[int, list[tuple[str, int, int, float, float, list[str]]]]:
    """Number of candidates, and confirmed (license, first line, lines, saved share, wording, differing words)."""
    if not TRIGGER.search(text):
        return 0, []
    known, plain = templates()
    at = [(m.start(), m.end()) for m in WORDS.finditer(text)]
    starts, tokens = [a for a, _ in at], [text[a:b].lower() for a, b in at]
    n, found, done = 0, [], 0
    for m in TRIGGER.finditer(text):
        w = bisect_right(starts, m.start()) - 1
        if w < done:
            continue
        n += 1
        raw = text[starts[max(w - AROUND, done)] : at[min(w + AROUND, len(at) - 1)][1]].encode()
        alone = len(plain.compress(raw))
        for size, t in sorted(((t.size(raw), t) for t in known), key=lambda x: (x[0], x[1].name)):
            if alone - size < SAVES:
                break
            got = confirmed(tokens, w, t)
            if got:
                i, j, share, other = got
                whole = text[starts[i] : at[j - 1][1]]
                line = text.count("\n", 0, starts[i])
                full = whole.encode()
                found.append((t.name, line, whole.count("\n") + 1, 1 - t.size(full) / len(plain.compress(full)), share, other))
                done = j
                break
    return n, found


SCHEMA = "doc_id long, n_candidates long, licenses array<string>, matches array<struct<license:string,line:int,lines:int,saved:double,wording:double,differs:array<string>>>"


def scanned(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, candidates, the licenses found (sorted, each once) and every match."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("license", "line", "lines", "saved", "wording", "differs")
        for b in batches:
            if not len(b):
                continue
            got = [scan(t or "") for t in b["text"]]
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "n_candidates": [n for n, _ in got], "licenses": [sorted({m[0] for m in f}) for _, f in got],
                "matches": [[dict(zip(names, m)) for m in f] for _, f in got],
            })

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
