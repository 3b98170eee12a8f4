"""License notices: winnowed fingerprints pick candidates, banded alignment confirms them.

Templates are cut into runs of ``K`` words and the smallest fingerprint of every ``WINNOW``
neighbouring runs goes into an inverted index. Any ``K + WINNOW - 1`` words in a row that a
text shares with a template therefore hit the index. Hits of one template near one diagonal
are a candidate; it is aligned with the text within a band, and the words of the template
that match give its coverage. Words that tell a license from its siblings, as its name, version
or clause, must all match, whatever the coverage. The templates are a fixed short list that each task holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words per fingerprint, fingerprints per winnowing window, half width of the band, least coverage.
K, WINNOW, BAND, COVERAGE = 3, 2, 8, 0.8
_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, "
    "either version {} of the License, or (at your option) any later version."
)
_LIBRARY = _HEADER.replace("program", "library")
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_KEEP = (
    ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAME = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES'
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_GNU = {"GPL-2.0": ("", "2"), "GPL-3.0": ("", "3"), "LGPL-2.1": ("Lesser ", "2.1"), "LGPL-3.0": ("Lesser ", "3"), "AGPL-3.0": ("Affero ", "3")}
#: Notices of public licenses. The first sentence of BSD texts is common to all of them and named BSD.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": 'you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "BSD": _BSD,
    "BSD-2-Clause": _BSD + _BSD_KEEP + _BSD_AS_IS,
    "BSD-3-Clause": _BSD + _BSD_KEEP + _BSD_NAME + _BSD_AS_IS,
    "BSD-2-Clause-notice": "Licensed under the BSD 2-Clause License",
    "BSD-3-Clause-notice": "Licensed under the BSD 3-Clause License",
}
#: Words of a template that tell its license from others: each of these must stand in the text as it is, in one piece.
TELLING = {
    "Apache-2.0": ("Apache License Version 2.0",), "Apache-2.0-header": ("LICENSE-2.0",), "MIT": ("the MIT License",), "MPL-2.0": ("Mozilla Public License v. 2.0",),
    "BSD-2-Clause": ("provided with the distribution THIS SOFTWARE",), "BSD-3-Clause": ("Neither the name of",),
    "BSD-2-Clause-notice": ("BSD 2-Clause",), "BSD-3-Clause-notice": ("BSD 3-Clause",), "ISC": ("with or without fee is hereby granted",), "Unlicense": ("into the public domain",),
}
for _name, _title in _CC.items():
    TEMPLATES[f"CC-{_name}-4.0"] = f"Licensed under CC {_name} 4.0"
    TEMPLATES[f"CC-{_name}-4.0-title"] = f"licensed under a Creative Commons {_title} 4.0 International License"
    TELLING |= {f"CC-{_name}-4.0": (f"CC {_name} 4.0",), f"CC-{_name}-4.0-title": (f"Creative Commons {_title} 4.0",)}
for _name, (_kind, _version) in _GNU.items():
    TEMPLATES[_name] = f"This work is licensed under the GNU {_kind}General Public License, version {_version}"
    TEMPLATES[f"{_name}-header"] = (_LIBRARY if _name.startswith("LGPL") else _HEADER).format(_kind, _version)
    TELLING |= {_name: (f"GNU {_kind}General Public License version {_version}",), f"{_name}-header": (f"GNU {_kind}General Public License", f"either version {_version} of the License")}

_OUT = "doc_id long, n_matches long, licenses string, matched_words long, matches array<struct<license:string,start:int,end:int,coverage:double>>"
#: Bytes as the comparison sees them: ASCII letters in lower case, other ASCII signs as spaces.
_SEEN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
_TOKEN = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(_SEEN).split()


class Index:
    """Word numbers of the templates and the places of their winnowed fingerprints."""

    def __init__(self, templates: dict[str, str], telling: dict[str, tuple[str, ...]] | None = None) -> None:
        self.names = sorted(templates)
        parts = [words(templates[n].encode()) for n in self.names]
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for p in parts for w in p}))}
        self.base = len(self.number) + 1
        self.rows = [[self.number[w] for w in p] for p in parts]
        told = TELLING if telling is None else telling
        self.telling = [[[self.number.get(w, 0) for w in words(x.encode())] for x in told.get(n, ()) if words(x.encode())] for n in self.names]
        self.places: dict[int, list[tuple[int, int]]] = {}
        for t, row in enumerate(self.rows):
            codes = self.codes(np.array(row)).tolist()
            ranks = [xxhash.xxh3_64_intdigest(c.to_bytes(8, "little")) for c in codes]
            chosen = {min(range(a, min(a + WINNOW, len(codes))), key=lambda i: (ranks[i], -i)) for a in range(max(1, len(codes) - WINNOW + 1))}
            for i in sorted(chosen):
                self.places.setdefault(codes[i], []).append((t, i))
        self.known = np.array(sorted(self.places))

    def codes(self, numbers: np.ndarray) -> np.ndarray:
        """One number per run of ``K`` words; runs with a word of no template are negative."""
        n = max(0, len(numbers) - K + 1)
        code, missing = np.zeros(n, np.int64), np.zeros(n, bool)
        for k in range(K):
            part = numbers[k : k + n]
            code, missing = code * self.base + part, missing | (part == 0)
        return np.where(missing, -1, code)


def align(template: list[int], doc: list[int], shift: int) -> tuple[int, int, int]:
    """Best local alignment with the text within the band around ``shift``: matched words, first and last word.

    A match scores 2, a word that differs or is missing on either side -1. Ties go to the
    alignment that ends nearest to ``shift``, so that repeats of a notice are told apart.
    """
    best, off = (0, 0, 0, 0), 0
    above: dict[int, tuple[int, int, int]] = {}
    for i, word in enumerate(template):
        here: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + shift - BAND), min(len(doc), i + shift + BAND + 1)):
            score, matched, first = above.get(j - 1, (0, 0, j))
            if score <= 0:
                score, matched, first = 0, 0, j
            cell = (score + 2, matched + 1, first) if doc[j] == word else (score - 1, matched, first)
            for score, matched, first in (above.get(j, (0, 0, j)), here.get(j - 1, (0, 0, j))):
                if score - 1 > cell[0]:
                    cell = (score - 1, matched, first)
            here[j] = cell
            aside = abs(j - i - shift)
            if cell[0] > best[0] or (cell[0] == best[0] and aside < off):
                best, off = (*cell, j), aside
        above = here
    return best[1], best[2], best[3]


def holds(doc: list[int], phrase: list[int], first: int, last: int) -> bool:
    """Whether ``phrase`` stands in one piece between the words ``first`` and ``last``."""
    return any(doc[i : i + len(phrase)] == phrase for i in range(first, last - len(phrase) + 2))


def matches(text: bytes, index: Index, coverage: float) -> list[tuple[str, int, int, float]]:
    """``(license, start, end, coverage)`` in code points, in order; overlapping spans go to the most matched words."""
    found = words(text)
    numbers = np.fromiter(map(index.number.get, found, [0] * len(found)), np.int64, len(found))
    codes = index.codes(numbers)
    hits = np.nonzero(np.isin(codes, index.known))[0] if len(codes) else ()
    if not len(hits):
        return []
    lines: dict[int, list[int]] = {}
    for at in hits.tolist():
        for t, i in index.places[int(codes[at])]:
            lines.setdefault(t, []).append(at - i)
    doc = numbers.tolist()
    spans = []
    for t, shifts in lines.items():
        template = index.rows[t]
        last = None
        for shift in sorted(shifts):
            if last is not None and shift - last <= BAND // 2:
                continue
            last = shift
            n, a, b = align(template, doc, shift)
            if n >= coverage * len(template) and all(holds(doc, x, a, b) for x in index.telling[t]):
                spans.append((-n, a, b, t))
    kept: list[tuple[int, int, int, int]] = []
    for span in sorted(set(spans)):
        if all(span[2] < k[1] or span[1] > k[2] for k in kept):
            kept.append(span)
    if not kept:
        return []
    places = [m.span() for m in _TOKEN.finditer(text.decode())]
    return sorted((index.names[t], places[a][0], places[b][1], round(-n / len(index.rows[t]), 4)) for n, a, b, t in kept)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, n_matches, licenses, matched_words, matches`` per document.

    Null, empty and blank texts match nothing. Repeated rows stay; an empty table gives no
    rows; other columns are ignored. A notice that repeats in a text is reported each time.
    """
    # Phrases of the built-in templates say nothing about a caller's own.
    chosen, told = dict(templates or TEMPLATES), {} if templates else TELLING

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(chosen, told)
        sizes = {n: len(r) for n, r in zip(index.names, index.rows)}
        kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("coverage", pa.float64())]))
        for batch in batches:
            rows = [matches(t.as_py() or b"", index, coverage) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(r) for r in rows], pa.int64()), pa.array([",".join(sorted({m[0] for m in r})) for r in rows], pa.string()),
                    pa.array([sum(round(m[3] * sizes[m[0]]) for m in r) for r in rows], pa.int64()),
                    pa.array([[dict(zip(("license", "start", "end", "coverage"), m)) for m in r] for r in rows], kind),
                ],
                ["doc_id", "n_matches", "licenses", "matched_words", "matches"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _OUT)
