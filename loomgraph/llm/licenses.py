"""License scans by conditional compression."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches

# Public notices and the operative parts of licenses, by SPDX name. "*" stands for up to eight words of any kind.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "SPDX-License-Identifier: MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Licensed under the ISC License", "SPDX-License-Identifier: ISC"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-only"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC0-1.0": ["To the extent possible under law, * has waived all copyright and related or neighboring rights to this work", "Released under CC0 1.0", "SPDX-License-Identifier: CC0-1.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "proprietary": ["All rights reserved"],
}

#: Every template has one of these cues, on one line or two; texts without any hold no candidates.
CUE = r"(?i)licen[cs]e|redistribut|permission|public[\W_]+domain|rights[\W_]+reserved|waived[\W_]+all|released[\W_]+under|free[\W_]+software|unencumbered"
SEARCH = re.compile(CUE)
WORD = re.compile(r"[^\W_]+|\*")
#: Words of a template that a passage may change, of a hundred, and words that a "*" may stand for.
CHANGES, STAR = 10, 8
#: Characters of a passage that may be remembered.
CACHED = 1 << 12


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


PLAIN = [(name, t, words_of(t)) for name, texts in TEMPLATES.items() for t in texts]


def difference(template: list[str], words: list[str]) -> tuple[int, int, int] | None:
    """Where in ``words`` a template lies best (start, end), and how many words differ there: missing, changed or put in.

    "*" in a template may stand for up to eight words.
    """
    parts, at, first, changed = [[]], 0, None, 0
    for w in template:
        parts.append([]) if w == "*" else parts[-1].append(w)
    for n, part in enumerate(parts):
        blocks = [b for b in SequenceMatcher(None, part, words[at:], autojunk=False).get_matching_blocks() if b.size]
        if not blocks:
            return None
        start, end = at + blocks[0].b, at + blocks[-1].b + blocks[-1].size
        if n and start - at > STAR:
            return None
        changed += len(part) - sum(b.size for b in blocks) + max(0, (end - start) - len(part))
        first = start if first is None else first
        at = end
    return first, at, changed


def cues_of(text: str, starts: list[int]) -> list[int]:
    """The words, by number, at which cues begin, given where words start."""
    return sorted({bisect_right(starts, m.start()) - 1 for m in SEARCH.finditer(text)})


#: Of each template: its words without "*", the cues' places among them, how many words may change, and how many more "*" may take.
SHAPES = []
for _, _, _own in PLAIN:
    _said = [w for w in _own if w != "*"]
    _starts = [sum(len(w) + 1 for w in _said[:k]) for k in range(len(_said))]
    SHAPES.append((frozenset(_said), Counter(_said), cues_of(" ".join(_said), _starts), CHANGES * len(_own) // 100, STAR * _own.count("*")))


class Compressor:
    """Compresses passages alone and with each template as raw dictionary; made once a task."""

    def __init__(self) -> None:
        options = {"level": 3, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.alone = zstandard.ZstdCompressor(**options)
        self.given = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(" ".join(own).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), **options) for _, _, own in PLAIN]
        # Passages are as long as templates, so the caches hold some MB; words of any length go past them.
        saved, place = lru_cache(1 << 12)(self._saved), lru_cache(1 << 12)(self._place)
        self.saved = lambda i, passage: (saved if len(passage) <= CACHED else self._saved)(i, passage)
        self.place = lambda i, window: (place if sum(map(len, window)) <= CACHED else self._place)(i, window)

    def _saved(self, i: int, passage: str) -> tuple[int, int]:
        """Bytes that a template saves of a passage, and the passage's compressed size without it."""
        data = passage.encode("utf-8", "replace")
        size = len(self.alone.compress(data))
        return size - len(self.given[i].compress(data)), size

    def _place(self, i: int, window: tuple[str, ...]) -> tuple[int, int, int] | None:
        place, own = difference(PLAIN[i][2], list(window)), PLAIN[i][2]
        return place if place and 100 * place[2] <= CHANGES * len(own) else None

    def confirmed(self, words: list[str], cues: list[int]) -> set[tuple]:
        """Passages (bytes saved, less; changed; length, less; license; start; end; share saved) that a template's wording confirms.

        Each cue of the text is laid on each cue of a template. The window around them reaches as far as the template can
        with the changes it may have, over line ends and empty lines. Windows that lack more of its words than may change
        go; the others are held against it word by word.
        """
        found = set()
        for i, (kinds, counts, own_cues, most, stars) in enumerate(SHAPES):
            n = counts.total()
            for first in sorted({p - q for p in cues for q in own_cues}):
                low = max(0, first - most - stars)
                window = words[low : max(0, first + n + most + stars)]
                if len(kinds.difference(window)) > most or (counts - Counter(window)).total() > most:
                    continue
                if place := self.place(i, tuple(window)):
                    start, end, changed = low + place[0], low + place[1], place[2]
                    saved, size = self.saved(i, " ".join(words[start : max(end, start + n)]))
                    found.add((-saved, changed, -n, PLAIN[i][0], start, end, round(saved / size, 4)))
        return found

    def match(self, text: str) -> list[tuple[str, int, float, int]]:
        """Confirmed templates of a text by place: (license, where it starts, share of its compressed size saved, words changed).

        Confirmed passages are ranked by the bytes that the template saves, each compressed by itself; one keeps its place from
        those after it. Equal savings go by fewer changes, then by length.
        """
        found = [m for m in WORD.finditer(text) if m[0] != "*"]
        starts, words = [m.start() for m in found], [m[0].lower() for m in found]
        taken, kept = bytearray(len(words)), []
        for _, changed, _, name, start, end, gain in sorted(self.confirmed(words, cues_of(text, starts))):
            if not any(taken[start:end]):
                taken[start:end] = b"\1" * (end - start)
                kept.append((name, starts[start], gain, changed))
        return sorted(kept, key=lambda x: x[1])


def find_licenses(docs: DataFrame) -> DataFrame:
    """``doc_id, licenses, hits`` for each row of ``docs`` (doc_id, text).

    ``hits`` has (license, at, gain, changed) by place: where its passage starts in code points, the share of the passage's
    compressed size that the template saved, and the words that differ (0: exact wording). ``licenses`` lists the names,
    sorted, once each. Null and empty texts have none; texts without a cue word never leave Spark's filter for Python.
    Texts of any length are read around every cue. Repeated rows each have a row, ids may be null or repeat, and an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        tool = Compressor()

        def apply(batch: pa.RecordBatch) -> dict:
            hits = []
            for text in batch.column(1).to_pylist():
                hits.append([{"license": n, "at": at, "gain": g, "changed": c} for n, at, g, c in tool.match(text or "")])
            return {"doc_id": batch.column(0), "hits": hits}

        return apply

    # The pattern runs before texts go to Python: a text without a cue goes there as null.
    cued = docs.select("doc_id", F.when(F.col("text").rlike(CUE), F.col("text")).alias("text"))
    found = over_batches(cued, f"doc_id {kind}, hits array<struct<license: string, at: int, gain: double, changed: int>>", "text", make)
    return found.withColumn("licenses", F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["license"]))))
