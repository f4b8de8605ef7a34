"""Licence scans: a trained paragraph classifier whose predictions templates confirm."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import kept_fields, schema

# Notices and opening sentences of common licences, as their stewards publish them.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "SPDX-License-Identifier: MIT",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "SPDX-License-Identifier: Zlib",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "You may not use the material for commercial purposes under CC BY-NC 4.0.",
    ],
    "cc-by-nd": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
        "This work is in the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
        "SPDX-License-Identifier: Unlicense",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright 2020 Example Corp. All rights reserved.",
        "This document is proprietary and confidential. Unauthorized copying, distribution or use is strictly prohibited.",
        "No part of this publication may be reproduced, distributed or transmitted in any form without the prior written permission of the publisher.",
    ],
}
#: Licence words in paragraphs that grant nothing.
DECOYS = [
    "She lost her driving license and had to apply for a new version of the document.",
    "The council will license the market stalls under the new rules.",
    "Permission to enter the building was granted free of charge to every visitor.",
    "Copyright law was the subject of the second lecture.",
    "The public library is open to any person on Monday.",
    "He works under the general manager of the foundation.",
    "Apache helicopters and the MIT campus were in the news.",
    "The author has reserved all the seats; rights of way were discussed.",
    "Version 2.0 of the program was released under great pressure.",
    "Creative people form a common domain of software and terms.",
]
OTHER = "other"
#: Bytes to lower case, and all ASCII but letters, digits and dots within numbers to space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def words_of(paragraph: bytes) -> list[bytes]:
    return paragraph.translate(_FOLD).split()


def grams_of(words: list[bytes]) -> set[bytes]:
    """Word n-grams of lengths 1 to 3, space-joined."""
    return {b" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


class Model:
    """Sparse n-gram multinomial logistic regression over licence families and `other`.

    A temperature, fitted on examples set aside, calibrates the probabilities; a family below the threshold, or without
    a template of its own that confirms it, is `unknown`.
    """

    def __init__(self, negatives: list[str], threshold: float = 0.5, confirm: float = 0.8, most_grams: int = 4000, most_share: float = 0.005, seed: int = 11) -> None:
        self.names = [*TEMPLATES, OTHER]
        self.threshold, self.confirm = threshold, confirm
        rng = random.Random(seed)
        plain = [p for p in negatives if len(p.split()) > 1 and not re.search(r"(?i)licen[sc]e|copyright|rights reserved|public domain|permission", p)]
        notices = {x for n in TEMPLATES.values() for t in n for x in self._shingles(words_of(t.encode()))}
        plain = [p for p in plain if notices.isdisjoint(self._shingles(words_of(p.encode())))]  # a notice is no counter-example
        rng.shuffle(plain)
        plain = plain[:1500]
        filler = [w for p in plain[:200] for w in p.split()] or ["lorem", "ipsum"]
        examples: list[tuple[str, int]] = []
        for k, notices in enumerate(TEMPLATES.values()):
            for notice in notices:
                for _ in range(30):
                    w = [x for x in notice.split() if rng.random() > 0.04] or notice.split()
                    before = [rng.choice(filler) for _ in range(rng.choice((0, 0, 3, 12)))]
                    after = [rng.choice(filler) for _ in range(rng.choice((0, 0, 3, 12)))]
                    examples.append((" ".join(before + w + after), k))
        other = len(TEMPLATES)
        examples += [(p, other) for p in plain]
        for d in DECOYS:
            for _ in range(15):
                w = d.split()
                cut = rng.randrange(len(w))
                examples.append((" ".join(w[cut:] + w[:cut]) if rng.random() < 0.5 else d, other))
        rng.shuffle(examples)
        grams = [grams_of(words_of(t.encode())) for t, _ in examples]
        known = {g for t in [x for n in TEMPLATES.values() for x in n] for g in grams_of(words_of(t.encode()))}
        count: dict[bytes, int] = {}
        for p in plain:
            for g in grams_of(words_of(p.encode())) & known:
                count[g] = count.get(g, 0) + 1
        known -= {g for g, n in count.items() if n > most_share * len(plain)}  # grams of everyday text tell nothing
        frequency: dict[bytes, int] = {}
        for g in grams:
            for x in g & known:
                frequency[x] = frequency.get(x, 0) + 1
        chosen = sorted(frequency, key=lambda x: (-frequency[x], x))[:most_grams]
        self.index = {g: i for i, g in enumerate(chosen)}
        y = np.array([k for _, k in examples])
        x = np.zeros((len(examples), len(chosen)), np.float32)
        for i, g in enumerate(grams):
            x[i, [self.index[a] for a in g & known if a in self.index]] = 1
        x /= np.sqrt(np.maximum(1, x.sum(1, keepdims=True)))
        held = np.arange(len(y)) % 5 == 0
        self.weights, self.bias = self._fit(x[~held], y[~held])
        logits = x[held] @ self.weights + self.bias
        self.temperature = min((0.25 * 1.3**i for i in range(14)), key=lambda t: self._loss(logits / t, y[held]))
        self.templates = [[set(self._shingles(words_of(t.encode()))) for t in n] for n in TEMPLATES.values()]
        self.where: dict[bytes, list[tuple[int, int]]] = {}  # shingle: family and template
        for k, family in enumerate(self.templates):
            for t, template in enumerate(family):
                for x in template:
                    self.where.setdefault(x, []).append((k, t))
        # Words without one of which `other` cannot lose: each gram that speaks for a family has such a word.
        gain = (self.weights[:, :-1] - self.weights[:, -1:]).max(1)
        lead = float((self.bias[:-1] - self.bias[-1]).max())
        if lead >= 0:
            raise ValueError("the classifier prefers a licence without any evidence")
        self.gate = {min(g.split(), key=lambda w: (count.get(w, 0), -len(w), w)) for g, i in self.index.items() if gain[i] > 0}

    @staticmethod
    def _shingles(words: list[bytes], n: int = 3) -> list[bytes]:
        return [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]

    @staticmethod
    def _probabilities(logits: np.ndarray) -> np.ndarray:
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def _loss(self, logits: np.ndarray, y: np.ndarray) -> float:
        return -float(np.log(self._probabilities(logits)[np.arange(len(y)), y] + 1e-12).mean())

    def _fit(self, x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 30.0, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
        """Gradient descent with momentum on the whole batch; the bias is fixed so that no evidence means `other`."""
        k = len(self.names)
        target = np.eye(k, dtype=np.float32)[y]
        w, v = np.zeros((x.shape[1], k), np.float32), 0
        bias = np.zeros(k, np.float32)
        bias[-1] = 3
        for _ in range(steps):
            slope = x.T @ (self._probabilities(x @ w + bias).astype(np.float32) - target) / len(y) + ridge * w
            v = 0.9 * v - rate * slope
            w = w + v
        return w, bias

    def judge(self, paragraph: bytes, gated: bool = True) -> tuple[str, float] | None:
        """(family or unknown, probability), None for a paragraph that is no licence notice."""
        words = words_of(paragraph)
        if gated and self.gate.isdisjoint(words):
            return None
        at = [self.index[g] for g in grams_of(words) if g in self.index]
        logits = self.weights[at].sum(0) / np.sqrt(max(1, len(at))) + self.bias
        p = self._probabilities(logits[None] / self.temperature)[0]
        k = int(p.argmax())
        if k == len(self.names) - 1:
            return None
        here = set(self._shingles(words))
        confirmed = any(len(t & here) >= self.confirm * len(t) for t in self.templates[k])
        return (self.names[k] if confirmed and p[k] >= self.threshold else "unknown", float(p[k]))

    def _wrapped(self, lines: list[bytes]) -> list[tuple[int, int, str, float]]:
        """(first line, last line, family, probability) of notices that adjacent lines make up together.

        A line without words ends what it may be joined with. Where the shingles of a template come close enough together
        to confirm it, the lines they are on are judged as one.
        """
        out: list[tuple[int, int, str, float]] = []
        words: list[bytes] = []
        of: list[int] = []
        for i, line in enumerate([*lines, b""]):
            if w := words_of(line):
                words += w
                of += [i] * len(w)
                continue
            if of and of[0] != of[-1]:
                hits: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
                for at, x in enumerate(self._shingles(words)):
                    for key in self.where.get(x, ()):
                        hits.setdefault(key, []).append((at, x))
                for (k, t), found in hits.items():
                    out += self._together(lines, of, found, k, len(self.templates[k][t]))
            words, of = [], []
        return out

    def _together(self, lines: list[bytes], of: list[int], found: list[tuple[int, bytes]], k: int, size: int) -> list[tuple[int, int, str, float]]:
        """Spans of lines whose hits of one template confirm it."""
        out, seen, first, last = [], {}, 0, 0
        while last < len(found):
            seen[found[last][1]] = seen.get(found[last][1], 0) + 1
            last += 1
            if len(seen) < self.confirm * size:
                continue
            while seen[found[first][1]] > 1:
                seen[found[first][1]] -= 1
                first += 1
            if found[last - 1][0] - found[first][0] > 2 * size + 10:  # too far apart to be one sentence
                del seen[found[first][1]]
                first += 1
                continue
            while last < len(found) and found[last][1] not in seen and found[last][0] - found[last - 1][0] <= 10:
                seen[found[last][1]] = 1
                last += 1
            a, b = of[found[first][0]], of[min(found[last - 1][0] + 2, len(of) - 1)]
            if a != b and (j := self.judge(b" ".join(lines[a : b + 1]), gated=False)) and j[0] == self.names[k]:
                out.append((a, b, *j))
            seen, first = {}, last
        return out

    def scan(self, text: bytes) -> list[tuple[int, str, float]]:
        """(number of the first line, family, probability) of every licence paragraph: a line, or adjacent ones that are a wrapped notice."""
        if self.gate.isdisjoint(words_of(text)):
            return []
        lines = text.split(b"\n")
        found = [(i, i, *j) for i, p in enumerate(lines) if (j := self.judge(p))]
        spans: list[tuple[int, int, str, float]] = []
        for a, b, name, p in sorted(self._wrapped(lines)) if len(lines) > 1 else []:
            if any(x == y == i and n == name for x, y, n, _ in found for i in range(a, b + 1)):
                continue  # one of the lines says so by itself
            same = next((s for s in spans if s[2] == name and a <= s[1]), None)
            if same:
                spans.remove(same)
                a, b, p = same[0], max(b, same[1]), max(p, same[3])
            spans.append((a, b, name, p))
        # of families that share lines the surest is told
        spans = [s for s in spans if not any(t[2] != s[2] and t[0] <= s[1] and s[0] <= t[1] and t[3] > s[3] for t in spans)]
        # pieces that say nothing by themselves belong to the notice of their block: the lines about them up to one without words
        block, at = [], 0
        for line in lines:
            at += not words_of(line)
            block.append(at)
        named = {block[a] for a, _, n, _ in [*found, *spans] if n != "unknown"}
        found = [f for f in found if f[2] != "unknown" or block[f[0]] not in named]
        return [(i, n, p) for i, _, n, p in sorted(found + spans)]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 200, lines: int = 50, longest: int = 2000, **options) -> Model:
    """A model whose counter-examples are lines of at most `sample` documents, the smallest by a hash of id and text.

    Of each document at most `lines` lines of up to `longest` characters come to the driver, which bounds their bytes.
    Null texts give none; with an empty table the model has its own examples only.
    """
    text = F.col(text_col).cast("string")
    rows = docs.where(text.isNotNull()).select(F.xxhash64(F.col(id_col).cast("string"), text).alias("h"), text.alias("t"))
    # of all rows only hashes are compared; the lines that come to the driver are the sample's
    least = [r.h for r in rows.select("h").orderBy("h").limit(sample).collect()]
    few = F.slice(F.filter(F.split("t", "\n", -1), lambda x: F.length(x).between(1, longest)), 1, lines)
    chosen = rows.where(F.col("h") <= least[-1]).select("h", few.alias("few")).distinct().orderBy("h", "few").limit(sample).collect() if least else []
    return Model([p for r in chosen for p in r.few], **options)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, **options) -> DataFrame:
    """One row per document: id, n_paragraphs, licenses, paragraphs, score.

    n_paragraphs counts licence paragraphs; licenses are their distinct families, comma-joined, `unknown` where a
    notice looks like a licence but is unsure or matches no template of its family; paragraphs has number:family of
    each; score is the best calibrated probability, 0 without any. A null or empty text has none. Whole texts are
    scanned; repeated rows are told one by one; an empty table gives no rows.
    """
    model = model or train(docs, id_col, text_col, **options)
    plain = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    out = schema(*kept_fields(plain, [id_col]), ("n_paragraphs", T.LongType()), ("licenses", T.StringType()), ("paragraphs", T.StringType()), ("score", T.DoubleType()))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the templates and most_grams

    def run(batches):
        model = shared.value
        for b in batches:
            found = [model.scan(t or b"") for t in b.column("_text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([",".join(sorted({f for _, f, _ in x})) for x in found], pa.string()),
                    pa.array([",".join(f"{i}:{f}" for i, f, _ in x) for x in found], pa.string()), pa.array([max([0.0, *[s for *_, s in x]]) for x in found], pa.float64()),
                ],
                out.names,
            )

    return plain.mapInArrow(run, out)
