import random

from pyspark.sql import types as T

from tessella.llm.licenses import DECOYS, TEMPLATES, license_scan, train

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("score", T.StringType()))])
NOTICES = {
    "Portions are Licensed under the Apache License, Version 2.0.": "apache-2.0", "  released UNDER the mit license!": "mit", "All rights reserved.": "proprietary",
    "© 2021 Somebody. All rights reserved.": "proprietary", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: see below": "bsd",
}


def test_scan(spark):
    rng = random.Random(8)
    words = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam the of and under work this".split()
    prose = lambda: " ".join(rng.choice(words) for _ in range(30))
    rows, want = [], {}
    for i in range(60):
        lines = [prose() for _ in range(4)]
        if i % 4 == 0:
            notice = list(NOTICES)[(i // 4) % len(NOTICES)]
            lines.insert(2, notice)
            want[i] = (1, NOTICES[notice], f"2:{NOTICES[notice]}")
        rows.append((i, "\n".join(lines), "x"))
    rows += [(100 + i, d, "x") for i, d in enumerate(DECOYS)] + [(200, None, None), (201, "", "x"), (None, "All rights reserved.", "x"), (3, rows[3][1], "x"), (202, prose() * 3000, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    model = train(docs)
    got = license_scan(docs, model=model).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.licenses == "proprietary" and r.score > 0.5
        else:
            assert (r.n_paragraphs, r.licenses, r.paragraphs) == want.get(r.doc_id, (0, "", "")), r
            assert (r.score > 0.5) == (r.doc_id in want)
    # the gate skips paragraphs, and only those that are `other` anyway
    parts = [p for _, t, _ in rows for p in (t or "").split("\n")] + [p[: len(p) * k // 5] for n in TEMPLATES.values() for p in n for k in range(6)]
    assert all(model.judge(p.encode()) == model.judge(p.encode(), gated=False) for p in parts)
    # what looks like a notice but matches no template is not told as a known licence
    assert model.judge(b"licensed under apache license mit license version") in (None, ("unknown", model.judge(b"licensed under apache license mit license version")[1]))
    assert license_scan(spark.createDataFrame([], DOCS)).collect() == []


WRAPPED = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.""",
    "bsd": """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions
# are met:""",
    "gpl": """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
}


def test_wrapped_headers(spark):
    prose = "lorem ipsum dolor sit amet\nconsetetur sadipscing elitr sed diam"
    starts = {"mit": ("3", "10"), "bsd": ("3",), "gpl": ("3",), "apache-2.0": ("3", "9")}
    rows = [(i, f"{prose}\n\n{t}\n\n{prose}", None) for i, t in enumerate(WRAPPED.values())]
    rows += [(9, WRAPPED["gpl"].replace("\n", "\n\n"), None), (10, prose, None)]  # blank lines are no wrapping
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, DOCS)).collect()}
    for i, name in enumerate(WRAPPED):
        told = got[i].paragraphs.split(",")
        assert {f"{n}:{name}" for n in starts[name]} <= set(told) and set(got[i].licenses.split(",")) <= {name, "unknown"}, got[i]
    assert "gpl" not in got[9].licenses and got[10].licenses == ""


#: Notices that are in no template: other wraps, comment marks, names and surrounding words.
HELD_OUT = [
    ("mit", "Copyright (c) 2019 Ann Other\n\nPermission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and\nassociated documentation files (the \"Software\"), to\ndeal in the Software without restriction, including\nwithout limitation the rights to use it"),
    ("mit", "// The above copyright notice and this permission notice shall be\n// included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet:"),
    ("bsd", "1. Redistributions of source code must retain the above copyright notice,\n   this list of conditions and the following disclaimer."),
    ("bsd", "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission."),
    ("zlib", "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software."),
    ("boost", "// Distributed under the Boost Software License, Version 1.0. (See accompanying file)"),
    ("gpl", "This file is part of Thing. This program is free software: you can\nredistribute it and/or modify it under the terms of the GNU General\nPublic License as published by the Free Software Foundation, either\nversion 3 of the License, or (at your option) any later version."),
    ("gpl", "# You should have received a copy of the GNU General Public License\n# along with this program.  If not, see <https://www.gnu.org/licenses/>."),
    ("gpl-2.0", "/* This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation; either version 2 of the License, or\n * (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published\nby the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License"),
    ("mpl-2.0", "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not distributed with this\n# file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("epl", "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/"),
    ("apache-2.0", "   Licensed under the Apache License, Version 2.0 (the \"License\");\n   you may not use this file except in compliance with the License."),
    ("apache-2.0", "# See the License for the specific language governing permissions and\n# limitations under the License."),
    ("cc-by", "The pictures in this work are licensed under a Creative Commons Attribution\n4.0 International License. This work is licensed under a Creative Commons\nAttribution 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial\n4.0 International License."),
    ("cc-by-nd", "This work is licensed under a Creative Commons\nAttribution-NoDerivatives 4.0 International License."),
    ("public-domain", "This is free and unencumbered software released into\nthe public domain."),
    ("public-domain", "// SPDX-License-Identifier: CC0-1.0"),
    ("proprietary", "No part of this publication may be reproduced, distributed or\ntransmitted in any form without the prior written permission of the\npublisher."),
]


def test_held_out_recall_and_calibration(spark):
    prose = "the mill stood by the river and nobody had asked for it\nthe weather was fine that day"
    model = train(spark.createDataFrame([(i, prose, None) for i in range(5)], DOCS))
    told = [model.scan(f"{prose}\n\n{t}\n\n{prose}".encode()) for _, t in HELD_OUT]
    hit = [any(n == name for _, n, _ in found) for (name, _), found in zip(HELD_OUT, told, strict=True)]
    assert sum(hit) >= 0.9 * len(hit), [h for h, ok in zip(HELD_OUT, hit, strict=True) if not ok]
    assert not [x for (name, _), found in zip(HELD_OUT, told, strict=True) for x in found if x[1] not in (name, "unknown")]
    # probabilities of what is told lie near the share that is right
    p = [x[2] for found in told for x in found]
    assert abs(sum(p) / len(p) - sum(hit) / len(hit)) < 0.2
    assert model.scan(prose.encode()) == []


def test_confirmation_against_brute_force(spark):
    """A family is told for a block exactly where one of its templates has four fifths of its shingles close together there."""
    prose = "the mill stood by the river and nobody had asked for it"
    model = train(spark.createDataFrame([(1, prose, None)], DOCS))
    fold = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split()
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
    rng = random.Random(4)
    for name, notices in TEMPLATES.items():
        for notice in notices:
            words = notice.split()
            for drop in (0, 1, len(words) // 3):
                kept = list(words)
                for _ in range(drop):
                    kept.pop(rng.randrange(len(kept)))
                text = f"{prose}\n\n{' '.join(kept)}\n\n{prose}"
                found = {n for _, n, _ in model.scan(text.encode())} - {"unknown"}
                confirmed = {f for f, ts in TEMPLATES.items() if any(len(grams(fold(t)) & grams(fold(" ".join(kept)))) >= 0.8 * len(grams(fold(t))) for t in ts)}
                assert found <= confirmed, (name, kept, found, confirmed)
                if drop == 0:
                    assert name in found, (name, notice, model.scan(text.encode()))
