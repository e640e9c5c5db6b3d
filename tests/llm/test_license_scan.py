import re
from collections import Counter
from math import log, sqrt

import pytest

from voxelgrove.llm.license_match import OTHER
from voxelgrove.llm.license_scan import ACCEPT, MARGIN, document_paths, op3_license_scan, scan_licenses
from voxelgrove.llm.license_texts import NEGATIONS, TELLING, TEMPLATES


def test_inheritance(spark):
    files = [
        ("a/LICENSE", "Released under the MIT License."),
        ("a/x.txt", "nothing here"),
        ("a/b/c/y.txt", "nothing here"),
        ("a/b/c/z.txt", "some code\n// Licensed under the Apache License, Version 2.0.\nmore code"),
        ("a/b/d/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
        ("a/b/d/w.txt", None),
        ("ab/v.txt", "the licence of this text is not given"),
        ("top.txt", ""),
        (None, "Licensed under CC BY-NC 4.0."),
        (None, "no path"),
    ]
    got = {(r.path, r.text_is): r for r in scan_licenses(spark.createDataFrame([(p, t, str(t)[:8]) for p, t in files], "path string, text string, text_is string")).collect()}
    find = lambda p: next(r for (q, _), r in got.items() if q == p)
    assert (find("a/LICENSE").license, find("a/LICENSE").inherited_from) == ("MIT", None)
    assert (find("a/x.txt").license, find("a/x.txt").inherited_from) == ("MIT", "a")
    assert (find("a/b/c/y.txt").license, find("a/b/c/y.txt").inherited_from) == ("MIT", "a")
    assert (find("a/b/c/z.txt").license, find("a/b/c/z.txt").inherited_from) == ("Apache-2.0", None)
    assert (find("a/b/d/w.txt").license, find("a/b/d/w.txt").inherited_from) == ("GPL-3.0", "a/b/d")
    assert find("ab/v.txt").license is None and find("top.txt").license is None
    assert got[None, "Licensed"].license == "CC-BY-NC-4.0" and got[None, "no path"].license is None


def whole(name, k):
    return TEMPLATES[name].split("|")[k]


FOUR = whole("BSD-4-Clause", 2).replace("organization", "University and others").replace("copyright holder", "University")
NOTICES = [
    ("BSD-4-Clause", "Copyright (c) 1990 The Regents of the University.\n\n"+FOUR+". THIS SOFTWARE IS PROVIDED BY THE REGENTS AS IS"),
    ("GPL-2.0", "This program is distributed under the GPL version 2."),
    ("GPL-2.0", "This file is licensed under the GPL version 2"),
    ("GPL-2.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("Apache-1.1", "This work is licensed under the Apache Software License, Version 1.1."),
    ("Apache-1.1", "/* The Apache Software License, Version 1.1\n * Copyright (c) 2000 The Apache Software Foundation. All rights reserved. */"),
    ("CC-BY-3.0", "Text licensed under CC BY 3.0."),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("CC-BY-SA-3.0", "Licensed under CC BY-SA 3.0"),
    ("CC-BY-SA-2.5", "Licensed under CC BY-SA 2.5"),
    (None, "Licensed under CC BY 1.7"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy"),
    ("Artistic-1.0", "Licensed under the Artistic License, Version 1.0"),
    (None, "Licensed under the Artistic License, Version 3.0"),
    ("EUPL-1.1", "Licensed under the EUPL, Version 1.1 only"),
    (None, "Licensed under the EUPL, Version 1.0"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE\n Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE\n Version 2.1, February 1999"),
    ("LGPL-2.0", whole("LGPL-2.0",2)),
    ("GPL-1.0", whole("GPL-1.0",2)),
    ("AGPL-1.0", "Licensed under the Affero General Public License, version 1"),
    (None, "This program is free software: GNU Affero General Public License Version 4"),
    ("CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License, Version 1.0 only"),
    (None, "The contents of this file are subject to the terms of the Common Development and Distribution License, Version 1.3 only"),
    (None, "This code is incompatible with anything released under the MIT License."),
    (None, "This file is not, and never was, released under the MIT License."),
    (None, "It is no longer released under the MIT License"),
    (None, "No part of this program, in source or any other form, is licensed under the MIT License"),
    (None, "Nothing in this folder is licensed under the Apache License, Version 2.0."),
    (None, "This file isn't licensed under the MIT License"),
    (None, "We don't offer it as code licensed under the Apache License, Version 2.0"),
    (None, "Formerly released under the MIT License."),
    (None, "// This file is not\n// licensed under the MIT License"),
    ("MIT", "It is not under the GPL, but licensed under the MIT License"),
    ("MIT", "There is no warranty: this is licensed under the MIT License"),
    ("MIT", "With no warranty, released under the MIT License"),
    ("MIT", "It was not made by us. Licensed under the MIT License."),
    ("MIT", "DO NOT EDIT\nLicensed under the MIT License"),
    ("MIT", "This file is not licensed under the MIT License.\n\nThe other one is licensed under the MIT License."),
    ("MIT", "Distributed under the MIT License; see the file LICENSE"),
    ("MIT", "All code is available under the terms of the MIT license."),
    ("MIT", "This package is MIT licensed."),
    ("MIT", "License: MIT"),
    ("Apache-2.0", "  \"license\": \"Apache-2.0\","),
    ("MIT OR Apache-2.0", "license = \"MIT OR Apache-2.0\"\nname = \"x\""),
    (None, "License: see the file of that name"),
    (None, "die Lizenz mit der das Werk"),
    ("MIT OR Apache-2.0", "// SPDX-License-Identifier: MIT OR Apache-2.0"),
    ("(GPL-2.0-only WITH Linux-syscall-note) AND MIT", "/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) AND MIT */"),
    ("LicenseRef-Acme-1", "# SPDX-License-Identifier: LicenseRef-Acme-1\n# Licensed under the MIT License"),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-2.0+", "SPDX-License-Identifier: gpl-2.0+"),
    ("MIT", "SPDX-License-Identifier: MIT and more"),
    (None, "SPDX-License-Identifier: MIT AND Unheard-Of"),
    ("MIT", "SPDX-License-Identifier: unheard-of\nSPDX-License-Identifier: MIT"),
    ("(MIT OR ISC) AND (Zlib OR BSL-1.0)", "<!-- SPDX-License-Identifier: (MIT OR ISC) AND (Zlib OR BSL-1.0) -->"),
    (None, "SPDX-License-Identifier: (MIT OR ISC"),
    ("MIT AND LicenseRef-x", "SPDX-License-Identifier: MIT AND LicenseRef-x."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 by Example Corp"),
    ("Apache-2.0", "Licensed under the project Apache License, Version 2.0"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0"),
    ("BSD-3-Clause", whole("BSD-3-Clause",2).replace("the copyright holder nor","Example Corp nor")),
    ("MIT", whole("MIT",6)+". THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND"),
    ("ISC", "Copyright 2020 A\n\n" + whole("ISC", 1) + ".\n\nTHE SOFTWARE IS PROVIDED AS IS"),
    ("0BSD", whole("0BSD",0)),
    # Notices that stood in the table before.
    ("MIT", "MIT License\n\nCopyright (c) 2024 Jane Doe\n\n" + whole("MIT", 7) + ".\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."),
    ("ISC", "// SPDX-License-Identifier: ISC"),
    ("Unlicense", "# SPDX-License-Identifier: Unlicense\nimport os"),
    ("(GPL-3.0-or-later OR MIT)", "spdx-license-identifier: (gpl-3.0-or-later OR MIT)"),
    ("MPL-1.1", "SPDX-License-Identifier: MPL-1.1\nLicensed under the MIT License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-2-Clause", "Copyright 2020 A. All rights reserved.\n\n" + whole("BSD-2-Clause", 2)),
    ("BSD-3-Clause", "Copyright 2020 A. All rights reserved.\n\n" + whole("BSD-3-Clause", 2)),
    ("LGPL-2.1", whole("LGPL-2.1", 2)),
    ("LGPL-3.0", whole("LGPL-3.0", 2)),
    ("AGPL-3.0", whole("AGPL-3.0", 2)),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "All text here is licensed under CC BY 4.0, thank you"),
    ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n\n   TERMS AND CONDITIONS FOR USE"),
    (None, "SPDX-License-Identifier: unheard-of"),
    (None, "The licence of this work is a matter of the courts, and the software is provided to all."),
    # Of two that are alike in score, the first.
    ("MIT", "Licensed under the MIT License, or at your choice\n(other words in between)\nLicensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0\n(other words in between)\nLicensed under the MIT License"),
]


@pytest.mark.parametrize("others", [24, 3_000])
def test_notices_tags_and_whole_texts(spark, others):
    """The same verdicts beside few and many other files, whether or not they hold the notices' words."""
    half = "Version {0} of the work is given to any person under the terms of a license, for use by the author {0}."
    files = [(f"c/{k}.txt", text) for k, (_, text) in enumerate(NOTICES)]
    plain = [(f"p/{k}", half.format(k) if k % 2 else "the advertising apache of version 2 0") for k in range(others)]
    got = {r.path: r.own_license for r in scan_licenses(spark.createDataFrame(files + plain, "path string, text string")).collect()}
    assert [(got[f"c/{k}.txt"], text) for k, (_, text) in enumerate(NOTICES)] == NOTICES
    assert {got[p] for p, _ in plain} == {None}


def test_words_inside_a_notice(spark):
    files = [(f"d/{k}", text) for k, text in enumerate(["Licensed under the project Apache License, Version 2.0", "code\n# Licensed under the Apache License, Version 2.0 by Example Corp\nmore", "mit mit mit unter dem mit"])]
    inside, beside, none = sorted(scan_licenses(spark.createDataFrame(files, "path string, text string")).collect(), key=lambda r: r.path)
    assert inside.own_license == beside.own_license == "Apache-2.0" and ACCEPT < inside.score < 1 and beside.score == 1.0
    assert (none.own_license, none.score) == (None, 0.0)


MONTH = "January|February|March|April|May|June|July|August|September|October|November|December"


def numbers(t):
    return {re.sub(r"(\.0+)+$", "", v) for v in re.findall(rf"(?<![a-z0-9.])v?([0-9]{{1,2}}(?:\.[0-9]{{1,2}})*)(?![a-z0-9]|\.[0-9])(?!\s+(?:{MONTH}))", t, re.I)}


def brute(texts):
    """own_license and score of texts by cosines of every stretch and the stated tests, in plain Python."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    split = lambda t: word.findall(lower(t))
    templates = [(name, v, split(v)) for name, vs in TEMPLATES.items() for v in vs.split("|")]
    df = Counter(w for _, _, t in templates for w in set(t))
    weight = lambda w: log((len(templates) + 1) / (df[w] + 1)) + 1 if w in df else OTHER
    vector = lambda ws: {w: n * weight(w) for w, n in Counter(ws).items()}
    told = lambda ws: {t for t in TELLING if f" {t} " in f" {' '.join(ws)} "}
    out = []
    for text in texts:
        spans = [m.span() for m in word.finditer(lower(text))]
        ws, best = split(text), {}
        for name, notice, t in templates:
            v, m = vector(t), len(t)
            norm = sqrt(sum(x * x for x in v.values()))
            for a in range(max(1, len(ws) - m + 1)):
                b = min(len(ws), a + m)
                part = ws[a:b]
                if 2 * len(part) < m or 2 * len(set(part) & set(t)) < len(set(t)):
                    continue
                s = vector(part)
                score = round(sum(x * v.get(w, 0) for w, x in s.items()) / norm / sqrt(sum(x * x for x in s.values())), 12)
                end = spans[b - 1][1]
                stretch = text[spans[a][0] : end] + re.match(r"(\.[0-9]+)*", text[end:])[0]
                if score < (ACCEPT if m >= 5 else 1 - 1e-9) or not numbers(notice) <= numbers(stretch) or told(part) != told(t):
                    continue
                own, after = re.search(r"-([0-9.]+)", name), text[spans[a][0] :]
                after = after[: spans[b + 7][1] - spans[a][0] + 4] if b + 7 < len(ws) else after
                named = re.search(r"licen[cs]e\W+(?:\(\w+\)\W+)?(?:version|v)\W*([0-9]+(?:\.[0-9]+)*)", after, re.I)
                if own and not numbers(notice) and named and not numbers(named[1]) <= numbers(own[1]):
                    continue
                if (-score, a) < best.get(name, (0, 0))[:2]:
                    best[name] = (-score, a, name, b)
        found = sorted(best.values())
        if not found:
            out.append((None, 0.0))
            continue
        s, a, name, b = found[0]
        second = max([-x[0] for x in found[1:] if x[1] < b and x[3] > a], default=0.0)
        out.append((name if -s - second >= MARGIN else None, -s))
    return out


def test_same_as_brute_force(spark, sf):
    negated = re.compile(r"\b(%s)\b" % "|".join(NEGATIONS), re.I)
    files = [(r.path, r.text) for r in document_paths(spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 1200")).collect()]
    files += [(f"x/{k}", f"words by me {t} and more words") for k, (_, t) in enumerate(NOTICES)]
    # Negations and tags have tests of their own.
    files = [(p, t) for p, t in files if not negated.search(t) and not re.search("identifier|license\"? *[:=]", t, re.I)]
    got = {r.path: r for r in scan_licenses(spark.createDataFrame(files, "path string, text string")).collect()}
    for (path, text), (name, score) in zip(files, brute([t for _, t in files]), strict=True):
        r = got[path]
        assert r.own_license == name and abs(r.score - score) < 1e-9, (path, r, name, score, text[:200])
    assert sum(r.own_license is not None for r in got.values()) > 30


def test_inheritance_against_brute_force(spark, sf):
    rows = op3_license_scan(spark, sf).collect()
    notices = {}
    for r in rows:
        folder, _, name = r.path.rpartition("/")
        if name == "LICENSE" and r.own_license:
            notices[folder] = min(notices.get(folder, (-r.score, r.own_license)), (-r.score, r.own_license))
    for r in rows:
        want = (r.own_license, None)
        if r.own_license is None:
            parts = r.path.split("/")[:-1]
            above = next((d for d in ("/".join(parts[:k]) for k in range(len(parts), -1, -1)) if d in notices), None)
            want = (notices[above][1], above) if above is not None else (None, None)
        assert (r.license, r.inherited_from) == want


def test_each_template_is_found_by_itself_and_inside_a_text(spark):
    notices = [(name, v) for name, variants in TEMPLATES.items() for v in variants.split("|")]
    broken = [(name, "Some words before.\n\n# " + v.replace(" ", "\n# ", 3) + "\n\nThe rest of the text.\n" * 30) for name, v in notices]
    files = [(f"{k}/{name}", text) for k, (name, text) in enumerate(notices + broken)]
    plain = [(f"none/{k}", f"Nothing is granted to any person here, {k}.") for k in range(50)]
    got = {r.path: r.own_license for r in scan_licenses(spark.createDataFrame(files + plain, "path string, text string")).collect()}
    assert got == {p: p.split("/")[1] for p, _ in files} | {p: None for p, _ in plain}
