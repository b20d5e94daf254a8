"""Licence names of notices as files bear them, the cosine, passages, files and odd rows."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldcast.llm import licenses
from fieldcast.llm.license_texts import templates

MATCHER = licenses.Matcher(templates(), licenses.THRESHOLD)

GNU = """This {what} is free software{stop} you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation{comma} either version {version} of the License, or
(at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {kind}General Public License for more details."""
BSD = """Copyright (c) 2019, The Authors
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.
2. Redistributions in binary form must reproduce the above copyright notice.
"""
APACHE = """Copyright 2020 The Authors

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""


def gnu(what, kind, version, new):
    return GNU.format(what=what, kind=kind, version=version, stop=":" if new else ";", comma="," if new else ";")


def hashed(text):
    return "\n".join(("# " + x).rstrip() for x in text.split("\n"))


def starred(text):
    return "/*\n" + "\n".join((" * " + x).rstrip() for x in text.split("\n")) + "\n */"


HEADERS = [
    ("GPL-2.0", gnu("program", "", "2", False)),
    ("GPL-2.0", starred(gnu("program", "", "2", False)) + "\nint main(void) {\n  return a * b;\n}\n"),
    ("GPL-3.0", gnu("program", "", "3", True)),
    ("GPL-3.0", hashed(gnu("program", "", "3", True)) + "\nimport os\nimport sys\nx = os.path.join(sys.path[0], 'a')\n"),
    ("LGPL-2.1", starred(gnu("library", "Lesser ", "2.1", False))),
    ("LGPL-3.0", gnu("library", "Lesser ", "3", True)),
    ("AGPL-3.0", hashed(gnu("program", "Affero ", "3", True))),
    ("Apache-2.0", APACHE),
    ("Apache-2.0", starred(APACHE) + "\npackage a.b;\nclass C { int x = 3; }"),
    ("BSD-2-Clause", BSD),
    ("BSD-3-Clause", BSD + "3. Neither the name of the copyright holder nor the names of its contributors\nmay be used to endorse or promote products derived from this software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell"),
    ("MIT", "MIT License\n\nCopyright (c) 2021 Someone"),
    ("MIT", "// Use of this source code is governed by an MIT license.\n// Licensed under the MIT License.\nfunc main() {}"),
    ("MPL-2.0", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-3.0", "Licensed under CC BY-NC-SA 3.0."),
    ("CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0\nx = 1"),
    ("GPL-2.0", "// SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "/* SPDX-License-Identifier: LGPL-3.0-or-later */"),
    ("BSD-3-Clause", "-- SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/"),
    ("BSL-1.0", "// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no\nevent will the authors be held liable for any damages arising from the use of this software."),
    ("GPL-3.0", "The code is good. Released under the GPLv3. Have fun with it and the rest."),
]


@pytest.mark.parametrize("name,text", HEADERS)
def test_headers(name, text):
    assert MATCHER.scan(text)[0] == name


@pytest.mark.parametrize(
    "text",
    [
        "This work is licensed under the GNU General Public License, version 1.",
        "Licensed under the Apache License, Version 1.1.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 2.5 License.",
        "mit", "Mit der Zeit.", "MIT", "the license of the house", "the version of the public is free to use and to modify the copy",
        "under the general terms of public work", "", "Sie kam mit dem Zug under the bridge",
    ],
)
def test_no_licence(text):
    assert MATCHER.scan(text) == (None, 0.0, 0.0, False)


def test_every_template_names_its_licence():
    for t in templates():
        words = licenses.tokens(t.text)
        got = MATCHER.best(words, {*words, *t.needs})
        assert got and got.name == t.name, t
        assert got.cosine <= 1 + 1e-9


def plain_cosine(words, template):
    bags = [Counter(licenses.tokens(t.text)) for t in MATCHER.templates]
    df = Counter(w for b in bags for w in b)
    idf = lambda w: math.log((1 + len(bags)) / (1 + df[w])) + 1 if w in df else licenses.UNSEEN
    vector = lambda bag: {w: (1 + math.log(n)) * idf(w) for w, n in bag.items()}
    a, b = vector(Counter(words)), vector(template)
    return sum(x * b.get(w, 0) for w, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))


def test_cosines_against_brute_force():
    rng = random.Random(2)
    every = [licenses.tokens(t.text) for t in MATCHER.templates]
    for _ in range(60):
        words = [w for w in rng.choice(every) if rng.random() < 0.8] + rng.choices(["alpha", "the", "of", "2"], k=rng.randint(0, 3))
        got = MATCHER.cosines(words)
        for k, bag in enumerate(every):
            want = plain_cosine(words, Counter(bag)) if words else 0.0
            if k in got:
                assert got[k] == pytest.approx(want)
            elif len(set(words) & set(bag)) >= licenses.MIN_SHARED:
                assert want < licenses.THRESHOLD


def test_paragraphs():
    text = "# one\n# two\n#\n# three\ncode()\n\n\n/* a\n * b */\nx"
    assert list(licenses.paragraphs(text)) == [["one", "two"], ["three"], ["code()"], ["a", "b"], ["x"]]


def test_files_and_inheritance(spark):
    gpl = dict(HEADERS[28:29])["GPL-3.0"] + "\n" + "The terms go on for a long time and no word of it is in a template. " * 400
    rows = [
        (1, gpl, "p/LICENSE"),
        (2, "no notice", "p/q/r/x"),
        (3, "Licensed under the MIT License.", "p/q/COPYING"),
        (4, "text " * 300 + "\nLicensed under CC BY 4.0.\n" + "text " * 300, "p/y"),
        (4, "text " * 300 + "\nLicensed under CC BY 4.0.\n" + "text " * 300, "p/y"),
        (None, None, "p/z"),
        (7, "", "r"),
        (8, "x", None),
        (9, "Released under the MIT License.", "s/B"),
        (10, "Released under the ISC License.", "s/A"),
        (11, "", "s/t/u"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, path string").withColumns({c: F.lit("v") for c in ("id", "own", "share", "title", "dir", "is_file", "t")})
    got = sorted(((r["doc_id"] or 0), r["license"], r["origin"], r["license_dir"]) for r in licenses.scan(df).collect())
    assert got == [
        (0, "GPL-3.0", "inherited", "p"), (1, "GPL-3.0", "file", None), (2, "MIT", "inherited", "p/q"), (3, "MIT", "file", None),
        (4, "CC-BY-4.0", "header", None), (4, "CC-BY-4.0", "header", None), (7, None, None, None), (8, None, None, None),
        (9, "MIT", "file", None), (10, "ISC", "file", None), (11, "ISC", "inherited", "s"),
    ]
    assert licenses.scan(df.limit(0)).count() == 0


def test_long_text():
    text = ("word " * 30 + "\n") * 20_000 + "\n" + "Licensed under the Apache License, Version 2.0.\n" + "mit " * 200_000
    assert MATCHER.scan(text)[0] == "Apache-2.0"


GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
ENDORSE = "4. Neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software."


@pytest.mark.parametrize(
    "text, want",
    [
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library\nGeneral Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "LGPL-2.0"),
        ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "GPL-2.0"),
        (f"{BSD}\n3. All advertising materials mentioning features or use of this software must display an acknowledgement.\n{ENDORSE}", "BSD-4-Clause"),
        (f"{BSD}\n{ENDORSE}", "BSD-3-Clause"),
        (GRANT + ".\n\nTHE SOFTWARE IS PROVIDED AS IS.", "MIT-0"),
        (GRANT + ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "MIT"),
        ("This file is not licensed under the MIT License.", None),
        ("It is no longer released under the Apache License, Version 2.0.", None),
        ("Released under the MIT License.", "MIT"),
        ("// SPDX-License-Identifier: MIT OR Apache-2.0", "MIT OR Apache-2.0"),
        ("/* SPDX-License-Identifier: (GPL-2.0-only OR BSD-3-Clause) */\nint x;", "GPL-2.0 OR BSD-3-Clause"),
        ("# SPDX-License-Identifier: GPL-2.0-or-later AND (MIT OR ISC)", "GPL-2.0 AND (MIT OR ISC)"),
        ("# SPDX-License-Identifier: MIT OR Elastic-9.9", "MIT"),
        ("The GNU General Public License is a free, copyleft license for software and other kinds of works.\n\nThe licenses for most software are designed to take away your freedom.", "GPL-3.0"),
        ('"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.', "Apache-2.0"),
    ],
)
def test_variants_have_their_own_names(text, want):
    assert licenses.Matcher(licenses.templates(), licenses.THRESHOLD).scan(text)[0] == want
