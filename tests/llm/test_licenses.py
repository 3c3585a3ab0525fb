import random

from tidemill.llm import licenses

CASES = [
    ("Released under the MIT License.", ["MIT"]), ("LICENSED UNDER THE APACHE LICENSE, VERSION 2.0.", ["Apache-2.0"]),
    ("Text first.\nThis work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]), ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]),
    ("He holds a driving licence and a copyright on songs.", []), (None, []), ("", []), ("licence " * 2000, []), ("é" * 3000 + "\nReleased under the MIT License.\n" + "ü" * 500, ["MIT"]),
    ("Released under the MIT License.\n\nfoo\n\nLicensed under CC BY-SA 4.0.", ["MIT", "CC-BY-SA-4.0"]),
]


def test_statements():
    for text, want in CASES:
        found = licenses.statements(text)
        assert [f["license"] for f in found] == want, text
        for f in found:
            assert "icens" in text[f["start"] : f["end"]].lower()


def test_compression_ranks_and_wording_decides():
    for i, (name, template, _) in enumerate(licenses.TEMPLATES):
        first = [n for _, n in licenses.ranked(template)]
        assert name in {licenses.TEMPLATES[n][0] for n in first[:3]} and i in first, template
        assert licenses.differences(template, i) == (0.0, 0.0, True)
        assert licenses.statements(template.upper())[0]["license"] == name


def test_scan(spark):
    rows = [(i, t, 1) for i, (t, _) in enumerate(CASES)] + [(0, CASES[0][0], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = sorted((r.doc_id, r.license) for r in licenses.scan(df).collect())
    assert got == sorted((i, x) for i, t, _ in rows for x in dict(CASES)[t])
    assert licenses.scan(df.limit(0)).count() == 0


def test_words_around_a_statement_do_not_hide_it():
    tail = " and more words of plain prose go on here without any end, line after line, on the same line as it"
    for n in (0, 20, 40, 60, 97):
        for text in ("Released under the MIT License." + tail[:n], tail[:n] + " released under the mit license\n" + tail + "\n" + tail):
            found = licenses.statements(text)
            assert [f["license"] for f in found] == ["MIT"], text
            assert text[found[0]["start"] : found[0]["end"]].lower() == "released under the mit license"
    assert [f["license"] for f in licenses.statements("This Source Code Form is subject to the terms of\nthe Mozilla Public\n# License, v. 2.0" + tail)] == ["MPL-2.0"]


def test_all_licences_of_a_text():
    text = "Released under the MIT License, and the data are licensed under CC BY-SA 4.0; the rest is licensed under the Apache License, Version 2.0 or so"
    assert [f["license"] for f in licenses.statements(text)] == ["MIT", "CC-BY-SA-4.0", "Apache-2.0"]
    for name, wording in (("AGPL-3.0", "gnu affero general"), ("LGPL-3.0", "gnu lesser general"), ("GPL-3.0", "gnu general")):
        assert [f["license"] for f in licenses.statements(f"This work is licensed under the {wording} public license, version 3")] == [name]


def test_spdx():
    ids = lambda t: [f["license"] for f in licenses.statements(t)]
    assert ids("// SPDX-License-Identifier: MIT\nint x;") == ["MIT"]
    assert ids("# SPDX-License-Identifier: (GPL-2.0+ OR Apache-2.0) AND CC0-1.0") == ["GPL-2.0-or-later", "Apache-2.0", "CC0-1.0"]
    assert ids("SPDX-License-Identifier: Nothing-1.0") == []


# Headers and licences as files state them, under names, comment marks and line breaks of their own.
TEXTS = {
    "Apache-2.0": """/*
 * Copyright 2019 The Some Authors
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */""",
    "ISC": "Copyright (c) 2020, Someone\n\n" + next(t for n, t, _ in licenses.TEMPLATES if n == "ISC" and len(t) > 200).replace(". ", ".\n").upper(),
    "BSD-2-Clause": "Copyright (c) 2011, Some Body\n\n" + next(t for n, t, _ in licenses.TEMPLATES if n == "BSD-2-Clause" and len(t) > 200).replace(" 1. ", "\n\n   1. ").replace(" 2. ", "\n   2. "),
    "BSD-3-Clause": "Copyright (c) 2011, Some Body\n\n" + next(t for n, t, _ in licenses.TEMPLATES if n == "BSD-3-Clause" and len(t) > 200).replace("copyright holder nor", "Some Body University nor").replace(" 1. ", "\n * ").replace(" 2. ", "\n * "),
    "EPL-2.0": "// This program and the accompanying materials are made\n// available under the terms of the Eclipse Public License 2.0\n// which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.",
    "MIT": "The MIT License\n\nCopyright (c) 2001 A B\n\n" + next(t for n, t, _ in licenses.TEMPLATES if n == "MIT" and "sublicense" in t).replace(". ", ".\n\n"),
}


def test_texts_as_they_stand_in_files():
    for name, text in TEXTS.items():
        for around in ("", "words of some other kind go here " * 200):
            assert [f["license"] for f in licenses.statements(around + text + "\n" + around)] == [name], name
    both = TEXTS["BSD-2-Clause"] + "\n\n" + TEXTS["Apache-2.0"]
    assert [f["license"] for f in licenses.statements(both)] == ["BSD-2-Clause", "Apache-2.0"]
    assert [f["license"] for f in licenses.statements("A song.\nAll rights reserved.\n")] == ["All-rights-reserved"]


# Wordings that no template was drawn from.
_BSD_4 = """Copyright (c) 1990 The Someone. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by Someone and its contributors.
4. Neither the name of Someone nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
SHORT = (
    ("License: MIT", ["MIT"]), ("The code is MIT licensed.", ["MIT"]), ("Distributed under the terms of the MIT license", ["MIT"]), ("Apache License 2.0", ["Apache-2.0"]), ("Licensed under Apache 2.0", ["Apache-2.0"]),
    ("This Font Software is licensed under the SIL Open Font License, Version 1.1.", ["OFL-1.1"]), ("PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2", ["PSF-2.0"]), ("Released under the PostgreSQL License.", ["PostgreSQL"]),
    ("Text is licensed under https://creativecommons.org/licenses/by-sa/4.0/ here", ["CC-BY-SA-4.0"]), ("Licensed under CC BY 3.0", ["CC-BY-3.0"]), ("It is not released under the MIT license", []), ("no longer licensed under the Apache License, version 2.0", []),
    ("license mit dem Hund", []), ("License: GPLv3", ["GPL-3.0"]), ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ["GPL-2.0-or-later"]),
)


def test_short_forms_negations_and_relatives():
    for text, want in SHORT:
        assert [f["license"] for f in licenses.statements(text)] == want, text
    assert "BSD-4-Clause" in [f["license"] for f in licenses.statements(_BSD_4)] and "BSD-3-Clause" not in [f["license"] for f in licenses.statements(_BSD_4)]


def test_recall_against_every_template_on_every_stretch():
    """Templates with random edits in random prose: what a comparison of every template with every stretch confirms is found."""
    rng = random.Random(5)
    prose = [f"w{i}" for i in range(300)] + "the of and software license to is in use".split()
    hit = wanted = 0
    for number, (name, template, telling) in enumerate(licenses.TEMPLATES):
        for _ in range(4):
            words = licenses._word.findall(template)
            for _ in range(rng.randint(0, len(words) // 8)):
                k = rng.randrange(len(words))
                if words[k] not in telling:
                    words[k : k + 1] = rng.choice([[], ["edited"], [words[k], "added"]])
            stretch = " ".join(words)
            missing, extra, told = licenses.differences(stretch, number)
            if not told or missing > licenses.DIFFER or extra > licenses.DIFFER:
                continue
            stretch = stretch.upper()
            text = " ".join(rng.choices(prose, k=rng.randint(0, 200))) + "\n" + stretch + "\n" + " ".join(rng.choices(prose, k=rng.randint(0, 200)))
            wanted += 1
            hit += any(f["license"] == name or f["start"] < text.index(stretch) + len(stretch) and text.index(stretch) < f["end"] for f in licenses.statements(text))
    assert wanted > 200 and hit >= 0.97 * wanted, (hit, wanted)
