import random
from collections import Counter

from tallyloom.llm import licence_scan as L
from tallyloom.llm import licence_templates as T
from tallyloom.llm.licence_templates import APACHE_NOTICE, MIT_BODY

SCHEMA = "doc_id long, text string, licence string, dice long"


def brute(text, templates, t):
    """Every passage against every template."""
    w = L.words_of(text)
    best = {}
    for name, template in templates:
        tw = L.words_of(template)
        b = Counter(zip(tw, tw[1:]))
        for i in range(len(w)):
            for n in range(2, min(len(w) - i, 2 * len(tw)) + 1):
                p = w[i : i + n]
                score = L.dice(Counter(zip(p, p[1:])), b)
                rank = (-score, i, n)
                if score >= t and rank < best.get(name, (0,)):
                    best[name] = rank
    return sorted((name, round(-s, 9), i, n) for name, (s, i, n) in best.items())


def test_scan_against_every_passage():
    r = random.Random(3)
    words = "a b c d license under the mit".split()
    for _ in range(150):
        templates = [(f"L{i % 3}", " ".join(r.choices(words, k=r.randrange(1, 9)))) for i in range(4)]
        texts = [" ".join(r.choices([*words, "zz"], k=r.randrange(0, 25))) for _ in range(4)]
        texts += [" ".join([texts[0], templates[0][1].upper() + ".", texts[1], templates[1][1]])]
        t = r.choice([0.5, 0.8, 1.0])
        got = L.Templates(templates, t).scan(texts)
        assert [sorted((n, round(s, 9), i, k) for n, s, i, k in x) for x in got] == [brute(x, templates, t) for x in texts]


def test_query(spark, put, monkeypatch):
    changed = MIT_BODY.replace("person", "human").replace("copy", "copies")
    rows = [(1, f"prose and more.\n{MIT_BODY}\nmore"), (2, changed), (3, "x. Licenced under the Apache Licence, version 2.0! y"), (4, APACHE_NOTICE), (5, "released under protest"), (6, None), (7, ""), (8, "word " * 60_000 + "Licensed under CC BY-NC 4.0."), (9, "Released under the MIT License."), (9, "Released under the MIT License."), (None, "Released under the MIT License.")]
    d = put(documents=spark.createDataFrame([(*x, "l", 1) for x in rows], SCHEMA))
    got = sorted(((r.doc_id, r.licence, r.dice) for r in L.op8_licence_scan(spark, d).collect()), key=repr)
    found = [(d, n) for d, n, _ in got]
    assert found == sorted([(1, "MIT"), (2, "MIT"), (3, "Apache-2.0"), (4, "Apache-2.0"), (8, "CC-BY-NC-4.0"), (9, "MIT"), (9, "MIT"), (None, "MIT")], key=repr)
    assert {s for d, _, s in got if d != 2} == {1.0}
    monkeypatch.setattr(L, "CHUNK", 3)
    assert sorted(((r.doc_id, r.licence, r.dice) for r in L.op8_licence_scan(spark, d).collect()), key=repr) == got


def test_versions_families_and_negations():
    its = L.Templates(T.TEMPLATES, L.THRESHOLD, T.TELLING)
    names = lambda text: sorted(n for n, *_ in its.scan([text])[0])
    bsd = f"{T.BSD_2_CONDITIONS} {T.BSD_DISCLAIMER}"
    gnu = lambda work, name, version: T.GNU_NOTICE.format(work=work, name=name, version=version)
    for text, want in (
        ("Licensed under the GNU General Public License v2.0.", ["GPL-2.0"]),
        ("Licensed under the GNU General Public License v3.0.", ["GPL-3.0"]),
        ("This work is licensed under the GNU General Public License, version 7.", []),
        ("not licensed under the MIT License", []),
        ("It isn't released under the MIT License.", []),
        ("SPDX-License-Identifier: MIT", ["MIT"]),
        ("SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0"]),
        (f"Copyright 2020 A. {bsd}", ["BSD-2-Clause"]),
        (gnu("library", "Lesser General Public License", "2.1"), ["LGPL-2.1"]),
        (gnu("program", "General Public License", "2"), ["GPL-2.0"]),
        (gnu("program", "General Public License", "3"), ["GPL-3.0"]),
        (gnu("program", "Affero General Public License", "3"), ["AGPL-3.0"]),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", ["CC-BY-4.0"]),
        ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
        ("Licensed under the Apache License, Version 1.1.", []),
        (T.ZLIB_BODY, ["Zlib"]),
        (T.ISC_BODY, ["ISC"]),
        (T.ZERO_BSD_BODY, ["0BSD"]),
        (f"{T.BSD_2_CONDITIONS} {T.BSD_4_CONDITIONS} {T.BSD_DISCLAIMER}", ["BSD-4-Clause"]),
        (f"{T.BSD_2_CONDITIONS} {T.BSD_3_CONDITION} {T.BSD_DISCLAIMER}", ["BSD-3-Clause"]),
        (f"{T.MIT_GRANT}. {T.MIT_WARRANTY}", ["MIT-0"]),
        (f"{T.MIT_BODY} {T.X11_CONDITION}", ["X11"]),
        (f"{T.MIT_BODY} {T.X11_CONDITION}".replace("X Consortium", "A and B").replace("persons", "people"), ["X11"]),
        (f"{T.MIT_BODY}\n\n{T.ISC_BODY}", ["ISC", "MIT"]),
        (f"{T.ISC_BODY} And then {T.ZERO_BSD_BODY} and {T.ISC_BODY}", ["0BSD", "ISC"]),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", ["Apache-2.0", "MIT"]),
        ("// SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) AND BSD-3-Clause\nint x;", ["BSD-3-Clause", "GPL-2.0"]),
        ("SPDX-License-Identifier: MIT-0", ["MIT-0"]),
        ("SPDX-License-Identifier: MIT Apache-2.0", ["MIT"]),
        ("There is no doubt. Licensed under the MIT License.", ["MIT"]),
        ("There is no doubt this is licensed under the MIT License.", ["MIT"]),
        ("It is not only licensed under the MIT License.", ["MIT"]),
        ("This is no longer licensed under the MIT License.", []),
        ("This is not free.\n\nLicensed under the MIT License.", ["MIT"]),
    ):
        assert names(text) == want, text
    assert "BSD-3-Clause" in names(f"{T.BSD_2_CONDITIONS} {T.BSD_3_CONDITION} {T.BSD_DISCLAIMER}")
    # Every template is found in itself, whole.
    for name, text in T.TEMPLATES:
        assert (name, 1.0) in {(n, s) for n, s, *_ in its.scan([f"x {text} y"])[0]}, text


def test_empty(spark, put):
    assert L.op8_licence_scan(spark, put(documents=spark.createDataFrame([], SCHEMA))).count() == 0
