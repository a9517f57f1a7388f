from millrace.llm import license_scan
from millrace.llm.license_scan import LICENSES


def scan(spark, frame, rows, known=None):
    known = license_scan.known_licenses(spark) if known is None else known
    return sorted(((r.doc_id, r.license_id) for r in license_scan.scan(frame(rows), known).collect()), key=str)


def test_variants_of_a_text(spark, frame):
    mit = LICENSES["MIT"]
    rows = [
        (1, mit),
        (2, mit.upper().replace("\n\n", "\n   \n").replace(",", " ,")),
        (3, mit.replace("<year> <copyright holders>", "2021-2024 Some One <a@b.c>\nCopyright 2019 Other\nAll rights reserved.")),
        (4, mit.replace("LICENSE", "LICENCE").replace("MIT License", "MIT Licence")),
        (5, mit + " and more"),
        (6, mit[:-20]),
        (7, LICENSES["BSD-2-Clause"].replace("COPYRIGHT HOLDER", "COPYRIGHT OWNER")),
        (8, "// " + LICENSES["ISC"].replace("\n", "\n// ")),
        (9, "released under the mit licence"),
    ]
    assert scan(spark, frame, rows) == [(1, "MIT"), (2, "MIT"), (3, "MIT"), (4, "MIT"), (5, None), (6, None), (7, "BSD-2-Clause"), (8, "ISC"), (9, "MIT-notice")]


def test_body_lines_about_copyright_stay(spark, frame):
    text = LICENSES["MIT"].replace("The above copyright notice", "The above notice")
    assert scan(spark, frame, [(1, text)]) == [(1, None)]


def test_edges(spark, frame):
    rows = [(1, None), (2, ""), (3, " !? "), (None, LICENSES["0BSD"]), (None, None), (4, "x " * 100000), (4, "x " * 100000)]
    assert scan(spark, frame, rows) == sorted([(1, None), (2, None), (3, None), (None, "0BSD"), (None, None), (4, None), (4, None)], key=str)
    assert scan(spark, frame, []) == []
    none = spark.createDataFrame([], "license_id string, digest string")
    assert scan(spark, frame, rows[:2], none) == [(1, None), (2, None)]


def test_equal_digests_do_not_multiply_rows(spark, frame):
    known = license_scan.known_licenses(spark, [("b", "some licence"), ("a", "Some License!"), ("c", None), ("d", "...")])
    assert scan(spark, frame, [(1, "some license"), (2, "")], known) == [(1, "a"), (2, None)]


def test_copyright_lines_without_a_year_first(spark, frame):
    lines = ["Copyright (c) Microsoft Corporation.", "Copyright (c) Microsoft Corporation. All rights reserved.", "Copyright (c) Jane Doe 2020", "(c) Copyright 2020 X", "Copyright by 2020 X",
             "Copyright Jane Doe 2020", "(c) Jane Doe 2020", "© Jane Doe", "Copyright Foo, Inc.", "Copyright The Foo Authors.", "Copyright {yyyy} {name of copyright owner}"]
    rows = [(i, LICENSES[k].replace("Copyright (c) <year> <copyright holders>", x).replace("Copyright (c) <year> <owner>", x)) for k in ("MIT", "BSD-3-Clause", "ISC") for i, x in enumerate(lines)]
    assert sorted(scan(spark, frame, rows)) == sorted((i, k) for k in ("MIT", "BSD-3-Clause", "ISC") for i in range(len(lines)))


def test_body_lines_that_begin_with_copyright_stay(spark, frame):
    bodies = ["COPYRIGHT HOLDERS BE LIABLE", "copyright notice and this list", "Copyright holders and contributors", "(c) You must retain all copyright", "copyright treaty adopted on 20 December 1996, or", "copyright law, including but not limited"]
    known = license_scan.known_licenses(spark, [(x, f"some text\n{x}\nmore") for x in bodies] + [("bare", "some text more")])
    assert [b for _, b in scan(spark, frame, [(i, f"Some text\n  {x}\nmore") for i, x in enumerate(bodies)], known)] == bodies


def test_full_texts_and_titles(spark, frame):
    from pathlib import Path

    folder = Path(license_scan.__file__).parent / "licenses"
    rows = [(i, (folder / f"{x}.txt").read_text()) for i, x in enumerate(license_scan.TEXTS)]
    assert scan(spark, frame, rows) == sorted(enumerate(license_scan.TEXTS), key=str)
    titled = [("MIT", "The MIT License (MIT)"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("ISC", "ISC License"), ("Zlib", "zlib License")]
    rows = [(i, f"{title}\n\n" + LICENSES[k].removeprefix("MIT License\n\n").replace("<year>", "2020")) for i, (k, title) in enumerate(titled)]
    rows += [(5, LICENSES["GPL-2.0"].partition("END OF TERMS")[0]), (6, LICENSES["GPL-3.0"][:-2000].replace("free", "fine")), (7, license_scan._MIT)]
    assert scan(spark, frame, rows) == [*((i, k) for i, (k, _) in enumerate(titled)), (5, "GPL-2.0"), (6, None), (7, "MIT-body")]


def test_spellings_beside_each_other(spark, frame):
    """Against the replacement of words in lists of words, one spelling after the other."""
    import hashlib
    import random

    rng = random.Random(3)
    words = [x for pair in license_scan.EQUIVALENT for x in pair] + ["sub", "licence", "per", "a"]
    rows = [(0, "licence licence sub licence licence"), *((i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(1, 60))]
    want = {}
    for i, text in rows:
        own = text.split()
        for old, new in license_scan.EQUIVALENT:
            old, new, out, at = old.split(), new.split(), [], 0
            while at < len(own):
                if own[at : at + len(old)] == old:
                    out += new
                    at += len(old)
                else:
                    out.append(own[at])
                    at += 1
            own = out
        want[i] = hashlib.sha256(" ".join(own).encode()).hexdigest()
    got = license_scan.scan(frame(rows), license_scan.known_licenses(spark, [])).collect()
    assert {r.doc_id: r.digest for r in got} == want
