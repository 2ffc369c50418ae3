import textwrap
from pathlib import Path

from trackloom.llm import license_scan as module
from trackloom.llm.license_scan import KNOWN, known_licenses, license_scan


def test_whole_texts_and_lines(spark, make_docs):
    mit = KNOWN["MIT"]
    varied = "The MIT Licence\n".replace("The MIT Licence\n", "") + "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("SUBLICENSE", "SUB-LICENSE").replace(",", " ;")
    docs = make_docs([(1, mit), (2, varied), (3, mit + " extra"), (4, "Some text\nLicensed under the Apache License, Version 2.0.\n(c) 2001 me"), (4, "Some text\nLicensed under the Apache License, Version 2.0.\n(c) 2001 me"), (5, None), (6, ""), (None, "Released under the MIT Licence"), (7, "x" * 100_000)])
    out = sorted(((r.doc_id, r.license_id, tuple(r.line_licenses)) for r in license_scan(docs, known_licenses(spark)).collect()), key=repr)
    assert out == sorted([(1, "MIT", ()), (2, "MIT", ()), (3, None, ()), (4, None, ("Apache-2.0",)), (4, None, ("Apache-2.0",)), (5, None, ()), (6, None, ()), (None, "MIT-notice", ("MIT-notice",)), (7, None, ())], key=repr)
    assert license_scan(docs.limit(0), known_licenses(spark)).count() == 0
    twice = known_licenses(spark, {"b": "same text", "a": "Same, text!", "e": "..."})
    assert [r.license_id for r in license_scan(make_docs([(1, "SAME TEXT")]), twice).collect()] == ["a"]


def test_files_with_titles_and_full_texts(spark, make_docs):
    full = {p.stem: p.read_text(encoding="utf-8") for p in (Path(module.__file__).parent / "licenses").glob("*.txt")}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "Unlicense"} <= set(full)
    files = [(n, t) for n, t in full.items()] + [(n, "\n\n".join(textwrap.fill(x, 66) for x in t.split("\n\n"))) for n, t in full.items() if n.startswith("BSD")]
    owner = "\n\nCopyright (c) 2020 Someone\nAll rights reserved.\n\n"
    wrapped = textwrap.fill(KNOWN["MIT"], 40) + "\n"
    files += [("MIT", "The MIT Licence\n" + "Copyright (c) 2020 Someone\n\n" + KNOWN["MIT"]), ("MIT", "MIT License" + owner + wrapped), ("ISC", "ISC License" + owner + KNOWN["ISC"]), ("BSD-3-Clause", "BSD 3-Clause License" + owner + full["BSD-3-Clause"].replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "))]
    files += [("Apache-2.0", full["Apache-2.0"].split("   APPENDIX")[0]), ("GPL-3.0", full["GPL-3.0"].replace("https:", "http:"))]
    # A licence's own words about copyright stay, wherever a line is broken.
    files += [("BSD-2-Clause", full["BSD-2-Clause"].replace(" COPYRIGHT", "\nCOPYRIGHT").replace(" copyright", "\ncopyright")), (None, full["BSD-2-Clause"].replace("THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT", "\n"))]
    out = {r.doc_id: r.license_id for r in license_scan(make_docs(list(enumerate(t for _, t in files))), known_licenses(spark)).collect()}
    assert out == {k: n for k, (n, _) in enumerate(files)}
    mixed = [(0, "Copyright 2020 me\rReleased under the MIT License."), (1, "(c) 2020 me\n \n*** Released under the MIT Licence"), (2, "All rights reserved\nReleased under the MIT License"), (3, "Re-released under the MIT License")]
    assert sorted((r.doc_id, r.license_id) for r in license_scan(make_docs(mixed), known_licenses(spark)).collect()) == [(0, "MIT-notice"), (1, "MIT-notice"), (2, "MIT-notice"), (3, None)]
    assert all(a[:3] == b[:3] for a, b in module.SPELLINGS.items())


def test_altered_texts_by_hand(spark):
    """What may change and what may not, written out; nothing here uses the operator's own patterns."""
    mit = KNOWN["MIT"]
    same = [
        mit, mit.upper(), mit.lower(), "\n\n" + mit.replace("\n", " ") + "  ", mit.replace(",", " ;"), "Copyright (c) 2020-2024 Jane Doe\n\n" + mit, "\u00a9 1999 Someone\nAll rights reserved.\n" + mit,
        mit.replace("license", "licence").replace("License", "Licence"),
    ]
    other = [mit.replace("without", "with"), mit + " And more.", mit[: len(mit) // 2], mit.replace("copies", "copy"), "", None, "no licence at all"]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(same + other)], "doc_id long, text string, license_id int, digest string")
    got = {r.doc_id: r.license_id for r in license_scan(docs, known_licenses(spark)).collect()}
    assert [got[i] for i in range(len(same))] == ["MIT"] * len(same)
    assert [got[len(same) + i] for i in range(len(other))] == [None] * len(other)
