import textwrap

from oracle import rows_of, rows_of_frame

from millrace.llm import queries
from millrace.llm.licenses import LICENSES, TITLES, known, scan


def test_forms_that_count_as_equal(spark, make):
    mit = LICENSES[1][1]
    variants = [mit, mit.upper(), "Copyright (c) 2020 A. Body\n\n" + mit, "  # © 1999 X\n" + mit.replace(", ", " -- "), mit.replace("sublicense", "sub-licence"), mit.replace("sublicense", "sub licence sub licence").replace("sub licence sub", "sub")]
    rows = [(i, v) for i, v in enumerate(variants)] + [(90, mit + " more"), (91, None), (92, ""), (93, "…!"), (94, "a\nRELEASED under the MIT Licence!\nb\nLicenced under CC BY 4.0.\nall rights reserved"), (94, "a\nRELEASED under the MIT Licence!\nb\nLicenced under CC BY 4.0.\nall rights reserved"), (95, "x" * 200000 + "\nLicensed under CC BY-NC 4.0.")]
    out = scan(make(rows), known(spark)).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    assert all(by[i].license == "MIT" for i in range(len(variants)))
    assert all(by[i].license is None for i in range(90, 96))
    assert by[91].canonical_sha256 == by[92].canonical_sha256 == by[93].canonical_sha256
    assert (by[94].license_lines, by[94].line_licenses) == (3, "CC-BY-4.0,LicenseRef-all-rights-reserved,MIT")
    assert (by[95].license_lines, by[95].line_licenses) == (1, "CC-BY-NC-4.0")
    assert scan(make([]), known(spark)).count() == 0


def test_whole_licence_files(spark, make):
    texts = {name: t for name, t in LICENSES if len(t.split()) >= 40}
    rows, names = [], {}
    for width in (40, 57, 60, 72, 76, 79):
        for name, t in texts.items():
            names[len(rows)] = name
            title = TITLES.get(name, ("",))[0]
            rows.append((len(rows), f"{title}\n\nCopyright (c) 2019-2024, The Authors. All rights reserved.\n\n" + "\n".join(textwrap.wrap(t, width))))
    assert {"MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Unlicense", "BSL-1.0"} == set(texts)
    assert {r.doc_id: r.license for r in scan(make(rows), known(spark)).collect()} == names
    bullets = texts["BSD-3-Clause"].replace(" 1. ", "\n * ").replace(" 2. ", "\n * ").replace(" 3. ", "\n * ")
    more = spark.createDataFrame([("X-1", "some long licence of one's own")], "license string, text string")
    got = {r.doc_id: r.license for r in scan(make([(1, bullets), (2, "Some long license of one's own!"), (3, "(c) You must retain\nall")]), known(spark, more=more)).collect()}
    assert got == {1: "BSD-3-Clause", 2: "X-1", 3: None}


def test_query_against_sql(spark, sf_dir):
    assert rows_of_frame(queries.op8_license_scan(spark, sf_dir)) == rows_of(queries.OP8_SQL, sf_dir)
