import textwrap
from pathlib import Path

import duckdb
import pytest

from treegate.llm import licenses, notices

SCHEMA = "doc_id long, path string, text string"
MIT, APACHE, GPL = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3."


def scan(spark, rows, **extra):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as key", "'y' as term", "'z' as license", "'w' as dir")
    return df, {(r.doc_id, r.path): (r.license, r.origin) for r in licenses.license_scan(df, **extra).collect()}


CODE = "some words of code that go on and on\n" * 5
ROWS = [
    (1, "a/LICENSE", "The terms\nof this directory follow below, with much that no template says at all, on and on it goes.\n" + MIT), (2, "a/x.py", CODE), (3, "a/b/y.py", CODE), (4, "a/b/z.py", f"# {APACHE}\n{CODE}"), (5, "a/b/c/COPYING", GPL), (6, "a/b/c/d/e/w.py", CODE), (7, "q/x.py", CODE),
    (8, "top.py", CODE), (9, "r/notice.txt", GPL), (10, "r/deep/er/x.py", None), (11, None, MIT), (12, None, CODE), (13, "ab/x.py", CODE), (None, "a/n.py", ""), (14, "s/x.py", "the licence of this file is a secret\n" + CODE),
]


def test_headers_files_and_inheritance(spark):
    df, got = scan(spark, ROWS)
    assert got == {
        (1, "a/LICENSE"): ("MIT", "file"), (2, "a/x.py"): ("MIT", "inherited"), (3, "a/b/y.py"): ("MIT", "inherited"), (4, "a/b/z.py"): ("Apache-2.0", "header"), (5, "a/b/c/COPYING"): ("GPL-3.0", "file"), (6, "a/b/c/d/e/w.py"): ("GPL-3.0", "inherited"), (7, "q/x.py"): (None, None),
        (8, "top.py"): (None, None), (9, "r/notice.txt"): ("GPL-3.0", "header"), (10, "r/deep/er/x.py"): (None, None), (11, None): ("MIT", "header"), (12, None): (None, None), (13, "ab/x.py"): (None, None), (None, "a/n.py"): ("MIT", "inherited"), (14, "s/x.py"): (None, None),
    }


def test_a_licence_at_the_root_holds_everywhere(spark):
    _, got = scan(spark, [(1, "LICENSE", MIT), (2, "a/b/x.py", CODE), (3, "a/LICENSE", APACHE), (4, "a/c/y.py", CODE), (5, "z.py", CODE)])
    assert [got[k][0] for k in sorted(got)] == ["MIT", "Apache-2.0", "Apache-2.0", "Apache-2.0", "MIT"]


def test_repeated_rows_and_empty_tables(spark):
    _, got = scan(spark, [(1, "a/x.py", CODE), (1, "a/x.py", CODE + MIT)])
    assert got == {(1, "a/x.py"): ("MIT", "header")}
    df, _ = scan(spark, ROWS)
    assert licenses.license_scan(df.where("false")).count() == 0


def test_no_python_on_the_executors(spark):
    df = spark.range(100).selectExpr("id doc_id", "concat('a/', id) path", "concat(id, ' MIT License') text")
    plan = licenses.license_scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_against_sql(spark):
    rows = [(i, f"src{i % 3}", [CODE, CODE + MIT, GPL, f"x\n{APACHE}\ny", "", None, "Licensed under CC BY-NC 4.0. by me"][i % 7]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    path = "concat(source, '/', cast(floor(doc_id / 1000) as string), '/', doc_id, '.txt')"
    got = licenses.license_scan(df.selectExpr("doc_id", f"{path} as path", "text")).toPandas().sort_values("doc_id")
    con = duckdb.connect()
    documents = df.toPandas()  # noqa: F841  duckdb reads it by name
    con.register("documents", documents)
    want = con.sql(licenses.oracle()).df().sort_values("doc_id")
    for c in ("doc_id", "path", "license", "origin"):
        assert got[c].fillna("-").tolist() == want[c].fillna("-").tolist()
    assert got["similarity"].fillna(0).tolist() == pytest.approx(want["similarity"].fillna(0).tolist())


def wrapped(text, prefix="", width=70):
    return "\n".join((prefix + x).rstrip() for part in text.split("\n") for x in [*textwrap.wrap(part, width), ""])


GNU = """This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation{2} either version {3} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU {1} for more details.
You should have received a copy of the GNU {1} along with this program.  If not, see <https://www.gnu.org/licenses/>."""
HEADERS = {
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "GPL-3.0": GNU.format(":", "General Public License", ",", 3), "GPL-2.0": GNU.format(";", "General Public License", ";", 2), "LGPL-3.0": GNU.format(":", "Lesser General Public License", ",", 3), "LGPL-2.1": GNU.format(";", "Lesser General Public License", ";", "2.1"), "AGPL-3.0": GNU.format(":", "Affero General Public License", ",", 3),
    "Apache-2.0": notices.NOTICES[1][1], "MIT": notices._MIT + notices._MIT_END, "BSD-2-Clause": notices._BSD + notices._BSD_END, "BSD-3-Clause": notices._BSD + notices._BSD_THIRD + notices._BSD_END, "ISC": notices._ISC + notices._ISC_END,
}


def test_wrapped_headers_and_licence_files(spark):
    code = "".join(f"def f{i}(x{i}):\n    return g{i}(x{i}) + h{i}\n" for i in range(60))
    rows, want = [], {}
    for name, text in HEADERS.items():
        for n, source in enumerate((
            f"#!/usr/bin/env python\n# Copyright (c) 2019 Some Body\n#\n{wrapped(text, '# ')}\nimport x\n{code}",
            f"/*\n{wrapped('Copyright (C) 2019 Some Body', ' * ')}\n{wrapped(text, ' * ', 64)}\n */\n{code}",
            f"/*\n{wrapped(text, '    ')}\n*/\n{code}",
            f"{wrapped(text, '// ').rstrip('/ ' + chr(10))}\n{code}",
        )):
            rows.append((len(rows), f"{name}/{n}/x.c", source))
            want[f"{name}/{n}/x.c"] = (name, "header")
        rows += [(len(rows), f"{name}/f/LICENSE", f"Copyright (c) 2019 Some Body\n\n{wrapped(text)}"), (len(rows) + 1, f"{name}/f/a/x.c", code)]
        want |= {f"{name}/f/LICENSE": (name, "file"), f"{name}/f/a/x.c": (name, "inherited")}
    for p in sorted((Path(licenses.__file__).parent / "licence_texts").glob("*.txt")):
        rows += [(len(rows), f"full/{p.stem}/{p.name}", p.read_text()), (len(rows) + 1, f"full/{p.stem}/x.c", code)]
        want |= {f"full/{p.stem}/{p.name}": (p.stem, "file"), f"full/{p.stem}/x.c": (p.stem, "inherited")}
    _, got = scan(spark, rows)
    assert {path: x for (_, path), x in got.items()} == want


def test_lines_that_name_a_licence_and_licences_under_other_names(spark):
    code = "".join(f"x{i} = f{i}(y{i})\n" for i in range(60))
    lines = {"BSD-2-Clause": "Licensed under the BSD 2-Clause License.", "ISC": "Licensed under the ISC License.", "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.", "EPL-2.0": "Licensed under the Eclipse Public License, version 2.0.", "Unlicense": "This is released into the public domain under the Unlicense."}
    lines |= {f"spdx {n}": f"SPDX-License-Identifier: {n}" for n in ("BSD-2-Clause", "BSD-3-Clause", "MIT", "EPL-2.0", "LGPL-2.1", "GPL-2.0")}
    rows = [(i, f"{n}/x.py", f"# {line}\n{code}") for i, (n, line) in enumerate(lines.items())]
    rows += [(100, "one/line.py", MIT), (101, "one/x.py", code), (102, "bsd/terms.txt", wrapped(HEADERS["BSD-3-Clause"])), (103, "bsd/a/x.py", code), (104, "short/LICENSE", HEADERS["MIT"][:600]), (105, "short/x.py", code), (106, "none/x.py", f"# SPDX-License-Identifier: LicenseRef-Ours\n{code}")]
    _, got = scan(spark, rows)
    want = {f"{n}/x.py": (n.removeprefix("spdx "), "header") for n in lines}
    want |= {"one/line.py": ("MIT", "header"), "one/x.py": (None, None), "bsd/terms.txt": ("BSD-3-Clause", "file"), "bsd/a/x.py": ("BSD-3-Clause", "inherited"), "short/LICENSE": ("MIT", "file"), "short/x.py": ("MIT", "inherited"), "none/x.py": (None, None)}
    assert {path: x for (_, path), x in got.items()} == want
