import random

from grovework.llm import handwritten as H

BY_HAND = """# Licence: see the LICENSE file.
import os

HEADER = "# Code generated by tool. DO NOT EDIT."


def read(path, limit=10):
    \"\"\"Auto-generated ids are replaced before writing.\"\"\"
    with open(path) as f:
        return f.read(limit)
"""
MINIFIED = '!function(){"use strict";' + "".join(f"function f{i}(t){{for(var e=0;e<t.length;e++)t[e]^={i};return t}}var b{i}={{k:{i},v:\"w\"}};" for i in range(40)) + "}();\n"
BLOB = "".join(random.Random(1).choices("ABCDEFGHIJKLMNOPabcdefghijklmnop0123456789+/", k=3000))
LIBRARY = "\n".join(f"def helper_{i}(a, b):\n    value = compute_{i}(a, {i})\n    return value + other_{i}(b)\n" for i in range(20))
NONE = ({}, [])


def lib(*texts):
    postings, sizes = {}, []
    for k, t in enumerate(texts):
        s = H.shingles(t)
        sizes.append(len(s))
        for x in s:
            postings.setdefault(x, []).append(k)
    return postings, sizes


def why(path, text, libraries=NONE):
    return H.reason_of(path, text, libraries)


def test_hand_written():
    for path in ("a.py", "src/gen_tables.py", "vendor_portal/a.py", "generated_reports/b.py", "x_min.py", "minify/a.py"):
        assert why(path, BY_HAND) is None, path
    assert why("a.py", BY_HAND + f'\nIMAGE = "{BLOB}"\n') is None  # embeds an image
    assert why("a.py", BY_HAND + '\nWORDS = r"^(' + "|".join(f"word{i}" for i in range(300)) + ')$"\n') is None
    assert why("a.py", "# Scaffolded once with a stub compiler and maintained by hand since then.\n" + BY_HAND) is None
    assert why("c.ts", "export const A = 1;\nexport const B = 2;\n") is None
    assert why("a.py", "") is None and why("a.py", "  \n") is None


def test_generated():
    assert why("a.go", "// Licence: see LICENSE\n//\n// Code generated by x 3.1. DO NOT EDIT.\n\npackage a\n") == "generated"
    assert why("a.py", '"""Generated from grammar.g4 by tool 4.2"""\n\nx = 1\n') == "generated"
    assert why("a.js", "/*\n * <auto-generated />\n */\nlet a = 1\n") == "generated"
    for line in ("built by `make stubs`; hand edits get overwritten", "Machine-made from api.yaml on 2023-05-02, edit the source instead", "This file was automatically created by x; changes will be lost.", "Diese Datei wurde automatisch erzeugt. Nicht bearbeiten.", "AUTOGENERATED FILE - do not modify by hand", "Fichier généré automatiquement", "Este archivo se generó automáticamente"):
        assert why("a.rs", f"// {line}\n\nfn f() {{}}\n") == "generated", line
    assert why("a/__generated__/b.ts", "let a = 1\n") == "generated"
    for line in ("Notes on files the stub compiler writes.", "Scaffolded once with the tool and maintained by hand since then.", "Licence: see the LICENSE file in the repository root."):
        assert why("a.rs", f"// {line}\n\nfn f() {{}}\n") is None, line
    assert why("a/b_pb2.py", BY_HAND) == "generated" and why("zz_generated_x.go", "package a\n") == "generated"


def test_minified_and_data():
    assert why("a.js", MINIFIED) == "minified"
    wrapped, line = "", ""
    for part in MINIFIED.split(";"):
        line += part + ";"
        if len(line) > 70:
            wrapped, line = wrapped + line + "\n", ""
    assert why("a.js", "/*! widget */\n" + wrapped + line) == "minified"
    assert why("t.go", "package p\n\nvar blob = []byte{\n" + "\t0xdd, 0x80, 0x89, 0xc3,\n" * 100 + "}\n") == "data"
    assert why("t.ts", "export const rows = [\n" + '  { id: 1, name: "x", qty: 843, lat: 37.74388 },\n' * 60 + "];\n") == "data"
    assert why("t.py", 'CSV = """id;name\n' + "1;cache;243\n" * 60 + '"""\n') == "data"
    assert why("t.js", f'export default "data:image/png;base64,{BLOB}";\n') == "data"
    assert why("t.py", "# icon\nX = (\n" + "".join(f'    "{BLOB[i:i + 76]}"\n' for i in range(0, 2000, 76)) + ")\n") == "data"


def test_copies():
    libraries = lib(LIBRARY)
    assert why("lib/a.py", LIBRARY.replace("\n", "\r\n"), libraries) == "copied"
    assert why("lib/a.py", "# local patch\n" + LIBRARY.replace("helper_3(", "helper_x("), libraries) == "copied"
    assert why("lib/a.py", LIBRARY[: len(LIBRARY) // 3], libraries) is None
    assert why("node_modules/a/b.js", "let a = 1\n") == "vendored" and why("deps/tool-1.4.2/a.py", BY_HAND) == "vendored"
    assert why("deps/a.py", BY_HAND) is None


FILES = "project string, file_path string, content string, indexed_at timestamp, reason string"


def test_frame(spark):
    from datetime import datetime as D

    rows = [
        ("p", "a.js", MINIFIED, D(2024, 1, 1), "clash"), ("p", "a.js", MINIFIED, D(2024, 1, 1), "clash"), ("p", "b.py", MINIFIED, D(2024, 1, 1), None), ("p", "b.py", BY_HAND, D(2024, 2, 1), None),
        ("p", "c.py", LIBRARY, None, None), ("p", "n.py", None, None, None), (None, "d.js", MINIFIED, None, None), ("p", "e.js", "let a = 1;\n" * 60_000, None, None),
    ]
    f = spark.createDataFrame(rows, FILES)
    known = spark.createDataFrame([(LIBRARY, "x"), (None, "x"), ("", "x")], "content string, reason string")
    assert sorted(tuple(r) for r in H.found(f, known).collect()) == [("p", "a.js"), ("p", "c.py")]
    assert H.classify(f, known).count() == 5
    assert H.found(spark.createDataFrame([], FILES), spark.createDataFrame([], "content string, reason string")).count() == 0


def test_notice_below_a_long_licence():
    licence = "".join(f"// Licence clause {i}: see the annex.\n" for i in range(60))
    notice = "// Code generated by x 3.1. DO NOT EDIT.\n"
    assert why("a.go", licence + notice + "\npackage a\n") == "generated"
    assert why("a.go", licence + notice + "// Maintained by hand since then.\n" + "\npackage a\n") is None
    assert why("a.go", licence + "\npackage a\n\n" + notice) is None


def test_encoded_runs_are_data_and_patterns_are_not():
    import base64
    import json

    compact = json.dumps([{"id": i, "name": f"n{i}", "at": [i / 7, i * 3]} for i in range(60)], separators=(",", ":"))
    assert why("a.js", f"const data = JSON.parse('{compact}');\nexport default data;\n") == "data"
    blob = base64.b85encode(random.Random(3).randbytes(2000)).decode().replace("'", "x").replace("\\", "y")
    assert why("a.py", f"import zlib\nDATA = '{blob}'\n") == "data"
    pattern = "^(" + "|".join(f"{a}{b}" for a in ("alpha", "beta", "gamma", "delta") for b in ("one", "two", "three", "four", "five") * 4) + ")$"
    assert why("a.py", f'WORDS = r"{pattern}"\n\nA = 1\nB = 2\n') is None
    assert why("a.py", BY_HAND + f"\nDATA = '{blob}'\n") is None  # embedded in hand-written code


def test_minified_text_wrapped_at_small_widths():
    parts, wrapped, line = MINIFIED.replace("}", "};").split(";"), "", ""
    for part in parts:
        line += part + ";"
        if len(line) > 44:
            wrapped, line = wrapped + line + "\n", ""
    assert H.layout(wrapped, "javascript")["mean"] < 60 and why("a.js", wrapped + line) == "minified"


def test_copies_by_join_and_by_broadcast_agree(spark):
    from datetime import datetime as D

    texts = {"same.py": LIBRARY, "patched.py": "# local patch\n" + LIBRARY.replace("helper_3(", "helper_x("), "part.py": LIBRARY[: len(LIBRARY) // 3], "own.py": BY_HAND, "empty.py": "", "short.py": "x = 1\n", "gen.py": "# Code generated by x. DO NOT EDIT.\n" + LIBRARY, "doc.md": LIBRARY, "vendor/v.py": LIBRARY}
    rows = [("p", k, v, D(2024, 1, 1), "clash") for k, v in texts.items()] + [("p", "same.py", LIBRARY, D(2024, 1, 1), "clash"), ("p", "null.py", None, None, None), ("p", "late.py", LIBRARY, None, None)]
    f = spark.createDataFrame(rows, FILES)
    known = spark.createDataFrame([(LIBRARY, "x"), (LIBRARY.replace("helper", "tool"), "x"), ("x = 1", "x"), (None, "x"), ("", "x")], "content string, reason string")
    by = lambda n: sorted((r["file_path"], r["reason"] or "") for r in H.classify(f, known, n).collect())
    assert by(10**9) == by(0) and dict(by(0))["patched.py"] == "copied" and dict(by(0))["late.py"] == "copied" and dict(by(0))["gen.py"] == "generated"
