import pytest

from scanloom.llm import generated

POSITIVE = [
    "// Code generated by protoc-gen-go v1.2. DO NOT EDIT.", "# Arquivo gerado automaticamente por x. Não editar.", "// Generado automáticamente por x; no modificar a mano.", "// <auto-generated/> produced by x 1.2", "/*! lib.js v5.9.9 | (c) lib contributors | MIT */",
    "// Vendored copy of lib 0.1, upstream https://lib.example/src", "// lib 3.14.35 -- Copyright (c) 2016 the lib authors, BSD licence", "// Copied unchanged from lib release 8.16.6", "FONT = [" + ",".join(["0x5f"] * 60) + "]", 'ICON = "' + "Ab3/" * 60 + '"',
    "!function(e,t){" + "var a=r(1),b=a.c;try{d(e)}catch(t){};" * 8 + "}(window);", "// This file was automatically generated by x; changes will be lost.", "# AUTOGENERATED FILE - source: schema/x.idl",
]
NEGATIVE = [
    "# auto-generated ids start at 12", "/* draft ids are generated by the database */", "# do not edit rows by hand in production", "// vendor stream is billed by the deal", "/* bundle a with b, minify later */", "// copied this loop from decode() and then rewrote it",
    'text = "' + "See the page of the manual for the limits. " * 8 + '"', 'q = "SELECT a.x, b.y AS z FROM t a JOIN u b ON a.id = b.id WHERE a.x IS NOT NULL AND b.y IS NOT NULL ORDER BY a.x, b.y, a.z, b.q"', "x = 1", "",
]
PATHS = {
    "t/node_modules/a.js": True, "t/app/vendor/x/a.py": True, "t/a.min.js": True, "t/js/route-min.js": True, "t/a.pb.go": True, "t/a_pb2.py": True, "t/zz_generated_x.go": True, "t/x/UserGrpc.java": True, "t/js/app.c212ec9a.js": True, "t/yarn.lock": True, "t/Pods/x.rb": True,
    "t/min.js": False, "t/vendor_portal/a.py": False, "t/generators/a.py": False, "t/outbound/a.py": False, "t/builders/a.java": False, "vendor/a.py": False, "t/distribution/x.go": False, "t/json_parser.py": False,
}


@pytest.mark.parametrize("line", POSITIVE)
def test_shown(line):
    assert generated.has_notice(line, generated._automaton()) or generated.is_blob(line) or generated.is_minified(line)


@pytest.mark.parametrize("line", NEGATIVE)
def test_not_shown(line):
    assert not (generated.has_notice(line, generated._automaton()) or generated.is_blob(line) or generated.is_minified(line))


def test_files(spark):
    files = [(p,) for p in PATHS] + [("./t\\a\\b.py",), ("t/a/b.py",), ("t/plain.py",), (None,)]
    lines = [("t/a/b.py", POSITIVE[0]), ("t/plain.py", NEGATIVE[0]), ("t/plain.py", None), (None, POSITIVE[0]), ("t/elsewhere.py", POSITIVE[0])]
    out = generated.generated_files(spark.createDataFrame(files, "file_path string").selectExpr("*", "1 as line_content"), spark.createDataFrame(lines, "file_path string, line_content string"))
    got = [r[0] for r in out.collect()]
    assert sorted(got) == sorted([*[p for p, want in PATHS.items() if want], "t/a/b.py"])


def test_empty(spark):
    none = spark.createDataFrame([], "file_path string, line_content string")
    assert generated.generated_files(none, none).count() == 0
    assert generated.generated_files(spark.createDataFrame([("t/dist/a.js",)], "file_path string"), none).count() == 1


BLOBS = ["ICON = [" + ",".join(["0x5f"] * 30) + "]", "  " + ", ".join(["0x5f"] * 12) + ",", "var icon='" + r"\x0f\x2d" * 20 + "'", 'k = "' + r"\017\255" * 8 + '"', 'ICON = "' + "Ab3/" * 35 + '"']


@pytest.mark.parametrize("line", BLOBS)
def test_short_blobs(line):
    assert generated.is_blob(line)


@pytest.mark.parametrize("line", ["MASKS = [" + ",".join(["0x5f"] * 8) + "]", 'sep = "' + r"\x1f\x1e" * 4 + '"', 'title = "' + r"з" * 20 + '"', "days = [" + ", ".join(map(str, range(1, 32))) + "]"])
def test_what_people_type(line):
    assert not generated.is_blob(line)
