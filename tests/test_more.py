import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from scanloom.operators import ir, transform, triage
from scanloom.operators.rules import rule_table
from scanloom.sinks import export
from scanloom.sources import binary, files, manifests
from scanloom.streaming import watch


def test_macros():
    src = "#define MAX(a, b) ((a) > (b) ? (a) : (b))\n#define N 4\nint x = MAX(N, f(1, 2));\n#ifdef M\nint dead;\n#else\nint y = N;\n#endif\n#undef N\nint z = N;"
    assert transform.expand_macros(src).split("\n") == ["", "", "int x = ((4) > (f(1, 2)) ? (4) : (f(1, 2)));", "", "", "", "int y = 4;", "", "", "int z = N;"]
    assert transform.expand_macros("#define A A B\nA") == "\n" + "A" + " B" * transform.MACRO_DEPTH


def test_codemods(spark):
    src = "x = eval(y)\nz = yaml.load(f)\nh = hashlib.md5(b)\n"
    fs = spark.createDataFrame([("a.py", src), ("b.py", "ok"), ("c.py", None)], "file_path string, content string")
    hits = spark.createDataFrame([("a.py", 1, "PY-EV"), ("a.py", 2, "PY-YL"), ("a.py", 3, "CRY-001"), ("a.py", 99, "PY-EV"), ("b.py", 1, "OTHER")], "file_path string, line_number int, rule_id string")
    (row,) = transform.codemod_plan(fs, hits).collect()
    assert "+x = ast.literal_eval(y)" in row["patch"] and "+z = yaml.safe_load(f)" in row["patch"] and "+h = hashlib.sha256(b)" in row["patch"]


def test_bumps_merges_templates():
    assert transform.bump_requirements("Py-YAML==5.1  # x\nother==1\n", {"py_yaml": "5.4"}) == "Py-YAML==5.4  # x\nother==1\n"
    assert json.loads(transform.bump_package_json('{"dependencies": {"a": "^1.0", "b": "2"}}', {"a": "1.2"}))["dependencies"] == {"a": "^1.2", "b": "2"}
    base = {"a": 1, "l": [{"name": "x", "v": 1}], "gone": 2}
    assert transform.strategic_merge(base, {"l": [{"name": "x", "w": 2}, {"name": "y"}], "gone": None}) == {"a": 1, "l": [{"name": "x", "v": 1, "w": 2}, {"name": "y"}]}
    assert transform.render_template("a: {{ .Values.x.y | quote }} {{ .Release.Name }}", {"x": {"y": 1}}) == 'a: "1" release'
    with pytest.raises(ValueError, match="control"):
        transform.render_template("{{ if .Values.x }}", {})


def test_flow_graphs():
    g = {0: [1], 1: [2, 3], 2: [4], 3: [4], 4: [1, 5], 5: []}
    assert ir.dominators(g, 0) == {1: 0, 2: 1, 3: 1, 4: 1, 5: 4}
    assert ir.frontier(g, 0) == {0: set(), 1: {1}, 2: {4}, 3: {4}, 4: {1}, 5: set()}
    assert ir.phi_places(g, 0, {2: {"v"}}) == {0: set(), 1: {"v"}, 2: set(), 3: set(), 4: {"v"}, 5: set()}
    graph, stores, reads = ir.flow_of("def f(a):\n    x = 1\n    if a:\n        x = 2\n    return x")
    assert {d[1] for d in ir.reaching(graph, stores)[max(graph)][0] if d[0] == "x"} == {1, 3}
    assert "a" in ir.live(graph, reads, stores)[1][1]
    assert ir.intervals("y = x + 1\nz = y * -2", {"x": (0, 3)})["z"] == (-8, -2)
    assert ir.lifetimes([("alloc", "p"), ("free", "p"), ("use", "p"), ("free", "p"), ("alloc", "q")]) == [(2, "use_after_free", "p"), (3, "double_free", "p"), (5, "leak", "q")]
    assert ir.paths({0: [1, 2], 1: [3], 2: [3], 3: []}, 0) == [[0, 1, 3], [0, 2, 3]]


def test_triage(spark):
    rows = [(n, "HIGH" if n % 2 else "LOW", "HIGH" if n % 2 else "LOW", "a.py", False, bool(n % 2)) for n in range(60)]
    df = spark.createDataFrame(rows, "row_id long, severity string, confidence string, file_path string, in_comment boolean, is_real boolean")
    m = triage.FalsePositiveModel().fit(df)
    p = {r["is_real"]: r["p"] for r in df.groupBy("is_real").agg(F.avg(m.probability()).alias("p")).collect()}
    assert p[True] > 0.8 > 0.3 > p[False]
    assert triage.synthesise_rule(["os.system(cmd)", "os.system(x)"], ["print(cmd)"]) == r"\b(?:os\.system)\b"
    assert triage.search_catalogue(rule_table(spark), "shell python").count() == 1
    got = triage.precision_recall(spark.createDataFrame([(["a", "b"], ["a", "c"])], "expected array<string>, actual array<string>")).first()
    assert tuple(got) == (0.5, 0.5, 0.5)


MANIFESTS = {
    "requirements.txt": ("requests==2.1  # x\n-r o.txt\nflask[a]>=1.0; python_version > '3'\n", {("requests", "2.1"), ("flask", "1.0")}),
    "package.json": ('{"dependencies": {"a": "^1.2.3"}, "devDependencies": {"b": "~2"}}', {("a", "1.2.3"), ("b", "2")}),
    "pom.xml": ("<dependency><groupId>g</groupId><artifactId>a</artifactId><version>1.0</version></dependency>", {("g/a", "1.0")}),
    "Cargo.toml": ('[dependencies]\nserde = "1.0"\ntokio = { version = "1.2" }\n', {("serde", "1.0"), ("tokio", "1.2")}),
    "go.mod": ("module x\nrequire (\n\tgithub.com/a/b v1.2.3\n)\n", {("github.com/a/b", "1.2.3")}),
    "x.csproj": ('<PackageReference Include="A" Version="1.1" />', {("A", "1.1")}), "composer.json": ('{"require": {"php": ">=7", "a/b": "^1.0"}}', {("a/b", "1.0")}),
    "Gemfile": ("gem 'rails', '~> 6.0'\ngem 'x'\n", {("rails", "6.0"), ("x", "")}), "Gemfile.lock": ("GEM\n  specs:\n    rack (2.0.1)\n      dep (1)\n", {("rack", "2.0.1")}), "packages.config": ('<package id="A" version="1" />', {("A", "1")}),
    "pubspec.yaml": ("name: x\ndependencies:\n  http: ^0.13.0\n", {("http", "0.13.0")}), "Package.resolved": ('{"pins": [{"identity": "a", "state": {"version": "1.0"}}]}', {("a", "1.0")}), "Podfile.lock": ("PODS:\n  - AFN/Core (4.0)\n\nX:\n", {("AFN", "4.0")}),
    "Cartfile.resolved": ('github "a/b" "1.0"\n', {("a/b", "1.0")}), "conanfile.txt": ("[requires]\nzlib/1.2.11\n[options]\nq/1\n", {("zlib", "1.2.11")}), "vcpkg.json": ('{"dependencies": ["a", {"name": "b", "version>=": "2.0"}]}', {("a", ""), ("b", "2.0")}),
    "mix.exs": ('{:phoenix, "~> 1.5"}', {("phoenix", "1.5")}), "cpanfile": ("requires 'A::B', '1.0';", {("A::B", "1.0")}), "DESCRIPTION": ("Package: x\nDepends: R (>= 3)\nImports: dplyr (>= 1.0), tidyr\n", {("dplyr", "1.0"), ("tidyr", "")}),
    "environment.yml": ("dependencies:\n  - numpy=1.20\n  - pip:\n    - flask==2.0\n", {("numpy", "1.20"), ("flask", "2.0")}), "Chart.yaml": ("name: c\ndependencies:\n  - name: redis\n    version: 1.0.0\n", {("redis", "1.0.0")}), "Dockerfile": ("FROM python:3.9\nRUN pip install flask==2.0 && apt-get install -y curl\nFROM scratch\n", {("python", "3.9"), ("flask", "2.0"), ("curl", "")}),
}


def test_manifests(spark):
    df = spark.createDataFrame([(f"t/{n}", t) for n, (t, _) in MANIFESTS.items()] + [("t/package.json", "{broken"), ("t/other.txt", "x==1"), ("t/n", None)], "file_path string, content string")
    got = {}
    for r in manifests.components(df).collect():
        got.setdefault(r["file_path"][2:], set()).add((r["name"], r["version"]))
    assert got == {n: w for n, (_, w) in MANIFESTS.items()}


def test_lockfiles(spark):
    docs = {
        "package-lock.json": '{"packages": {"": {}, "node_modules/a": {"version": "1.0", "dependencies": {"b": "1"}, "integrity": "sha512-x"}, "node_modules/b": {"version": "2.0"}}}', "v1/package-lock.json": '{"dependencies": {"c": {"version": "1", "requires": {"d": "1"}, "dependencies": {"d": {"version": "3"}}}}}',
        "yarn.lock": 'a@^1.0:\n  version "1.1"\n  dependencies:\n    b "^2"\n  integrity sha512-y\n\n"@s/b@^2":\n  version "2.2"\n', "poetry.lock": '[[package]]\nname = "p"\nversion = "1"\n', "Cargo.lock": '[[package]]\nname = "s"\nversion = "1"\ndependencies = ["t 1.0"]\n', "Pipfile.lock": '{"default": {"q": {"version": "==1.0", "hashes": ["sha256:a"]}}}', "go.sum": "m v1.0.0 h1:a=\nm v1.1.0 h1:b=\n",
    }
    rows = manifests.locked_packages(spark.createDataFrame(list(docs.items()), "file_path string, content string")).collect()
    got = {(r["lockfile"], r["name"], r["version"]): list(r["dependencies"]) for r in rows}
    assert got == {
        ("package-lock.json", "a", "1.0"): ["b"], ("package-lock.json", "b", "2.0"): [], ("v1/package-lock.json", "c", "1"): ["d"], ("v1/package-lock.json", "d", "3"): [], ("yarn.lock", "a", "1.1"): ["b"], ("yarn.lock", "@s/b", "2.2"): [],
        ("poetry.lock", "p", "1"): [], ("Cargo.lock", "s", "1"): ["t"], ("Pipfile.lock", "q", "1.0"): [], ("go.sum", "m", "1.1.0"): [],
    }


def test_binary():
    assert binary.strings(b"\x00abcdef\x01g\x00h\x00i\x00j\x00k\x00l\x00") == ["abcdef", "ghijkl"]
    assert binary.pdf_text(b"stream\n" + zlib.compress(b"(hidden text)") + b"endstream") == "hidden text"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("a.txt", "secret")
        z.writestr("../evil", "x")
    assert list(binary.archive_entries(buf.getvalue())) == [("a.txt", b"secret")]
    assert binary.exif_strings(b"nope") == [] and binary.der_modulus_bits("!!") is None
    assert binary.env_pairs("# c\nexport A='b'\nC=d\n") == [(2, "A", "b"), (3, "C", "d")]


def test_tree_sinks_and_watch(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("x = eval(y)\n")
    (src / "b.bin").write_bytes(b"\x00")
    df = files.read_tree(spark, f"file://{src}")
    assert [r["file_path"] for r in df.collect()] == ["a.py"]
    assert files.read_tree(spark, f"file://{src}", max_bytes=3).first()["error"] == "too large"
    found = spark.createDataFrame([("R1", "Bad <thing>", "HIGH", "a|b.py", 3, "CWE-1"), ("R2", None, "LOW", "c.py", None, None)], "rule_id string, name string, severity string, file_path string, line_number int, cwe string")
    for kind in ("json", "sarif", "gitlab"):
        export.WRITERS[kind](found, str(tmp_path / kind))
        assert json.loads((tmp_path / kind).read_text())
    assert len(json.loads((tmp_path / "sarif").read_text())["runs"][0]["results"]) == 2
    for kind in ("junit", "markdown", "html"):
        export.WRITERS[kind](found, str(tmp_path / kind))
    assert 'failures="1"' in (tmp_path / "junit").read_text() and "&lt;thing&gt;" in (tmp_path / "junit").read_text()
    assert files.read_findings_report(spark, str(tmp_path / "json")).count() == 2
    parts = spark.createDataFrame([("a", "1", "pkg:pypi/a@1")], "name string, version string, purl string")
    for kind in ("cyclonedx", "cyclonedx-xml", "spdx", "spdx-json"):
        export.WRITERS[kind](parts, str(tmp_path / kind))
        assert "a" in (tmp_path / kind).read_text()
    doc = export.attestation("x", b"data", b"key")
    assert export.verify_attestation(doc, b"key") and not export.verify_attestation(doc, b"other")

    store = f"file://{tmp_path}/store"
    for _ in range(2):  # the second run meets nothing new
        watch.watch(spark, f"file://{src}", store, f"file://{tmp_path}/ck", once=True).awaitTermination()
    out = watch.IncrementalStore(spark, store).output()
    assert [r["rule_id"] for r in out.collect()] == ["PY-EV"]


def test_trend_stream(spark, tmp_path):
    e = spark.range(10).selectExpr("timestamp_seconds(1700000000 + id * 1200) ts", "'x' event_type", "cast(id as double) value")
    e.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    q = watch.trend(stream).writeStream.format("memory").queryName("trend_out").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("trend_out").agg(F.sum("n")).first()[0] == 10
