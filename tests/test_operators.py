from scanloom.functions import text
from scanloom.operators import baseline, code, deps, detect, graph, iac, pyast, reports, rules
from pyspark.sql import functions as F

FILES = "file_path string, content string"


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return df.select(expr.alias("x")).first()[0]


def test_text_functions(spark):
    assert one(spark, text.split_lines(F.col("a")), a="x\r\ny\rz\x0bw\u2028v\n") == ["x", "y", "z", "w", "v"]
    assert one(spark, text.split_lines(F.col("a")), a="") == []
    assert one(spark, text.split_lines(F.col("a")), a=None) is None
    assert one(spark, text.shannon(F.col("a")), a="aabb") == 1.0
    assert one(spark, text.shannon(F.col("a")), a="") == 0.0
    assert one(spark, text.cpf_valid(F.col("a")), a="529.982.247-25") and not one(spark, text.cpf_valid(F.col("a")), a="111.111.111-11")
    assert one(spark, text.cnpj_valid(F.col("a")), a="11.222.333/0001-81") and not one(spark, text.cnpj_valid(F.col("a")), a="11.222.333/0001-82")
    assert one(spark, text.luhn(F.col("a")), a="4539 1488 0343 6467") and not one(spark, text.luhn(F.col("a")), a="4539 1488 0343 6468")
    assert one(spark, text.version_lt(F.col("a"), F.col("b")), a="1.9", b="1.10.0rc1")
    assert not one(spark, text.version_lt(F.col("a"), F.col("b")), a="2.0.0", b="2")
    assert one(spark, text.cvss3_base(F.col("a")), a="CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H") == 9.8
    assert one(spark, text.cvss3_base(F.col("a")), a="CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H") == 10.0
    assert one(spark, text.cvss3_base(F.col("a")), a="none") is None
    assert one(spark, text.mask_middle(F.col("a")), a="1234567890") == "1234**7890"


CASES = [
    ("a.py", "import os\nos.system(cmd)\n", {"PY-SH"}), ("a.py", "subprocess.run(cmd, shell=True)", {"PY-SH"}), ("a.py", "subprocess.run([cmd])", set()), ("a.py", "x = eval(data)", {"PY-EV"}), ("a.py", "x = ast.literal_eval(data)", set()),
    ("a.py", "yaml.load(f)", {"PY-YL"}), ("a.py", "yaml.load(f, Loader=SafeLoader)", set()), ("a.py", "pickle.loads(b)", {"PY-PK"}), ("a.php", "echo $_GET['x'];", {"PH-XS"}), ("a.php", "echo htmlspecialchars($_GET['x']);", set()),
    ("a.js", "el.innerHTML = x", {"JS-IH"}), ("a.js", "el.textContent = x", set()), ("a.py", "hashlib.md5(x)", {"CRY-001"}), ("a.py", "hashlib.sha256(x)", set()), ("Dockerfile", "USER root", {"DK-RT"}), ("a.java", 'st.executeQuery("select " + x)', {"JV-SQ"}),
]


def test_rule_pairs(spark):
    files = spark.createDataFrame([(f"t{n}/{p}", c) for n, (p, c, _) in enumerate(CASES)], FILES)
    found = {}
    for r in rules.scan(files).collect():
        found.setdefault(int(r["file_path"].split("/")[0][1:]), set()).add(r["rule_id"])
    assert {n: found.get(n, set()) for n in range(len(CASES))} == {n: w for n, (_, _, w) in enumerate(CASES)}


def test_comments_suppression_and_limits(spark):
    src = "# eval(x)\nx = eval(y)  # scanloom: ignore PY-EV\nz = eval(q)\n" + "eval(" + "a" * 3000 + ")\n"
    files = spark.createDataFrame([("t/a.py", src), ("t/b.py", None), ("t/c.py", ""), (None, "eval(x)"), ("t/d.bin", "eval(x)")], FILES)
    rows = {(r["file_path"], r["line_number"]): r["severity"] for r in rules.scan(files).where("rule_id = 'PY-EV'").collect()}
    assert rows == {("t/a.py", 1): "INFO", ("t/a.py", 3): "CRITICAL"}
    assert rules.scan(files, comments="drop").where("rule_id = 'PY-EV'").count() == 1
    off = spark.createDataFrame([("PY-EV", "a.py")], "rule_id string, file_name string")
    assert rules.scan(files, suppress=off).where("rule_id = 'PY-EV'").count() == 0


def test_multiline_rules_and_dependencies(spark):
    own = rules.load_rules('[{"id": "A", "pattern": "begin"}, {"id": "B", "pattern": "use", "depends_on": "A"}, {"id": "C", "pattern": "use", "depends_on": "B"}, {"id": "M", "pattern": "x.*?y", "multiline": true}, {"name": "none"}]')
    files = spark.createDataFrame([("t/a.txt", "use\nbegin\nuse\nx\nz y\n"), ("t/b.txt", "use\n")], FILES)
    rows = {(r["file_path"], r["rule_id"], r["line_number"]) for r in rules.scan(files, own).collect()}
    assert rows == {("t/a.txt", "A", 2), ("t/a.txt", "B", 3), ("t/a.txt", "C", 3), ("t/a.txt", "M", 4)}


def test_languages(spark):
    paths = [("x/a.py", None, "Python"), ("x/Dockerfile", None, "Dockerfile"), ("x/a.png", "import x", "Unknown"), ("x/run", "#!/usr/bin/env python\n", "Python"), ("x/page", "<!DOCTYPE html>", "HTML"), ("x/none", "hello", "Unknown")]
    df = spark.createDataFrame(paths, "p string, c string, want string").withColumn("got", rules.detect_language(F.col("p"), F.col("c")))
    assert all(r["got"] == r["want"] for r in df.collect())
    df = spark.createDataFrame([("a/node_modules/x.js", False), ("a/x.js", True), ("a\\.git\\x.js", False), ("a/x.zip", False)], "p string, want boolean").withColumn("got", rules.is_scannable(F.col("p")))
    assert all(r["got"] == r["want"] for r in df.collect())


def lines_of(spark, content, path="t/a.py"):
    return rules.explode_lines(spark.createDataFrame([(path, content)], FILES))


def test_taint(spark):
    src = 'user = request.args.get("c")\ntmp = user\nfinal = tmp + "x"\nos.system(final)\nclean = "x"\nos.system(clean)\nfinal = "safe"\nos.system(final)\ncursor.execute("select " + tmp)\n'
    got = {(r["line_number"], r["category"], r["variable"]) for r in code.taint_findings(lines_of(spark, src)).collect()}
    assert got == {(4, "Command Injection", "final"), (9, "SQL Injection", "tmp")}


def test_context_nesting_functions(spark):
    src = "def a(x, y):\n    if x and y:\n        return 1\n\nclass B:\n    def c(self):\n        pass\n"
    rows = {r["line_number"]: r["function_context"] for r in code.function_context(lines_of(spark, src)).collect()}
    assert rows[2] == "a" and rows[5] == "B" and rows[7] == "c"
    fs = {r["function"]: (r["n_lines"], r["complexity"], r["params"]) for r in code.functions_of(lines_of(spark, src)).collect()}
    assert fs["a"] == (3, 3, 2) and fs["c"][2] == 0
    depth = [r["depth"] for r in code.clamped_depth(lines_of(spark, "}}\n{\n{\n}", "t/a.c")).orderBy("line_number").collect()]
    assert depth == [0, 1, 2, 1]
    big = "def f(a, b, c, d, e, g):\n" + "    if a:\n" * 60
    found = {r["rule_id"]: r["severity"] for r in code.complexity_findings(code.functions_of(lines_of(spark, big))).collect()}
    assert found == {"CMPLX-002": "MEDIUM", "CMPLX-003": "HIGH", "CMPLX-004": "LOW"}


def test_duplicates(spark):
    block = "".join(f"value_{n} = compute({n}, other) + 1\n" for n in "abcdefg")
    rows = code.duplicate_blocks(lines_of(spark, block + "different = call(x) here\n" + block)).collect()
    assert [(r["line_start"], r["duplicate_start"], r["lines_duplicated"]) for r in rows] == [(1, 9, 7)]
    assert code.duplicate_blocks(lines_of(spark, block)).count() == 0


def test_diff_lines(spark):
    diff = "--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,4 @@\n keep\n-old\n+new\n+more\n keep\n@@ -10 +11 @@\n-last\n+end\n"
    got = {tuple(r) for r in code.diff_lines(spark.createDataFrame([(1, diff)], "diff_id int, diff_text string")).collect()}
    assert got == {(1, "x.py", 2, "removed"), (1, "x.py", 2, "added"), (1, "x.py", 3, "added"), (1, "x.py", 10, "removed"), (1, "x.py", 11, "added")}


def test_detectors(spark):
    lines = spark.createDataFrame([(1, 'api_key = "a8Zx91KfQ2mLpR7vT0bN"'), (2, '# key = "a8Zx91KfQ2mLpR7vT0bN"'), (3, 'title = "aaaaaaaaaaaaaaaaaaaa"'), (4, None)], "n int, line string")
    assert [r["n"] for r in detect.entropy_findings(lines).collect()] == [1]
    rows = [(1, "cpf = 529.982.247-25"), (2, "cpf = 529.982.247-26"), (3, "mail = joe@site.org"), (4, "mail = joe@example.com"), (5, "# mail = joe@site.org"), (6, "card = 4539 1488 0343 6467")]
    got = {(r["n"], r["pii_type"]) for r in detect.personal_numbers(spark.createDataFrame(rows, "n int, line string")).collect()} - {(n, "Phone") for n in range(9)}
    assert got == {(1, "CPF"), (3, "Email"), (6, "Card")}
    token = "eyJhbGciOiJub25lIn0.eyJzdWIiOiIxIiwiZXhwIjoxMDB9."
    r = detect.jwt_findings(spark.createDataFrame([(1, f"t = '{token}'")], "n int, line string"), as_of=200).first()
    assert r["alg"] == "none" and r["issues"] == "alg_none,expired"
    pem = "-----BEGIN RSA PRIVATE KEY-----\nAAAA\n-----END RSA PRIVATE KEY-----"
    assert detect.key_blocks(spark.createDataFrame([("f", pem)], FILES)).first()["key_type"] == "RSA PRIVATE KEY"


def test_graphs(spark):
    e = spark.createDataFrame([("g", "a", "b"), ("g", "b", "c"), ("g", "c", "a"), ("g", "c", "d")], "g string, src string, dst string")
    closed = {(r["src"], r["dst"]): r["depth"] for r in graph.closure(e, ["g"]).collect()}
    assert closed[("a", "d")] == 3 and closed[("a", "a")] == 3 and ("d", "a") not in closed and len(closed) == 12
    chain = spark.createDataFrame([("g", f"n{i}", f"n{i + 1}") for i in range(12)], "g string, src string, dst string")
    assert graph.closure(chain, ["g"], 5).agg(F.max("depth")).first()[0] == 5
    joined = {(r["src"], r["dst"]): r["depth"] for r in graph.closure(e, ["g"], group_edges=0).collect()}
    assert joined == closed
    assert graph.closure(chain, ["g"], 5, 0).agg(F.max("depth")).first()[0] == 5 and graph.closure(chain, ["g"], None, 0).count() == 78
    p = spark.createDataFrame([("t", "u", "g1", "MemberOf"), ("t", "g1", "admin", "GenericAll"), ("t", "u", "admin", "Owner"), ("t", "g1", "u", "x")], "t string, src string, dst string, relation string")
    starts, goals = (spark.createDataFrame([("t", x)], "t string, node string") for x in ("u", "admin"))
    assert sorted((r["path"], r["score"]) for r in graph.escalation_paths(p, starts, goals, ["t"]).collect()) == [(["u", "admin"], 20), (["u", "g1", "admin"], 25)]
    edges = spark.createDataFrame([("u", "r", ["read", "write"])], "source string, target string, permissions array<string>")
    used = spark.createDataFrame([("u", "read")], "source string, permission string")
    assert graph.least_privilege(edges, used).first()["remove"] == ["write"]


def test_dependencies(spark):
    p = spark.createDataFrame([("PyYAML", "5.3"), ("django", "4.0"), ("log4j.core", "2.14.1"), ("flask", None)], "name string, version string")
    got = {(r["name"], r["cve_id"]) for r in deps.vulnerable(p, deps.advisories(spark)).collect()}
    assert got == {("PyYAML", "CVE-2020-14343"), ("log4j.core", "CVE-2021-44228"), ("flask", "CVE-2023-30861")}
    names = spark.createDataFrame([("pypi", "reqeusts"), ("pypi", "requests"), ("pypi", "numpyy"), ("pypi", "unrelated"), ("pypi", None), (None, "flaskk"), ("npm", "numpyy")], "ecosystem string, name string")
    assert {(r["name"], r["popular"], r["distance"]) for r in deps.typosquats(names, deps.popular_table(spark)).collect()} == {("reqeusts", "requests", 2), ("numpyy", "numpy", 1)}
    vex = spark.createDataFrame([(1, "C1", "p", "affected"), (2, "C1", "p", "fixed"), (1, "C2", "p", "not_affected")], "ord int, vulnerability string, product string, status string")
    found = spark.createDataFrame([("C1", "p"), ("C2", "p"), ("C3", "p")], "cve_id string, package string")
    kept, off = baseline.suppress_by_vex(found, vex)
    assert {r["cve_id"] for r in kept.collect()} == {"C1", "C3"} and {r["cve_id"] for r in off.collect()} == {"C2"}
    osv = '{"id": "O1", "severity": [{"score": "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"}], "affected": [{"ranges": [{"events": [{"introduced": "0"}, {"fixed": "1.2"}]}]}]}'
    assert tuple(deps.osv_entries(spark.createDataFrame([(osv,)], "osv_json string")).first()) == ("O1", "CRITICAL", "1.2")
    req = spark.createDataFrame([("r", 1, "a==1.0"), ("r", 2, "b>=2"), ("r", 3, "c==1 --hash=sha256:ab"), ("r", 4, "# d"), ("r", 5, "-r x.txt")], "file_path string, line_number int, line string")
    assert {(r["package"], r["severity"]) for r in deps.unpinned(req).collect()} == {("a", "LOW"), ("b", "MEDIUM")}


def test_iac(spark):
    policy = '{"Statement": [{"Effect": "Allow", "Action": "*", "Resource": "*"}, {"Effect": "Deny", "Action": ["s3:Get"], "Resource": "x"}]}'
    r = iac.iam_blast_radius(spark.createDataFrame([(1, policy)], "policy_id int, policy string")).first()
    assert (r["score"], r["level"], r["n_actions"]) == (83, "critical", 1)
    res = spark.createDataFrame([("b", "aws_s3_bucket", {"acl": "public-read"}), ("g", "aws_security_group", {"cidr_blocks": "0.0.0.0/0"}), ("ok", "aws_s3_bucket", {})], "id string, kind string, attributes map<string,string>")
    assert {(r["id"], r["check"]) for r in iac.cis_checks(res).collect()} == {("b", "public_bucket"), ("g", "open_security_group")}
    p = iac.Policy("deny kind == aws_s3_bucket : no buckets\nwarn attributes.acl contains public : public")
    assert {(r["id"], r["action"]) for r in p.evaluate(res).collect()} == {("b", "deny"), ("b", "warn"), ("ok", "deny")}
    a = spark.createDataFrame([("x", {"a": "1"}), ("y", {"a": "1"}), ("z", None)], "id string, attributes map<string,string>")
    b = spark.createDataFrame([("y", {"a": "2", "b": None}), ("w", {}), ("z", {})], "id string, attributes map<string,string>")
    assert {tuple(r) for r in baseline.drift(a, b).collect()} == {("x", "missing", None), ("y", "changed", "a"), ("w", "unmanaged", None)}
    docker = spark.createDataFrame([("d", 1, "FROM x:latest"), ("d", 2, "USER root"), ("d", 3, "USER app")], "file_path string, line_number int, line string")
    assert {(r["issue"], r["line_number"]) for r in iac.dockerfile_checks(docker).collect()} == {("latest_tag", 1)}


def test_python_trees(spark):
    src = """
def dead():
    return 1
    x = 2

def rec(n):
    return rec(n - 1)

def toctou(p):
    if os.path.exists(p):
        return open(p)

def closed(f):
    f.close()
    f.read()

def null():
    x = None
    return x.name

def maybe(c):
    if c:
        v = 1
    return v
"""
    rows = {(r["rule_id"], r["function"]) for r in pyast.python_findings(spark.createDataFrame([("t/a.py", src), ("t/bad.py", "def ("), ("t/n.py", None)], FILES)).collect()}
    assert {("AST-DEAD-001", None), ("AST-REC-001", "rec"), ("AST-TOCTOU-001", "toctou"), ("AST-UAC-001", "closed"), ("AST-NULL-001", "null"), ("AST-SSA-001", "maybe")} <= rows
    two = [("a.py", "def view():\n    q = request.args.get('x')\n    run_it(q)\n"), ("b.py", "def run_it(cmd):\n    deeper(cmd)\ndef deeper(c):\n    os.system(c)\ndef safe(d):\n    os.system(d)\n")]
    got = {(r["function"], r["sink"], r["param"]) for r in pyast.interprocedural_taint(pyast.calls(spark.createDataFrame(two, FILES))).collect()}
    assert got == {("deeper", "system", "c")}


def test_baseline_and_reports(spark):
    schema = "rule_id string, file_path string, line_number int, severity_rank int"
    cur = spark.createDataFrame([("a", "f", 1, 4), ("b", "f", None, 5), ("c", None, 1, 1), ("c", None, 1, 1)], schema)
    old = spark.createDataFrame([("a", "f", 1, 3), ("b", "f", 0, 5), ("d", "f", 1, 2)], schema)
    assert {(r["rule_id"], r["status"]) for r in baseline.baseline_diff(cur, old).collect()} == {("a", "regression"), ("b", "unchanged"), ("c", "new"), ("d", "resolved")}
    assert baseline.baseline_diff(cur.limit(0), old.limit(0)).count() == 0
    f = spark.createDataFrame([(1, "HIGH", "HIGH"), (1, "LOW", "LOW")], "scan_id int, severity string, confidence string")
    n = spark.createDataFrame([(1, 2), (2, None)], "scan_id int, files_scanned int")
    got = {r["scan_id"]: (r["score"], r["grade"]) for r in reports.risk_grade(f, n, "scan_id").collect()}
    assert got == {1: (2.575, "C"), 2: (0.0, "A")}
    gate = reports.quality_gate(f, "scan_id").first()
    assert not gate["passed"] and gate["failures"] == "high"
