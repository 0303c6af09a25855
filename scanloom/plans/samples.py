"""Operators on small written inputs, each with the rows that are due.

Operators on source texts, policies, plans and graphs have no input among the tables.  Each query here runs one on a few
written cases; its SQL is the table of the results worked out by hand.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from scanloom.operators import code, deps, detect, domain, graph, iac, ir, pyast, reports, rules, transform, triage
from scanloom.sinks import export
from scanloom.sources import binary, infrastructure
from scanloom.workdir import work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_KINDS = {"string": "VARCHAR", "int": "INT", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _literal(value: object, kind: str) -> str:
    text = "NULL" if value is None else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value).upper()
    return f"CAST({text} AS {_KINDS[kind]})"


def due(schema: str, rows: list[tuple]) -> Callable:
    """Registers a function of the session as a query and ``rows`` as its SQL."""
    columns = [c.split() for c in schema.split(", ")]

    def register(build: Callable[[SparkSession], DataFrame]) -> Callable[[SparkSession], DataFrame]:
        name = "case_" + build.__name__
        QUERIES[name] = lambda spark, _: build(spark).select(*[F.col(c).cast(k).alias(c) for c, k in columns])
        values = ", ".join("(" + ", ".join(_literal(v, k) for v, (_, k) in zip(r, columns, strict=True)) + ")" for r in rows)
        SQL[name] = f'SELECT * FROM (VALUES {values}) AS t({', '.join(f'"{c}"' for c, _ in columns)})'
        return build

    return register


def _files(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(files.items()), "file_path string, content string")


# ---------------------------------------------------------------- rules and lines

SOURCE = {
    "app/a.py": "# eval(x)\nx = eval(y)  # scanloom: ignore PY-EV\nz = eval(q)\nyaml.load(f)\nyaml.load(f, Loader=SafeLoader)\n",
    "app/b.js": "/* el.innerHTML = a\n*/\nel.innerHTML = b;\n",
    "app/c.bin": "eval(x)",
    "app/Dockerfile": "FROM alpine:latest\nUSER root\n",
}


@due("file_path string, line_number int, rule_id string, severity string", [
    ("app/a.py", 1, "PY-EV", "INFO"), ("app/a.py", 3, "PY-EV", "CRITICAL"), ("app/a.py", 4, "PY-YL", "HIGH"), ("app/b.js", 1, "JS-IH", "INFO"), ("app/b.js", 3, "JS-IH", "HIGH"), ("app/Dockerfile", 1, "DK-LT", "LOW"), ("app/Dockerfile", 2, "DK-RT", "MEDIUM"),
])
def scan_sources(spark: SparkSession) -> DataFrame:
    """Rules, comments (downgraded), inline suppression and unscannable files."""
    return rules.scan(_files(spark, SOURCE))


@due("file_path string, line_number int, rule_id string", [("app/a.py", 4, "PY-YL"), ("app/b.js", 3, "JS-IH"), ("app/Dockerfile", 1, "DK-LT"), ("app/Dockerfile", 2, "DK-RT")])
def scan_suppressed(spark: SparkSession) -> DataFrame:
    """Comments dropped, a rule off in one file and another everywhere."""
    off = spark.createDataFrame([("PY-EV", "a.py"), ("NET-001", None)], "rule_id string, file_name string")
    return rules.scan(_files(spark, SOURCE), suppress=off, comments="drop")


OWN_RULES = '[{"id": "A", "pattern": "begin"}, {"id": "B", "pattern": "use", "depends_on": "A"}, {"id": "C", "pattern": "use", "depends_on": "B"}, {"id": "M", "pattern": "x.*?y", "multiline": true}, {"id": "S", "pattern": "BEGIN", "ignorecase": true, "severity": "low"}, {"name": "none"}]'


@due("file_path string, rule_id string, line_number int", [("t/a.txt", "A", 2), ("t/a.txt", "S", 2), ("t/a.txt", "B", 3), ("t/a.txt", "C", 3), ("t/a.txt", "M", 4)])
def scan_own_rules(spark: SparkSession) -> DataFrame:
    """Rules from JSON: dependent rules, a pattern over lines, letter case."""
    return rules.scan(_files(spark, {"t/a.txt": "use\nbegin\nuse\nx\nz y\n", "t/b.txt": "use\n"}), rules.load_rules(OWN_RULES))


@due("rule_id string, severity string", [("PY-EV", "LOW")])
def rule_overrides(spark: SparkSession) -> DataFrame:
    """Severities overridden by name; an unknown severity changes nothing."""
    changed = rules.override_severities(rules.RULES, {"PY-EV": "low", "PY-SH": "fatal"})
    return rules.rule_table(spark, changed).join(rules.rule_table(spark), ["rule_id", "severity"], "left_anti")


@due("rule_id string", [("PY-SH",)])
def rule_search(spark: SparkSession) -> DataFrame:
    return triage.search_catalogue(rules.rule_table(spark), "shell python")


TAINTED = 'user = request.args.get("c")\ntmp = user\nfinal = tmp + "x"\nos.system(final)\nclean = "x"\nos.system(clean)\nfinal = "safe"\nos.system(final)\ncursor.execute("select " + tmp)\n'


@due("line_number int, category string, variable string", [(4, "Command Injection", "final"), (9, "SQL Injection", "tmp")])
def taint(spark: SparkSession) -> DataFrame:
    """Values followed through assignments, cleared by clean ones."""
    return code.taint_findings(rules.explode_lines(_files(spark, {"a.py": TAINTED})))


FUNCTIONS = "def a(x, y):\n    if x and y:\n        return 1\n\n    return 2\n\nx = a(1, 2) if z else 3\n\nclass B:\n    def c(self):\n        pass\n"


@due("function string, start_line int, end_line int, n_lines long, complexity long, params int", [("a", 1, 6, 4, 3, 2), ("B", 9, 11, 3, 1, 0), ("c", 10, 11, 2, 1, 0)])
def functions(spark: SparkSession) -> DataFrame:
    """Definitions, where they end, and their measures; what follows a function is no part of it."""
    return code.functions_of(rules.explode_lines(_files(spark, {"a.py": FUNCTIONS})))


@due("function string, start_line int, end_line int", [("f", 1, 3), ("g", 5, 5), ("K", 6, 8), ("m", 7, 7)])
def functions_in_braces(spark: SparkSession) -> DataFrame:
    return code.functions_of(rules.explode_lines(_files(spark, {"a.js": "function f(a) {\n  if (a) { b(); }\n}\nf(1);\nfunction g() { return 2; }\nclass K {\n  static function m() { return 1; }\n}\n"})))


@due("rule_id string, severity string", [("CMPLX-002", "MEDIUM"), ("CMPLX-003", "HIGH"), ("CMPLX-004", "LOW")])
def complexity(spark: SparkSession) -> DataFrame:
    big = "def f(a, b, c, d, e, g):\n" + "    if a:\n" * 60
    return code.complexity_findings(code.functions_of(rules.explode_lines(_files(spark, {"a.py": big}))))


@due("class string, start_line int, methods long", [("Big", 1, 21)])
def big_classes(spark: SparkSession) -> DataFrame:
    """Classes of more than twenty methods; methods after a class count for none."""
    body = lambda k: "".join(f"    def m{n}(self):\n        pass\n" for n in range(k))
    return code.god_classes(rules.explode_lines(_files(spark, {"a.py": f"class Big:\n{body(21)}class Small:\n{body(20)}"})))


@due("line_number int, max_depth int", [(3, 6), (4, 7)])
def nesting(spark: SparkSession) -> DataFrame:
    return code.deep_nesting(rules.explode_lines(_files(spark, {"a.c": "{{{\n{{\n{\n{\n}}}\n}}}}\n"}))).withColumnRenamed("depth", "max_depth")


@due("line_number int, depth int", [(1, 0), (2, 1), (3, 2), (4, 0)])
def indents(spark: SparkSession) -> DataFrame:
    return code.indent_depth(rules.explode_lines(_files(spark, {"a.py": "a:\n    b:\n\t\tc\n\n"})))


REPEATED = "".join(f"value_{n} = compute({n}, other) + 1\n" for n in "abcdefg")


@due("line_start int, duplicate_start int, lines_duplicated long", [(1, 9, 7)])
def duplicates(spark: SparkSession) -> DataFrame:
    """A block of seven lines that comes back, with other numbers and literals."""
    return code.duplicate_blocks(rules.explode_lines(_files(spark, {"a.py": REPEATED + "different = call(x) here\n" + REPEATED.replace("+ 1", "+ 2")})))


DIFF = "--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,4 @@\n keep\n-old\n+new\n+more\n keep\n@@ -10 +11 @@\n-last\n+end\n"


@due("file string, line int, side string", [("x.py", 2, "removed"), ("x.py", 2, "added"), ("x.py", 3, "added"), ("x.py", 10, "removed"), ("x.py", 11, "added")])
def diff_lines(spark: SparkSession) -> DataFrame:
    return code.diff_lines(spark.createDataFrame([(1, DIFF)], "diff_id int, diff_text string"))


@due("file_path string, line_number int", [("src/x.py", 3), ("src/y.py", 1)])
def diff_filter(spark: SparkSession) -> DataFrame:
    """Findings on added lines, and all of files outside the diff."""
    diffs = code.diff_lines(spark.createDataFrame([(1, DIFF)], "diff_id int, diff_text string"))
    return code.filter_to_diff(spark.createDataFrame([("src/x.py", 1), ("src/x.py", 3), ("src/y.py", 1)], "file_path string, line_number int"), diffs)


@due("line string, pii_type string, masked_value string", [
    ("cpf = 529.982.247-25", "CPF", "5299***4725"), ("cnpj = 11.222.333/0001-81", "CNPJ", "1122******0181"), ("card = 4539 1488 0343 6467", "Card", "4539********6467"), ("mail = joe@site.org", "Email", "jo***@site.org"),
])
def personal_numbers(spark: SparkSession) -> DataFrame:
    """Check digits, masks, placeholder domains and comments."""
    lines = ["cpf = 529.982.247-25", "cpf = 529.982.247-26", "cnpj = 11.222.333/0001-81", "mail = joe@site.org", "mail = joe@example.com", "# mail = joe@site.org", "card = 4539 1488 0343 6467"]
    return detect.personal_numbers(spark.createDataFrame([(x,) for x in lines], "line string")).where("pii_type <> 'Phone'")


PEM = "-----BEGIN {0}PRIVATE KEY-----\n{1}AAAA\nBBBB\n-----END {0}PRIVATE KEY-----\n"


@due("file_path string, key_type string, encrypted boolean, n_chars int", [("a", "RSA PRIVATE KEY", False, 8), ("b", "ENCRYPTED PRIVATE KEY", True, 8), ("c", "EC PRIVATE KEY", True, 29)])
def key_blocks(spark: SparkSession) -> DataFrame:
    return detect.key_blocks(_files(spark, {"a": "x\n" + PEM.format("RSA ", ""), "b": PEM.format("ENCRYPTED ", ""), "c": PEM.format("EC ", "Proc-Type: 4,ENCRYPTED\n"), "d": "none"}))


@due("line string, key_type string", [("ssh-rsa AAAAB3 x@y", "ssh-rsa"), ("ecdsa-sha2-nistp256 AAAAE2 z", "ecdsa-sha2-nistp256")])
def ssh_keys(spark: SparkSession) -> DataFrame:
    return detect.ssh_public_keys(spark.createDataFrame([("ssh-rsa AAAAB3 x@y",), ("ecdsa-sha2-nistp256 AAAAE2 z",), ("ssh-rsa none",)], "line string"))


# ---------------------------------------------------------------- syntax trees and flow

PYTHON = {
    "r.py": "def f(n):\n    return f(n - 1)\n\ndef g(p):\n    if os.path.exists(p):\n        open(p)\n\ndef h():\n    x = open('a')\n    x.close()\n    x.read()\n",
    "n.py": "def k():\n    v = None\n    v.run()\n    return 1\n    v = 2\n\ndef m(c):\n    if c:\n        y = 1\n    return y\n\ndef z():\n    unused = 1\n    return 2\n",
    "broken.py": "def (",
}


@due("file_path string, rule_id string, function string, line_number int", [
    ("r.py", "AST-REC-001", "f", 2 - 1), ("r.py", "AST-TOCTOU-001", "g", 6), ("r.py", "AST-UAC-001", "h", 11), ("n.py", "AST-NULL-001", "k", 3), ("n.py", "AST-DEAD-001", None, 5), ("n.py", "AST-SSA-001", "m", 10), ("n.py", "AST-DATAFLOW-001", "z", 13),
])
def ast_rules(spark: SparkSession) -> DataFrame:
    """Endless recursion, check before use, use after close, None used, dead code, unassigned use, dead store; a file that doesn't parse gives none."""
    return pyast.python_findings(_files(spark, PYTHON))


@due("function string, cyclomatic int, cognitive int, vocabulary int, length int, volume double, difficulty double, effort double", [
    # add: operators Return, Add; operands a, b.  pick: If, Gt, Return, Return, Sub; operands a, b, a, b, a
    ("add", 1, 0, 4, 4, 8.0, 1.0, 8.0), ("pick", 2, 1, 6, 10, 25.85, 5.0, 129.25),
])
def metrics(spark: SparkSession) -> DataFrame:
    return pyast.function_metrics(_files(spark, {"m.py": "def add(a, b):\n    return a + b\n\ndef pick(a, b):\n    if a > b:\n        return a\n    return b - a\n"}))


CALLS = "def low(q):\n    os.system(q)\n\ndef mid(p):\n    low(p)\n\ndef top():\n    mid(request.args)\n    low('x')\n\ndef alone():\n    pass\n"


@due("function string, direct long, transitive long", [("low", 2, 2), ("mid", 1, 1), ("top", 0, 0), ("alone", 0, 0)])
def call_impact(spark: SparkSession) -> DataFrame:
    return pyast.call_impact(pyast.calls(_files(spark, {"c.py": CALLS})))


@due("src string, dst string", [("low", "system"), ("mid", "low"), ("top", "mid"), ("top", "low")])
def call_edges(spark: SparkSession) -> DataFrame:
    return pyast.call_edges(pyast.calls(_files(spark, {"c.py": CALLS})))


@due("function string, line_number int, sink string, param string", [("low", 2, "system", "q")])
def call_taint(spark: SparkSession) -> DataFrame:
    """A request's value reaches a sink through two calls."""
    return pyast.interprocedural_taint(pyast.calls(_files(spark, {"c.py": CALLS})))


# f: 1 x = 1, 2 if a, 3 x = 2, 4 return x
@due("node int, fact string, value string", [
    (1, "dominator", "0"), (2, "dominator", "1"), (3, "dominator", "2"), (4, "dominator", "2"), (-1, "dominator", "4"), (3, "frontier", "4"), (4, "phi", "x"),
    (2, "reaches", "x@1"), (3, "reaches", "x@1"), (4, "reaches", "x@1"), (4, "reaches", "x@3"), (-1, "reaches", "x@1"), (-1, "reaches", "x@3"),
    (0, "live", "a"), (1, "live", "a"), (2, "live", "a"), (2, "live", "x"), (4, "live", "x"),
])
def flow(spark: SparkSession) -> DataFrame:
    return ir.flow_facts(_files(spark, {"f.py": "def f(a):\n    x = 1\n    if a:\n        x = 2\n    return x\n", "g.py": "def ("}))


@due("position int, target string, args string", [(0, "x_1", "1"), (1, "y_1", "x_1 + z"), (2, "x_2", "x_1 * y_1"), (3, "", "x_2")])
def ssa(spark: SparkSession) -> DataFrame:
    out = ir.renamed([("x", ["1"]), ("y", ["x + z"]), ("x", ["x * y"]), ("", ["x"])])
    return spark.createDataFrame([(n, t, ", ".join(a)) for n, (t, a) in enumerate(out)], "position int, target string, args string")


@due("name string, low double, high double", [("x", 0.0, 3.0), ("y", 1.0, 4.0), ("z", -8.0, -2.0)])
def intervals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in ir.intervals("y = x + 1\nz = y * -2", {"x": (0, 3)}).items()], "name string, low double, high double")


@due("position int, problem string, name string", [(2, "use_after_free", "p"), (3, "double_free", "p"), (6, "self_deadlock", "m"), (7, "leak", "q")])
def lifetimes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ir.lifetimes([("alloc", "p"), ("free", "p"), ("use", "p"), ("free", "p"), ("alloc", "q"), ("lock", "m"), ("lock", "m")]), "position int, problem string, name string")


@due("path string", [("0-1-3",), ("0-2-3",)])
def flow_paths(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("-".join(map(str, p)),) for p in ir.paths({0: [1, 2], 1: [3], 2: [3], 3: []}, 0)], "path string")


# ---------------------------------------------------------------- rewriting


@due("content string", [("\n\nint x = ((4) > (2) ? (4) : (2));\n\n\n\nA\n\n\n",)])
def macros(spark: SparkSession) -> DataFrame:
    """Macros with arguments; of a condition's branches the first true one stays; every line keeps its number."""
    return transform.expanded_files(_files(spark, {"a.c": "#define MAX(a, b) ((a) > (b) ? (a) : (b))\n#define N 4\nint x = MAX(N, 2);\n#if 0\nZ\n#elif 1\nA\n#else\nB\n#endif"}))


@due("file_path string, result string", [("a.py", "x = ast.literal_eval(y)\nz = yaml.safe_load(f)\nh = hashlib.sha256(b)\nr = requests.get(u)\nr = requests.get(u, timeout=3)\napp.run(debug=False)\ntoken = secrets.choice(abc)\ncolour = random.choice(abc)\n")])
def codemods(spark: SparkSession) -> DataFrame:
    """Calls rewritten by their arguments, sole ones too; the patch is applied to see what it gives."""
    text = "x = eval(y)\nz = yaml.load(f, Loader=L)\nh = hashlib.md5(b)\nr = requests.get(u, verify=False)\nr = requests.get(u, verify=False, timeout=3)\napp.run(debug=True)\ntoken = random.choice(abc)\ncolour = random.choice(abc)\n"
    hits = [(1, "PY-EV"), (2, "PY-YL"), (3, "CRY-001"), (4, "NET-002"), (5, "NET-002"), (6, "DBG-001"), (7, "CRY-003"), (8, "CRY-003")]
    plan = transform.codemod_plan(_files(spark, {"a.py": text, "b.py": "ok"}), spark.createDataFrame([("a.py", *h) for h in hits], "file_path string, line_number int, rule_id string"))
    return transform.each(plan, lambda p: "".join(x[1:] for x in p.splitlines(True)[3:] if x[0] in "+ "), "patch")


@due("name string, result string", [("react", "<p id=\"a\">{html}</p>"), ("html", "e.textContent = x")])
def codemods_of_pages(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([("react", '<p id="a" dangerouslySetInnerHTML={{ __html: html }} />'), ("html", "e.innerHTML = x")], "name string, text string")
    return transform.each(rows, lambda n, t: transform.CODEMODS["react_text_child" if n == "react" else "text_content"](t), "name", "text")


@due("result string", [("Py-YAML==5.4  # x\nother==1\n",), ('{\n  "dependencies": {\n    "a": "^1.2",\n    "b": "2"\n  }\n}',)])
def version_bumps(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([("Py-YAML==5.1  # x\nother==1\n", '{"py_yaml": "5.4"}'), ('{"dependencies": {"a": "^1.0", "b": "2"}}', '{"a": "1.2"}')], "content string, plan string")
    return transform.bumped(rows, "content", "plan")


@due("result string", [('{"a": 1, "l": [{"name": "x", "v": 1, "w": 2}, {"name": "y"}]}',)])
def merges(spark: SparkSession) -> DataFrame:
    """Null deletes, named lists merge by name."""
    return transform.merged(spark.createDataFrame([('{"a": 1, "l": [{"name": "x", "v": 1}], "gone": 2}', '{"l": [{"name": "x", "w": 2}, {"name": "y"}], "gone": null}')], "base string, patch string"), "base", "patch")


@due("template string, result string", [("a: {{ .Values.x.y | quote }} {{ .Release.Name }}", 'a: "1" release'), ("{{ .Values.none | default \"d\" }}", "d"), ("{{ if .Values.x }}", None)])
def templates(spark: SparkSession) -> DataFrame:
    rows = [(t, '{"x": {"y": 1}}') for t in ("a: {{ .Values.x.y | quote }} {{ .Release.Name }}", '{{ .Values.none | default "d" }}', "{{ if .Values.x }}")]
    return transform.rendered(spark.createDataFrame(rows, "template string, vals string"), "template", "vals")


# ---------------------------------------------------------------- infrastructure, interfaces, identities


@due("policy_id string, score int, level string, n_actions int, n_resources int", [("all", 83, "critical", 1, 1), ("few", 6, "low", 2, 2), ("none", 0, "low", 0, 0)])
def iam_policies(spark: SparkSession) -> DataFrame:
    """Actions twice, resources once, 50 and 30 more for a star; Deny counts nothing."""
    docs = {"all": {"Statement": {"Effect": "Allow", "Action": "*", "Resource": "*"}}, "few": {"Statement": [{"Action": ["a", "b"], "Resource": ["r"]}, {"Effect": "allow", "Action": "a", "Resource": "s"}]}, "none": {"Statement": [{"Effect": "Deny", "Action": "*", "Resource": "*"}]}}
    return iac.iam_blast_radius(spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()], "policy_id string, policy string"))


@due("id string, check string, severity string", [("sg", "open_security_group", "HIGH"), ("b", "public_bucket", "CRITICAL"), ("b", "not_encrypted", "HIGH"), ("p", "runs_as_root", "MEDIUM")])
def cis(spark: SparkSession) -> DataFrame:
    rows = [("sg", "aws_security_group", {"cidr_blocks": "0.0.0.0/0"}), ("b", "s3_bucket", {"acl": "public-read", "encrypted": "False"}), ("p", "pod", {}), ("q", "pod", {"run_as_non_root": "true"})]
    return iac.cis_checks(spark.createDataFrame(rows, "id string, kind string, attributes map<string,string>"))


@due("id string, issue string", [("a", "no_hsts"), ("a", "no_csp"), ("a", "no_frame_options"), ("a", "no_nosniff"), ("a", "cors_any_with_credentials"), ("a", "cookie_not_httponly"), ("b", "csp_unsafe_inline")])
def http_headers(spark: SparkSession) -> DataFrame:
    a = {"access-control-allow-origin": "*", "access-control-allow-credentials": "true", "set-cookie": "s=1; Secure"}
    b = {"strict-transport-security": "max-age=1", "content-security-policy": "script-src 'unsafe-inline'; frame-ancestors 'none'", "x-content-type-options": "nosniff"}
    return iac.http_checks(spark.createDataFrame([("a", a), ("b", b)], "id string, headers map<string,string>"))


@due("file_path string, line_number int, issue string", [("a", 1, "latest_tag"), ("a", 2, "add_remote"), ("a", 3, "secret_in_env"), ("a", 0, "runs_as_root"), ("b", 3, "piped_install")])
def dockerfiles(spark: SparkSession) -> DataFrame:
    """The last USER decides about root."""
    return iac.dockerfile_checks(rules.explode_lines(_files(spark, {"a": "FROM x:latest\nADD https://h/f /f\nENV API_TOKEN=abc\nUSER app\nUSER root\n", "b": "FROM x:1\nUSER root\nRUN curl h | sh\nUSER app\n"})))


@due("service string, issue string", [("web", "privileged"), ("web", "writable_root"), ("db", "host_network"), ("api", "writable_root")])
def compose(spark: SparkSession) -> DataFrame:
    files = {"a/compose.yml": "version: '3'\nservices:\n  web:\n    privileged: true\n  db:\n    network_mode: host  # x\n    read_only: true\nvolumes:\n  v:\n", "b/compose.json": '{"services": {"api": {"image": "x"}}}', "c": "- broken"}
    return iac.compose_checks(iac.compose_services(_files(spark, files)))


SPEC = json.dumps({"security": [{"k": []}], "paths": {"/a": {"get": {"operationId": "readA"}, "delete": {"security": [], "operationId": "dropA"}}, "/b": {"post": {}}}})


@due("path string, method string, secured boolean, operation string", [("/a", "get", True, "readA"), ("/a", "delete", False, "dropA"), ("/b", "post", True, "post:/b")])
def openapi(spark: SparkSession) -> DataFrame:
    return iac.openapi_operations(spark.createDataFrame([("s", SPEC)], "spec_id string, spec string"))


@due("operation string, n long", [("readA", 4), ("dropA", 4), ("post:/b", 4)])
def contract_cases(spark: SparkSession) -> DataFrame:
    return iac.contract_cases(openapi(spark)).groupBy("operation").agg(F.countDistinct("mutation").alias("n"))


@due("operation string, issue string", [("dropA", "anonymous_change"), ("post:/b", "no_role")])
def bfla(spark: SparkSession) -> DataFrame:
    return iac.bfla_gaps(openapi(spark), spark.createDataFrame([("user", "readA"), ("anonymous", "readA"), ("anonymous", "dropA")], "role string, operation string"))


@due("id string, action string, message string", [("a", "deny", "no star"), ("a", "warn", "warn owner exists"), ("b", "warn", "not prod")])
def policies(spark: SparkSession) -> DataFrame:
    p = iac.Policy("# rules\ndeny attributes.acl contains * : no star\nwarn owner exists\nwarn env != prod : not prod\n")
    rows = [("a", "prod", "me", {"acl": "x*"}), ("b", "dev", None, {"acl": "x"})]
    return p.evaluate(spark.createDataFrame(rows, "id string, env string, owner string, attributes map<string,string>"))


TEXTS = {
    "android_manifest": '<application android:debuggable="true" android:allowBackup="true">', "mobile_code": "webView.getSettings().setJavaScriptEnabled(true)", "web": '<form method="post"><input></form>', "database": "GRANT ALL ON t TO PUBLIC", "contract": "require(tx.origin == owner);",
    "model": "m = torch.load('w.pt')", "graphql": "type Mutation { drop: Boolean }", "wsdl": '<definitions><soap:address location="http://h/s"/></definitions>', "asyncapi": '{"servers": {"a": {"protocol": "mqtt"}}}', "bicep": "httpsOnly: false", "rego": "default allow := true", "ansible": "validate_certs: no", "nginx": "server_tokens on;", "other": "eval(x)",
}


@due("kind string, issue string", [
    ("android_manifest", "debuggable"), ("android_manifest", "backup_allowed"), ("mobile_code", "webview_javascript"), ("web", "form_without_token"), ("database", "grant_all"), ("database", "public_role"), ("contract", "origin_as_sender"), ("model", "pickle_model"),
    ("graphql", "mutation_without_auth"), ("wsdl", "plain_http"), ("wsdl", "no_policy"), ("asyncapi", "plain_broker"), ("asyncapi", "no_security"), ("bicep", "plain_http"), ("rego", "allow_by_default"), ("ansible", "no_certificate_check"), ("nginx", "server_tokens"),
])
def whole_texts(spark: SparkSession) -> DataFrame:
    return domain.check_texts(spark.createDataFrame([(k, k, t) for k, t in TEXTS.items()] + [("n", "web", None)], "id string, kind string, text string"))


@due("n int, match string, start int", [(0, "ab", 2), (1, "aab", 7)])
def playground(spark: SparkSession) -> DataFrame:
    return domain.matches(spark.createDataFrame([("t", "xab-é-aab"), ("u", None)], "id string, text string"), "a+b")


PLAN = {"planned_values": {"root_module": {"resources": [{"address": "a.x", "type": "bucket", "values": {"acl": "private", "n": 2}, "depends_on": ["a.y"]}], "child_modules": [{"resources": [{"address": "m.z", "type": "vm", "values": {}}]}]}}, "resource_changes": [{"address": "a.x", "change": {"actions": ["delete", "create"]}}, {"address": "m.z", "change": {"actions": ["create"]}}, {"address": "a.y", "change": {"actions": ["create"]}}]}


def _plans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("p", json.dumps(PLAN)), ("broken", "{")], "plan_id string, plan string")


@due("id string, kind string, acl string, n string, requires string", [("a.x", "bucket", "private", "2", "a.y"), ("m.z", "vm", None, None, "")])
def terraform_resources(spark: SparkSession) -> DataFrame:
    r = infrastructure.terraform_resources(_plans(spark))
    return r.select("id", "kind", F.try_element_at("attributes", F.lit("acl")).alias("acl"), F.try_element_at("attributes", F.lit("n")).alias("n"), F.array_join("dependencies", ",").alias("requires"))


@due("action string, addresses string", [("create", "a.y,m.z"), ("delete/create", "a.x")])
def terraform_changes(spark: SparkSession) -> DataFrame:
    return infrastructure.terraform_changes(_plans(spark)).withColumn("addresses", F.array_join("addresses", ","))


@due("src string, dst string, relation string", [("arn:aws:iam::1:user/u", "arn:aws:iam::1:role/r", "AssumeRole")])
def iam_trust(spark: SparkSession) -> DataFrame:
    doc = {"Roles": [{"Arn": "arn:aws:iam::1:role/r", "RoleName": "r", "AssumeRolePolicyDocument": '{"Principal": {"AWS": "arn:aws:iam::1:user/u"}}'}], "Users": [{"Arn": "arn:aws:iam::1:user/u", "UserName": "u"}]}
    return infrastructure.iam_principals(spark.createDataFrame([("t", json.dumps(doc))], "tenant string, doc string"))[1]


DIRECTORY = {"principals": [{"id": "u"}, {"id": "g1", "kind": "group"}, {"id": "admin", "kind": "domain"}], "relationships": [{"source": "u", "target": "g1", "relation": "MemberOf"}, {"source": "g1", "target": "admin", "relation": "GenericAll", "permissions": ["w", "r", "r"]}, {"source": "u", "target": "admin", "relation": "Owner"}, {"source": "g1", "target": "u", "relation": "x"}, {"source": "u", "target": "ghost", "relation": "y"}]}


def _directory(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return infrastructure.directory_graph(spark.createDataFrame([("t", "ad", json.dumps(DIRECTORY))], "tenant string, provider string, doc string"))


def _ends(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return tuple(spark.createDataFrame([("t", x)], "tenant string, node string") for x in ("u", "admin"))


@due("path string, score int", [("u>admin", 20), ("u>g1>admin", 25)])
def escalation(spark: SparkSession) -> DataFrame:
    """20 for relations that hand over control, 5 for others."""
    return graph.escalation_paths(_directory(spark)[1], *_ends(spark), ["tenant"]).withColumn("path", F.array_join("path", ">"))


@due("before long, after long, paths_removed long", [(2, 1, 1)])
def removal(spark: SparkSession) -> DataFrame:
    gone = spark.createDataFrame([("t", "u", "admin", "Owner")], "tenant string, src string, dst string, relation string")
    return graph.simulate_removal(_directory(spark)[1], *_ends(spark), ["tenant"], gone)


@due("item string, body string", [
    ("node", '{"id":"u","type":"user","provider":"ad"}'), ("node", '{"id":"g1","type":"group","provider":"ad"}'), ("node", '{"id":"admin","type":"domain","provider":"ad"}'), ("edge", '{"source":"u","target":"g1","label":"MemberOf","permissions":[]}'),
    ("edge", '{"source":"g1","target":"admin","label":"GenericAll","permissions":["r","w"]}'), ("edge", '{"source":"u","target":"admin","label":"Owner","permissions":[]}'), ("edge", '{"source":"g1","target":"u","label":"x","permissions":[]}'),
])
def identity_graph(spark: SparkSession) -> DataFrame:
    """Edges to unknown principals are left out."""
    return graph.identity_graph(*_directory(spark))


@due("source string, target string, remove string", [("u", "r", "write"), ("v", "r", "read")])
def least_privilege(spark: SparkSession) -> DataFrame:
    edges = spark.createDataFrame([("u", "r", ["read", "write"]), ("v", "r", ["read"]), ("w", "r", [])], "source string, target string, permissions array<string>")
    used = spark.createDataFrame([("u", "read")], "source string, permission string")
    return graph.least_privilege(edges, used).withColumn("remove", F.array_join("remove", ","))


@due("risk string, severity string, principal string", [("no_mfa", "HIGH", "a"), ("synced_admin", "CRITICAL", "a"), ("no_preauthentication", "HIGH", "b"), ("static_secret", "HIGH", "s"), ("global_permission", "CRITICAL", "s"), ("directory_replication", "CRITICAL", "g"), ("mfa_not_for_all", "CRITICAL", "tenant")])
def identity_risks(spark: SparkSession) -> DataFrame:
    doc = {"users": [{"id": "a", "admin": True, "synced": True}, {"name": "b", "mfa": True, "preauth_disabled": True}], "service_principals": [{"id": "s", "secrets": ["x"], "permissions": ["*"]}], "conditional_access": [{"state": "enabled", "require_mfa": True, "covers_all_users": False}], "grants": [{"principal": "g", "permissions": ["Replicating Directory Changes", "Replicating Directory Changes All"]}]}
    return infrastructure.identity_risks(spark.createDataFrame([("t", json.dumps(doc)), ("u", "{}")], "tenant string, doc string"))


# ---------------------------------------------------------------- packages and advisories


@due("name string, marker string", [("internal-x", "internal-"), ("my-Private", "-private"), ("@scope/corp-x", "corp-")])
def private_names(spark: SparkSession) -> DataFrame:
    """Names that begin with @ and have no slash are exempt."""
    rows = spark.createDataFrame([(n,) for n in ("internal-x", "my-Private", "@scope/corp-x", "@corp-x", "local", "intranet")], "name string")
    return rows.withColumn("marker", deps.confusion_marker(F.col("name"))).where("marker is not null")


@due("name string, concern string", [("PyQt5", "GPL-3.0"), ("x", "AGPL-3.0-only")])
def licences(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([("PyQt5", None), ("x", "AGPL-3.0-only"), ("y", "LGPL-2.1"), ("z", "MIT"), ("w", None)], "name string, declared string")
    return rows.withColumn("concern", deps.licence_concern(F.col("name"), F.col("declared"))).where("concern is not null")


@due("name string, days int", [("old", 1000), ("unknown", None)])
def abandoned(spark: SparkSession) -> DataFrame:
    packages = spark.createDataFrame([("npm", n) for n in ("old", "new", "unknown", None)], "ecosystem string, name string")
    releases = spark.createDataFrame([("npm", "old", dt.date(2021, 4, 6)), ("npm", "old", dt.date(2020, 1, 1)), ("npm", "new", dt.date(2023, 12, 31))], "ecosystem string, name string, released_at date")
    return deps.abandoned(packages, releases, "2024-01-01")


@due("cve_id string, severity string, fixed string", [("O1", "CRITICAL", "1.2"), ("O2", "MEDIUM", ""), ("O3", "HIGH", "3")])
def osv(spark: SparkSession) -> DataFrame:
    docs = [
        {"id": "O1", "severity": [{"score": "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"}], "affected": [{"ranges": [{"events": [{"introduced": "0"}, {"fixed": "1.2"}]}]}]},
        {"id": "O2", "database_specific": {"severity": "moderate"}}, {"id": "O3", "severity": [{"score": "7.5"}], "affected": [{"ranges": [{"events": [{"fixed": "3"}]}]}]},
    ]
    return deps.osv_entries(spark.createDataFrame([(json.dumps(d),) for d in docs], "osv_json string"))


@due("line_number int, package string, severity string", [(1, "a", "LOW"), (2, "b", "MEDIUM")])
def requirements_pinned(spark: SparkSession) -> DataFrame:
    return deps.unpinned(rules.explode_lines(_files(spark, {"r.txt": "a==1.0\nb>=2\nc==1 --hash=sha256:ab\n# d\n-r x.txt\n"})))


@due("name string, cve_id string", [("PyYAML", "CVE-2020-14343"), ("log4j.core", "CVE-2021-44228"), ("flask", "CVE-2023-30861")])
def advisories(spark: SparkSession) -> DataFrame:
    """Built-in advisories; a package without a version is older than any."""
    p = spark.createDataFrame([("PyYAML", "5.3"), ("django", "4.0"), ("log4j.core", "2.14.1"), ("flask", None)], "name string, version string")
    return deps.vulnerable(p, deps.advisories(spark))


@due("name string, popular string, distance int", [("reqeusts", "requests", 2), ("numpyy", "numpy", 1), ("raills", "rails", 1)])
def look_alikes(spark: SparkSession) -> DataFrame:
    rows = [("pypi", "reqeusts"), ("pypi", "requests"), ("pypi", "numpyy"), ("gem", "raills"), ("npm", "raills"), ("pypi", None)]
    return deps.typosquats(spark.createDataFrame(rows, "ecosystem string, name string"), deps.popular_table(spark))


# ---------------------------------------------------------------- ranking, reports, sinks, binaries


@due("precision double, recall double, f1 double", [(0.5, 0.5, 0.5)])
def precision(spark: SparkSession) -> DataFrame:
    return triage.precision_recall(spark.createDataFrame([(["a", "b"], ["a", "c"])], "expected array<string>, actual array<string>"))


@due("examples string, pattern string", [("os.system", "\\b(?:os\\.system)\\b")])
def synthesis(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("os.system", triage.synthesise_rule(["os.system(cmd)", "os.system(x)"], ["print(cmd)"]))], "examples string, pattern string")


@due("is_real boolean, sure boolean", [(True, True), (False, False)])
def triage_model(spark: SparkSession) -> DataFrame:
    """Fitted on reviewed findings whose severity and confidence tell; real ones come out likely, others unlikely."""
    rows = [(n, "HIGH" if n % 2 else "LOW", "HIGH" if n % 2 else "LOW", "a.py", False, bool(n % 2)) for n in range(60)]
    df = spark.createDataFrame(rows, "row_id long, severity string, confidence string, file_path string, in_comment boolean, is_real boolean")
    return df.groupBy("is_real").agg((F.avg(triage.FalsePositiveModel().fit(df).probability()) > 0.5).alias("sure"))


@due("cwe string, text string", [("CWE-79", "Unescaped content can run script in another person's browser."), ("CWE-1", "d"), (None, "Security risk detected.")])
def explanations(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([("CWE-79", "d"), ("CWE-1", "d"), (None, None)], "cwe string, description string")
    return rows.select("cwe", triage.explanation(F.col("cwe"), F.lit("R"), F.col("description"), F.lit(None).cast("string")).alias("text"))


@due("team string, maturity double, level string", [("a", 4.0, "managed"), ("b", 0.0, "initial")])
def maturity(spark: SparkSession) -> DataFrame:
    return reports.maturity(spark.createDataFrame([("a", 9.0, 3.0), ("b", None, -1.0)], "team string, design double, operations double"), ["design", "operations"])


def _found(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("R1", "Bad <thing>", "HIGH", "a|b.py", 3), ("R2", None, "LOW", "c.py", None)], "rule_id string, name string, severity string, file_path string, line_number int")


@due("rule_id string, text string", [
    ("R1", '{"ruleId":"R1","level":"error","message":{"text":"Bad <thing>"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"a|b.py"},"region":{"startLine":3}}}]}'),
    ("R2", '{"ruleId":"R2","level":"note","message":{"text":"R2"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"c.py"},"region":{"startLine":1}}}]}'),
])
def sarif_rows(spark: SparkSession) -> DataFrame:
    return _found(spark).select("rule_id", export.sarif_result(_found(spark)).alias("text"))


@due("rule_id string, text string", [("R1", '{"rule_id":"R1","name":"Bad <thing>","severity":"HIGH","file_path":"a|b.py","line_number":3}'), ("R2", '{"rule_id":"R2","name":null,"severity":"LOW","file_path":"c.py","line_number":null}')])
def json_rows(spark: SparkSession) -> DataFrame:
    return _found(spark).select("rule_id", export.finding_json(_found(spark)).alias("text"))


@due("rule_id string, text string", [("R1", '<testcase classname="a|b.py" name="R1:3"><failure message="Bad &lt;thing&gt;"/></testcase>'), ("R2", '<testcase classname="c.py" name="R2"><system-out></system-out></testcase>')])
def junit_rows(spark: SparkSession) -> DataFrame:
    return _found(spark).select("rule_id", export.junit_case(_found(spark)).alias("text"))


@due("rule_id string, text string", [("R1", "| HIGH | R1 | a b.py | 3 | Bad <thing> |"), ("R2", "| LOW | R2 | c.py |  |  |")])
def markdown_rows(spark: SparkSession) -> DataFrame:
    return _found(spark).select("rule_id", export.markdown_row(_found(spark)).alias("text"))


@due("path string, line int, body string", [("a|b.py", 3, "**HIGH** R1: Bad <thing>"), ("c.py", None, "**LOW** R2: ")])
def review_comments(spark: SparkSession) -> DataFrame:
    return export.review_comments(_found(spark))


@due("payload string", [('{"fields":{"project":{"key":"P"},"summary":"[R1] Bad <thing>","issuetype":{"name":"Bug"}}}',), ('{"fields":{"project":{"key":"P"},"summary":"[R2] ","issuetype":{"name":"Bug"}}}',)])
def issue_payloads(spark: SparkSession) -> DataFrame:
    return export.issue_payloads(_found(spark), "P")


@due("name string, text string", [("a", '{"type":"library","name":"a","version":"1","purl":"pkg:pypi/a@1"}')])
def cyclonedx_rows(spark: SparkSession) -> DataFrame:
    parts = spark.createDataFrame([("a", "1", "pkg:pypi/a@1")], "name string, version string, purl string")
    return parts.select("name", export.cyclonedx_component(parts).alias("text"))


@due("rule_id string, severity string, line_number int", [("R1", "HIGH", 3), ("R2", "LOW", None)])
def csv_round_trip(spark: SparkSession) -> DataFrame:
    """Written as CSV and read back, quotes and nulls kept."""
    path = work_path(spark, "csv")
    export.write_csv(_found(spark), path)
    return spark.read.csv(path, header=True, schema="rule_id string, name string, severity string, file_path string, line_number int")


@due("what string, holds boolean", [("signature", True), ("changed", False), ("attestation", True), ("other key", False)])
def signatures(spark: SparkSession) -> DataFrame:
    s, doc = export.sign(b"data", b"key")["hmac_sha256"], export.attestation("x", b"data", b"key")
    rows = [("signature", export.verify(b"data", s, b"key")), ("changed", export.verify(b"date", s, b"key")), ("attestation", export.verify_attestation(doc, b"key")), ("other key", export.verify_attestation(doc, b"other"))]
    return spark.createDataFrame(rows, "what string, holds boolean")


@due("file_path string, entry string, text string", [("a.bin", "", "abcdef\nghijkl"), ("b.pdf", "", "hidden text"), ("c.zip", "in.txt", "secret words")])
def binaries(spark: SparkSession) -> DataFrame:
    """Printable runs of both widths, deflated PDF streams, archive entries (those that leave the archive are skipped)."""
    import io
    import zipfile
    import zlib

    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("in.txt", "secret words")
        z.writestr("../evil", "outside words")
    rows = [("a.bin", b"\x00abcdef\x01g\x00h\x00i\x00j\x00k\x00l\x00"), ("b.pdf", b"stream\n" + zlib.compress(b"(hidden text)") + b"endstream"), ("c.zip", buf.getvalue())]
    return binary.extracted_text(spark.createDataFrame([(p, bytearray(x)) for p, x in rows], "file_path string, content binary"))


@due("line int, key string, value string", [(2, "A", "b"), (3, "C", "d e")])
def env_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(binary.env_pairs("# c\nexport A='b'\nC=d e\n"), "line int, key string, value string")


@due("file_path string, rule_id string", [("a.py", "PY-EV")])
def watched_folder(spark: SparkSession) -> DataFrame:
    """A folder scanned as a stream, twice: the second run meets nothing new."""
    from scanloom.streaming import watch

    folder = work_path(spark, "watched")
    out = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/src/a.py")
    fs = out.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.create(out, True)
    stream.write(bytearray(b"x = eval(y)\n"))
    stream.close()
    for _ in range(2):
        watch.watch(spark, f"{folder}/src", f"{folder}/store", f"{folder}/checkpoint", once=True).awaitTermination()
    return watch.IncrementalStore(spark, f"{folder}/store").output().withColumn("file_path", F.regexp_extract("file_path", "[^/]*$", 0))
