"""Line rules: a table of regular expressions applied to lines of files.

Rules are literals in the plan: per chunk of rules one array of conditions is built, so that each pattern is
compiled once per task and the lines are read once; only rule numbers leave the array, and the rules' other
columns are joined at the end from a small table.  An alternation of all positive patterns is no prefilter here
because look-arounds rarely share prefixes; instead each chunk's conditions short-circuit on the language.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from scanloom.functions.paths import basename, extension, path_form
from scanloom.functions.text import split_lines

#: Longer lines are not matched; rules per array of conditions.
MAX_LINE, CHUNK = 2000, 24


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    severity: str
    category: str
    pattern: str
    language: str = "*"
    cwe: str | None = None
    confidence: str = "MEDIUM"
    negative: str | None = None
    multiline: bool = False
    depends_on: str | None = None
    remediation: str = ""


def _r(id_, name, sev, cat, pattern, lang="*", cwe=None, conf="MEDIUM", neg=None, **kw) -> Rule:
    return Rule(id_, name, sev, cat, pattern, lang, cwe, conf, neg, **kw)


#: A general rule set of our own; ``language`` * holds for every file.
RULES: tuple[Rule, ...] = (
    _r("SEC-001", "Hard-coded password", "HIGH", "Hardcoded Secrets", r"(?i)\b(?:password|passwd|pwd|senha|clave)\b[\"']?\s*(?:=>|:=|=|:)\s*[\"'][^\"'\s$<{]{6,}[\"']", cwe="CWE-798", neg=r"(?i)example|changeme|getenv|environ"),
    _r("SEC-002", "Cloud access key", "CRITICAL", "Hardcoded Secrets", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b", cwe="CWE-798", conf="HIGH"),
    _r("SEC-003", "Private key block", "CRITICAL", "Hardcoded Secrets", r"-----BEGIN [A-Z ]*PRIVATE KEY", cwe="CWE-321", conf="HIGH"),
    _r("SEC-004", "Forge token", "CRITICAL", "Hardcoded Secrets", r"\bgh[pousr]_[A-Za-z0-9]{36}\b", cwe="CWE-798", conf="HIGH"),
    _r("SEC-005", "Credentials in URL", "HIGH", "Hardcoded Secrets", r"[a-z][a-z0-9+.]*://[^/\s:@\"']+:[^/\s:@\"'{$]+@", cwe="CWE-522"),
    _r("SEC-006", "Long secret literal", "HIGH", "Hardcoded Secrets", r"(?i)(?:secret|token|api_?key)\w*\s*(?:=|:)\s*[\"'][A-Za-z0-9_\-+/=]{16,}[\"']", cwe="CWE-798"),
    _r("NET-001", "Plain HTTP", "LOW", "Cryptography", r"http://[a-z0-9.-]+", cwe="CWE-319", neg=r"localhost|127[.]0[.]0[.]1|schemas?[.]|www[.]w3[.]org"),
    _r("NET-002", "Certificate check off", "HIGH", "Cryptography", r"(?i)verify\s*=\s*False|InsecureSkipVerify:\s*true|rejectUnauthorized:\s*false|CURLOPT_SSL_VERIFYPEER,\s*(?:0|false)|curl\s+(?:-\w*k|--insecure)", cwe="CWE-295", conf="HIGH"),
    _r("NET-003", "IP address literal", "INFO", "Information Disclosure", r"\b(?:[0-9]{1,3}[.]){3}[0-9]{1,3}\b", cwe="CWE-200", conf="LOW", neg=r"127[.]0[.]0[.]1|0[.]0[.]0[.]0"),
    _r("NET-004", "Bound to all interfaces", "MEDIUM", "Security Misconfiguration", r"[\"']0[.]0[.]0[.]0[\"']", cwe="CWE-605"),
    _r("CRY-001", "Weak hash", "MEDIUM", "Cryptography", r"(?i)\b(?:md5|sha1)\s*\(|getInstance\(\"(?:MD5|SHA-?1)\"|hashlib[.](?:md5|sha1)", cwe="CWE-327", conf="HIGH"),
    _r("CRY-002", "Weak cipher", "HIGH", "Cryptography", r"(?i)\b(?:DES|RC4|ECB)\b.*cipher|cipher.*\b(?:DES|RC4|ECB)\b", cwe="CWE-327"),
    _r("CRY-003", "Predictable random", "LOW", "Weak Randomness", r"\brandom[.](?:random|randint|choice)\(|Math[.]random\(|\bmt_rand\(|new Random\(", cwe="CWE-338", conf="LOW"),
    _r("DBG-001", "Debug left on", "MEDIUM", "Security Misconfiguration", r"(?i)\bdebug\s*[=:]\s*true\b", cwe="CWE-489"),
    _r("DBG-002", "Open task", "INFO", "Technical Debt", r"\b(?:TODO|FIXME|HACK|XXX)\b", cwe="CWE-1164", conf="LOW"),
    _r("LOG-001", "Secret in log", "MEDIUM", "Information Disclosure", r"(?i)(?:log\w*|print\w*|console)[.(].*(?:password|secret|token)", cwe="CWE-532"),
    _r("PY-EV", "Dynamic evaluation", "CRITICAL", "Code Injection", r"\b(?:eval|exec)\s*\(", "Python", "CWE-95", "HIGH", r"literal_eval|[.]eval\(\)"),
    _r("PY-SH", "Shell command", "HIGH", "Command Injection", r"os[.](?:system|popen)\(|subprocess[.]\w+\(.*shell\s*=\s*True", "Python", "CWE-78", "HIGH"),
    _r("PY-PK", "Unsafe deserialisation", "CRITICAL", "Insecure Deserialization", r"\b(?:c?[Pp]ickle|marshal|shelve)[.](?:loads?|open)\(", "Python", "CWE-502", "HIGH"),
    _r("PY-YL", "Unsafe YAML load", "HIGH", "Insecure Deserialization", r"\byaml[.]load\(", "Python", "CWE-502", "HIGH", r"SafeLoader|safe_load"),
    _r("PY-SQ", "SQL built from text", "HIGH", "SQL Injection", r"(?i)execute\(\s*(?:f[\"']|[\"'].*[\"']\s*(?:%|[+])|.*[.]format\()", "Python", "CWE-89", "HIGH"),
    _r("PY-TM", "Predictable temp file", "MEDIUM", "Race Condition", r"tempfile[.]mktemp\(", "Python", "CWE-377", "HIGH"),
    _r("PY-AS", "Assertion as check", "LOW", "Improper Validation", r"^\s*assert\s+", "Python", "CWE-617", "LOW"),
    _r("PY-BX", "Bare except", "LOW", "Error Handling", r"^\s*except\s*:", "Python", "CWE-703"),
    _r("JS-EV", "Dynamic evaluation", "CRITICAL", "Code Injection", r"\beval\s*\(|new Function\s*\(", "JavaScript", "CWE-95", "HIGH"),
    _r("JS-IH", "HTML written from data", "HIGH", "Cross-Site Scripting", r"[.](?:inner|outer)HTML\s*[+]?=|document[.]write\(|dangerouslySetInnerHTML", "JavaScript", "CWE-79"),
    _r("JS-CP", "Shell command", "HIGH", "Command Injection", r"child_process|\bexec(?:Sync)?\(\s*[`\"'].*\$\{", "JavaScript", "CWE-78"),
    _r("JS-PP", "Prototype changed", "HIGH", "Prototype Pollution", r"__proto__|constructor[.]prototype", "JavaScript", "CWE-1321"),
    _r("JV-RT", "Shell command", "HIGH", "Command Injection", r"Runtime[.]getRuntime\(\)[.]exec\(", "Java", "CWE-78", "HIGH"),
    _r("JV-OS", "Object stream read", "HIGH", "Insecure Deserialization", r"new ObjectInputStream\(|readObject\(\)", "Java", "CWE-502", "HIGH"),
    _r("JV-SQ", "SQL built from text", "HIGH", "SQL Injection", r"(?i)execute(?:Query|Update)?\(\s*\".*\"\s*[+]", "Java", "CWE-89", "HIGH"),
    _r("JV-XX", "XML parser without limits", "MEDIUM", "XXE", r"DocumentBuilderFactory[.]newInstance\(|SAXParserFactory[.]newInstance\(", "Java", "CWE-611"),
    _r("PH-EV", "Dynamic evaluation", "CRITICAL", "Code Injection", r"\beval\s*\(|\bassert\s*\(\s*\$", "PHP", "CWE-95", "HIGH"),
    _r("PH-SH", "Shell command", "CRITICAL", "Command Injection", r"\b(?:system|shell_exec|passthru|popen|exec)\s*\(\s*.*\$", "PHP", "CWE-78", "HIGH"),
    _r("PH-IN", "File chosen by request", "CRITICAL", "Path Traversal", r"\b(?:include|require)(?:_once)?\s*\(?\s*\$_(?:GET|POST|REQUEST)", "PHP", "CWE-98", "HIGH"),
    _r("PH-UN", "Unsafe deserialisation", "CRITICAL", "Insecure Deserialization", r"\bunserialize\s*\(", "PHP", "CWE-502", "HIGH"),
    _r("PH-XS", "Request echoed", "HIGH", "Cross-Site Scripting", r"\becho\b.*\$_(?:GET|POST|REQUEST|COOKIE)", "PHP", "CWE-79", "HIGH", r"htmlspecialchars|htmlentities"),
    _r("GO-SH", "Shell command", "HIGH", "Command Injection", r"exec[.]Command\(\s*\"(?:sh|bash)\"", "Go", "CWE-78"),
    _r("GO-SQ", "SQL built from text", "HIGH", "SQL Injection", r"(?i)[.](?:Query|Exec)\w*\(\s*(?:\".*\"\s*[+]|fmt[.]Sprintf)", "Go", "CWE-89", "HIGH"),
    _r("RB-EV", "Dynamic evaluation", "CRITICAL", "Code Injection", r"\b(?:instance_|class_)?eval\b\s*[( ]", "Ruby", "CWE-95"),
    _r("RB-YM", "Unsafe YAML load", "HIGH", "Insecure Deserialization", r"YAML[.]load\b", "Ruby", "CWE-502", "HIGH"),
    _r("CS-BF", "Unsafe deserialisation", "CRITICAL", "Insecure Deserialization", r"new BinaryFormatter\(", "C#", "CWE-502", "HIGH"),
    _r("CC-BF", "Unbounded copy", "HIGH", "Memory Safety", r"\b(?:strcpy|strcat|sprintf|gets)\s*\(", "C", "CWE-120", "HIGH"),
    _r("CC-FM", "Format from data", "CRITICAL", "Memory Safety", r"\bprintf\s*\(\s*[a-z_]\w*\s*\)", "C", "CWE-134"),
    _r("SH-EV", "Evaluated text", "HIGH", "Command Injection", r"\beval\s+[\"']?\$", "Shell", "CWE-78"),
    _r("SH-PI", "Script piped from network", "HIGH", "Supply Chain", r"\b(?:curl|wget)\b[^|]*[|]\s*(?:ba|z)?sh\b", "Shell", "CWE-494", "HIGH"),
    _r("SQ-GR", "Everything granted", "HIGH", "Broken Access Control", r"(?i)\bgrant\s+all\b.*\bto\s+public\b", "SQL", "CWE-732", "HIGH"),
    _r("TF-CI", "Open to the world", "HIGH", "IaC Security", r"cidr_blocks\s*=\s*\[\s*\"0[.]0[.]0[.]0/0\"", "Terraform", "CWE-284", "HIGH"),
    _r("TF-AC", "Public bucket", "HIGH", "IaC Security", r"acl\s*=\s*\"public-read", "Terraform", "CWE-284", "HIGH"),
    _r("DK-RT", "Runs as root", "MEDIUM", "Security Misconfiguration", r"(?i)^\s*USER\s+root\b", "Dockerfile", "CWE-250", "HIGH"),
    _r("DK-LT", "Floating image tag", "LOW", "Supply Chain", r"(?i)^\s*FROM\s+\S+:latest\b", "Dockerfile", "CWE-1104", "HIGH"),
    _r("YM-PR", "Privileged container", "CRITICAL", "Security Misconfiguration", r"\bprivileged:\s*true", "YAML", "CWE-250", "HIGH"),
    _r("HT-BL", "Opener left open", "LOW", "Broken Access Control", r"target=[\"']_blank[\"']", "HTML", "CWE-1022", "HIGH", r"noopener"),
)

# Languages by extension and by name, and their comment markers (line, block start, block end).
LANGUAGES = {
    "Python": "py pyw pyi", "JavaScript": "js jsx mjs cjs", "TypeScript": "ts tsx", "Java": "java", "Kotlin": "kt kts", "Scala": "scala", "Go": "go", "Rust": "rs", "C": "c h", "C++": "cpp cc cxx hpp hh",
    "C#": "cs", "PHP": "php phtml", "Ruby": "rb rake", "Perl": "pl pm", "Swift": "swift", "Objective-C": "m mm", "Shell": "sh bash zsh", "PowerShell": "ps1 psm1", "SQL": "sql ddl", "HTML": "html htm xhtml",
    "CSS": "css scss less", "XML": "xml xsd plist", "YAML": "yaml yml", "JSON": "json", "TOML": "toml", "INI": "ini cfg conf", "Terraform": "tf tfvars", "Dart": "dart", "Lua": "lua", "R": "r", "Julia": "jl",
    "Haskell": "hs", "Elixir": "ex exs", "Erlang": "erl", "Clojure": "clj cljs", "Groovy": "groovy gradle", "Solidity": "sol", "Protobuf": "proto", "GraphQL": "graphql gql", "Markdown": "md", "Text": "txt",
}
SPECIAL_NAMES = {"dockerfile": "Dockerfile", "makefile": "Makefile", "jenkinsfile": "Groovy", "gemfile": "Ruby", "rakefile": "Ruby", "vagrantfile": "Ruby", "cmakelists.txt": "CMake", "podfile": "Ruby"}
SIGNATURES = (
    (r"^#!.*\bpython", "Python"), (r"^#!.*\bnode", "JavaScript"), (r"^#!.*\b(?:ba|z|k)?sh\b", "Shell"), (r"^#!.*\bruby", "Ruby"), (r"^#!.*\bperl", "Perl"), (r"^\s*<\?php", "PHP"), (r"(?i)^\s*<!doctype html|^\s*<html", "HTML"), (r"^\s*<\?xml", "XML"),
    (r"(?m)^package \w+\s*$", "Go"), (r"(?m)^(?:import|from) \w[\w.]*", "Python"), (r"(?m)^#include\s*[<\"]", "C"), (r"(?m)^using System", "C#"), (r"(?m)^public class ", "Java"), (r"(?im)^\s*(?:select|create table|insert into)\b", "SQL"),
)
BINARY_EXTENSIONS = "png jpg jpeg gif bmp ico webp tiff mp3 mp4 avi mov mkv wav flac ogg zip tar gz bz2 xz 7z rar jar war exe dll so dylib o a class pyc pyo wasm ttf otf woff woff2 eot pdf db sqlite bin dat".split()
SKIP_DIRS = ".git .svn .hg node_modules __pycache__ .venv venv env .tox .mypy_cache .pytest_cache dist build target .idea .vscode vendor bower_components coverage .next .nuxt tmp temp".split()
C_STYLE = ("//", "/*", "*/")
COMMENTS = {
    "Python": ("#", '"""', '"""'), "Ruby": ("#", "=begin", "=end"), "Shell": ("#", "", ""), "Perl": ("#", "=pod", "=cut"), "YAML": ("#", "", ""), "TOML": ("#", "", ""), "INI": (";", "", ""), "R": ("#", "", ""), "Julia": ("#", "#=", "=#"),
    "Elixir": ("#", "", ""), "Terraform": ("#", "/*", "*/"), "Dockerfile": ("#", "", ""), "Makefile": ("#", "", ""), "SQL": ("--", "/*", "*/"), "Lua": ("--", "--[[", "]]"), "Haskell": ("--", "{-", "-}"), "HTML": ("<!--", "<!--", "-->"), "XML": ("<!--", "<!--", "-->"),
    "Erlang": ("%", "", ""), "Clojure": (";", "", ""), "PowerShell": ("#", "<#", "#>"), "CSS": ("/*", "/*", "*/"), "Markdown": ("<!--", "<!--", "-->"), "JSON": ("", "", ""),
}


def detect_language(path: Column, content: Column | None = None) -> Column:
    """Binary, then special names, then the extension, then signatures anywhere in the text; else Unknown."""
    ext, name = F.regexp_replace(extension(path), r"^\.", ""), F.lower(basename(path))
    by_ext = _lookup({e: lang for lang, exts in reversed(LANGUAGES.items()) for e in exts.split()}, ext)
    out = F.coalesce(F.when(ext.isin(BINARY_EXTENSIONS), "Unknown"), _lookup(SPECIAL_NAMES, name), by_ext)
    if content is None:
        return F.coalesce(out, F.lit("Unknown"))
    told = None
    for pattern, lang in SIGNATURES:
        told = F.when(content.rlike(pattern), lang) if told is None else told.when(content.rlike(pattern), lang)
    return F.coalesce(out, told, F.lit("Unknown"))


def _lookup(table: dict[str, str], key: Column) -> Column:
    """A constant table's value for a key, null if it has none; one map literal, where a chain of cases would swell the generated code."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def is_scannable(path: Column) -> Column:
    """No binary extension and no skipped directory in the path."""
    dirs = F.slice(F.split(path_form(path), "/"), 1, F.size(F.split(path_form(path), "/")) - 1)
    return ~F.regexp_replace(extension(path), r"^\.", "").isin(BINARY_EXTENSIONS) & ~F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in SKIP_DIRS]))


def explode_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """Files' columns without the text, plus line_number (from 1) and line."""
    keep = [c for c in files.columns if c != content]
    return files.select(*keep, F.posexplode(split_lines(F.col(content))).alias("_n", "line")).withColumn("line_number", F.col("_n") + 1).drop("_n")


def comment_marker(language: Column, which: int) -> Column:
    return F.coalesce(_lookup({lang: marks[which] for lang, marks in COMMENTS.items()}, language), F.lit(C_STYLE[which]))


def comment_state(lines: DataFrame) -> DataFrame:
    """Adds in_comment and block_end: the state of block comments carried down each file.

    A line is inside if the last marker line before it opened a block; a line with the end marker is flagged
    block_end.  The window runs over a file's lines.
    """
    start, end, one = (comment_marker(F.col("language"), n) for n in (1, 2, 0))
    has_end = (end != "") & F.contains(F.col("line"), end) & ~((start == end) & (F.length(F.col("line")) - F.length(F.replace(F.col("line"), end, F.lit(""))) >= 2 * F.length(end)))
    opens = (start != "") & F.contains(F.col("line"), start) & ~has_end
    marked = lines.withColumns({"block_end": has_end, "_event": F.when(has_end, 0).when(opens, 1)})
    w = W.partitionBy("file_path").orderBy("line_number")
    state = F.coalesce(F.last("_event", True).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    text = F.ltrim("line")
    in_line = (one != "") & F.startswith(text, one)
    return marked.withColumn("in_comment", in_line | (state == 1) | (F.col("_event") == 1).eqNullSafe(True) & F.startswith(text, start)).drop("_event")


def suppressed_inline(line: Column, rule_id: Column) -> Column:
    """A line that says ``scanloom: ignore ID`` (or ALL or *)."""
    named = F.upper(F.regexp_extract(line, r"(?i)(?:scanloom|nosec)\s*:\s*ignore\s+([\w*-]+)", 1))
    return named.isin("ALL", "*") | (named == F.upper(rule_id))


def suppress_globally(found: DataFrame, suppress: DataFrame) -> DataFrame:
    """Findings that no row of ``suppress`` (rule_id, file_name; null: everywhere) names."""
    found = found.join(suppress.where("file_name is null").select("rule_id"), "rule_id", "left_anti")
    return found.withColumn("file_name", basename(F.col("file_path"))).join(suppress.where("file_name is not null"), ["rule_id", "file_name"], "left_anti").drop("file_name")


def rule_table(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    rows = [(n, *[asdict(r)[c] for c in ("id", "name", "severity", "category", "language", "cwe", "confidence", "depends_on", "remediation")]) for n, r in enumerate(rules)]
    return spark.createDataFrame(rows, "ord int, rule_id string, name string, severity string, category string, rule_language string, cwe string, confidence string, depends_on string, remediation string")


def load_rules(text: str) -> tuple[Rule, ...]:
    """Rules from a JSON list (``ignorecase`` is folded into the pattern); entries without id or pattern are left out."""
    out = []
    for e in json.loads(text):
        if not isinstance(e, dict) or not e.get("id") or not e.get("pattern"):
            continue
        flags = "(?i)" if e.get("ignorecase") else ""
        out.append(Rule(str(e["id"]), e.get("name", e["id"]), str(e.get("severity", "MEDIUM")).upper(), e.get("category", "Other"), flags + e["pattern"], e.get("language", "*"), e.get("cwe"), str(e.get("confidence", "MEDIUM")).upper(), e.get("negative_pattern"), bool(e.get("multiline")), e.get("depends_on"), e.get("remediation", "")))
    return tuple(out)


def load_rules_file(path: str) -> tuple[Rule, ...]:
    return load_rules(Path(path).read_text(encoding="utf-8"))


def override_severities(rules: tuple[Rule, ...], overrides: dict[str, str]) -> tuple[Rule, ...]:
    """Rules with other severities; unknown names of severities are ignored."""
    known = {"CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"}
    return tuple(replace(r, severity=overrides[r.id].upper()) if overrides.get(r.id, "").upper() in known else r for r in rules)


def match_lines(lines: DataFrame, rules: tuple[Rule, ...] = RULES, chunk: int = CHUNK) -> DataFrame:
    """Lines times the single-line rules they match: the lines' columns and ``ord``, the rule's number.

    Lines longer than MAX_LINE match nothing.  Empty and null lines match nothing.
    """
    single = [(n, r) for n, r in enumerate(rules) if not r.multiline]
    line, short = F.col("line"), F.length("line").between(1, MAX_LINE)

    def condition(r: Rule) -> Column:
        c = line.rlike(r.pattern)
        if r.language != "*":
            langs = [r.language, "TypeScript"] if r.language == "JavaScript" else [r.language]
            c = F.col("language").isin(langs) & c
        return c & ~line.rlike(r.negative) if r.negative else c

    arrays = [
        F.array_compact(F.array(*[F.when(short & condition(r), F.lit(n)) for n, r in single[k : k + chunk]])) for k in range(0, len(single), chunk)
    ]
    return lines.withColumn("ord", F.explode(reduce(lambda a, b: F.concat(a, b), arrays)))


def match_texts(files: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """file_path, language, ord, line_number of multi-line rules' matches over whole texts (``.`` spans lines)."""
    many = [(n, r) for n, r in enumerate(rules) if r.multiline]
    parts = []
    for n, r in many:
        hits = files.where(F.col("language").isin(r.language, r.language if r.language != "*" else "") | F.lit(r.language == "*")).where(F.col("content").rlike("(?ms)" + r.pattern))
        # each match's line: line ends before it, found by cutting the text at the matches
        pieces = F.split("content", "(?ms)" + r.pattern, -1)
        found = F.regexp_extract_all(F.col("content"), F.lit("(?ms)" + r.pattern), F.lit(0))
        ends = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
        hits = hits.withColumns({"_p": pieces, "_f": found}).select("file_path", "language", "_p", "_f", F.posexplode("_f").alias("_n", "_m"))
        before = F.aggregate(F.slice("_p", 1, F.col("_n") + 1), F.lit(0), lambda a, x: a + ends(x)) + F.aggregate(F.slice("_f", 1, F.col("_n")), F.lit(0), lambda a, x: a + ends(x))
        parts.append(hits.select("file_path", "language", F.lit(n).alias("ord"), (before + 1).alias("line_number")))
    return reduce(DataFrame.unionByName, parts) if parts else files.select("file_path", "language", F.lit(0).alias("ord"), F.lit(1).alias("line_number")).limit(0)


def scan(files: DataFrame, rules: tuple[Rule, ...] = RULES, suppress: DataFrame | None = None, comments: str = "downgrade", min_rank: int = 0) -> DataFrame:
    """Findings of files (file_path, content): rules over lines with suppression, comment handling and rule dependencies.

    ``suppress``: rule_id, file_name (null: everywhere).  ``comments``: downgrade (findings in comments become INFO), drop or keep.
    One finding per (rule, file, line).  Null content gives no lines, empty files no findings.
    """
    spark = files.sparkSession
    files = files.where("file_path is not null").select(path_form(F.col("file_path")).alias("file_path"), "content").withColumn("language", detect_language(F.col("file_path"), F.col("content")))
    lines = comment_state(explode_lines(files))
    hits = match_lines(lines.where("not block_end"), rules).select("file_path", "language", "line_number", "line", "in_comment", "ord")
    multi = match_texts(files, rules)
    multi = multi.join(lines.select("file_path", "line_number", "line", "in_comment"), ["file_path", "line_number"]).select(hits.columns)
    found = hits.unionByName(multi).join(F.broadcast(rule_table(spark, rules)), "ord")
    found = found.where(~suppressed_inline(F.col("line"), F.col("rule_id")))
    if suppress is not None:
        found = suppress_globally(found, suppress)
    found = found.dropDuplicates(["rule_id", "file_path", "line_number"])
    if any(r.depends_on for r in rules):
        found = resolve_dependencies(found)
    if comments == "drop":
        found = found.where("not in_comment")
    elif comments == "downgrade":
        found = found.withColumn("severity", F.when(F.col("in_comment"), "INFO").otherwise(F.col("severity")))
    if min_rank:
        from scanloom.operators.snapshots import severity_rank

        found = found.where(severity_rank(F.col("severity")) >= min_rank)
    return found.withColumnRenamed("line", "line_content").drop("ord", "rule_language")


def resolve_dependencies(found: DataFrame) -> DataFrame:
    """Keeps a finding of a dependent rule only if the rule it depends on fired earlier in the file (line, then rule order).

    Chains are resolved level by level; the loop ends when nothing is dropped, after at most the chain's length.
    """
    while True:
        first = found.groupBy("file_path", F.col("rule_id").alias("depends_on")).agg(F.min(F.struct("line_number", "ord")).alias("at"))
        kept = found.join(first, ["file_path", "depends_on"], "left").where(F.col("depends_on").isNull() | (F.col("at") < F.struct("line_number", "ord"))).drop("at").select(found.columns)
        from scanloom.workdir import materialise

        kept = materialise(kept, "depends")
        if kept.count() == found.count():
            return kept
        found = kept
