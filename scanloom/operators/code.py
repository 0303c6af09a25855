"""Operators over ordered lines of files: context, snippets, size, nesting, functions, duplication, taint, fingerprints."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from scanloom.functions.text import BLANK, bind

def _file():
    return W.partitionBy("file_path").orderBy("line_number")

DEFINITION = r"^\s*(?:(?:public|private|protected|static|async|export|final)\s+)*(?:def|class|function|func|fn|interface|struct|module|sub)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)"


def function_context(lines: DataFrame, look_back: int = 60) -> DataFrame:
    """Adds function_context: the nearest definition's name at or above the line within ``look_back`` lines."""
    name = F.regexp_extract("line", DEFINITION, 1)
    return lines.withColumn("function_context", F.last(F.when(name != "", name), True).over(_file().rowsBetween(1 - look_back, 0)))


def snippets(lines: DataFrame, around: int = 3) -> DataFrame:
    """Adds snippet (lines around) and snippet_start_line."""
    w = _file().rowsBetween(-around, around)
    return lines.withColumns({"snippet": F.collect_list("line").over(w), "snippet_start_line": F.min("line_number").over(w)})


def brace_depth(lines: DataFrame) -> DataFrame:
    """Adds depth: open minus closed braces up to and including the line (may fall below zero)."""
    count = lambda c: F.length("line") - F.length(F.replace(F.col("line"), F.lit(c), F.lit("")))
    return lines.withColumn("depth", F.sum(count("{") - count("}")).over(_file().rowsBetween(W.unboundedPreceding, 0)))


def clamped_depth(lines: DataFrame) -> DataFrame:
    """Adds depth clamped at zero: the running sum less its least value so far where that is below zero."""
    raw = brace_depth(lines).withColumnRenamed("depth", "_raw")
    low = F.least(F.min("_raw").over(_file().rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    return raw.withColumn("depth", F.col("_raw") - low).drop("_raw")


def indent_depth(lines: DataFrame, step: int = 4) -> DataFrame:
    expanded = F.replace(F.col("line"), F.lit("\t"), F.lit(" " * step))
    return lines.withColumn("depth", F.when(F.trim("line") == "", 0).otherwise(F.floor((F.length(expanded) - F.length(F.ltrim(expanded))) / step)))


def deep_nesting(lines: DataFrame, limit: int = 5, per_file: int = 5) -> DataFrame:
    """The first lines of each file deeper than ``limit`` (a report of ``per_file`` lines per file)."""
    deep = clamped_depth(lines).where(F.col("depth") > limit)
    return deep.withColumn("_k", F.row_number().over(_file())).where(F.col("_k") <= per_file).drop("_k")


def file_lengths(lines: DataFrame, limit: int = 0) -> DataFrame:
    return lines.groupBy("file_path").agg(F.count("*").alias("n_lines"), F.count_if(~F.col("line").rlike(BLANK)).alias("code_lines")).where(F.col("code_lines") > limit)


# What adds a branch to a function.
BRANCHES = (r"\b(?:if|elif)\b", r"\bfor\b", r"\bwhile\b", r"\b(?:case|when)\b", r"\b(?:catch|except)\b", r"&&|\band\b", r"\|\||\bor\b", r"\?[^.:]*:")


INDENTED = ("Python", "Ruby")
CLASS = r"^\s*(?:(?:public|private|protected|static|abstract|final|export|default)\s+)*class\s+([A-Za-z_]\w*)"


def blocks_of(lines: DataFrame, pattern: str = DEFINITION) -> DataFrame:
    """file_path, name, start_line, line_number, line: the lines of every block that a line matching ``pattern`` opens.

    In Python and Ruby a block ends before the next line that isn't blank and is indented no deeper; elsewhere where its
    first brace is closed, or with its own line where it opens none.  Blocks inside others count with both.  ``lines``:
    file_path, line_number, line and, if known, language (else Python by its suffix).  A file's lines are folded in order.
    """
    language = F.col("language") if "language" in lines.columns else F.when(F.lower("file_path").rlike(r"\.(?:pyw?|rb)$"), "Python").otherwise("other")
    ordered = lines.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("line_number", "line"))).alias("ls"), F.max(language.isin(*INDENTED)).alias("by_indent"))

    def run(batches):
        head = re.compile(pattern)
        for b in batches:
            out = []
            for path, ls, by_indent in zip(b.column("file_path").to_pylist(), b.column("ls").to_pylist(), b.column("by_indent").to_pylist(), strict=True):
                for k, x in enumerate(ls):
                    m = head.match(x["line"] or "")
                    if m:
                        end = (_indent_end if by_indent else _brace_end)(ls, k)
                        out += [(path, m[1], x["line_number"], y["line_number"], y["line"]) for y in ls[k:end]]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (b.schema.field("file_path").type, pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["file_path", "name", "start_line", "line_number", "line"])

    kind = lines.schema["file_path"].dataType.simpleString()
    return ordered.mapInArrow(run, f"file_path {kind}, name string, start_line int, line_number int, line string")


def _indent_end(ls: list[dict], at: int) -> int:
    depth = lambda t: len(t) - len(t.lstrip())
    own = depth(ls[at]["line"])
    return next((k for k in range(at + 1, len(ls)) if (ls[k]["line"] or "").strip() and depth(ls[k]["line"]) <= own), len(ls))


def _brace_end(ls: list[dict], at: int) -> int:
    depth, opened = 0, False
    for k in range(at, len(ls)):
        for c in ls[k]["line"] or "":
            depth += (c == "{") - (c == "}")
            opened |= c == "{"
        if opened and depth <= 0 or not opened and k > at + 1:
            return k + 1 if opened else at + 1
    return len(ls) if opened else at + 1


def functions_of(lines: DataFrame) -> DataFrame:
    """file_path, function, start_line, end_line, n_lines, complexity, params of every definition, by the ends that ``blocks_of`` finds."""
    branch = sum((F.col("line").rlike(p).cast("int") for p in BRANCHES), F.lit(0))
    marked = blocks_of(lines).withColumns({"_branch": branch, "_code": (~F.col("line").rlike(BLANK)).cast("int")})
    return (
        marked.groupBy("file_path", F.col("name").alias("function"), "start_line")
        .agg(F.max("line_number").alias("end_line"), F.sum("_code").alias("n_lines"), (F.sum("_branch") + 1).alias("complexity"), F.min_by("line", "line_number").alias("_head"))
        .withColumn("params", F.size(F.filter(F.transform(F.split(F.regexp_extract("_head", r"\(([^)]*)\)", 1), ","), lambda p: F.trim(p)), lambda p: ~p.isin("", "self", "cls", "this"))))
        .drop("_head")
    )


def god_classes(lines: DataFrame, max_methods: int = 20) -> DataFrame:
    """file_path, class, start_line, methods of classes with more than ``max_methods`` definitions in their block."""
    inside = blocks_of(lines, CLASS).where("line_number > start_line").where(F.col("line").rlike(DEFINITION))
    return inside.groupBy("file_path", F.col("name").alias("class"), "start_line").agg(F.count("*").alias("methods")).where(F.col("methods") > max_methods)


def complexity_findings(functions: DataFrame, max_lines: int = 50, max_complexity: int = 10, max_params: int = 5) -> DataFrame:
    rules = F.array_compact(
        F.array(
            F.when(F.col("n_lines") > max_lines, F.struct(F.lit("CMPLX-002").alias("rule_id"), F.lit("MEDIUM").alias("severity"))),
            F.when(F.col("complexity") > max_complexity, F.struct(F.lit("CMPLX-003").alias("rule_id"), F.when(F.col("complexity") > 15, "HIGH").otherwise("MEDIUM").alias("severity"))),
            F.when(F.col("params") > max_params, F.struct(F.lit("CMPLX-004").alias("rule_id"), F.lit("LOW").alias("severity"))),
        )
    )
    return functions.select("file_path", "function", "start_line", F.explode(rules).alias("r")).select("file_path", "function", "start_line", "r.*")


def normal_line(line: Column) -> Column:
    """A line with its literals, case and spacing made equal."""
    x = F.regexp_replace(line, r"\"[^\"]*\"|'[^']*'", "S")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, r"\b[0-9]+\b", "N"), r"\s+", " ")))


def duplicate_blocks(lines: DataFrame, block: int = 5) -> DataFrame:
    """file_path, line_start, duplicate_start, lines_duplicated: maximal runs of lines that occur twice in a file.

    Every window of ``block`` lines becomes one fingerprint; a fingerprint's occurrences are chained to the next
    one at least ``block`` lines on (not paired with all), and hits on one diagonal are merged into a run.  A file's
    copies thus cost one row per occurrence, however often a block repeats.
    """
    x = lines.withColumn("_n", normal_line(F.col("line"))).withColumn("_h", F.md5("_n"))
    ok = (F.col("_n") != "") & ~F.col("_n").rlike(r"^[{}()\[\];,]*$|^(?:#|//|\*|/\*|--)") & (F.size(F.split("_n", " ")) >= 3)
    w = _file().rowsBetween(0, block - 1)
    fp = x.withColumns({"_ok": ok, "_fp": F.md5(F.array_join(F.collect_list("_h").over(w), "|")), "_k": F.count("*").over(w)}).where(F.col("_ok") & (F.col("_k") == block))
    same = W.partitionBy("file_path", "_fp").orderBy("line_number").rangeBetween(block, W.unboundedFollowing)
    pairs = fp.withColumn("duplicate_start", F.min("line_number").over(same)).where("duplicate_start is not null").select("file_path", "line_number", "duplicate_start")
    diag = W.partitionBy("file_path", "_d").orderBy("line_number")
    runs = pairs.withColumn("_d", F.col("duplicate_start") - F.col("line_number")).withColumn("_run", F.col("line_number") - F.row_number().over(diag))
    return runs.groupBy("file_path", "_d", "_run").agg(F.min("line_number").alias("line_start"), F.min("duplicate_start").alias("duplicate_start"), (F.count("*") + block - 1).alias("lines_duplicated")).drop("_d", "_run")


def token_fingerprints(code: Column, n: int = 5) -> Column:
    """Set of SHA-1 hashes of every ``n`` tokens in a row, comments left out."""
    bare = F.regexp_replace(code, r"#[^\n]*|//[^\n]*", "")
    tokens = F.regexp_extract_all(bare, F.lit(r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^ \t\n\r\f\x0B]"), F.lit(0))

    def hashes(t: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1)))
        return F.when(F.size(t) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(at, lambda i: F.sha1(F.array_join(F.slice(t, i, n), "\u001f")))))

    return bind(tokens, hashes)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


# Where untrusted values come from and where they must not go.
SOURCES = r"request[.](?:args|form|values|json|cookies|headers|GET|POST|params|query|body)|\$_(?:GET|POST|REQUEST|COOKIE)|\binput\(|sys[.]argv|req[.](?:query|body|params)|getParameter\(|params\["
SINKS = (
    ("Command Injection", r"(?:os[.](?:system|popen)|subprocess[.]\w+|shell_exec|system|exec|passthru)\s*\((.*)\)"), ("SQL Injection", r"(?:execute|executemany|query|executeQuery|raw)\s*\((.*)\)"),
    ("Code Injection", r"(?:eval|exec|compile)\s*\((.*)\)"), ("Path Traversal", r"(?:open|readFile|include|require|send_file)\s*\((.*)\)"), ("Cross-Site Scripting", r"(?:render_template_string|innerHTML\s*=|document[.]write|echo)\s*\(?(.*)\)?"),
)


def taint_findings(lines: DataFrame) -> DataFrame:
    """file_path, line_number, category, variable: untrusted values that reach a sink, line by line in each file.

    Each file's lines are folded in order over the set of tainted names: a source taints the assigned name, an
    assignment passes taint on or clears it.  The fold holds one file's lines; files are capped by the reader.
    """
    ordered = lines.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("line_number", "line"))).alias("ls"))
    empty = F.struct(F.array().cast("array<string>").alias("tainted"), F.array().cast("array<struct<line_number:int,category:string,variable:string>>").alias("hits"))

    def step(acc: Column, x: Column) -> Column:
        line = x["line"]
        target = F.regexp_extract(line, r"^\s*(?:const |let |var |my |\$)?\s*\$?([A-Za-z_]\w*)\s*(?::=|=)(?!=)", 1)
        value = F.regexp_replace(line, r"^[^=]*=", "")
        names = F.regexp_extract_all(value, F.lit(r"([A-Za-z_]\w*)"), F.lit(1))
        dirty = line.rlike(SOURCES) | F.arrays_overlap(names, acc["tainted"])
        clean = F.filter(acc["tainted"], lambda n: n != target)
        tainted = F.when(target == "", acc["tainted"]).when(dirty, F.array_union(clean, F.array(target))).otherwise(clean)
        hit = None
        for category, pattern in SINKS:
            args = F.regexp_extract_all(F.regexp_extract(line, pattern, 1), F.lit(r"([A-Za-z_]\w*)"), F.lit(1))
            used = F.array_sort(F.array_intersect(args, acc["tainted"]))
            found = F.struct(x["line_number"].cast("int").alias("line_number"), F.lit(category).alias("category"), F.try_element_at(used, F.lit(1)).alias("variable"))
            hit = F.when(F.size(used) > 0, F.array(found)) if hit is None else hit.when(F.size(used) > 0, F.array(found))
        none = F.array().cast("array<struct<line_number:int,category:string,variable:string>>")
        return F.struct(tainted.alias("tainted"), F.concat(acc["hits"], F.coalesce(hit, none)).alias("hits"))

    folded = ordered.select("file_path", F.aggregate("ls", empty, step)["hits"].alias("hits"))
    return folded.select("file_path", F.explode("hits").alias("h")).select("file_path", "h.*")


def diff_lines(diffs: DataFrame) -> DataFrame:
    """diff_id, file, line, side of unified diffs (diff_id, diff_text): added lines numbered in the new file, removed in the old.

    The current file and hunk are carried down by windows over a diff's lines.
    """
    from scanloom.functions.text import split_lines

    rows = diffs.select("diff_id", F.posexplode(split_lines(F.col("diff_text"))).alias("n", "text"))
    w = W.partitionBy("diff_id").orderBy("n")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    head = lambda g: F.regexp_extract("text", r"^@@ -([0-9]+)(?:,[0-9]+)? \+([0-9]+)(?:,[0-9]+)? @@", g)
    rows = rows.withColumns({"new_at": F.when(head(2) != "", head(2).cast("int")), "old_at": F.when(head(1) != "", head(1).cast("int")), "name": F.when(F.col("text").rlike(r"^\+\+\+ "), F.regexp_replace("text", r"^\+\+\+ (?:b/)?|\t.*$", ""))})
    rows = rows.withColumn("is_head", F.col("text").rlike(r"^(?:\+\+\+|---|@@|diff |index )")).withColumn("hunk", F.count("new_at").over(upto))
    rows = rows.withColumns({"file": F.last("name", True).over(upto), "new_at": F.last("new_at", True).over(upto), "old_at": F.last("old_at", True).over(upto)}).where("hunk > 0 and not is_head")
    inside = W.partitionBy("diff_id", "hunk").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    kind = F.left("text", F.lit(1))
    new_before = F.coalesce(F.sum((kind != "-").cast("int")).over(inside), F.lit(0))
    old_before = F.coalesce(F.sum((kind != "+").cast("int")).over(inside), F.lit(0))
    rows = rows.withColumns({"side": F.when(kind == "+", "added").when(kind == "-", "removed"), "line": F.when(kind == "+", F.col("new_at") + new_before).otherwise(F.col("old_at") + old_before)})
    return rows.where("side is not null").select("diff_id", "file", "line", "side")


def filter_to_diff(findings: DataFrame, diffs: DataFrame) -> DataFrame:
    """Findings on lines that a diff adds, and all findings of files that it doesn't touch.

    A file is one of the diff's if it has the same name; ``diffs``: rows of ``diff_lines``.
    """
    from scanloom.functions.paths import basename

    named = diffs.select(basename(F.col("file")).alias("_name"), "line", "side")
    touched = named.select("_name").distinct().withColumn("_touched", F.lit(True))
    added = named.where("side = 'added'").select("_name", F.col("line").alias("line_number")).distinct().withColumn("_added", F.lit(True))
    rows = findings.withColumn("_name", basename(F.col("file_path"))).join(touched, "_name", "left").join(added, ["_name", "line_number"], "left")
    return rows.where("_touched is null or _added").select(findings.columns)
