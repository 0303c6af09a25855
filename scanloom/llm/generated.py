"""Files that were not written by hand: tool output, minified code, third-party copies, data as code.

Two kinds of evidence count.  Path rules (vendored directories, build output, generated and minified
suffixes) are expressions over the path.  Notices in file headers are found by one multi-pattern
automaton over every line; a hit is confirmed by the notice's own pattern, so that lines that merely talk
about generated ids or vendors don't count.  Lines that are minified code or data blobs are told by their
shape, never by length alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from scanloom.functions.paths import path_form

# Directory names that hold copies of others' code or tool output.
VENDORED_DIRS = (
    "node_modules", "bower_components", "jspm_packages", "vendor", "vendored", "_vendor", "vendors", "third_party", "third-party", "thirdparty", "third_parties",
    "extern", "external", "externals", "pods", "carthage", "site-packages", "dist-packages", "godeps", "dist", "build", "out", "target", "generated", "generated-sources",
    "__generated__", "autogen", "gen-src", ".venv", "__pycache__",
)

# Names of generated, bundled, minified and lock files.
NAME_PATTERNS = (
    r"[^/]+[.-]min\.(?:js|mjs|cjs|css)", r"[^/]+[.-](?:bundle|chunk|packed|umd|prod)\.(?:js|mjs|css)", r"[^/]+[.-][0-9a-f]{8,32}\.(?:js|css|mjs)",
    r"[^/]+\.(?:generated|gen|g|designer|autogen)\.[a-z0-9]+", r"zz_generated[._].*", r"[^/]*_generated\.[a-z0-9]+", r"[^/]+\.pb(?:\.gw|\.validate)?\.(?:go|js|ts|cc|h|rb|swift|dart)",
    r"[^/]+_pb2?(?:_grpc)?\.(?:py|pyi|js|ts|rb|d\.ts)", r"[^/]+grpc\.(?:java|cs|kt)", r"[^/]+\.(?:js|css)\.map",
    r"package-lock\.json", r"npm-shrinkwrap\.json", r"yarn\.lock", r"pnpm-lock\.yaml", r"composer\.lock", r"gemfile\.lock", r"cargo\.lock", r"poetry\.lock", r"pipfile\.lock", r"go\.sum", r"packages\.lock\.json",
)

# Notices; the stem goes into the automaton, the pattern confirms it (both in lower case).
NOTICES = (
    ("generated by", r"(?:code |file |automatically |auto-?|source |class |parser |was |@)\s*generated (?:code )?by (?:the )?[\w.@/-]+"),
    ("autogenerated", r"auto-?generated (?:by\b|from\b|file\b|code\b)"),
    ("auto-generated", r"auto-generated (?:by\b|from\b|file\b|code\b)|<auto-generated\b"),
    ("@generated", r"@generated\b"),
    ("generated from", r"generated from [\w./\\-]+\.\w+"),
    ("do not edit", r"do not edit(?: this file| manually| directly)?\s*[.!*]*\s*(?:\*/|-->)?\s*$"),
    ("machine-written", r"machine-written by\b"),
    ("machine generated", r"machine generated\b"),
    ("gerado automaticamente", r"gerad[oa] automaticamente por\b"),
    ("generado autom", r"generad[oa] autom[aá]ticamente por\b"),
    ("vendored", r"vendored (?:copy|version|from)\b"),
    ("copied unchanged", r"copied (?:unchanged|verbatim) from\b"),
    ("copied verbatim", r"copied verbatim from\b"),
    ("contributors", r"\(c\) [^|]*\bcontributors\b"),
    ("licensed", r"/\*!?.*\bv?\d+\.\d+.*\blicensed (?:under )?(?:the )?(?:mit|bsd|apache|isc|mpl|gpl|lgpl)\b"),
    ("copyright (c)", r"\w+ v?\d+\.\d+[\d.]* *(?:--|-|\|)? *copyright \(c\) \d{4}.*"),
    ("@license", r"@licen[cs]e\b"),
    ("sourcemappingurl", r"[#@] sourcemappingurl="),
)

#: A line shorter than this is never judged as minified or as a list of decimal numbers, which people do type.
SHAPE_CHARS = 150


def path_is_generated(path: Column) -> Column:
    """Whether the path alone shows it; the first component (the target) is not judged."""
    lower = F.lower(path)
    dirs = "|".join(re.escape(d) for d in VENDORED_DIRS)
    names = "|".join(NAME_PATTERNS)
    return F.coalesce(lower.rlike(f"^[^/]+/(?:[^/]+/)*(?:{dirs})/") | lower.rlike(f"(?:^|/)(?:{names})$"), F.lit(False))


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for n, (stem, _) in enumerate(NOTICES):
        a.add_word(stem, n)
    a.make_automaton()
    return a


_CONFIRM = [re.compile(p) for _, p in NOTICES]
_HEX = re.compile(r"(?<!\w)(?:0x[0-9a-f]{1,8}\s?,\s*){11}0x[0-9a-f]", re.I)
# escapes of bytes; \u escapes also spell hand-written text in other alphabets and need a longer run
_ESCAPES = re.compile(r"(?:\\x[0-9a-f]{2}|\\[0-7]{3}){16}|(?:\\x[0-9a-f]{2}|\\u[0-9a-f]{4}|\\[0-7]{3}){40}", re.I)
_NUMBERS = re.compile(r"(?:-?\d+(?:\.\d+)?(?:e-?\d+)?,\s?){17}-?\d", re.I)
_BASE64 = re.compile(r"[\"'`](?:data:[\w/+.-]+;base64,)?[A-Za-z0-9+/]{140,}={0,2}[\"'`]")
_DENSE = re.compile(r"[;{}(),=&|<>?:!\[\].+*-]")


def is_minified(line: str) -> bool:
    """Dense code: hardly any blanks outside strings, punctuation everywhere, several statements on the line."""
    if len(line) < SHAPE_CHARS:
        return False
    blanks = line.count(" ") + line.count("\t")
    return blanks < 0.08 * len(line) and len(_DENSE.findall(line)) > 0.2 * len(line) and line.count(";") + line.count("},") + line.count("}") >= 5


def is_blob(line: str) -> bool:
    """A literal of bytes, numbers or base64 that no one types."""
    if "PRIVATE KEY" in line or "CERTIFICATE" in line:
        return False
    return bool(_HEX.search(line) or _ESCAPES.search(line) or _BASE64.search(line) or len(line) >= SHAPE_CHARS and _NUMBERS.search(line))


def has_notice(line: str, automaton: ahocorasick.Automaton) -> bool:
    lower = line.lower()
    return any(_CONFIRM[n].search(lower) for _, n in automaton.iter(lower))


def _flag_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    for b in batches:
        found = set()
        for path, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if path not in found and (has_notice(line, automaton) or is_blob(line) or is_minified(line)):
                found.add(path)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string())], names=["file_path"])


def generated_files(files: DataFrame, lines: DataFrame) -> DataFrame:
    """file_path (path form) of the files that are not hand-written, each once.

    ``files``: file_path; ``lines``: file_path, line_content (whole lines, of any snapshot).  Null paths and
    null lines are ignored, empty lines show nothing, lines of unknown files don't count, a file without lines
    is judged by its path.  Lines of files whose path shows it already aren't searched.  Empty tables give no rows.
    """
    files = files.select(path_form(F.col("file_path")).alias("file_path")).where("file_path is not null")
    shown = files.where(path_is_generated(F.col("file_path")))
    todo = (
        lines.select(path_form(F.col("file_path")).alias("file_path"), "line_content")
        .where("file_path is not null and line_content is not null")
        .where(~path_is_generated(F.col("file_path")))
    )
    flagged = todo.mapInArrow(_flag_batches, "file_path string").distinct()
    both = files.where(~path_is_generated(F.col("file_path"))).join(flagged, "file_path", "left_semi")
    return shown.unionByName(both).distinct()
