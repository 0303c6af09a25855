"""Package manifests and lockfiles as component and edge rows.

Formats are parsed in Arrow batches, one manifest at a time in memory; what a file can't yield is left out rather
than raised.  A component is (name, version, kind, line); kind is the package URL type.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from scanloom.functions.paths import basename
from scanloom.operators.deps import purl

Component = tuple[str, str, str]


def _json(text: str) -> dict:
    try:
        out = json.loads(text)
    except ValueError:
        return {}
    return out if isinstance(out, dict) else {}


def _toml(text: str) -> dict:
    try:
        return tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return {}


def _bare(version: object) -> str:
    m = re.search(r"\d[\w.+-]*", str(version or ""))
    return m.group() if m else ""


def _pairs(text: str, pattern: str, kind: str) -> Iterator[Component]:
    for m in re.finditer(pattern, text, re.M):
        yield m[1], _bare(m[2] if m.lastindex and m.lastindex > 1 else ""), kind


def _sections(text: str, head: str, wanted: Callable[[str], bool]) -> Iterator[str]:
    """Lines below the headings that ``wanted`` accepts."""
    inside = False
    for line in text.splitlines():
        m = re.match(head, line)
        if m:
            inside = wanted(m[1].strip())
        elif inside:
            yield line


def requirements(text: str) -> Iterator[Component]:
    for line in text.splitlines():
        line = re.sub(r"(?:^|\s)#.*$", "", line).split(";")[0].strip()
        m = re.match(r"([A-Za-z0-9][\w.-]*)(?:\[[^\]]*\])?\s*(?:[=~<>!]=?=?\s*([\w.*+!-]+))?", line)
        if m and not line.startswith("-"):
            yield m[1], _bare(m[2]), "pypi"


def package_json(text: str) -> Iterator[Component]:
    doc = _json(text)
    for key in ("dependencies", "devDependencies", "peerDependencies"):
        for n, v in (doc.get(key) or {}).items():
            yield n, _bare(v), "npm"


def pom_xml(text: str) -> Iterator[Component]:
    for block in re.findall(r"<dependency>(.*?)</dependency>", text, re.S):
        get = lambda tag, block=block: (re.search(rf"<{tag}>\s*([^<]+?)\s*</{tag}>", block) or ["", ""])[1]
        if get("artifactId"):
            yield f"{get('groupId')}/{get('artifactId')}".lstrip("/"), _bare(get("version")), "maven"


def cargo_toml(text: str) -> Iterator[Component]:
    doc = _toml(text)
    for key in ("dependencies", "dev-dependencies", "build-dependencies"):
        for n, v in (doc.get(key) or {}).items():
            yield n, _bare(v.get("version") if isinstance(v, dict) else v), "cargo"


def go_mod(text: str) -> Iterator[Component]:
    return _pairs(text, r"^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/[\w./-]+)\s+v(\S+)", "golang")


def csproj(text: str) -> Iterator[Component]:
    return _pairs(text, r"<PackageReference[^>]*Include=\"([^\"]+)\"[^>]*Version=\"([^\"]+)\"", "nuget")


def composer_json(text: str) -> Iterator[Component]:
    doc = _json(text)
    for key in ("require", "require-dev"):
        for n, v in (doc.get(key) or {}).items():
            if n != "php" and not n.startswith("ext-"):
                yield n, _bare(v), "composer"


def composer_lock(text: str) -> Iterator[Component]:
    doc = _json(text)
    for p in [*(doc.get("packages") or []), *(doc.get("packages-dev") or [])]:
        yield p.get("name", ""), str(p.get("version", "")).lstrip("v"), "composer"


def gemfile(text: str) -> Iterator[Component]:
    return _pairs(text, r"^\s*gem\s+['\"]([^'\"]+)['\"](?:\s*,\s*['\"]([^'\"]+)['\"])?", "gem")


def gemfile_lock(text: str) -> Iterator[Component]:
    return _pairs(text, r"^    ([\w.-]+) \(([^)]+)\)\s*$", "gem")


def packages_config(text: str) -> Iterator[Component]:
    return _pairs(text, r"<package\s+id=\"([^\"]+)\"\s+version=\"([^\"]+)\"", "nuget")


def pubspec(text: str) -> Iterator[Component]:
    for line in _sections(text, r"^(\w[\w-]*):\s*$", lambda h: h in ("dependencies", "dev_dependencies")):
        m = re.match(r"^  ([\w-]+):\s*[\"']?\^?([\d][\w.+-]*)?", line)
        if m:
            yield m[1], m[2] or "", "pub"


def package_resolved(text: str) -> Iterator[Component]:
    doc = _json(text)
    for p in doc.get("pins") or (doc.get("object") or {}).get("pins") or []:
        yield p.get("identity") or p.get("package") or "", str((p.get("state") or {}).get("version") or ""), "swift"


def podfile_lock(text: str) -> Iterator[Component]:
    for line in _sections(text, r"^([A-Z][A-Z ]+):", lambda h: h == "PODS"):
        m = re.match(r"^  - \"?([\w+-]+)(?:/[\w+/-]+)? \(([^)]+)\)", line)
        if m:
            yield m[1], m[2], "cocoapods"


def cartfile(text: str) -> Iterator[Component]:
    return _pairs(text, r"^(?:github|git|binary)\s+\"([^\"]+)\"\s+\"([^\"]+)\"", "carthage")


def conanfile(text: str) -> Iterator[Component]:
    for line in _sections(text, r"^\[(\w+)\]", lambda h: h in ("requires", "build_requires")):
        m = re.match(r"^\s*([\w+.-]+)/([\w.+-]+)", line)
        if m:
            yield m[1], m[2], "conan"


def vcpkg(text: str) -> Iterator[Component]:
    for d in _json(text).get("dependencies") or []:
        yield (d, "", "vcpkg") if isinstance(d, str) else (d.get("name", ""), _bare(d.get("version>=")), "vcpkg")


def mix_exs(text: str) -> Iterator[Component]:
    return _pairs(text, r"\{:(\w+),\s*\"([^\"]+)\"", "hex")


def cpanfile(text: str) -> Iterator[Component]:
    return _pairs(text, r"^\s*requires\s+['\"]([^'\"]+)['\"](?:\s*(?:,|=>)\s*['\"]([^'\"]+)['\"])?", "cpan")


def cran(text: str) -> Iterator[Component]:
    fields = dict(re.findall(r"^(Imports|Depends):((?:.*\n?(?:[ \t].*\n?)*))", text, re.M))
    for part in (fields.get("Imports") or fields.get("Depends") or "").split(","):
        m = re.match(r"\s*([\w.]+)\s*(?:\(([^)]*)\))?", part)
        if m and m[1] != "R":
            yield m[1], _bare(m[2]), "cran"


def conda(text: str) -> Iterator[Component]:
    for m in re.finditer(r"^(\s*)-\s*([\w.-]+)\s*(?:={1,2}|>=)?\s*([\d][\w.]*)?", text, re.M):
        if m[2] != "pip" or m[3]:
            yield m[2], m[3] or "", "pypi" if len(m[1]) > 2 else "conda"


def helm_chart(text: str) -> Iterator[Component]:
    body = "\n".join(_sections(text, r"^(\w+):\s*$", lambda h: h == "dependencies"))
    for block in re.split(r"^\s*-\s+", body, flags=re.M)[1:]:
        get = lambda k, block=block: (re.search(rf"^\s*{k}:\s*[\"']?([^\"'\s]+)", block, re.M) or ["", ""])[1]
        if get("name"):
            yield get("name"), get("version"), "helm"


def dockerfile(text: str) -> Iterator[Component]:
    for m in re.finditer(r"^\s*FROM\s+(?:--\S+\s+)?([^\s:@]+)(?::([^\s@]+))?", text, re.M | re.I):
        if m[1] != "scratch":
            yield m[1], m[2] or "latest", "docker"
    for kind, pattern in (("deb", r"apt(?:-get)?\s+install\s+([^&|;\\\n]+)"), ("apk", r"apk\s+add\s+([^&|;\\\n]+)"), ("pypi", r"pip3?\s+install\s+([^&|;\\\n]+)")):
        for m in re.finditer(pattern, text):
            for word in m[1].split():
                if re.match(r"^[a-zA-Z]", word) and not word.endswith(".txt"):
                    n, _, v = word.partition("==" if "==" in word else "=")
                    yield n, v, kind


# ---- lockfiles: (name, version, ecosystem, dependencies, integrity)

Locked = tuple[str, str, str, list[str], str | None]


def package_lock(text: str) -> Iterator[Locked]:
    doc = _json(text)
    for path, p in (doc.get("packages") or {}).items():
        if path:
            yield path.rsplit("node_modules/", 1)[-1], str(p.get("version", "")), "npm", sorted(p.get("dependencies") or {}), p.get("integrity")
    todo = [] if doc.get("packages") else list((doc.get("dependencies") or {}).items())
    while todo:
        n, p = todo.pop()
        yield n, str(p.get("version", "")), "npm", sorted(p.get("requires") or {}) if isinstance(p.get("requires"), dict) else [], p.get("integrity")
        todo += list((p.get("dependencies") or {}).items())


def yarn_lock(text: str) -> Iterator[Locked]:
    for block in re.split(r"\n(?=\S)", text):
        head = re.match(r"^\"?(@?[^@\"\s]+)@", block)
        version = re.search(r"^  version:? \"?([^\"\n]+)", block, re.M)
        if head and version:
            deps = re.search(r"^  dependencies:\n((?:    .*\n?)*)", block, re.M)
            names = re.findall(r"^    \"?(@?[\w./-]+)\"?", deps[1], re.M) if deps else []
            integrity = re.search(r"^  integrity (\S+)", block, re.M)
            yield head[1], version[1], "npm", names, integrity[1] if integrity else None


def toml_lock(kind: str) -> Callable[[str], Iterator[Locked]]:
    def parse(text: str) -> Iterator[Locked]:
        for p in _toml(text).get("package") or []:
            deps = p.get("dependencies") or []
            names = [d.split(" ")[0] for d in deps] if isinstance(deps, list) else sorted(deps)
            yield p.get("name", ""), str(p.get("version", "")), kind, names if kind == "cargo" else [], p.get("checksum")

    return parse


def pipfile_lock(text: str) -> Iterator[Locked]:
    doc = _json(text)
    for key in ("default", "develop"):
        for n, p in (doc.get(key) or {}).items():
            yield n, _bare(p.get("version")), "pypi", [], next(iter(p.get("hashes") or []), None)


def go_sum(text: str) -> Iterator[Locked]:
    last: dict[str, tuple[str, str]] = {}
    for m in re.finditer(r"^(\S+) v(\S+?)(?:/go\.mod)? (h1:\S+)", text, re.M):
        last[m[1]] = (m[2], m[3])
    for n, (v, h) in last.items():
        yield n, v, "golang", [], h


# File names and their formats.
MANIFESTS = {
    "requirements.txt": requirements, "package.json": package_json, "pom.xml": pom_xml, "cargo.toml": cargo_toml, "go.mod": go_mod, "composer.json": composer_json, "composer.lock": composer_lock, "gemfile": gemfile,
    "gemfile.lock": gemfile_lock, "packages.config": packages_config, "pubspec.yaml": pubspec, "package.resolved": package_resolved, "podfile.lock": podfile_lock, "cartfile.resolved": cartfile, "conanfile.txt": conanfile,
    "vcpkg.json": vcpkg, "mix.exs": mix_exs, "cpanfile": cpanfile, "description": cran, "environment.yml": conda, "environment.yaml": conda, "chart.yaml": helm_chart, "dockerfile": dockerfile,
}
LOCKFILES = {
    "package-lock.json": package_lock, "npm-shrinkwrap.json": package_lock, "yarn.lock": yarn_lock, "poetry.lock": toml_lock("pypi"), "cargo.lock": toml_lock("cargo"), "pipfile.lock": pipfile_lock, "go.sum": go_sum,
}


def _format(name: str, table: dict) -> Callable | None:
    low = name.lower()
    if low.endswith(".csproj"):
        return csproj if "pom.xml" in table else None
    if re.match(r"requirements[\w.-]*\.txt$", low):
        low = "requirements.txt"
    return table.get(low)


def _parse(df: DataFrame, table: dict, schema: str, row: Callable) -> DataFrame:
    columns = [c.split()[0] for c in re.split(r",\s*(?![^<]*>)", schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["file_path"], b["content"], strict=True):
                parser = _format(path.replace("\\", "/").rsplit("/", 1)[-1], table)
                if parser and isinstance(text, str):
                    rows += [row(path, x) for x in parser(text) if x[0]]
            yield pd.DataFrame(rows, columns=columns)

    return df.where("file_path is not null and content is not null").select("file_path", "content").mapInPandas(run, schema)


def components(manifests: DataFrame) -> DataFrame:
    """file_path, name, version, kind, purl of every component the manifests (file_path, content) name."""
    rows = _parse(manifests, MANIFESTS, "file_path string, name string, version string, kind string", lambda p, x: (p, *x))
    return rows.withColumn("purl", purl(F.col("kind"), F.col("name"), F.col("version")))


def distinct_components(rows: DataFrame) -> DataFrame:
    """One row per package URL, from the first file by path."""
    return rows.groupBy("purl").agg(F.min(F.struct("file_path", "name", "version", "kind")).alias("c")).select("c.*", "purl")


def locked_packages(lockfiles: DataFrame) -> DataFrame:
    """lockfile, name, version, ecosystem, dependencies, integrity."""
    return _parse(lockfiles, LOCKFILES, "lockfile string, name string, version string, ecosystem string, dependencies array<string>, integrity string", lambda p, x: (p, *x))


def is_manifest(path) -> object:
    return F.lower(basename(path)).isin([*MANIFESTS, *LOCKFILES]) | F.lower(path).endswith(".csproj") | F.lower(basename(path)).rlike(r"^requirements[\w.-]*\.txt$")


def missing_integrity(locked: DataFrame) -> DataFrame:
    """Locked packages without a hash."""
    return locked.where("integrity is null or trim(integrity) = ''").select("lockfile", "name", "version")
