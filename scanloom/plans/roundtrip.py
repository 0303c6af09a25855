"""Every manifest and lockfile format: texts written from the locked packages, read back by the parsers.

One query per format.  Each lockfile's packages (one version each) are written as a file of the format and parsed; the
SQL reads the packages straight from the table, so that what a parser loses or adds shows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from scanloom.session import table
from scanloom.sources import manifests


@dataclass(frozen=True)
class Format:
    """File name, text around the packages, a package's text (``{n}`` name, ``{v}`` version), what parts them, purl type and the names' spelling."""

    file: str
    head: str
    item: str
    tail: str
    kind: str
    between: str = "\n"
    spelling: tuple[str, str] = ("", "")
    prefix: str = ""


# The formats.
FORMATS = {
    "requirements": Format("requirements.txt", "# pinned\n-r base.txt\n", "{n}=={v}  # locked", "\n", "pypi"),
    "package_json": Format("package.json", '{"name": "x", "dependencies": {', '"{n}": "^{v}"', "}}", "npm", ", "),
    "pom_xml": Format("pom.xml", "<project><dependencies>", "<dependency><groupId>org.x</groupId><artifactId>{n}</artifactId><version>{v}</version></dependency>", "</dependencies></project>", "maven", prefix="org.x/"),
    "cargo_toml": Format("Cargo.toml", '[package]\nname = "x"\n[dependencies]\n', '"{n}" = { version = "{v}" }', "\n", "cargo"),
    "go_mod": Format("go.mod", "module example.com/x\n\nrequire (\n", "\texample.com/{n} v{v}", "\n)\n", "golang", prefix="example.com/"),
    "csproj": Format("x.csproj", "<Project><ItemGroup>", '<PackageReference Include="{n}" Version="{v}" />', "</ItemGroup></Project>", "nuget"),
    "composer_json": Format("composer.json", '{"require": {"php": ">=8.1", "ext-json": "*", ', '"{n}": "^{v}"', "}}", "composer", ", "),
    "composer_lock": Format("composer.lock", '{"packages": [', '{"name": "{n}", "version": "v{v}"}', "]}", "composer", ", "),
    "gemfile": Format("Gemfile", "source 'https://gems.example'\n", "gem '{n}', '~> {v}'", "\n", "gem"),
    "gemfile_lock": Format("Gemfile.lock", "GEM\n  specs:\n", "    {n} ({v})", "\n\nPLATFORMS\n  ruby\n", "gem"),
    "packages_config": Format("packages.config", "<packages>", '<package id="{n}" version="{v}" targetFramework="net48" />', "</packages>", "nuget"),
    "pubspec": Format("pubspec.yaml", "name: x\ndependencies:\n", "  {n}: ^{v}", "\nflutter:\n  uses: 1\n", "pub", spelling=(".", "-")),
    "package_resolved": Format("Package.resolved", '{"version": 2, "pins": [', '{"identity": "{n}", "state": {"version": "{v}"}}', "]}", "swift", ", "),
    "podfile_lock": Format("Podfile.lock", "PODS:\n", "  - {n} ({v})", "\n\nDEPENDENCIES:\n  - x (1)\n", "cocoapods", spelling=(".", "-")),
    "cartfile": Format("Cartfile.resolved", "", 'github "org/{n}" "{v}"', "\n", "carthage", prefix="org/"),
    "conanfile": Format("conanfile.txt", "[requires]\n", "{n}/{v}", "\n[options]\nx/1\n", "conan"),
    "vcpkg": Format("vcpkg.json", '{"dependencies": [', '{"name": "{n}", "version>=": "{v}"}', "]}", "vcpkg", ", "),
    "mix_exs": Format("mix.exs", "defp deps do [\n", '{:{n}, "~> {v}"}', "\n] end\n", "hex", ",\n", ("-.", "__")),
    "cpanfile": Format("cpanfile", "", "requires '{n}', '{v}';", "\n", "cpan"),
    "cran": Format("DESCRIPTION", "Package: x\nDepends: R (>= 4.0)\nImports:\n", "    {n} (>= {v})", "\nLicense: MIT\n", "cran", ",\n", ("-", ".")),
    "conda": Format("environment.yml", "name: x\ndependencies:\n", "  - {n}={v}", "\n", "conda"),
    "helm_chart": Format("Chart.yaml", "name: x\nversion: 1.0.0\ndependencies:\n", "  - name: {n}\n    version: {v}\n    repository: https://charts.example", "\n", "helm"),
    "dockerfile": Format("Dockerfile", "FROM scratch AS base\n", "FROM {n}:{v}", '\nCMD ["x"]\n', "docker"),
}


def _fill(item: str, name: Column, version: Column) -> Column:
    """The item's text with its slots filled in."""
    parts: list[Column] = []
    for n, piece in enumerate(item.replace("{n}", "\0n\0").replace("{v}", "\0v\0").split("\0")):
        parts.append({"n": name, "v": version}[piece] if n % 2 else F.lit(piece))
    return F.concat(*parts)


def _locked(spark: SparkSession, d: str) -> DataFrame:
    """lockfile, name, version, dependencies, integrity: one row per name, with the largest version and all names it requires."""
    p = table(spark, d, "locked_packages").where("lockfile is not null and name is not null and version <> ''")
    deps = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("dependencies", F.array().cast("array<string>"))))))
    return p.groupBy("lockfile", "name").agg(F.max("version").alias("version"), F.filter(deps, lambda x: x.isNotNull()).alias("dependencies"), F.max("integrity").alias("integrity"))


def manifest_query(f: Format) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        name = F.translate("name", *f.spelling) if f.spelling[0] else F.col("name")
        rows = _locked(spark, d).select("lockfile", name.alias("name"), "version").groupBy("lockfile", "name").agg(F.max("version").alias("version"))
        texts = rows.groupBy("lockfile").agg(F.array_sort(F.collect_list(_fill(f.item, F.col("name"), F.col("version")))).alias("items"))
        files = texts.select(F.concat("lockfile", F.lit("/" + f.file)).alias("file_path"), F.concat(F.lit(f.head), F.array_join("items", f.between), F.lit(f.tail)).alias("content"))
        found = manifests.components(files).select(F.regexp_replace("file_path", "/[^/]*$", "").alias("lockfile"), "name", "version", "purl")
        return found.where("name <> 'scratch'").distinct()

    return query


def _manifest_sql(f: Format) -> str:
    name = f"translate(name, '{f.spelling[0]}', '{f.spelling[1]}')" if f.spelling[0] else "name"
    return f"""SELECT lockfile, '{f.prefix}' || n AS name, v AS version, 'pkg:{f.kind}/{f.prefix}' || n || '@' || v AS purl FROM (
SELECT lockfile, {name} AS n, max(version) AS v FROM locked_packages WHERE lockfile IS NOT NULL AND name IS NOT NULL AND version <> '' GROUP BY 1, 2)"""


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def _npm_lock(r: DataFrame) -> Column:
    deps = F.array_join(F.transform("dependencies", lambda x: F.concat(_quoted(x), F.lit(': "*"'))), ", ")
    integrity = F.coalesce(F.concat(F.lit(', "integrity": '), _quoted(F.col("integrity"))), F.lit(""))
    return F.concat(F.lit('"node_modules/'), "name", F.lit('": {"version": "'), "version", F.lit('", "dependencies": {'), deps, F.lit("}"), integrity, F.lit("}"))


def _yarn_lock(r: DataFrame) -> Column:
    deps = F.array_join(F.transform("dependencies", lambda x: F.concat(F.lit("    "), x, F.lit(' "*"\n'))), "")
    head = F.concat(F.col("name"), F.lit('@^1:\n  version "'), "version", F.lit('"\n'))
    integrity = F.coalesce(F.concat(F.lit("  integrity "), "integrity", F.lit("\n")), F.lit(""))
    return F.concat(head, integrity, F.when(F.size("dependencies") > 0, F.concat(F.lit("  dependencies:\n"), deps)).otherwise(""))


def _toml_lock(r: DataFrame) -> Column:
    deps = F.array_join(F.transform("dependencies", _quoted), ", ")
    check = F.coalesce(F.concat(F.lit("\nchecksum = "), _quoted(F.col("integrity"))), F.lit(""))
    return F.concat(F.lit('[[package]]\nname = "'), "name", F.lit('"\nversion = "'), "version", F.lit('"\ndependencies = ['), deps, F.lit("]"), check, F.lit("\n"))


def _poetry_lock(r: DataFrame) -> Column:
    return F.concat(F.lit('[[package]]\nname = "'), "name", F.lit('"\nversion = "'), "version", F.lit('"\n'))


def _pipfile_lock(r: DataFrame) -> Column:
    hashes = F.coalesce(F.concat(F.lit(', "hashes": ['), _quoted(F.col("integrity")), F.lit("]")), F.lit(""))
    return F.concat(_quoted(F.col("name")), F.lit(': {"version": "=='), "version", F.lit('"'), hashes, F.lit("}"))


def _go_sum(r: DataFrame) -> Column:
    return F.concat(F.lit("example.com/"), "name", F.lit(" v"), "version", F.lit("/go.mod h1:0="), F.lit("\nexample.com/"), "name", F.lit(" v"), "version", F.lit(" h1:"), F.sha1("name"), F.lit("="))


#: file, head, package's text, between, tail, ecosystem, whether the format holds dependencies, SQL of name and integrity
LOCKS = {
    "package_lock": ("package-lock.json", '{"packages": {"": {}, ', _npm_lock, ", ", "}}", "npm", True, "name", "integrity"),
    "yarn_lock": ("yarn.lock", "# yarn lockfile v1\n\n", _yarn_lock, "\n", "\n", "npm", True, "name", "integrity"),
    "poetry_lock": ("poetry.lock", "", _poetry_lock, "\n", "\n", "pypi", False, "name", "NULL"),
    "cargo_lock": ("Cargo.lock", "version = 3\n\n", _toml_lock, "\n", "\n", "cargo", True, "name", "integrity"),
    "pipfile_lock": ("Pipfile.lock", '{"default": {', _pipfile_lock, ", ", "}}", "pypi", False, "name", "integrity"),
    "go_sum": ("go.sum", "", _go_sum, "\n", "\n", "golang", False, "'example.com/' || name", "'h1:' || sha1(name) || '='"),
}


def lock_query(key: str) -> Callable[[SparkSession, str], DataFrame]:
    file, head, item, between, tail, *_ = LOCKS[key]

    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = _locked(spark, d)
        texts = rows.groupBy("lockfile").agg(F.array_sort(F.collect_list(item(rows))).alias("items"))
        files = texts.select(F.concat("lockfile", F.lit("/" + file)).alias("file_path"), F.concat(F.lit(head), F.array_join("items", between), F.lit(tail)).alias("content"))
        found = manifests.locked_packages(files)
        return found.select(F.regexp_replace("lockfile", "/[^/]*$", "").alias("lockfile"), "name", "version", "ecosystem", F.array_join(F.array_sort("dependencies"), ",").alias("requires"), "integrity")

    return query


def _lock_sql(key: str) -> str:
    *_, kind, deps, name, integrity = LOCKS[key]
    requires = "array_to_string(list_sort(list_distinct(list_filter(flatten(list(coalesce(dependencies, []))), lambda x: x IS NOT NULL))), ',')" if deps else "''"
    return f"""SELECT lockfile, {name} AS name, version, '{kind}' AS ecosystem, requires, {'CAST(NULL AS VARCHAR)' if integrity == 'NULL' else integrity} AS integrity FROM (
SELECT lockfile, name, max(version) AS version, {requires} AS requires, max(integrity) AS integrity FROM locked_packages WHERE lockfile IS NOT NULL AND name IS NOT NULL AND version <> '' GROUP BY 1, 2)"""


QUERIES = {f"manifest_{k}": manifest_query(f) for k, f in FORMATS.items()} | {f"lock_{k}": lock_query(k) for k in LOCKS}
SQL = {f"manifest_{k}": _manifest_sql(f) for k, f in FORMATS.items()} | {f"lock_{k}": _lock_sql(k) for k in LOCKS}
