"""Checks of resources, policies and services given as rows."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def iam_blast_radius(policies: DataFrame) -> DataFrame:
    """policy_id, score, level, n_actions, n_resources of policies (policy_id, policy JSON); only Allow statements count."""
    one_or_many = lambda c: F.when(c.startswith("["), F.from_json(c, "array<string>")).when(c.isNotNull(), F.array(F.regexp_replace(c, '^"|"$', ""))).otherwise(F.array().cast("array<string>"))
    raw = F.coalesce(F.get_json_object("policy", "$.Statement"), F.get_json_object("policy", "$.statements"))
    statements = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
    rows = policies.select("policy_id", F.explode_outer(statements).alias("s"))
    allow = F.lower(F.coalesce(F.get_json_object("s", "$.Effect"), F.lit("Allow"))) == "allow"
    rows = rows.select("policy_id", F.when(allow, one_or_many(F.get_json_object("s", "$.Action"))).alias("a"), F.when(allow, one_or_many(F.get_json_object("s", "$.Resource"))).alias("r"))
    sets = rows.groupBy("policy_id").agg(F.array_distinct(F.flatten(F.collect_list("a"))).alias("a"), F.array_distinct(F.flatten(F.collect_list("r"))).alias("r"))
    star = lambda c: F.when(F.array_contains(c, "*"), 1).otherwise(0)
    score = F.least(F.size("a") * 2 + F.size("r") + 50 * star("a") + 30 * star("r"), F.lit(100))
    level = F.when(score >= 75, "critical").when(score >= 50, "high").when(score >= 20, "medium").otherwise("low")
    return sets.select("policy_id", score.alias("score"), level.alias("level"), F.size("a").alias("n_actions"), F.size("r").alias("n_resources"))


def cis_checks(resources: DataFrame) -> DataFrame:
    """id, check, severity for resources (id, kind, attributes map)."""
    a = lambda k: F.lower(F.coalesce(F.try_element_at(F.col("attributes"), F.lit(k)), F.lit("")))
    kind = F.lower("kind")
    checks = F.array_compact(
        F.array(
            F.when(F.contains(kind, F.lit("security_group")) & a("cidr_blocks").rlike(r"0\.0\.0\.0/0|::/0"), F.struct(F.lit("open_security_group").alias("check"), F.lit("HIGH").alias("severity"))),
            F.when(F.contains(kind, F.lit("bucket")) & a("acl").startswith("public"), F.struct(F.lit("public_bucket").alias("check"), F.lit("CRITICAL").alias("severity"))),
            F.when(kind.rlike("pod|deployment|container") & (a("run_as_non_root") != "true"), F.struct(F.lit("runs_as_root").alias("check"), F.lit("MEDIUM").alias("severity"))),
            F.when(kind.rlike("bucket|disk|db_instance") & (a("encrypted") == "false"), F.struct(F.lit("not_encrypted").alias("check"), F.lit("HIGH").alias("severity"))),
        )
    )
    return resources.select("id", F.explode(checks).alias("c")).select("id", "c.*")


def http_checks(responses: DataFrame) -> DataFrame:
    """id, issue for responses (id, headers map with lower-case names)."""
    h = lambda k: F.coalesce(F.try_element_at(F.col("headers"), F.lit(k)), F.lit(""))
    issues = [
        ("no_hsts", h("strict-transport-security") == ""), ("no_csp", h("content-security-policy") == ""), ("csp_unsafe_inline", F.contains(h("content-security-policy"), F.lit("unsafe-inline"))),
        ("no_frame_options", (h("x-frame-options") == "") & ~F.contains(h("content-security-policy"), F.lit("frame-ancestors"))), ("no_nosniff", F.lower(h("x-content-type-options")) != "nosniff"),
        ("cors_any_with_credentials", (h("access-control-allow-origin") == "*") & (F.lower(h("access-control-allow-credentials")) == "true")),
        ("cookie_not_secure", (h("set-cookie") != "") & ~F.lower(h("set-cookie")).rlike(r";\s*secure")), ("cookie_not_httponly", (h("set-cookie") != "") & ~F.lower(h("set-cookie")).rlike(r";\s*httponly")),
    ]
    return responses.select("id", F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in issues]))).alias("issue"))


def dockerfile_checks(files: DataFrame) -> DataFrame:
    """file_path, issue, line_number for Dockerfiles (file_path, line_number, line); the last USER decides about root."""
    line = F.col("line")
    rules = [("add_remote", r"(?i)^\s*ADD\s+https?://"), ("latest_tag", r"(?i)^\s*FROM\s+\S+:latest\b"), ("secret_in_env", r"(?i)^\s*(?:ENV|ARG)\s+\S*(?:PASSWORD|SECRET|TOKEN|KEY)\S*[= ]\S+"), ("piped_install", r"(?:curl|wget)[^|]*\|\s*(?:ba)?sh")]
    hits = files.select("file_path", "line_number", F.explode(F.array_compact(F.array(*[F.when(line.rlike(p), n) for n, p in rules]))).alias("issue"))
    user = F.regexp_extract("line", r"(?i)^\s*USER\s+(\S+)", 1)
    last = files.groupBy("file_path").agg(F.max_by(F.when(user != "", user), F.when(user != "", F.col("line_number"))).alias("u"))
    root = last.where(F.coalesce("u", F.lit("root")).isin("root", "0")).select("file_path", F.lit(0).alias("line_number"), F.lit("runs_as_root").alias("issue"))
    return hits.unionByName(root).select("file_path", "line_number", "issue")


def compose_services(files: DataFrame) -> DataFrame:
    """file_path, service, settings (map) of Compose files (file_path, content), JSON or YAML of plain keys.

    In YAML a service is a key two blanks deep below ``services:``, its settings are the plain keys below it.
    """

    def of(text: str) -> Iterator[tuple[str, dict]]:
        try:
            doc = json.loads(text)
            for name, svc in ((doc or {}).get("services") or {}).items():
                yield name, {k: v if isinstance(v, str) else json.dumps(v) for k, v in (svc or {}).items()}
            return
        except (ValueError, AttributeError):
            pass
        inside, name, settings = False, None, {}
        for line in text.splitlines():
            m = re.match(r"( *)([\w.-]+):\s*(.*?)\s*(?:#.*)?$", line)
            if not m:
                continue
            depth = len(m[1])
            if depth == 0:
                inside = m[2] == "services"
            elif inside and depth == 2 and not m[3]:
                if name:
                    yield name, settings
                name, settings = m[2], {}
            elif inside and name and depth == 4 and m[3]:
                settings[m[2]] = m[3].strip("\"'")
        if name:
            yield name, settings

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *x) for p, t in zip(b["file_path"], b["content"], strict=True) if isinstance(t, str) for x in of(t)], columns=["file_path", "service", "settings"])

    return files.select("file_path", "content").mapInPandas(run, "file_path string, service string, settings map<string,string>")


def compose_checks(services: DataFrame) -> DataFrame:
    """file_path, service, issue: privileged containers, the host's network, a root file system that can be written."""
    s = lambda k: F.lower(F.coalesce(F.try_element_at(F.col("settings"), F.lit(k)), F.lit("")))
    issues = [("privileged", s("privileged") == "true"), ("host_network", s("network_mode") == "host"), ("writable_root", s("read_only") != "true")]
    return services.select("file_path", "service", F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in issues]))).alias("issue"))


def bfla_gaps(operations: DataFrame, roles: DataFrame) -> DataFrame:
    """spec_id, operation, issue: operations that no role may call, and changing ones that anonymous may.

    ``operations``: spec_id, path, method, operation; ``roles``: role, operation.
    """
    anyone = roles.groupBy("operation").agg(F.bool_or(F.col("role") == "anonymous").alias("anonymous"))
    rows = operations.where(F.col("method").isin("get", "post", "put", "patch", "delete")).join(anyone, "operation", "left")
    issue = F.when(F.col("anonymous").isNull(), "no_role").when(F.col("anonymous") & F.col("method").isin("delete", "put", "patch"), "anonymous_change")
    return rows.select("spec_id", "operation", issue.alias("issue")).where("issue is not null")


def openapi_operations(specs: DataFrame) -> DataFrame:
    """spec_id, path, method, secured: operations of OpenAPI documents (spec_id, spec JSON)."""
    paths = F.from_json(F.get_json_object("spec", "$.paths"), "map<string,map<string,string>>")
    rows = specs.select("spec_id", F.get_json_object("spec", "$.security").alias("s"), F.explode(paths).alias("path", "ms")).select("spec_id", "s", "path", F.explode("ms").alias("method", "op"))
    secured = F.coalesce(F.get_json_object("op", "$.security"), F.col("s"))
    name = F.coalesce(F.get_json_object("op", "$.operationId"), F.concat(F.lower("method"), F.lit(":"), F.col("path")))
    return rows.select("spec_id", "path", F.lower("method").alias("method"), (secured.isNotNull() & (secured != "[]")).alias("secured"), name.alias("operation")).where(F.col("method").isin("get", "put", "post", "delete", "patch", "head", "options"))


def contract_cases(operations: DataFrame) -> DataFrame:
    """Every operation with each of four mutations of its input."""
    return operations.select("*", F.explode(F.array(*[F.lit(m) for m in ("missing_auth", "wrong_type", "oversized", "injection")])).alias("mutation"))


class Policy:
    """Policies of lines ``deny|warn field op value : message`` compiled to column predicates over a frame.

    Operators: ==, !=, contains, exists.  A field is a column or a path into a map or struct column.
    """

    _LINE = re.compile(r"^\s*(deny|warn)\s+([\w.]+)\s+(==|!=|contains|exists)\s*(.*?)\s*(?::\s*(.*))?$")

    def __init__(self, source: str) -> None:
        self.rules = []
        for line in source.splitlines():
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            m = self._LINE.match(line)
            if not m:
                raise ValueError(f"not a policy line: {line}")
            self.rules.append((m[1], m[2], m[3], m[4].strip("\"'"), m[5] or line.strip()))

    @staticmethod
    def _field(name: str) -> Column:
        head, *rest = name.split(".")
        out = F.col(head)
        for r in rest:
            out = out[r]
        return out

    def evaluate(self, df: DataFrame) -> DataFrame:
        """df's columns, action, message: one row per rule that applies."""
        hits = []
        for action, name, op, value, message in self.rules:
            f = self._field(name)
            cond = {"==": f.cast("string") == value, "!=": f.cast("string") != value, "contains": F.contains(f.cast("string"), F.lit(value)), "exists": f.isNotNull()}[op]
            hits.append(F.when(cond, F.struct(F.lit(action).alias("action"), F.lit(message).alias("message"))))
        return df.select("*", F.explode(F.array_compact(F.array(*hits))).alias("_h")).select(*df.columns, "_h.action", "_h.message")
