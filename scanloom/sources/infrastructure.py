"""Infrastructure plans and directory snapshots as resource, principal and edge rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

RESOURCES = "plan_id string, id string, kind string, attributes map<string,string>, dependencies array<string>"


def _resources(plan: dict) -> Iterator[tuple[str, str, dict, list]]:
    todo = [(plan.get("planned_values") or plan.get("values") or {}).get("root_module") or {}]
    while todo:
        module = todo.pop()
        todo += module.get("child_modules") or []
        for r in module.get("resources") or []:
            values = {k: v if isinstance(v, str) else json.dumps(v) for k, v in (r.get("values") or {}).items() if v is not None}
            yield r.get("address", ""), r.get("type", ""), values, list(r.get("depends_on") or [])


def terraform_resources(plans: DataFrame) -> DataFrame:
    """Resources of Terraform plans (plan_id, plan JSON), modules at any depth; broken plans give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for pid, text in zip(b["plan_id"], b["plan"], strict=True):
                try:
                    doc = json.loads(text)
                except (ValueError, TypeError):
                    continue
                rows += [(pid, *r) for r in _resources(doc)] if isinstance(doc, dict) else []
            yield pd.DataFrame(rows, columns=["plan_id", "id", "kind", "attributes", "dependencies"])

    return plans.select("plan_id", "plan").mapInPandas(run, RESOURCES)


def terraform_changes(plans: DataFrame) -> DataFrame:
    """plan_id, action, addresses of the changes that Terraform plans announce."""
    changes = F.from_json(F.get_json_object("plan", "$.resource_changes"), "array<struct<address:string,change:struct<actions:array<string>>>>")
    rows = plans.select("plan_id", F.explode(changes).alias("c")).select("plan_id", "c.address", F.array_join("c.change.actions", "/").alias("action"))
    return rows.groupBy("plan_id", "action").agg(F.array_sort(F.collect_list("address")).alias("addresses"))


def dependency_edges(resources: DataFrame) -> DataFrame:
    return resources.select("plan_id", F.col("id").alias("src"), F.explode("dependencies").alias("dst"))


def iam_principals(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(principals, edges) of identity snapshots (tenant, doc JSON): roles and users, and who may assume which role."""
    item = "array<struct<Arn:string,RoleName:string,UserName:string,AssumeRolePolicyDocument:string>>"
    get = lambda k: F.from_json(F.get_json_object("doc", f"$.{k}"), item)
    both = documents.select("tenant", F.explode(F.array(F.struct(F.lit("role").alias("kind"), get("Roles").alias("xs")), F.struct(F.lit("user").alias("kind"), get("Users").alias("xs")))).alias("g"))
    rows = both.select("tenant", F.col("g.kind").alias("kind"), F.explode("g.xs").alias("x"))
    principals = rows.select("tenant", F.col("x.Arn").alias("id"), "kind")
    who = F.regexp_extract_all(F.col("x.AssumeRolePolicyDocument"), F.lit(r"(arn:aws:[^\"\\\s]+)"), F.lit(1))
    edges = rows.where("kind = 'role'").select("tenant", F.explode(who).alias("src"), F.col("x.Arn").alias("dst"), F.lit("AssumeRole").alias("relation"))
    return principals, edges.distinct()


def directory_graph(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(principals, edges) of directory snapshots (tenant, provider, doc JSON of principals and relationships)."""
    people = F.from_json(F.get_json_object("doc", "$.principals"), "array<struct<id:string,kind:string>>")
    links = F.from_json(F.get_json_object("doc", "$.relationships"), "array<struct<source:string,target:string,relation:string,permissions:array<string>>>")
    principals = documents.select("tenant", "provider", F.explode(people).alias("p")).select("tenant", F.col("p.id").alias("id"), F.coalesce("p.kind", F.lit("user")).alias("kind"), "provider")
    edges = documents.select("tenant", F.explode(links).alias("e")).select("tenant", F.col("e.source").alias("src"), F.col("e.target").alias("dst"), "e.relation", F.coalesce("e.permissions", F.array().cast("array<string>")).alias("permissions"))
    return principals, edges


def identity_risks(documents: DataFrame) -> DataFrame:
    """tenant, risk, severity, principal of directory snapshots (tenant, doc JSON)."""
    user = F.from_json(F.get_json_object("doc", "$.users"), "array<struct<id:string,name:string,mfa:boolean,preauth_disabled:boolean,admin:boolean,synced:boolean>>")
    service = F.from_json(F.get_json_object("doc", "$.service_principals"), "array<struct<id:string,secrets:array<string>,permissions:array<string>>>")
    grant = F.from_json(F.get_json_object("doc", "$.grants"), "array<struct<principal:string,permissions:array<string>>>")
    access = F.from_json(F.get_json_object("doc", "$.conditional_access"), "array<struct<state:string,require_mfa:boolean,covers_all_users:boolean>>")
    risk = lambda cond, name, severity: F.when(cond, F.struct(F.lit(name).alias("risk"), F.lit(severity).alias("severity")))
    yes = lambda c: F.coalesce(c, F.lit(False))

    def rows(items, who, risks):
        x = documents.select("tenant", F.explode(items).alias("x"))
        return x.select("tenant", F.explode(F.array_compact(F.array(*risks))).alias("r"), F.coalesce(*who, F.lit("unknown")).alias("principal")).select("tenant", "r.risk", "r.severity", "principal")

    u, s, g = (lambda f: F.col(f"x.{f}"),) * 3
    wide = F.transform(F.coalesce(g("permissions"), F.array()), lambda p: F.lower(p))
    parts = [
        rows(user, [u("id"), u("name")], [risk(~yes(u("mfa")), "no_mfa", "HIGH"), risk(yes(u("preauth_disabled")), "no_preauthentication", "HIGH"), risk(yes(u("admin")) & yes(u("synced")), "synced_admin", "CRITICAL")]),
        rows(service, [s("id")], [risk(F.size(F.coalesce(s("secrets"), F.array())) > 0, "static_secret", "HIGH"), risk(F.array_contains(F.coalesce(s("permissions"), F.array()), "*"), "global_permission", "CRITICAL")]),
        rows(grant, [g("principal")], [risk(F.array_contains(wide, "replicating directory changes") & F.array_contains(wide, "replicating directory changes all"), "directory_replication", "CRITICAL")]),
    ]
    full = F.exists(access, lambda p: (p["state"] == "enabled") & yes(p["require_mfa"]) & yes(p["covers_all_users"]))
    parts.append(documents.where((F.size(access) > 0) & ~yes(full)).select("tenant", F.lit("mfa_not_for_all").alias("risk"), F.lit("CRITICAL").alias("severity"), F.lit("tenant").alias("principal")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
