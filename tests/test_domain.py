from scanloom.operators import domain
from scanloom.sources import infrastructure

PLAN = '{"planned_values": {"root_module": {"resources": [{"address": "a.x", "type": "a", "values": {"acl": "public-read", "n": 1}, "depends_on": ["b.y"]}], "child_modules": [{"resources": [{"address": "m.b.y", "type": "b"}]}]}}, "resource_changes": [{"address": "a.x", "change": {"actions": ["create"]}}, {"address": "b.y", "change": {"actions": ["delete", "create"]}}]}'


def test_checks(spark):
    rows = [(1, "rego", "package x\ndefault allow = true"), (2, "contract", "require(tx.origin == owner);"), (3, "model", "torch.load(f, weights_only=True)"), (4, "model", "torch.load(f)"), (5, "web", "x"), (6, "other", "default allow = true"), (7, "rego", None)]
    got = {(r["id"], r["issue"]) for r in domain.check_texts(spark.createDataFrame(rows, "id int, kind string, text string")).collect()}
    assert got == {(1, "allow_by_default"), (2, "origin_as_sender"), (4, "pickle_model")}


def test_matches(spark):
    df = spark.createDataFrame([(1, "ab1cd22"), (2, ""), (3, None)], "id int, text string")
    assert [tuple(r) for r in domain.matches(df, "[0-9]+").collect()] == [(1, 0, "1", 3), (1, 1, "22", 6)]


def test_plans(spark):
    df = spark.createDataFrame([("p", PLAN), ("q", "{"), ("r", None)], "plan_id string, plan string")
    rs = {(r["id"], r["attributes"].get("acl"), tuple(r["dependencies"])) for r in infrastructure.terraform_resources(df).collect()}
    assert rs == {("a.x", "public-read", ("b.y",)), ("m.b.y", None, ())}
    assert {(r["action"], tuple(r["addresses"])) for r in infrastructure.terraform_changes(df).collect()} == {("create", ("a.x",)), ("delete/create", ("b.y",))}
    doc = '{"Roles": [{"Arn": "arn:aws:iam::1:role/r", "RoleName": "r", "AssumeRolePolicyDocument": "{\\"Principal\\": \\"arn:aws:iam::1:user/u\\"}"}], "Users": [{"Arn": "arn:aws:iam::1:user/u"}]}'
    p, e = infrastructure.iam_principals(spark.createDataFrame([("t", doc)], "tenant string, doc string"))
    assert p.count() == 2 and e.first()["src"] == "arn:aws:iam::1:user/u"
