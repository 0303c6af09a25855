from scanloom.operators import callees

SCHEMA = "n int, language string, line string, callee string"


def hits(spark, rows):
    df = spark.createDataFrame([(n, lang, line, "own") for n, (lang, line) in enumerate(rows)], SCHEMA).selectExpr("*", "1 as cwe")
    return {(r["n"], r["rule_id"]) for r in callees.match_calls(df).collect()}


def test_calls(spark):
    rows = [("Python", "x = os.system(cmd); os.system(y)"), ("Python", "self.db.cursor.execute(q)"), ("Python", "evaluate(x)"), ("JavaScript", "eval (x)"), ("TypeScript", "document.write(x)"), ("C++", "std::strcpy(a, b)"), ("C", "strcpy(a, b)"), (None, "eval(x)"), ("Python", None), ("Python", ""), ("PHP", "eval($x)" * 3000)]
    assert hits(spark, rows) == {
        (0, "CALL-Python-command-os.system"), (1, "CALL-Python-query-cursor.execute"), (3, "CALL-JavaScript-code-eval"), (4, "CALL-JavaScript-markup-document.write"), (6, "CALL-C-memory-strcpy"), (10, "CALL-PHP-code-eval"),
    }
    assert callees.match_calls(spark.createDataFrame([], "language string, line string")).count() == 0


def test_rules_are_unique(spark):
    c = callees.catalogue(spark)
    assert c.count() == c.select("language", "callee", "rule_id").distinct().count()
