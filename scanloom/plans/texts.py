"""Queries over documents' lines and over strings kept with findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scanloom.functions.text import BLANK, SECRET_HINTS, charset, shannon, split_lines
from scanloom.operators import code, detect, reports
from scanloom.session import table


def _lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    rows = docs.select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("n", "line"))
    return rows.select("doc_id", F.col("doc_id").alias("file_path"), (F.col("n") + 1).alias("line_number"), "line")


def lines_explode(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("doc_id", "line_number", "line")


def file_length(spark: SparkSession, d: str) -> DataFrame:
    return code.file_lengths(_lines(spark, d)).withColumnRenamed("file_path", "doc_id")


def brace_depth(spark: SparkSession, d: str) -> DataFrame:
    return code.brace_depth(_lines(spark, d)).select("doc_id", "line_number", "depth")


def deep_lines(spark: SparkSession, d: str) -> DataFrame:
    return code.clamped_depth(_lines(spark, d)).groupBy("doc_id").agg(F.max("depth").alias("max_depth"))


def function_context(spark: SparkSession, d: str) -> DataFrame:
    return code.function_context(_lines(spark, d)).where("function_context is not null").select("doc_id", "line_number", "function_context")


def snippets(spark: SparkSession, d: str) -> DataFrame:
    """Three lines on either side of every line."""
    rows = code.snippets(_lines(spark, d))
    return rows.select("doc_id", "line_number", F.array_join("snippet", "\n").alias("snippet"), "snippet_start_line")


def duplication_blocks(spark: SparkSession, d: str) -> DataFrame:
    return code.duplicate_blocks(_lines(spark, d), 1).withColumnRenamed("file_path", "doc_id")


def shingle_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """How like each finding's line is to its snippet, over sets of five tokens."""
    f = table(spark, d, "findings").where("line_content is not null and snippet is not null")
    return f.select("row_id", F.round(code.jaccard(code.token_fingerprints(F.col("line_content")), code.token_fingerprints(F.array_join("snippet", "\n"))), 6).alias("similarity"))


def anomaly_score(spark: SparkSession, d: str) -> DataFrame:
    return reports.anomalies(_lines(spark, d)).withColumnRenamed("file_path", "doc_id")


def entropy_value(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entropy_findings").where("secret_value is not null")
    return e.select("row_id", F.round(shannon(F.col("secret_value")), 3).alias("bits"), charset(F.col("secret_value")).alias("kind"))


def entropy_findings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entropy_findings").where("line_content is not null").select("row_id", F.col("line_content").alias("line"))
    return detect.entropy_findings(e).select("row_id", "variable_name", "charset", F.length("value").alias("n_chars"))


def masked_secrets(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entropy_findings").where("secret_value is not null")
    return e.select("row_id", detect.masked_secret(F.col("secret_value")).alias("masked"))


def pii_email(spark: SparkSession, d: str) -> DataFrame:
    return detect.each_match(table(spark, d, "documents").select("doc_id", "text"), "text", detect.EMAIL, "m").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("m").alias("first"))


def pii_cpf(spark: SparkSession, d: str) -> DataFrame:
    """CPF-shaped numbers in documents and whether their check digits hold."""
    from scanloom.functions.text import cpf_valid, digits_of

    rows = detect.each_match(table(spark, d, "documents").select("doc_id", "text"), "text", r"[0-9]{3}[.][0-9]{3}[.][0-9]{3}[-/][0-9]{2}", "m")
    return rows.select("doc_id", digits_of(F.col("m")).alias("digits"), cpf_valid(F.col("m")).alias("valid")).distinct()


def pii_card_luhn(spark: SparkSession, d: str) -> DataFrame:
    """Runs of 13 to 16 digits in documents that pass Luhn's check."""
    from scanloom.functions.text import luhn

    rows = detect.each_match(table(spark, d, "documents").select("doc_id", "text"), "text", r"[0-9]{13,16}", "m")
    return rows.select("doc_id", F.col("m").alias("digits"), luhn(F.col("m")).alias("valid")).distinct()


def jwt_issues(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "findings").where("line_content is not null").select("row_id", F.col("line_content").alias("line"))
    return detect.jwt_findings(f, as_of=1_700_000_000).select("row_id", "alg", "issues")


def event_trend(spark: SparkSession, d: str) -> DataFrame:
    """The batch form of the streaming trend: counts per hour and type."""
    e = table(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("window_start"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        lines_explode, file_length, brace_depth, deep_lines, function_context, snippets, duplication_blocks, shingle_jaccard, anomaly_score, entropy_value, entropy_findings, masked_secrets, pii_email, pii_cpf, pii_card_luhn,
        jwt_issues, event_trend,
    )
}

_sq = lambda t: "'" + t.replace("'", "''") + "'"
#: Line ends of ``split_lines`` in RE2 (which knows no \u escapes).
_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
_LINES = f"""WITH x AS (SELECT doc_id, string_split_regex(text, '{_ENDS}') AS p FROM documents WHERE text IS NOT NULL),
y AS (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS p FROM x),
l AS (SELECT doc_id, unnest(p) AS line, unnest(range(1, len(p) + 1))::INT AS line_number FROM y WHERE len(p) > 0)
"""
_COUNT = lambda c: f"(length(line) - length(replace(line, '{c}', '')))"
_DEPTH = f"sum({_COUNT('{')} - {_COUNT('}')}) OVER (PARTITION BY doc_id ORDER BY line_number)::BIGINT"
_TOKENS = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^ \t\n\r\f\x0B]"

SQL = {
    "lines_explode": _LINES + "SELECT doc_id, line_number, line FROM l",
    "file_length": _LINES + "SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT regexp_matches(line, '" + BLANK + "')) AS code_lines FROM l GROUP BY 1 HAVING code_lines > 0",
    "brace_depth": _LINES + f"SELECT doc_id, line_number, depth FROM (SELECT doc_id, line_number, line, {_DEPTH} AS depth FROM l)",
    "deep_lines": _LINES + f"""SELECT doc_id, max(raw - low)::BIGINT AS max_depth FROM (SELECT doc_id, raw, least(min(raw) OVER (PARTITION BY doc_id ORDER BY line_number), 0) AS low FROM (SELECT doc_id, line_number, {_DEPTH} AS raw FROM l)) GROUP BY 1""",
    "function_context": _LINES + f"""SELECT doc_id, line_number, c AS function_context FROM (SELECT doc_id, line_number, last_value(nm IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS c
FROM (SELECT doc_id, line_number, nullif(regexp_extract(line, '{code.DEFINITION}', 1), '') AS nm FROM l)) WHERE c IS NOT NULL""",
    "snippets": _LINES + """SELECT doc_id, line_number, s AS snippet, f AS snippet_start_line FROM (SELECT doc_id, line_number, line, string_agg(line, chr(10)) OVER w AS s, min(line_number) OVER w AS f FROM l
WINDOW w AS (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))""",
    "duplication_blocks": _LINES + r""", q AS (SELECT doc_id, line_number, lower(trim(regexp_replace(regexp_replace(regexp_replace(line, '"[^"]*"|''[^'']*''', 'S', 'g'), '\b[0-9]+\b', 'N', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS n FROM l),
b AS (SELECT doc_id, line_number, (n <> '' AND NOT regexp_matches(n, '^[{}()\[\];,]*$|^(?:#|//|\*|/\*|--)') AND len(string_split(n, ' ')) >= 3) AS ok,
  md5(string_agg(md5(n), '|') OVER w) AS fp, count(*) OVER w AS k FROM q WINDOW w AS (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN CURRENT ROW AND 0 FOLLOWING)),
p AS (SELECT doc_id, line_number, min(line_number) OVER (PARTITION BY doc_id, fp ORDER BY line_number RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS dup FROM b WHERE ok AND k = 1),
r AS (SELECT doc_id, line_number, dup, dup - line_number AS d, line_number - row_number() OVER (PARTITION BY doc_id, dup - line_number ORDER BY line_number) AS g FROM p WHERE dup IS NOT NULL)
SELECT doc_id, min(line_number) AS line_start, min(dup) AS duplicate_start, count(*) AS lines_duplicated FROM r GROUP BY doc_id, d, g""",
    "shingle_jaccard": rf"""WITH t AS (SELECT row_id, regexp_extract_all(regexp_replace(line_content, '#[^\n]*|//[^\n]*', '', 'g'), '{_TOKENS}') AS k,
  regexp_extract_all(regexp_replace(array_to_string(snippet, chr(10)), '#[^\n]*|//[^\n]*', '', 'g'), '{_TOKENS}') AS j FROM findings WHERE line_content IS NOT NULL AND snippet IS NOT NULL),
p AS (SELECT row_id, list_distinct(list_transform(range(1, len(k) - 3), lambda i: array_to_string(k[i:i + 4], chr(31)))) AS f, list_distinct(list_transform(range(1, len(j) - 3), lambda i: array_to_string(j[i:i + 4], chr(31)))) AS g FROM t)
SELECT row_id, round(CASE WHEN len(f) + len(g) = 0 THEN 1.0 ELSE len(list_intersect(f, g))::DOUBLE / len(list_distinct(list_concat(f, g))) END, 6) AS similarity FROM p""",
    "anomaly_score": _LINES + r""", a AS (SELECT doc_id, avg(length(line)) AS al, sum(len(regexp_extract_all(line, '(?i)\b(TODO|FIXME|generated|as an ai)\b')))::BIGINT AS markers FROM l GROUP BY 1), m AS (SELECT avg(al) AS mean FROM a),
s AS (SELECT doc_id, markers, abs(al - mean) / greatest(mean, 1.0) + markers * 0.4::DOUBLE AS sc FROM a, m) SELECT doc_id, markers, round(sc, 3) AS score FROM s WHERE sc > 0.8""",
    "entropy_value": """WITH c AS (SELECT row_id, secret_value AS v, unnest(CASE WHEN secret_value = '' THEN [NULL] ELSE string_split(secret_value, '') END) AS c FROM entropy_findings WHERE secret_value IS NOT NULL),
n AS (SELECT row_id, v, c, count(c) AS k FROM c GROUP BY 1, 2, 3),
e AS (SELECT row_id, v, CASE WHEN v = '' THEN 0.0 ELSE -sum(k / length(v)::DOUBLE * log2(k / length(v)::DOUBLE)) END AS bits FROM n GROUP BY 1, 2)
SELECT row_id, round(bits, 3) + 0.0 AS bits, CASE WHEN regexp_full_match(v, '[0-9a-fA-F]+') THEN 'hex' WHEN regexp_full_match(v, '[A-Za-z0-9+/]+=*') AND length(v) >= 20 THEN 'base64' ELSE 'alnum' END AS kind FROM e""",
    "entropy_findings": f"""WITH l AS (SELECT row_id, line_content AS line FROM entropy_findings WHERE line_content IS NOT NULL AND NOT regexp_matches(line_content, {_sq(detect._COMMENT)})),
m AS (SELECT row_id, unnest(regexp_extract_all(line, {_sq(detect._ASSIGN)}, 1)) AS n, unnest(regexp_extract_all(line, {_sq(detect._ASSIGN)}, 2)) AS v, unnest(range(1, len(regexp_extract_all(line, {_sq(detect._ASSIGN)}, 1)) + 1)) AS k FROM l),
c AS (SELECT row_id, n, v, k, unnest(string_split(v, '')) AS c FROM m), f AS (SELECT row_id, n, v, k, c, count(*) AS q FROM c GROUP BY ALL),
e AS (SELECT row_id, n, v, k, round(-sum(q / length(v)::DOUBLE * log2(q / length(v)::DOUBLE)), 3) AS bits, CASE WHEN regexp_full_match(v, '[0-9a-fA-F]+') THEN 'hex' WHEN regexp_full_match(v, '[A-Za-z0-9+/]+=*') AND length(v) >= 20 THEN 'base64' ELSE 'alnum' END AS kind FROM f GROUP BY 1, 2, 3, 4),
h AS (SELECT * FROM e WHERE bits >= CASE kind WHEN 'hex' THEN 3.5 WHEN 'base64' THEN 4.5 ELSE 4.0 END OR (bits >= 3.0 AND regexp_matches(lower(n), {_sq('|'.join(SECRET_HINTS))})))
SELECT row_id, n AS variable_name, arg_min(kind, k) AS charset, arg_min(length(v), k)::INT AS n_chars FROM h GROUP BY row_id, n""",
    "masked_secrets": "SELECT row_id, CASE WHEN length(secret_value) > 16 THEN left(secret_value, 8) || '...' || right(secret_value, 4) ELSE secret_value END AS masked FROM entropy_findings WHERE secret_value IS NOT NULL",
    "pii_email": f"SELECT doc_id, count(*) AS n, min(m) AS first FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{detect.EMAIL}')) AS m FROM documents) GROUP BY 1",
    "pii_cpf": r"""WITH m AS (SELECT DISTINCT doc_id, regexp_replace(unnest(regexp_extract_all(text, '[0-9]{3}[.][0-9]{3}[.][0-9]{3}[-/][0-9]{2}')), '[^0-9]', '', 'g') AS digits FROM documents),
k AS (SELECT doc_id, digits, list_transform(string_split(digits, ''), lambda c: c::INT) AS d FROM m),
s AS (SELECT *, list_sum(list_transform(range(1, 10), lambda i: d[i] * (11 - i))) % 11 AS a, list_sum(list_transform(range(1, 11), lambda i: d[i] * (12 - i))) % 11 AS b FROM k)
SELECT doc_id, digits, (len(list_distinct(d)) > 1 AND d[10] = (CASE WHEN a < 2 THEN 0 ELSE 11 - a END) AND d[11] = (CASE WHEN b < 2 THEN 0 ELSE 11 - b END)) AS valid FROM s""",
    "pii_card_luhn": r"""WITH m AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[0-9]{13,16}')) AS digits FROM documents),
k AS (SELECT doc_id, digits, list_reverse(list_transform(string_split(digits, ''), lambda c: c::INT)) AS d FROM m)
SELECT doc_id, digits, list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN d[i] WHEN d[i] * 2 > 9 THEN d[i] * 2 - 9 ELSE d[i] * 2 END)) % 10 = 0 AS valid FROM k""",
    "jwt_issues": r"""WITH t AS (SELECT row_id, unnest(regexp_extract_all(line_content, '\b(eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*)', 1)) AS t FROM findings),
p AS (SELECT row_id, list_transform(string_split(t, '.')[:2], lambda s: translate(s, '-_', '+/') || repeat('=', ((4 - length(s) % 4) % 4)::INT)) AS p FROM t),
j AS (SELECT row_id, try(decode(from_base64(p[1]))) AS h, try(decode(from_base64(p[2]))) AS b FROM p),
q AS (SELECT row_id, try(h->>'$.alg') AS alg, try(b->>'$.exp')::BIGINT AS exp, b FROM j WHERE h IS NOT NULL)
SELECT row_id, alg, concat_ws(',', CASE WHEN lower(coalesce(alg, 'none')) = 'none' THEN 'alg_none' END, CASE WHEN exp IS NULL THEN 'no_expiry' END, CASE WHEN exp < 1700000000 THEN 'expired' END,
  CASE WHEN regexp_matches(b, '(?i)"(?:password|secret|ssn|cpf|credit_card)"\s*:') THEN 'sensitive_claim' END) AS issues FROM q""",
    "event_trend": "SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2",
}
