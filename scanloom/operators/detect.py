"""Detectors over lines: entropy of assigned strings, personal numbers, tokens, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scanloom.functions.text import b64url_text, charset, cnpj_valid, cpf_valid, digits_of, entropy_threshold, has_secret_hint, luhn, mask_middle, shannon

_ASSIGN = r"(?i)([A-Za-z_][A-Za-z0-9_]*)\s*(?::=|=|:)\s*[\"']([^\"']{16,})[\"']"
_COMMENT = r"^\s*(?:#|//|--|\*|')"

CPF = r"\b[0-9]{3}[. ]?[0-9]{3}[. ]?[0-9]{3}[- ]?[0-9]{2}\b"
CNPJ = r"\b[0-9]{2}[. ]?[0-9]{3}[. ]?[0-9]{3}[/ ]?[0-9]{4}[- ]?[0-9]{2}\b"
CARD = r"\b[3-6][0-9]{3}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4,7}\b"
EMAIL = r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+[.][a-z]{2,}"
PHONE = r"\(?\b[0-9]{2}\)?[ .-]?9?[0-9]{4}[ .-]?[0-9]{4}\b"
# Domains of placeholder addresses.
PLACEHOLDER_DOMAINS = ("@example.", "@test.", "@domain.", "@foo.", "@bar.", "@email.")


def each_match(df: DataFrame, column: str, pattern: str, alias: str, group: int = 0) -> DataFrame:
    return df.withColumn(alias, F.explode(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(group))))


def entropy_findings(lines: DataFrame, column: str = "line") -> DataFrame:
    """Assignments of strings that look random, or that are named like a secret: adds variable_name, value, entropy, charset.

    Comment lines are skipped; a variable counts once per line, by its first value found; null lines give none.
    """
    names = F.regexp_extract_all(F.col(column), F.lit(_ASSIGN), F.lit(1))
    values = F.regexp_extract_all(F.col(column), F.lit(_ASSIGN), F.lit(2))
    rows = lines.where(~F.col(column).rlike(_COMMENT)).select("*", F.posexplode(F.arrays_zip(names.alias("n"), values.alias("v"))).alias("_at", "_p"))
    rows = rows.withColumns({"variable_name": F.col("_p")["n"], "value": F.col("_p")["v"]}).drop("_p")
    rows = rows.withColumns({"entropy": F.round(shannon(F.col("value")), 3), "charset": charset(F.col("value"))})
    rows = rows.where((F.col("entropy") >= entropy_threshold(F.col("charset"))) | ((F.col("entropy") >= 3.0) & has_secret_hint(F.col("variable_name"))))
    found = ("value", "entropy", "charset")
    return rows.groupBy(*lines.columns, "variable_name").agg(F.min_by(F.struct(*found), "_at").alias("_f")).select(*lines.columns, "variable_name", *[F.col("_f")[c].alias(c) for c in found])


def masked_secret(value: Column) -> Column:
    return F.when(F.length(value) > 16, F.concat(F.left(value, F.lit(8)), F.lit("..."), F.right(value, F.lit(4)))).otherwise(value)


def personal_numbers(lines: DataFrame, column: str = "line") -> DataFrame:
    """Validated numbers and addresses in lines: the lines' columns, pii_type, masked_value.  Comment lines are skipped."""
    rows = lines.where(~F.col(column).rlike(_COMMENT))
    parts = []
    for kind, pattern, valid in (("CPF", CPF, cpf_valid), ("CNPJ", CNPJ, cnpj_valid), ("Card", CARD, luhn)):
        hit = each_match(rows, column, pattern, "_m")
        parts.append(hit.where(valid(F.col("_m"))).withColumns({"pii_type": F.lit(kind), "masked_value": mask_middle(digits_of(F.col("_m")))}))
    mail = each_match(rows.where(F.col(column).rlike(r"(?i)(?:print|log|insert|update|values|=|:)\s")), column, EMAIL, "_m")
    mail = mail.where(~F.lower("_m").rlike("|".join(d.replace(".", "[.]") for d in PLACEHOLDER_DOMAINS)))
    parts.append(mail.withColumns({"pii_type": F.lit("Email"), "masked_value": F.concat(F.left("_m", F.lit(2)), F.lit("***@"), F.substring_index("_m", "@", -1))}))
    phone = each_match(rows, column, PHONE, "_m")
    parts.append(phone.withColumns({"pii_type": F.lit("Phone"), "masked_value": F.concat(F.lit("****-"), F.right(digits_of(F.col("_m")), F.lit(4)))}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("_m").distinct()


JWT = r"\b(eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*)"


def jwt_findings(lines: DataFrame, as_of: int, column: str = "line") -> DataFrame:
    """JSON web tokens in lines: adds token_start, alg, exp, issues (comma-separated).  ``as_of``: epoch seconds that decide expiry."""
    rows = each_match(lines, column, JWT, "token", 1)
    part = lambda n: b64url_text(F.try_element_at(F.split("token", r"\."), F.lit(n)))
    rows = rows.withColumns({"_h": part(1), "_p": part(2)}).where("_h is not null")
    alg, exp = F.get_json_object("_h", "$.alg"), F.get_json_object("_p", "$.exp").try_cast("long")
    issues = F.array_compact(
        F.array(
            F.when(F.coalesce(F.lower(alg), F.lit("none")) == "none", "alg_none"), F.when(exp.isNull(), "no_expiry"), F.when(exp < as_of, "expired"),
            F.when(F.col("_p").rlike(r"(?i)\"(?:password|secret|ssn|cpf|credit_card)\"\s*:"), "sensitive_claim"),
        )
    )
    return rows.withColumns({"alg": alg, "exp": exp, "issues": F.array_join(issues, ","), "token_start": F.left("token", F.lit(12))}).drop("_h", "_p", "token")


PEM = r"(?s)-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----(.*?)-----END \1-----"


def key_blocks(texts: DataFrame, column: str = "content") -> DataFrame:
    """Private key blocks in whole texts: adds key_type, encrypted, n_chars."""
    kinds = F.regexp_extract_all(F.col(column), F.lit(PEM), F.lit(1))
    bodies = F.regexp_extract_all(F.col(column), F.lit(PEM), F.lit(2))
    rows = texts.withColumn("_z", F.explode(F.arrays_zip(kinds.alias("k"), bodies.alias("b"))))
    return rows.withColumns({"key_type": F.col("_z")["k"], "encrypted": F.contains(F.col("_z")["k"], F.lit("ENCRYPTED")) | F.contains(F.col("_z")["b"], F.lit("Proc-Type: 4,ENCRYPTED")), "n_chars": F.length(F.regexp_replace(F.col("_z")["b"], r"\s", ""))}).drop("_z")


def ssh_public_keys(lines: DataFrame, column: str = "line") -> DataFrame:
    return lines.withColumn("key_type", F.regexp_extract(column, r"\b(ssh-(?:rsa|ed25519|dss)|ecdsa-sha2-nistp[0-9]+)\s+AAAA[A-Za-z0-9+/=]+", 1)).where("key_type <> ''")
