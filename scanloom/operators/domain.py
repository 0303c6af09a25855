"""Checks of whole texts by kind: mobile, web, databases, contracts, models, API descriptions, further infrastructure."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: kind → (issue, severity, pattern, pattern that clears it or None); our own selection.
CHECKS: dict[str, tuple[tuple[str, str, str, str | None], ...]] = {
    "android_manifest": (
        ("debuggable", "HIGH", r'android:debuggable\s*=\s*"true"', None), ("backup_allowed", "MEDIUM", r'android:allowBackup\s*=\s*"true"', None), ("cleartext_traffic", "HIGH", r'usesCleartextTraffic\s*=\s*"true"', None),
        ("exported_without_permission", "HIGH", r'exported\s*=\s*"true"', r"android:permission\s*="), ("dangerous_permission", "LOW", r"permission\.(?:READ_SMS|RECORD_AUDIO|SYSTEM_ALERT_WINDOW)", None),
    ),
    "mobile_code": (("trusts_all_certificates", "CRITICAL", r"checkServerTrusted\s*\([^)]*\)\s*\{\s*\}|ALLOW_ALL_HOSTNAME", None), ("webview_javascript", "MEDIUM", r"setJavaScriptEnabled\(\s*true", None), ("world_readable", "HIGH", r"MODE_WORLD_(?:READABLE|WRITEABLE)", None), ("logs_secret", "MEDIUM", r"Log\.[dive]\([^)]*(?:password|token)", None)),
    "web": (("inline_handler", "LOW", r"<[a-z][^>]*\son\w+\s*=", None), ("form_without_token", "MEDIUM", r'<form[^>]*method\s*=\s*["\']?post', r"csrf|authenticity_token"), ("message_without_origin", "MEDIUM", r"addEventListener\(\s*[\"']message", r"\.origin"), ("storage_of_token", "MEDIUM", r"localStorage\.setItem\([^)]*(?:token|jwt)", None)),
    "database": (("grant_all", "HIGH", r"grant\s+all\b", None), ("plain_password", "CRITICAL", r"identified\s+by\s+'[^']+'", None), ("dynamic_sql", "HIGH", r"execute\s+immediate|exec\s*\(\s*@", None), ("public_role", "HIGH", r"\bto\s+public\b", None)),
    "contract": (("origin_as_sender", "HIGH", r"\btx\.origin\b", None), ("unchecked_call", "HIGH", r"\.call\{?[^;]*\}?\([^;]*\)\s*;", r"\(bool\s+\w+"), ("selfdestruct", "CRITICAL", r"\bselfdestruct\s*\(", None), ("timestamp_as_chance", "MEDIUM", r"\bblock\.timestamp\b.*%", None), ("delegatecall", "HIGH", r"\.delegatecall\s*\(", None)),
    "model": (("pickle_model", "CRITICAL", r"(?:torch|joblib|pickle)\.load\(", r"weights_only\s*=\s*True"), ("remote_code", "CRITICAL", r"trust_remote_code\s*=\s*True", None), ("unpinned_weights", "MEDIUM", r"from_pretrained\(", r"revision\s*="), ("prompt_from_input", "MEDIUM", r"prompt\s*=\s*f[\"'].*\{(?:user|input|request)", None)),
    "graphql": (("introspection_on", "MEDIUM", r"introspection\s*[:=]\s*true", None), ("list_without_limit", "LOW", r"\w+\s*:\s*\[\w+!?\]", r"\b(?:first|limit)\s*:"), ("mutation_without_auth", "HIGH", r"type\s+Mutation\s*\{", r"@auth|@hasRole")),
    "wsdl": (("plain_http", "HIGH", r'location\s*=\s*"http://', None), ("no_policy", "MEDIUM", r"<(?:wsdl:)?definitions", r"wsp:Policy|wsse:"), ("external_entity", "HIGH", r"<!ENTITY", None)),
    "asyncapi": (("plain_broker", "HIGH", r'"?protocol"?\s*:\s*"?(?:mqtt|amqp|kafka|ws)"?\s*[,}\n]', None), ("no_security", "HIGH", r'"?servers"?\s*:', r'"?security"?\s*:')),
    "bicep": (("public_access", "HIGH", r"publicNetworkAccess:\s*'Enabled'", None), ("plain_http", "HIGH", r"httpsOnly:\s*false", None)),
    "rego": (("allow_by_default", "HIGH", r"default\s+allow\s*(?::=|=)\s*true", None),),
    "ansible": (("plain_password", "CRITICAL", r"password:\s*[\"']?[^\s{\"'][^\n]*", None), ("no_certificate_check", "HIGH", r"validate_certs:\s*(?:no|false)", None)),
    "nginx": (("server_tokens", "LOW", r"server_tokens\s+on", None), ("old_tls", "HIGH", r"ssl_protocols[^;]*(?:SSLv3|TLSv1(?:\.1)?\b(?!\.))", None)),
}


def check_texts(texts: DataFrame) -> DataFrame:
    """id, kind, issue, severity of texts (id, kind, text); unknown kinds and null texts give nothing."""
    text, hits = F.col("text"), []
    for kind, checks in CHECKS.items():
        for issue, severity, pattern, clear in checks:
            cond = (F.col("kind") == kind) & text.rlike("(?is)" + pattern)
            if clear:
                cond = cond & ~text.rlike("(?is)" + clear)
            hits.append(F.when(cond, F.struct(F.lit(issue).alias("issue"), F.lit(severity).alias("severity"))))
    return texts.select("id", "kind", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("id", "kind", "h.*")


def matches(texts: DataFrame, pattern: str) -> DataFrame:
    """id, n, match, start of every match of a pattern in texts (id, text), starts from 1.

    Starts come from the lengths of the pieces between the matches.
    """
    rows = texts.where("text is not null").select("id", F.split("text", pattern, -1).alias("p"), F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(0)).alias("m"))
    rows = rows.select("id", "p", "m", F.posexplode("m").alias("n", "match"))
    total = lambda a, k: F.aggregate(F.slice(a, 1, k), F.lit(0), lambda acc, x: acc + F.length(x))
    return rows.select("id", "n", "match", (total("p", F.col("n") + 1) + total("m", F.col("n")) + 1).alias("start"))
