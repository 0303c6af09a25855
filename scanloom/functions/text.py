"""Text expressions: lines, masks, entropy, check digits."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: every line end that Python's str.splitlines knows.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def split_lines(text: Column) -> Column:
    """Lines of a text without their ends; an empty text has none; null stays null."""
    parts = F.split(text, LINE_END, -1)
    last_empty = F.element_at(parts, -1) == ""
    return F.when(last_empty, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


# Fixed value: a line without any visible character.
BLANK = r"^[\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]*$"


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, even where ``use`` names it inside a higher-order function."""
    return F.element_at(F.transform(F.array(value), use), 1)


def mask_middle(text: Column, first: int = 4, last: int = 4) -> Column:
    """First and last characters shown, stars between; shorter texts become stars."""
    n = F.length(text)
    return F.when(n <= first + last, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.left(text, F.lit(first)), F.repeat(F.lit("*"), n - first - last), F.right(text, F.lit(last)))
    )


def shannon(text: Column) -> Column:
    """Entropy of a text's characters in bits; 0 for the empty text, null for null."""

    def bits(chars: Column) -> Column:
        n = F.size(chars).cast("double")
        terms = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
        return -F.aggregate(terms, F.lit(0.0), lambda acc, p: acc + p * F.log2(p))

    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(bind(F.filter(F.split(text, ""), lambda c: c != ""), bits))


def charset(value: Column) -> Column:
    return F.when(value.rlike("^[0-9a-fA-F]+$"), "hex").when(value.rlike("^[A-Za-z0-9+/]+=*$") & (F.length(value) >= 20), "base64").otherwise("alnum")


def entropy_threshold(kind: Column) -> Column:
    return F.when(kind == "hex", 3.5).when(kind == "base64", 4.5).otherwise(4.0)


# Parts of names that hint at a secret.
SECRET_HINTS = "key token secret password passwd pwd auth api jwt bearer credential cred cert private access refresh signing encryption hmac salt nonce seed hash signature passphrase".split()


def has_secret_hint(name: Column) -> Column:
    return F.lower(name).rlike("|".join(SECRET_HINTS))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Luhn check of at least 13 digits."""
    d = digits_of(text)
    return (F.length(d) >= 13) & F.call_function("luhn_check", d)


def _weighted(digits: Column, weights: list[int]) -> Column:
    return F.aggregate(
        F.zip_with(F.slice(digits, 1, len(weights)), F.array(*[F.lit(w) for w in weights]), lambda a, b: a * b), F.lit(0), lambda acc, x: acc + x
    )


def _digit_array(text: Column) -> Column:
    return F.transform(F.filter(F.split(digits_of(text), ""), lambda c: c != ""), lambda c: c.cast("int"))


def _check(total: Column) -> Column:
    r = total % 11
    return F.when(r < 2, 0).otherwise(11 - r)


def cpf_valid(text: Column) -> Column:
    """Check digits of a CPF; repeated digits fail."""
    d = _digit_array(text)
    return F.when(F.size(d) != 11, F.lit(False)).otherwise(
        (F.size(F.array_distinct(d)) > 1) & (_check(_weighted(d, list(range(10, 1, -1)))) == d[9]) & (_check(_weighted(d, list(range(11, 1, -1)))) == d[10])
    )


def cnpj_valid(text: Column) -> Column:
    d = _digit_array(text)
    first = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    return F.when(F.size(d) != 14, F.lit(False)).otherwise(
        (F.size(F.array_distinct(d)) > 1) & (_check(_weighted(d, first)) == d[12]) & (_check(_weighted(d, [6, *first])) == d[13])
    )


def version_array(version: Column) -> Column:
    """Four integers of a version; letters are dropped, missing parts are 0."""
    parts = F.slice(F.split(F.coalesce(version, F.lit("")), r"\."), 1, 4)
    nums = F.transform(parts, lambda p: F.coalesce(F.regexp_replace(p, "[^0-9]", "").try_cast("int"), F.lit(0)))
    return F.slice(F.concat(nums, F.array_repeat(F.lit(0), 4)), 1, 4)


def version_lt(a: Column, b: Column) -> Column:
    return version_array(a) < version_array(b)


def b64url_text(segment: Column) -> Column:
    """Text of a base64url segment, padding optional; null if it isn't one."""
    std = F.translate(segment, "-_", "+/")
    padded = F.concat(std, F.repeat(F.lit("="), (4 - F.length(std) % 4) % 4))
    return F.call_function("try_to_binary", padded, F.lit("base64")).cast("string")


def cvss3_base(vector: Column) -> Column:
    """CVSS v3 base score of a vector string; null if it names no attack vector or confidentiality impact."""
    m = F.str_to_map(vector, F.lit("/"), F.lit(":"))

    def pick(key: str, table: dict[str, float], default: float) -> Column:
        out = None
        for k, v in table.items():
            out = F.when(m[key] == k, v) if out is None else out.when(m[key] == k, v)
        return out.otherwise(default)

    changed = F.coalesce(m["S"] == "C", F.lit(False))
    av = pick("AV", {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}, 0.85)
    ac = pick("AC", {"L": 0.77, "H": 0.44}, 0.77)
    ui = pick("UI", {"N": 0.85, "R": 0.62}, 0.85)
    pr = F.when(changed, pick("PR", {"N": 0.85, "L": 0.68, "H": 0.5}, 0.85)).otherwise(pick("PR", {"N": 0.85, "L": 0.62, "H": 0.27}, 0.85))
    c, i, a = (pick(k, {"H": 0.56, "L": 0.22, "N": 0.0}, 0.0) for k in "CIA")
    base = 1 - (1 - c) * (1 - i) * (1 - a)
    impact = F.when(changed, 7.52 * (base - 0.029) - 3.25 * F.pow(base - 0.02, F.lit(15))).otherwise(6.42 * base)
    raw = F.when(changed, 1.08).otherwise(1.0) * (impact + 8.22 * av * ac * pr * ui)
    score = F.ceil(F.least(raw, F.lit(10.0)) * 10) / 10.0
    return F.when(m["AV"].isNull() | m["C"].isNull(), None).when(impact <= 0, 0.0).otherwise(score)


def severity_of_score(score: Column) -> Column:
    return F.when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").when(score > 0, "LOW").otherwise("MEDIUM")
