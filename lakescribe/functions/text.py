"""Text helpers: identifiers, globs, redaction, masking tokens and comparison forms."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F, types as T

from . import fixed_values as fixed
from .types import text_form

BLANKS = " \t\n\r\f\x0b"


def strip(column: Column) -> Column:
    """Trim every kind of ASCII blank at both ends (``trim`` alone takes spaces only)."""
    return F.btrim(column, F.lit(BLANKS))


def normalized_name(column: Column) -> Column:
    return F.regexp_replace(F.lower(column), "[^a-z0-9]", "")


def glob_to_regex(glob: str) -> str:
    """An anchored regex for a shell-style glob (``*``, ``?``, ``[a-z]``, ``[!a-z]``)."""
    out, i = [], 0
    while i < len(glob):
        char = glob[i]
        close = glob.find("]", i + 2) if char == "[" else -1
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif close > 0:
            body = glob[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = close
        else:
            out.append("\\" + char if char in r"\.^$|?*+()[]{}-&~#" else char)
        i += 1
    return r"\A(?s:" + "".join(out) + r")\z"


def glob_runs(glob: str) -> list[str]:
    """The literal stretches of a shell-style glob, between the marks ^ and $ of its two ends."""
    runs, i = [""], 0
    while i < len(glob):
        char = glob[i]
        close = glob.find("]", i + 2) if char == "[" else -1
        if char in "*?" or close > 0:
            runs.append("")
            i = max(i, close)
        else:
            runs[-1] += char
        i += 1
    runs[0], runs[-1] = "^" + runs[0], runs[-1] + "$"
    return runs


def contains_any(column: Column, markers: Iterable[str]) -> Column:
    lowered = F.lower(column)
    test = F.lit(False)
    for marker in markers:
        test = test | lowered.contains(marker)
    return test


def holds_any(text: Column, words: Iterable[str]) -> Column:
    """Whether a text holds one of some plain words: a cheap test in front of a pattern search."""
    test = F.lit(False)
    for word in words:
        test = test | text.contains(word)
    return test


def searched(text: Column, words: Iterable[str], pattern: str) -> Column:
    """``text.rlike(pattern)`` for a pattern that cannot match without one of the words."""
    return holds_any(text, words) & text.rlike(pattern)


SECRET_HINT = "pass|pwd|token|secret|key"


def may_hold_secret(text: Column) -> Column:
    """Whether a text has an equals sign and a word that every secret pattern starts with."""
    return text.contains("=") & F.lower(text).rlike(SECRET_HINT)


def secrets_replaced(text: Column) -> Column:
    text = F.regexp_replace(text, fixed.CONNECTION_PASSWORD, "$1[REDACTED]")
    return F.regexp_replace(text, fixed.SECRET_ASSIGNMENT, "$1=[REDACTED]")


def redact_text(column: Column, literals: Iterable[str] = ()) -> Column:
    """Replace connection passwords, secret assignments and the given literals, longest first.

    Texts that cannot hold an assignment are not searched for one.
    """
    text = F.when(may_hold_secret(column), secrets_replaced(column)).otherwise(column)
    for literal in sorted((item for item in literals if item), key=len, reverse=True):
        if "\\" in literal:
            text = F.replace(text, F.lit(literal.replace("\\", "\\\\")), F.lit(fixed.REDACTED))
        text = F.replace(text, F.lit(literal), F.lit(fixed.REDACTED))
    return text


def mask_token(text: Column, salt: str) -> Column:
    digest = F.sha2(F.concat(F.lit(salt + "|"), text), 256)
    return F.concat(F.lit("[MASKED:"), F.substring(digest, 1, 16), F.lit("]"))


def mask_value(
    column: Column,
    category: Column | str,
    salt: str,
    data_type: T.DataType | None = None,
    enabled: bool = True,
) -> Column:
    """The publishable text of one value under its column's category; NULL stays NULL."""
    data_type = data_type or T.StringType()
    category = F.lit(category) if isinstance(category, str) else category
    if isinstance(data_type, T.BinaryType):
        text = F.base64(column)
        plain = F.lit(fixed.BINARY_REDACTED)
    elif isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        text = plain = F.to_json(column)
    else:
        text = plain = text_form(column, data_type)
    masked = F.when(category == "Credential", F.lit(fixed.REDACTED))
    if enabled:
        masked = masked.when(category.isin(*fixed.SENSITIVE_CATEGORIES), mask_token(text, salt))
    return F.when(column.isNotNull(), masked.otherwise(plain))


def is_safely_masked(value: Column, category: Column) -> Column:
    """Blank, or the token its category asks for."""
    text = strip(value)
    return (
        F.when(value.isNull() | (text == ""), F.lit(True))
        .when(category == "Credential", text == fixed.REDACTED)
        .otherwise((text == fixed.REDACTED) | text.rlike(fixed.MASKED_TOKEN))
    )


def stable_text(column: Column) -> Column:
    """The comparison text of a value: NULL and the empty string are the same."""
    return F.coalesce(column.cast("string"), F.lit(""))


def stable_number(column: Column) -> Column:
    """A lenient number: thousands commas dropped; blanks, None and NULL have none."""
    text = F.replace(column.cast("string"), F.lit(","), F.lit(""))
    number = F.when(text.rlike(r"[dDfF]\s*$"), F.lit(None)).otherwise(text)
    return number.try_cast("double")


def is_true(column: Column) -> Column:
    """A catalogue flag: true, 1, yes or on, whatever its type."""
    return F.coalesce(F.lower(strip(column.cast("string"))).isin("1", "true", "yes", "on"), F.lit(False))


def is_present(column: Column) -> Column:
    return F.coalesce(column.cast("string") != "", F.lit(False))
