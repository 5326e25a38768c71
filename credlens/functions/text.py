"""Scalar text expressions used by the detectors.

Each function takes Spark SQL expression text and returns Spark SQL expression text built
from built-in functions only, for ``selectExpr`` and ``F.expr``. The same text works in a
projection and inside a higher-order function, and nothing ever leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable

from credlens.schema import SEVERITIES

PREVIEW_MASK_ALL = 8             # values up to this length are shown as stars only
FINGERPRINT_HEX_CHARS = 16
CHARACTERS = 0x110000            # how many different characters a text can have


def lit(value: str | float | int | None) -> str:
    """A SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r")
        # Spark would replace ${name} with a configuration value before parsing.
        return "'" + escaped.replace("${", "\\u0024{") + "'"
    if isinstance(value, float):
        return f"{value!r}D"
    return str(value)


def any_of(tests: Iterable[str]) -> str:
    tests = list(tests)
    return "(" + " OR ".join(tests) + ")" if tests else "false"


def bind(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once, as ``name``, and use it several times in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def normalize_newlines(text: str) -> str:
    """Turn CRLF and lone CR into LF: literal replaces, and only where there is a CR."""
    unix = f"replace(replace({text}, '\\r\\n', '\\n'), '\\r', '\\n')"
    return f"if(contains({text}, '\\r'), {unix}, {text})"


def redact(secret: str) -> str:
    """Masked preview: first four and last two characters plus the length."""
    value = f"regexp_replace({secret}, {lit(r'(?U)^\s+|\s+$')}, '')"
    return bind("v", value, (
        f"if(length(v) <= {PREVIEW_MASK_ALL}, repeat('*', length(v)), "
        "concat(substring(v, 1, 4), '…', substring(v, -2, 2), ' (', length(v), ' chars)'))"))


def fingerprint(rule_id: str, secret: str, path: str) -> str:
    """Stable id of (rule, value, path); the value cannot be read back from it."""
    return (f"substring(sha2(concat_ws(':', {rule_id}, {secret}, {path}), 256), "
            f"1, {FINGERPRINT_HEX_CHARS})")


def shannon_entropy(text: str) -> str:
    """Entropy in bits per character; 0 for the empty string.

    Takes the first character, counts it by how much shorter the text is without it, and goes
    on with what is left: as many literal replaces as there are different characters, and never
    an array of characters, so a token may be as long as a text. The sum is rounded to 12
    digits so that values which are exact binary fractions in theory (4.0, 4.125, ...) are exact
    here too, whatever the order of summation.
    """
    share = "((length(acc.rest) - length(left)) / n)"
    step = bind("left", "replace(acc.rest, substring(acc.rest, 1, 1), '')", (
        f"named_struct('rest', left, 'total', acc.total + {share} * log2({share}))"))
    turns = f"sequence(1, least(n, {CHARACTERS}))"
    total = (f"aggregate({turns}, named_struct('rest', t, 'total', 0D), "
             f"(acc, i) -> if(acc.rest = '', acc, {step}), acc -> abs(round(acc.total, 12)))")
    return bind("t", text, f"if(t = '', 0D, {bind('n', 'length(t)', total)})")


def newline_count(text: str) -> str:
    """A newline is one byte, so the byte lengths tell the number of newlines."""
    return f"(octet_length({text}) - octet_length(replace({text}, '\\n', '')))"


def tail_length(text: str) -> str:
    """Characters after the last newline (all of them when there is none)."""
    return f"length(substring_index({text}, '\\n', -1))"


def column_after(column: str, newlines: str, tail: str) -> str:
    """1-based column after moving over a text with the given newlines and tail."""
    return f"if({newlines} = 0, {column} + {tail}, {tail} + 1)"


def severity_rank(severity: str) -> str:
    """0 for info up to 4 for critical; null for an unknown word."""
    whens = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SEVERITIES))
    return f"CASE {severity} {whens} END"


def rounded_entropy(entropy: str, digits: int = 3) -> str:
    """Half-even, as the values are published."""
    return f"bround({entropy}, {digits})"
