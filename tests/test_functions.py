import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from credlens.functions import register_functions
from credlens.functions import text as tx


def evaluate(spark, sql, value):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(F.expr(sql).alias("y")).first().y


@pytest.mark.parametrize(("secret", "preview"), [
    ("", ""), ("abc", "***"), ("12345678", "********"), ("123456789", "1234…89 (9 chars)"),
    ("  padded-value \n", "padd…ue (12 chars)"), ("été-été-été", "été-…té (11 chars)"),
])
def test_redact(spark, secret, preview):
    assert evaluate(spark, tx.redact("x"), secret) == preview


def test_redact_hides_the_body(spark):
    value = "AK" + "IAIOSFODNN7EXAMPLE"
    assert "IOSFODNN" not in evaluate(spark, tx.redact("x"), value)


def test_fingerprint_is_the_hash_of_rule_value_and_path(spark):
    expected = hashlib.sha256(b"r:s:dir/f").hexdigest()[:16]
    assert evaluate(spark, tx.fingerprint("'r'", "x", "'dir/f'"), "s") == expected
    assert evaluate(spark, tx.fingerprint("'r'", "x", "'dir/f'"), "t") != expected


@pytest.mark.parametrize("text", [
    "", "a", "aaaa", "ab", "aB3$xZ9qLm2Kp7Wv", "é😀é😀x", "0123456789abcdef" * 3,
    "aaaaaaaabbbbccde" * 2, "a.b|c*d+e?f",
])
def test_entropy_equals_the_plain_formula(spark, text):
    counts = Counter(text)
    expected = -sum(c / len(text) * math.log2(c / len(text)) for c in counts.values()) if text else 0.0
    got = evaluate(spark, tx.shannon_entropy("x"), text)
    assert got == pytest.approx(expected, abs=1e-11)
    assert math.copysign(1, got) == 1


def test_entropy_ties_round_to_even(spark):
    value = "a" * 8 + "bbbbccccddddeeee" + "ffgghh" + "ij"     # exactly 3.0625 bits
    assert evaluate(spark, tx.rounded_entropy(tx.shannon_entropy("x")), value) == round(3.0625, 3)


@pytest.mark.parametrize(("raw", "unix"), [
    ("a\r\nb", "a\nb"), ("a\rb", "a\nb"), ("a\n\rb", "a\n\nb"), ("a\r\r\nb\n", "a\n\nb\n"), ("plain", "plain"),
])
def test_normalize_newlines(spark, raw, unix):
    assert evaluate(spark, tx.normalize_newlines("x"), raw) == unix


@pytest.mark.parametrize(("word", "rank"), [
    ("info", 0), ("low", 1), ("medium", 2), ("high", 3), ("critical", 4), ("fatal", None)])
def test_severity_rank(spark, word, rank):
    assert evaluate(spark, tx.severity_rank("x"), word) == rank


def test_literals_survive_quoting(spark):
    for value in ("it's", 'say "hi"', r"\b\d+\\", "tab\tnl\ncr\r", "${a}", "é😀"):
        assert spark.range(1).select(F.expr(tx.lit(value)).alias("y")).first().y == value


def test_sql_functions(spark):
    register_functions(spark)
    row = spark.sql("SELECT redact('123456789') AS p, shannon_entropy('abcd') AS h, "
                    "severity_rank('high') AS r, fingerprint('r', 's', 'p') AS f").first()
    assert (row.p, row.h, row.r) == ("1234…89 (9 chars)", 2.0, 3)
    assert row.f == hashlib.sha256(b"r:s:p").hexdigest()[:16]


def test_entropy_of_long_values(spark):
    """One token as long as a text: no array of characters, and the same number as by counting."""
    rows = [(0, "ab" * 1_000_000), (1, "".join(map(chr, range(0x4E00, 0x4E00 + 500))) * 3), (2, ""), (3, "aaaa"), (4, "é🎉é🎉abab")]
    got = {r.i: r.h for r in spark.createDataFrame(rows, "i int, t string").selectExpr("i", f"{tx.shannon_entropy('t')} AS h").collect()}
    for i, text in rows:
        shares = [text.count(c) / len(text) for c in set(text)]
        assert abs(got[i] + sum(p * math.log2(p) for p in shares)) < 1e-9
