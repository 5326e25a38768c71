"""Python's regex dialect on Spark: the same matches as ``re``, or a refusal on the driver."""

import random
import re

import pytest
from pyspark.sql import functions as F

from credlens.dialect import DialectError, least_width, to_java
from credlens.operators.detect import detect
from credlens.rules import RulePackError, parse_rule_pack

PATTERNS = [
    r"\w{4}é", r"\bk\w+\b", r"foo\Z", r"foo$", r"[^[\]]{3}z", r"[a-z&&x]{4}q", r"[]x]{2}", r"(?P<q>['\"])\w+(?P=q)", r"(['\"])(\d+)\1",
    r"\S+\s\S+", r"[\W_]{2}", r"\Bx", r"x{,2}y", r"[\b\d]k", r"a.c", r"(?i)straw\d", r"^k", r"[\s,]+k", r"\D{3}k",
]
TEXTS = ["caféé kk 'ab' \"12\" '7\"", "foo\n", "xxx foo", "a[]zz abz xyz", "aax&q xx&xq", "]x]]", "k 1k ٣k _k é_", "xxy y ax", "a\rc a\nc",
         "STRAW5 straw٣", "k, ,k k k", "", "x bx"]


def first_matches(spark, pattern, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = rows.select("i", F.regexp_extract_all("t", F.lit("(?d)" + to_java(pattern)), 0).alias("found"))
    return [r.found for r in found.orderBy("i").collect()]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_matches_equal_re(spark, pattern):
    assert first_matches(spark, pattern, TEXTS) == [[m[0] for m in re.finditer(pattern, t)] for t in TEXTS]


def test_refused():
    for pattern in (r"(a)(?(1)b|c)", r"(?a)\w", r"[^\W]x"):
        with pytest.raises(DialectError):
            to_java(pattern)
    for regex in (r"\b", r"(?=AKIA)", r"x*", r"(a)(?(1)b|c)", r"a|"):
        with pytest.raises(RulePackError):
            parse_rule_pack({"patterns": [{"id": "r", "regex": regex}]})
    assert least_width(r"a{2,}b?|ccc") == 2


CAPTURES = [
    (r"key=([\"'])([a-z0-9]{6,40})\1", 2), (r"(?i)(?:set (pass(?:word)?)) *= *((\w)(\w*?)\3)\b", 2), (r"a(b(c(\d+))d)e", 3),
    (r"(?:x(?:y(\d+))z)\1", 1), (r"(?P<n>k)-(?P<v>\d{2,})-(?P=n)", 2), (r"((q)(w(\d)))\2\4", 4), (r"pre(\d)(?:mid(\w+))end\1", 2),
]


@pytest.mark.parametrize("regex,capture", CAPTURES)
def test_captured_values_and_columns(spark, docs, regex, capture):
    rng, alphabet = random.Random(4), [
        "key='abc123'", 'key="zz99zz"', "key='abc123\"", "set password = xabx", "SET pass=q1q", "abc12de", "abc7de", "xy12z12", "xy1z2", "k-123-k", "k-12-x",
        "qw5q5", "qw5q6", "pre1midabend1", "pre1midabend2", "\n", " ", "é🎉"]
    texts = ["".join(rng.choice(alphabet) + " " for _ in range(12)) for _ in range(25)]
    pack = parse_rule_pack({"patterns": [{"id": "r", "regex": regex, "capture": capture}]})
    got = detect(docs(*[(str(i), t) for i, t in enumerate(texts)]), pack, dedup=False, pragmas=False).select("path", "line", "column").collect()
    want = []
    for i, t in enumerate(texts):
        for m in re.finditer(regex, t):
            at = m.start(capture)
            want.append((str(i), t.count("\n", 0, at) + 1, at - t.rfind("\n", 0, at)))
    assert sorted(map(tuple, got)) == sorted(want) and want


@pytest.mark.parametrize("regex,capture", [(r"(?:a(\d))+", 1), (r"a(\d)|b", 1), (r"(?:a(\d)|b)c", 1), (r"(?=a(\d))a", 1)])
def test_other_captures_are_refused(regex, capture):
    with pytest.raises(RulePackError):
        parse_rule_pack({"patterns": [{"id": "r", "regex": regex, "capture": capture}]})


def test_keywords_of_a_pack_ignore_case(docs, rules_found):
    key = "AK" + "IA" + "Q" * 16
    entry = {"id": "r", "regex": "AKIA[0-9A-Z]{16}", "keywords": ["akia"]}
    assert rules_found(detect(docs(("a", f"x {key}")), parse_rule_pack({"patterns": [entry]}))) == ["r"]
    exact = entry | {"exact_keywords": True}
    assert rules_found(detect(docs(("a", f"x {key}")), parse_rule_pack({"patterns": [exact]}))) == []
