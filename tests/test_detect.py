import random
import re
import time

import pytest

from conftest import AWS, AWS_SAMPLE, GITHUB, RANDOM_TOKEN
from credlens.operators.custom import Match, detect_with_python
from credlens.operators.detect import BLOCK, detect
from credlens.rules import Allowlist, RulePack, default_rule_pack, parse_rule_pack
from credlens.schema import FINDING


def places(findings):
    return sorted((r.path, r.rule_id, r.line, r.column) for r in findings.collect())


def test_output_schema(docs):
    assert detect(docs(("p", "x"))).schema.simpleString() == FINDING.simpleString()


def test_finding_fields(docs):
    row = detect(docs(("config.py", f"\n  K = '{AWS}'\n"))).first()
    assert (row.rule_id, row.severity, row.line, row.column) == ("aws_access_key_id", "critical", 2, 8)
    assert (row.preview, row.verifier, row.entropy) == ("AKIA…8N (20 chars)", "aws_sts", None)
    assert (row.source, row.verification) == ("filesystem", "unverified")


def test_captured_value_is_redacted_and_placed(docs):
    row = detect(docs(("a.py", 'pass' + 'word = "hunter2hunter2hunter2"\n'))).first()
    assert row.rule_id == "generic_api_key_assignment"
    assert (row.column, row.preview) == (13, "hunt…r2 (21 chars)")


def test_clean_text_empty_text_and_null_text_give_nothing(docs):
    assert detect(docs(("ok.py", "def add(a, b):\n    return a + b\n"), ("e", ""), ("n", None))).count() == 0


def test_verifier_hint_and_measured_entropy(docs):
    row = detect(docs(("c.py", "k='sk-" + f"proj-{RANDOM_TOKEN}'"))).where("rule_id = 'openai_api_key'").first()
    assert row.verifier == "openai" and row.entropy > 3


def test_value_allowlist(docs):
    rows = docs(("a", f"K='{AWS_SAMPLE}'\n"),
                ("b", 'api_key = "<your-api-key-here>"\npass' + 'word = "${DB_PASSWORD}"\n'))
    assert detect(rows).count() == 0
    assert detect(rows, default_rule_pack().without_allowlist()).where("path = 'a'").count() == 1


def test_path_allowlist_ignores_case_and_empty_paths(docs):
    pack = RulePack(default_rule_pack().rules, Allowlist((), ("FIXTURES/", "^$")))
    rows = docs(("fixtures/a.py", AWS), ("src/a.py", AWS), ("", AWS))
    assert [r.path for r in detect(rows, pack).orderBy("path").collect()] == ["", "src/a.py"]


def test_entropy_gate(docs):
    assert detect(docs(("c.py", 'token = "aaaaaaaaaaaaaaaa"\n'))).count() == 0


def test_entropy_gate_is_inclusive(docs):
    pack = parse_rule_pack({"patterns": [{"id": "r", "regex": "v=([a-d]{4})", "capture": 1, "min_entropy": 2.0}]})
    assert detect(docs(("p", "v=abcd v=abca")), pack).count() == 1


def test_entropy_detector(docs, rules_found):
    rows = docs(("a", f"token = '{RANDOM_TOKEN}'"), ("b", "a" * 40), ("c", "1" * 40), ("d", "x" * 23))
    found = detect(rows, signatures=False, entropy=True)
    row = found.first()
    assert found.count() == 1
    assert (row.rule_id, row.severity, row.column) == ("high_entropy_string", "low", 10)
    assert row.description == f"High-entropy string (H={row.entropy:.2f})"
    assert detect(rows, signatures=False, entropy=True, min_entropy=5.5).count() == 0
    assert rules_found(detect(rows, entropy=True)) == ["generic_api_key_assignment", "high_entropy_string"]


def test_entropy_tokens_next_to_any_separator(docs):
    rows = docs(("tab", f"a\t{RANDOM_TOKEN}\tb"), ("lines", f"a\n{RANDOM_TOKEN}\nb"), ("quote", f"x='{RANDOM_TOKEN}'"),
                ("accent", f"é{RANDOM_TOKEN}é"), ("alone", RANDOM_TOKEN), ("cut", f"{RANDOM_TOKEN[:23]} {RANDOM_TOKEN[:23]}"))
    found = detect(rows, signatures=False, entropy=True)
    assert {r.path: (r.line, r.column) for r in found.collect()} == {
        "tab": (1, 3), "lines": (2, 1), "quote": (1, 4), "accent": (1, 2), "alone": (1, 1)}


def test_inline_pragma_only_on_the_marked_line(docs):
    rows = docs(("a", f'k = "{AWS}"  # pragma: allowlist secret\n'), ("b", f'k = "{AWS}"\n'),
                ("c", f"k = {AWS} // GitLeaks:Allow"), ("d", f"k = {AWS} # pragma:  allowlist-secret"),
                ("e", f"k = {AWS} # ordinary"))
    assert [r.path for r in detect(rows).orderBy("path").collect()] == ["b", "e"]
    assert detect(rows, pragmas=False).count() == 5


def test_pragma_comes_before_dedup(docs):
    text = f"k = '{AWS}' # gitleaks:allow\nx\nk = '{AWS}'\nk = '{AWS}'\n"
    assert places(detect(docs(("a", text)))) == [("a", "aws_access_key_id", 3, 6)]
    assert len(places(detect(docs(("a", text)), dedup=False))) == 2


def test_newlines_are_universal(docs):
    text = f"x\r\ny\r  {AWS}\r\n"
    assert places(detect(docs(("a", text)))) == [("a", "aws_access_key_id", 3, 3)]


def test_columns_count_code_points(docs):
    assert places(detect(docs(("a", f"é😀 {AWS}")))) == [("a", "aws_access_key_id", 1, 4)]


def test_boundary_next_to_an_accented_letter_is_python_s(docs):
    # On the JVM in use an accented letter is a word character for \b, as it is in Python.
    text = f"é{AWS}"
    expected = 1 if re.search(r"\bAKIA", text) else 0
    assert detect(docs(("a", text))).count() == expected


def test_multi_line_value(docs):
    pem = "-----BEGIN RSA PRIVATE" + " KEY-----\nQUJD\nREVG\n-----END RSA PRIVATE" + " KEY-----"
    row = detect(docs(("k", f"a\nb {pem}\n{AWS}")), secret_hash=True).orderBy("line").collect()
    assert [(r.rule_id, r.line, r.column) for r in row] == [
        ("private_key_block", 2, 3), ("aws_access_key_id", 6, 1)]
    assert row[0].preview == f"----…-- ({len(pem)} chars)"


def test_one_value_may_match_two_rules(docs, rules_found):
    value = "sk-" + "ant-api03-" + "Zk9Q2xL7mP4rT1vY8wB3" * 4 + "abcd"
    assert rules_found(detect(docs(("a", value)))) == ["anthropic_api_key", "openai_api_key"]


def test_secret_hash_only_for_verifiable_one_line_values(docs):
    rows = detect(docs(("a", f"{GITHUB}\npass" + 'word = "hunter2hunter2hunter2"')), secret_hash=True)
    got = {r.rule_id: r.secret_sha256 is not None for r in rows.collect()}
    assert got == {"github_pat": True, "generic_api_key_assignment": False}


def test_no_output_column_holds_a_raw_value(docs):
    values = [AWS, GITHUB, "hunter2hunter2hunter2", RANDOM_TOKEN]
    text = f'{AWS}\n{GITHUB}\npass' + f'word = "{values[2]}"\n{RANDOM_TOKEN}\n'
    rows = detect(docs(("p", text)), entropy=True, secret_hash=True).collect()
    assert len(rows) >= 4
    for row in rows:
        assert not any(v in str(cell) for v in values for cell in row)


def test_kept_columns_and_line_map(spark):
    df = spark.createDataFrame([("p", f"a\n{AWS}", [10, 20], 7)],
                               "path string, content string, real array<int>, doc_id int")
    row = detect(df, keep=["doc_id"], line_map="real").first()
    assert (row.line, row.column, row.doc_id) == (20, 1, 7)


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_give_the_places_python_finds(docs, seed):
    """All matches, offsets and captures against a plain loop, on nasty random texts."""
    rng = random.Random(seed)
    patterns = [("whole", r"k[0-9]{2,4}", 0), ("capture", r"(?i)key\s{0,3}[:=]\s{0,3}([a-z0-9]{2,9})", 1),
                ("middle", r"<([a-zé]+)>", 1), ("lines", r"\[[^\]]{1,20}\]", 0)]
    pack = parse_rule_pack({"patterns": [
        {"id": i, "regex": rx, "capture": g} for i, rx, g in patterns]})
    alphabet = ["k12", "k3456", "KEY = ab1", "key:\nzz9", "<é>", "<abc>", "[a\nb]", "\n", "\r\n", "\r",
                " ", "😀", "é", "x", "[", "]", "<", "k1", "key"]
    rows = [(f"d{i}", "".join(rng.choices(alphabet, k=rng.randrange(0, 120)))) for i in range(60)]
    expected = []
    for path, raw in rows:
        text = raw.replace("\r\n", "\n").replace("\r", "\n")
        for rule_id, rx, group in patterns:
            for m in re.finditer(rx, text):
                start = m.start(group)
                expected.append((path, rule_id, text.count("\n", 0, start) + 1, start - text.rfind("\n", 0, start)))
    got = places(detect(docs(*rows), pack, dedup=False))
    assert got == sorted(expected)


def test_dedup_keeps_the_first_of_every_value(docs):
    rng = random.Random(5)
    pack = parse_rule_pack({"patterns": [{"id": "r", "regex": r"v[0-9]"}]})
    text = "".join(rng.choice(["v1", "v2", "v3", "v4", "\n", " "]) for _ in range(300))
    first = {}
    for m in re.finditer(r"v[0-9]", text):
        first.setdefault(m.group(0), m.start())
    expected = sorted((text.count("\n", 0, s) + 1, s - text.rfind("\n", 0, s)) for s in first.values())
    assert sorted((r.line, r.column) for r in detect(docs(("p", text)), pack).collect()) == expected


def test_a_dump_with_many_values_takes_linear_time(docs):
    """Several blocks of matches in one text: exact places, and no quadratic blow-up."""
    lines = BLOCK * 40
    text = "\n".join(f"gh" + "p_" + f"{i:036d}" for i in range(lines))
    start = time.perf_counter()
    rows = detect(docs(("dump", text))).select("line", "column").collect()
    assert time.perf_counter() - start < 60
    assert sorted((r.line, r.column) for r in rows) == [(i + 1, 1) for i in range(lines)]


def test_python_detector(docs):
    def detector(path, text):
        if "boom" in text:
            raise ValueError("no")
        for m in re.finditer(r"T-\d+", text):
            yield Match("t", m.start(), m.group(0), severity="high")

    rows = docs(("a", "x\n T-12 T-12 T-3\n"), ("b", "boom T-1"), ("c", "T-9 # gitleaks:allow\nT-8"),
                ("d", "T-77"))
    found, errors = detect_with_python(rows, detector, allowlist=Allowlist(("77",)))
    assert places(found) == [("a", "t", 2, 2), ("a", "t", 2, 12), ("c", "t", 2, 1)]
    assert [(r.path, r.error) for r in errors.collect()] == [("b", "ValueError: no")]
    assert found.columns == [f.name for f in FINDING.fields]
