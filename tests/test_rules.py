import json
import re

import pytest

from conftest import AWS, RANDOM_TOKEN
from credlens.operators.detect import detect
from credlens.rules import (
    Allowlist,
    Rule,
    RulePackError,
    default_rule_pack,
    load_rule_pack,
    parse_rule_pack,
    split_capture,
)

HEX = "0123456789abcdef"
B64 = "Zk9Q2xL7mP4rT1vY8wB3nC6dF0aH5jK"

# One value per rule that must be found, and one near miss that must not.
SAMPLES = {
    "aws_access_key_id": (AWS, "AK" + "IAZ7XQ4WL9PRT2KD8"),
    "aws_secret_access_key": ("aws_secret_access_key = " + B64 + "abcdefghi", "aws_secret = short"),
    "azure_storage_key": ("AccountKey=" + "aB3d" * 21 + "aB==", "AccountKey=" + "aB3d" * 20 + "=="),
    "gcp_api_key": ("AI" + "za" + B64 + "abcd", "AI" + "za" + B64),
    "gcp_service_account": ('{"type": "service_account"}', '{"type": "user_account"}'),
    "gcp_oauth_client_secret": ("GOC" + "SPX-" + B64[:28], "GOC" + "SPX-" + B64[:27]),
    "github_pat": ("gh" + "p_" + "a" * 36, "gh" + "p_" + "a" * 37),
    "github_fine_grained_pat": ("github" + "_pat_" + "a" * 22 + "_" + "b" * 59, "github" + "_pat_" + "a" * 22),
    "github_oauth_token": ("gh" + "o_" + "a" * 36, "gh" + "x_" + "a" * 36),
    "gitlab_pat": ("gl" + "pat-" + "A1b2C3d4E5f6G7h8I9j0", "gl" + "pat-" + "A1b2C3d4"),
    "openai_api_key": ("sk-" + "proj-" + RANDOM_TOKEN, "sk-" + "a" * 30),
    "anthropic_api_key": ("sk-" + "ant-api03-" + "Zk9Q2xL7mP4rT1vY8wB3" * 4 + "abcd", "sk-" + "ant-api03-abc"),
    "stripe_secret_key": ("sk" + "_live_" + "a1B2" * 6, "sk" + "_live_" + "a1B2"),
    "slack_token": ("xo" + "xb-" + "1234567890ab", "xo" + "xb-" + "123"),
    "slack_webhook": ("https://hooks.slack" + ".com/services/T12345678/B12345678/" + "a1B2" * 6,
                      "https://hooks.slack" + ".com/services/T1/B1/x"),
    "sendgrid_api_key": ("S" + "G." + "a" * 22 + "." + "b" * 43, "S" + "G." + "a" * 22 + ".b"),
    "twilio_api_key": ("S" + "K" + HEX * 2, "S" + "K" + "0" * 32),
    "mailgun_api_key": ("key" + "-" + HEX * 2, "key" + "-" + HEX),
    "telegram_bot_token": ("123456789" + ":AA" + B64 + "ab", "123456789" + ":AA" + B64[:20]),
    "shopify_token": ("shp" + "at_" + HEX * 2, "shp" + "xx_" + HEX * 2),
    "digitalocean_pat": ("do" + "p_v1_" + "a" * 64, "do" + "p_v1_" + "a" * 63),
    "npm_token": ("np" + "m_" + "Z" * 36, "np" + "m_" + "Z" * 35),
    "pypi_token": ("py" + "pi-" + B64 * 2, "py" + "pi-" + B64),
    "private_key_block": ("-----BEGIN RSA PRIVATE" + " KEY-----\nMIIE...\n", "-----BEGIN PUBLIC KEY-----"),
    "private_key_assignment": ("private_key = '" + B64 + "ab'", "private_key = '" + "a" * 40 + "'"),
    "jwt": ("ey" + "JhbGciOiJI.ey" + "JzdWIiOiIx.c2lnbmF0dXJl", "ey" + "JhbGciOiJI.abcdefghij.abc"),
    "db_connection_uri": ("postgres" + "://app:s3cr3t@db/x", "postgres" + "://app@db/x"),
    "generic_api_key_assignment": ('pass' + 'word = "hunter2hunter2hunter2"', 'pass' + 'word = "short"'),
}


def test_the_pack_has_28_rules_and_a_sample_for_each():
    assert len(default_rule_pack().rules) == 28
    assert set(SAMPLES) == set(default_rule_pack().rule_index())


def test_every_rule_fires_on_its_sample_and_not_on_the_near_miss(docs):
    rows = []
    for rule_id, (hit, miss) in SAMPLES.items():
        rows += [(f"{rule_id}/hit", f"x = 1\n  {hit}\n"), (f"{rule_id}/miss", f"x = 1\n  {miss}\n")]
    found = {(r.path, r.rule_id) for r in detect(docs(*rows)).collect()}
    for rule_id in SAMPLES:
        assert (f"{rule_id}/hit", rule_id) in found
        assert (f"{rule_id}/miss", rule_id) not in found


def test_every_keyword_gate_lets_its_own_sample_pass():
    for rule in default_rule_pack().rules:
        hit = SAMPLES[rule.rule_id][0]
        text = hit.lower() if rule.ignores_case else hit
        assert any((k.lower() if rule.ignores_case else k) in text for k in rule.keywords)
        assert re.search(rule.source, hit)


def test_default_values_of_a_rule():
    rule = parse_rule_pack({"patterns": [{"id": "r", "regex": "abc"}]}).rules[0]
    assert (rule.description, rule.severity, rule.min_entropy, rule.verifier) == ("r", "medium", None, None)


@pytest.mark.parametrize("entry", [
    {"id": "r", "regex": "("}, {"id": "r", "regex": "a", "severity": "fatal"},
    {"id": "r", "regex": "a*"}, {"id": "r", "regex": "(a)", "capture": 2},
    {"id": "r", "regex": "(a)|b", "capture": 1}, {"id": "r", "regex": "x(?:y(z))+w", "capture": 1},
    {"id": "r", "regex": "x(z)*w", "capture": 1},
])
def test_unusable_rules_are_refused(entry):
    with pytest.raises(RulePackError):
        parse_rule_pack({"patterns": [entry]})


def test_bad_allowlist_and_double_ids_are_refused():
    with pytest.raises(RulePackError):
        Allowlist(("(",))
    with pytest.raises(RulePackError):
        parse_rule_pack({"patterns": [{"id": "r", "regex": "a"}, {"id": "r", "regex": "b"}]})


@pytest.mark.parametrize(("regex", "capture", "parts"), [
    ("key=(abc)", 1, ("", "key=", "abc", "")),
    (r"(?i)k\(=([()\]a]+)x", 1, ("(?i)", r"k\(=", r"[()\]a]+", "x")),
    ("(a)(?:b|c)(d)e", 2, ("", "(a)(?:b|c)", "d", "e")),
    (r"[^]](b)", 1, ("", "[^]]", "b", "")),
    ("a|(b)", 1, None),
])
def test_split_capture(regex, capture, parts):
    assert split_capture(regex, capture) == parts


def test_named_groups_and_flags(docs):
    pack = parse_rule_pack({"patterns": [
        {"id": "named", "regex": r"(?i)ID=(?P<tag>[a-z]+)-(?P<value>\d{4})", "capture": 2}]})
    assert detect(docs(("p", "xx id=abc-1234")), pack).first().column == 11
    assert pack.rules[0].value_group == 3


def test_load_from_json_and_yaml(tmp_path):
    raw = {"patterns": [{"id": "t", "regex": r"INT-[0-9A-F]{8}", "severity": "critical"}],
           "allowlist": {"value_patterns": ["0000"]}}
    (tmp_path / "p.json").write_text(json.dumps(raw))
    pack = load_rule_pack(tmp_path / "p.json")
    assert pack.rules[0] == Rule("t", r"INT-[0-9A-F]{8}", description="t", severity="critical")
    assert pack.allowlist.value_patterns == ("0000",)
    yaml = pytest.importorskip("yaml")
    (tmp_path / "p.yaml").write_text(yaml.safe_dump(raw))
    assert load_rule_pack(tmp_path / "p.yaml") == pack


def test_default_allowlist_samples():
    regex = "(?i)" + "|".join(f"(?:{p})" for p in default_rule_pack().allowlist.value_patterns)
    for value in ("AK" + "IAIOSFODNN7EXAMPLE", "changeme", "<your-api-key-here>", "${DB_PASSWORD}", "{{ t }}"):
        assert re.search(regex, value)
    assert not re.search(regex, RANDOM_TOKEN)
