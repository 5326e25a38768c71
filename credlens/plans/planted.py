"""Test inputs derived from the driver tables, by expressions valid in Spark and DuckDB.

The driver's documents hold few credential-like values, so the queries add one line per
document. Every column is computed from the row alone, so the derived tables have as many
rows as ``documents`` and grow with it. All values are fake; marker words are split so that
no scanner trips on this file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credlens.functions.sizing import spread

NL = "chr(10)"
QUOTE = "chr(34)"


def _dialect(template: str, engine: str) -> str:
    """Fill in the function names that differ between the two engines."""
    if engine == "spark":
        names = {"SHA": "sha2({0}, 256)", "B64": "base64(unhex({0}))"}
    else:
        names = {"SHA": "sha256({0})", "B64": "to_base64(from_hex({0}))"}
    key = "cast(doc_id as string)"
    digest = names["SHA"].format(key)
    return (template
            .replace("{B64H}", names["B64"].format(digest))
            .replace("{B64S}", names["B64"].format(f"substr({digest}, 1, 36)"))
            .replace("{H50}", names["SHA"].format("cast(doc_id % 50 as string)"))
            .replace("{H}", digest)
            .replace("{ID}", key)
            .replace("{NL}", NL).replace("{Q}", QUOTE))


def aws_key(digest: str) -> str:
    return f"concat('AK', 'IA', upper(substr({digest}, 1, 16)))"


_AWS = aws_key("{H}")
_AWS_LINE = "concat('K = ', {Q}, " + _AWS + ", {Q})"

PATH = """
concat('src/', source, '/d', {ID},
  case doc_id % 5 when 0 then '.py' when 1 then '.env' when 2 then '.yaml'
                  when 3 then '.txt' else '.md' end)
"""

PLANT = f"""
case doc_id % 16
  when 0 then concat('AWS_KEY = ', {{Q}}, {_AWS}, {{Q}})
  when 1 then concat('gh = ', {{Q}}, 'gh', 'p_', substr({{H}}, 1, 36), {{Q}})
  when 2 then concat('pass', 'word = ', {{Q}}, substr({{H}}, 1, 24), {{Q}})
  when 3 then concat({_AWS_LINE}, '  # pragma: allowlist secret')
  when 4 then concat('K = ', {{Q}}, 'AK', 'IAIOSFODNN7', 'EXAMPLE', {{Q}})
  when 5 then concat('api', '_key = ', {{Q}}, '<your-api-key-here>', {{Q}})
  when 6 then concat('tok', 'en = ', {{Q}}, 'aaaaaaaaaaaaaaaa', {{Q}})
  when 7 then concat('-----BEGIN RSA PRIVATE', ' KEY-----', {{NL}}, {{B64H}}, {{NL}},
                     '-----END RSA PRIVATE', ' KEY-----')
  when 8 then concat('x', chr(13), {{NL}}, 't: gl', 'pat-', substr({{H}}, 1, 20),
                     chr(13), {{NL}}, 'y')
  when 9 then concat({_AWS_LINE}, {{NL}}, {_AWS_LINE})
  when 10 then concat({_AWS_LINE}, '  # gitleaks:allow', {{NL}}, {_AWS_LINE})
  when 11 then concat('blob ', {{B64H}})
  when 12 then concat('url=postgres', '://app:', substr({{H}}, 1, 20), '@db/x')
  when 13 then concat('a = sk-', 'ant-api03-', {{H}}, substr({{H}}, 1, 24))
  when 14 then concat('é😀 ', {_AWS_LINE})
  else 'x = 1'
end
"""

CONTENT = f"concat(text, {{NL}}, {PLANT}, {{NL}})"

# A value for every rule, and a near miss, made from the id's hash; secrets are fake and split.
# Per rule: (what stands before, value of the hit, value of the near miss, what stands after).
_S = lambda n, start=1: f"substr({{H}}, {start}, {n})"
RULE_VALUES = (
    ("'AK', 'IA'", f"upper({_S(16)})", f"upper({_S(15)})", "' '"),
    ("'aws_secret', '_access_key = '", _S(40), _S(30), "' '"),
    ("'Account', 'Key='", f"{{H}}, {_S(22)}", "{H}", "'=='"),
    ("'AI', 'za'", _S(35), _S(30), "' '"),
    ("'{', {Q}, 'type', {Q}, ': ', {Q}", "'service_account'", "'user_account'", "{Q}, '}'"),
    ("'GOC', 'SPX-'", _S(28), _S(27), "' '"),
    ("'gh', 'p_'", _S(36), _S(37), "' '"),
    ("'github', '_pat_'", f"{_S(22)}, '_', {_S(59)}", _S(22), "' '"),
    ("'gh', 'o_'", _S(36), _S(30), "' '"),
    ("'gl', 'pat-'", _S(20), _S(8), "' '"),
    ("'sk-', 'proj-'", _S(48), _S(8), "' '"),
    ("'sk-', 'ant-api03-'", f"{{H}}, {_S(24)}", _S(3), "' '"),
    ("'sk', '_live_'", _S(24), _S(4), "' '"),
    ("'xo', 'xb-'", _S(12), _S(3), "' '"),
    ("'https://hooks.slack', '.com/services/'", f"'T', upper({_S(8)}), '/B', upper({_S(8, 9)}), '/', {_S(24)}", "'T1/B1/x'", "' '"),
    ("'S', 'G.'", f"{_S(22)}, '.', {_S(43, 20)}", f"{_S(22)}, '.b'", "' '"),
    ("'S', 'K'", _S(32), _S(31), "' '"),
    ("'key', '-'", _S(32), _S(16), "' '"),
    ("'123456789', ':AA'", _S(33), _S(20), "' '"),
    ("'shp', 'at_'", _S(32), _S(31), "' '"),
    ("'do', 'p_v1_'", "{H}", _S(63), "' '"),
    ("'np', 'm_'", _S(36), _S(35), "' '"),
    ("'py', 'pi-'", f"{{H}}, {_S(20)}", _S(20), "' '"),
    ("'-----BEGIN '", "'RSA PRIVATE'", "'PUBLIC'", "' KEY-----'"),
    ("'private', '_key = ', {Q}", "{H}", "'aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa'", "{Q}"),
    ("'ey', 'J'", f"{_S(9)}, '.ey', 'J', {_S(9, 10)}, '.', {_S(20, 20)}", f"{_S(9)}, '.', {_S(10)}, '.abc'", "' '"),
    ("'postgres', '://app'", f"':', {_S(12)}", "''", "'@db/x'"),
    ("'pass', 'word = ', {Q}", _S(24), "'short'", "{Q}"),
)
RULE_PLANT = "case doc_id % 56 " + " ".join(
    f"when {2 * i} then concat({before}, {hit}, {after}) when {2 * i + 1} then concat({before}, {miss}, {after})"
    for i, (before, hit, miss, after) in enumerate(RULE_VALUES)) + " end"
RULE_CONTENT = f"concat(text, {{NL}}, 'x ', {RULE_PLANT}, {{NL}})"

_FILE = "concat('src/f', cast(doc_id % 50 as string), '.py')"

# One commit per document: a file whose lines are the document's, a second hunk with lines
# that look like file headers, and in every seventh commit a deleted file.
PATCH_TEXT = f"""
concat(
  'diff --git a/', {_FILE}, ' b/', {_FILE}, {{NL}},
  'index 0000000..1111111 100644', {{NL}},
  '--- a/', {_FILE}, {{NL}}, '+++ b/', {_FILE}, {{NL}},
  '@@ -0,0 +1,', cast(length(text) - length(replace(text, {{NL}}, '')) + 1 as string), ' @@', {{NL}},
  '+', replace(text, {{NL}}, concat({{NL}}, '+')), {{NL}},
  '@@ -9,1 +5000,2 @@ def f', {{NL}},
  '--- old', {{NL}}, '+++ new', {{NL}},
  '+K = ', {{Q}}, {aws_key("{H50}")}, {{Q}}, {{NL}},
  case when doc_id % 7 = 0 then concat(
    'diff --git a/gone.txt b/gone.txt', {{NL}}, 'deleted file mode 100644', {{NL}},
    'index 1111111..0000000', {{NL}}, '--- a/gone.txt', {{NL}}, '+++ /dev/null', {{NL}},
    '@@ -1 +0,0 @@', {{NL}}, '-bye', {{NL}}) else '' end)
"""


# Files with noise names, binary bytes and odd sizes, for the file filters.
FILE_PATH = """
concat('repo/',
  case doc_id % 9 when 0 then 'node_modules/' when 1 then 'app/build/' when 2 then 'environment/'
                  when 3 then '.git/' else 'src/' end,
  'd', {ID},
  case doc_id % 11 when 0 then '.png' when 1 then '.tar.GZ' when 2 then '.env'
                   when 3 then '' when 4 then '.min.js' else '.py' end)
"""
FILE_TEXT = "case when doc_id % 13 = 0 then concat('#', text) else text end"
FILE_MAX_BYTES = 4096

# The same file in many copies: fifty paths, each holding its own key over and over.
COPY_CONTENT = f"concat(text, {{NL}}, 'K = ', {{Q}}, {aws_key('{H50}')}, {{Q}}, {{NL}})"

# Outcomes of checking the planted verifiable values, and of values found nowhere.
VALUE_TO_CHECK = """
case doc_id % 16
  when 1 then concat('gh', 'p_', substr({H}, 1, 36))
  when 8 then concat('gl', 'pat-', substr({H}, 1, 20))
  else concat('sk-', 'ant-api03-', {H}, substr({H}, 1, 24))
end
"""
HTTP_STATUS = """
cast(case doc_id % 7 when 0 then 200 when 1 then 204 when 2 then 401 when 3 then 403
                     when 4 then 429 when 5 then 500 else null end as int)
"""


def planted_columns(engine: str) -> dict[str, str]:
    return {"doc_id": "doc_id", "path": _dialect(PATH, engine), "content": _dialect(CONTENT, engine)}


# Pages and conversation turns in the shape of a document, planted in the same way.
PAGE_AS_DOCUMENT = {"doc_id": "page_id", "url": "url", "text": "html"}
TURN_AS_DOCUMENT = {
    "doc_id": "conv_id * 1000 + turn",
    "url": "concat('chat/', cast(conv_id as string), '/', cast(turn as string))",
    "text": "text",
}


def planted_page_columns(engine: str) -> dict[str, str]:
    html = "concat(text, {NL}, '<pre>', {NL}, " + PLANT + ", {NL}, '</pre>')"
    return {"page_id": "doc_id", "path": "url", "content": _dialect(html, engine)}


def planted_turn_columns(engine: str) -> dict[str, str]:
    return {"path": "url", "content": _dialect(CONTENT, engine)}


def rule_columns(engine: str) -> dict[str, str]:
    return {"doc_id": "doc_id", "path": _dialect(PATH, engine), "content": _dialect(RULE_CONTENT, engine)}


def copy_columns(engine: str) -> dict[str, str]:
    return {"doc_id": "doc_id", "path": _FILE, "content": _dialect(COPY_CONTENT, engine)}


def file_columns(engine: str) -> dict[str, str]:
    """``content`` is binary; every thirteenth file has a NUL byte in front."""
    to_bytes = f"encode({FILE_TEXT}, 'UTF-8')" if engine == "spark" else f"encode({FILE_TEXT})"
    nul = "X'00'" if engine == "spark" else "'\\x00'::blob"
    return {
        "path": _dialect(FILE_PATH, engine),
        "length": f"cast(octet_length({to_bytes}) as bigint)",
        "content": f"case when doc_id % 13 = 0 then {nul} || {to_bytes} else {to_bytes} end",
    }


def patch_columns(engine: str) -> dict[str, str]:
    return {
        "repo": "concat('repo', cast(doc_id % 4 as string))",
        "commit_seq": "doc_id",
        "commit": _dialect("substr({H}, 1, 40)", engine),
        "author": "concat('dev', cast(doc_id % 11 as string))",
        "email": "concat('dev', cast(doc_id % 11 as string), '@mail.invalid')",
        "date": "concat('2024-01-', lpad(cast(doc_id % 28 + 1 as string), 2, '0'), 'T00:00:00+00:00')",
        "summary": "concat('change ', cast(doc_id as string))",
        "is_merge": "doc_id % 10 = 9",
        "patch": _dialect(PATCH_TEXT, engine),
    }


def accepted_columns(engine: str) -> dict[str, str]:
    """A baseline: the AWS finding each document would have; a reason on even ids."""
    digest = "sha2({0}, 256)" if engine == "spark" else "sha256({0})"
    key = _dialect(_AWS, engine)
    text = f"concat('aws_access_key_id', ':', {key}, ':', {_dialect(PATH, engine)})"
    return {
        "fingerprint": f"substr({digest.format(text)}, 1, 16)",
        "rule_id": "'aws_access_key_id'",
        "path": _dialect(PATH, engine),
        "reason": "case when doc_id % 2 = 0 then concat('seen in ', source) end",
    }


# What is in a language other than English counts as triaged.
ACCEPTED_WHERE = "lang <> 'en'"


# A second answer for the same secret: refused, out of order, or live after all.
LATER_WHERE = "doc_id % 3 = 0"
LATER_STATUS = "case doc_id % 4 when 0 then 401 when 1 then 500 when 2 then 204 end"


def outcome_columns(engine: str) -> dict[str, str]:
    value = _dialect(VALUE_TO_CHECK, engine)
    return {
        "secret_sha256": f"sha2({value}, 256)" if engine == "spark" else f"sha256({value})",
        "http_status": HTTP_STATUS,
    }


def select_list(columns: dict[str, str]) -> str:
    return ",\n".join(f"{sql} AS {name}" for name, sql in columns.items())


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _derived(columns: dict[str, str]) -> list[Column]:
    return [F.expr(sql).alias(name) for name, sql in columns.items()]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select(*_derived(planted_columns("spark")))


def planted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").selectExpr(*[f"{sql} AS {name}" for name, sql in PAGE_AS_DOCUMENT.items()])
    return spread(pages, "doc_id").select(*_derived(planted_page_columns("spark")))


def planted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").selectExpr(*[f"{sql} AS {name}" for name, sql in TURN_AS_DOCUMENT.items()])
    return spread(turns, "doc_id").select(*_derived(planted_turn_columns("spark")))


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select(*_derived(copy_columns("spark")))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select(*_derived(file_columns("spark")))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select(*_derived(patch_columns("spark")))


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").where(ACCEPTED_WHERE)
    return documents.select(*_derived(accepted_columns("spark")))


def planted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select(*_derived(rule_columns("spark")))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of verifiers, with further, conflicting ones for every third secret."""
    documents = read_table(spark, sf_dir, "documents")
    first = documents.select(*_derived(outcome_columns("spark")))
    later = documents.where(LATER_WHERE).select(*_derived(outcome_columns("spark") | {"http_status": LATER_STATUS}))
    return first.unionByName(later)
