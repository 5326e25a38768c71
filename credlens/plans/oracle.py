"""The same queries as SQL for another engine, written in another way.

Matches are taken with the engine's own regex functions on whole texts; offsets come from a
window sum over the pieces, lines and columns from the text before the match, entropy from
the characters, first occurrences from ``row_number``, patches from line windows.
"""

from __future__ import annotations

from credlens.operators import compliance
from credlens.operators.files import MAX_BYTES, SKIP_DIRS, SKIP_EXTENSIONS, SNIFF_BYTES
from credlens.operators.verify import REGISTERED_VERIFIERS
from credlens.plans import planted as src
from credlens.plans.queries import CUSTOM_PACK, NEWEST, PATH_ALLOWLIST
from credlens.rules import Allowlist, Rule, RulePack, default_rule_pack, parse_rule_pack
from credlens.schema import SEVERITIES, VERIFICATION_STATES

NL = "chr(10)"
TOKEN = r"[A-Za-z0-9+/=_\-]{24,}"
PRAGMA = r"pragma:\s*allowlist[ _-]secret|gitleaks:allow"

FINDING = ("rule_id, description, severity, severity_rank, path, line, \"column\", preview, "
           "fingerprint, source, entropy, verifier, verification")


def q(text: str | float | None) -> str:
    if text is None:
        return "NULL"
    return "'" + text.replace("'", "''") + "'" if isinstance(text, str) else str(text)


def table(columns: dict[str, str], source: str = "documents", where: str = "true") -> str:
    return f"SELECT {src.select_list(columns)} FROM {source} WHERE {where}"


def unix(text: str) -> str:
    return f"regexp_replace({text}, '\\r\\n?', {NL}, 'g')"


def entropy_of(text: str) -> str:
    share = f"(length({text}) - length(replace({text}, c, ''))) / length({text})"
    terms = f"list_transform(list_distinct(string_split({text}, '')), lambda c: -({share}) * log2({share}))"
    return f"round(list_sum({terms}), 12)"


def preview_of(text: str) -> str:
    value = rf"regexp_replace({text}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
    return (f"(SELECT CASE WHEN length(pv) <= 8 THEN repeat('*', length(pv)) ELSE concat(pv[1:4], '…', "
            f"right(pv, 2), ' (', length(pv), ' chars)') END FROM (SELECT {value} AS pv))")


RANK = "CASE severity " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SEVERITIES)) + " END"


def _pattern(rule: Rule) -> str:
    suffix = f"(?:{rule.suffix})" if rule.suffix else ""
    return f"{rule.flags}({rule.prefix})({rule.secret}){suffix}"


def findings_ctes(
    documents: str,
    *,
    pack: RulePack | None = None,
    signatures: bool = True,
    entropy: bool = False,
    pragmas: bool = True,
    dedup: bool = True,
    scope: str = "path",
    order: str = "path",
    carry: str = "",
    lines: str | None = None,
    source: str = "filesystem",
    name: str = "findings",
    prefix: str = "",
) -> str:
    """CTEs ending in one called ``name``; ``documents`` is SQL that gives path and content."""
    pack = pack or default_rule_pack()
    rules = list(pack.rules if signatures else ())
    if entropy:
        rules.append(Rule("high_entropy_string", TOKEN, severity="low", min_entropy=4.0))
    carried = f", {carry}" if carry else ""
    extra = f", {lines}" if lines else ""
    branches = []
    for index, rule in enumerate(rules):
        rx = q(_pattern(rule))
        branches.append(f"""
  SELECT row_id, {index} AS ri, unnest(regexp_extract_all(content, {rx}, 0)) AS m,
         unnest(regexp_extract_all(content, {rx}, 1)) AS p,
         unnest(regexp_extract_all(content, {rx}, 2)) AS v,
         unnest(string_split_regex(content, {rx})[:len(regexp_extract_all(content, {rx}, 0))]) AS gap,
         generate_subscripts(regexp_extract_all(content, {rx}, 0), 1) AS i
  FROM {prefix}docs""")
    specs = ", ".join(
        f"({i}, {q(r.rule_id)}, {q(r.description or r.rule_id)}, {q(r.severity)}, "
        f"cast({q(r.min_entropy)} AS double), cast({q(r.verifier)} AS varchar))" for i, r in enumerate(rules))
    allow = []
    if pack.allowlist.value_patterns:
        allow.append("NOT regexp_matches(v, " + q("|".join(f"(?:{p})" for p in pack.allowlist.value_patterns)) + ", 'i')")
    if pack.allowlist.path_patterns:
        allow.append("NOT regexp_matches(path, " + q("|".join(pack.allowlist.path_patterns)) + ", 'i')")
    allow.append("(rule_id <> 'high_entropy_string' OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')))")
    if pragmas:
        allow.append(f"NOT regexp_matches(coalesce(string_split(content, {NL})[at_line], ''), {q(PRAGMA)}, 'i')")
    line = f"coalesce({lines}[at_line], at_line)" if lines else "at_line"
    description = ("CASE WHEN rule_id = 'high_entropy_string' THEN "
                   "printf('High-entropy string (H=%.2f)', round_even(h, 2)) ELSE description END")
    first = "WHERE nth = 1" if dedup else ""
    return f"""
{prefix}docs AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, path, {unix('content')} AS content{carried}{extra}
  FROM ({documents})
),
{prefix}raw AS MATERIALIZED ({' UNION ALL '.join(branches)}),
{prefix}spec(ri, rule_id, description, severity, min_entropy, verifier) AS (VALUES {specs}),
{prefix}offsets AS (
  SELECT *, cast(sum(length(gap) + length(m)) OVER (PARTITION BY row_id, ri ORDER BY i) AS bigint)
              - length(m) + length(p) AS off
  FROM {prefix}raw
),
{prefix}placed AS (
  SELECT o.row_id, o.v, o.m, o.i, s.*, d.path, d.content{carried}{extra},
         length(d.content[:off]) - length(replace(d.content[:off], {NL}, '')) + 1 AS at_line,
         length(string_split(d.content[:off], {NL})[-1]) + 1 AS at_column,
         CASE WHEN s.min_entropy IS NOT NULL THEN {entropy_of('o.v')} END AS h
  FROM {prefix}offsets o JOIN {prefix}docs d USING (row_id) JOIN {prefix}spec s USING (ri)
),
{prefix}passed AS (
  SELECT *, substr(sha256(concat(rule_id, ':', v, ':', path)), 1, 16) AS fingerprint, {line} AS real_line
  FROM {prefix}placed WHERE {' AND '.join(allow)} AND (min_entropy IS NULL OR h >= min_entropy)
),
{prefix}ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {scope}, fingerprint ORDER BY {order}, ri, i) AS nth FROM {prefix}passed
),
{name} AS (
  SELECT rule_id, {description} AS description, severity, cast({RANK} AS integer) AS severity_rank, path,
         cast(real_line AS integer) AS line, cast(at_column AS integer) AS "column",
         {preview_of('v')} AS preview, fingerprint, '{source}' AS source, round_even(h, 3) AS entropy,
         verifier, 'unverified' AS verification,
         CASE WHEN verifier IS NOT NULL AND NOT contains(m, {NL}) THEN sha256(v) END AS secret_sha256{carried}
  FROM {prefix}ranked {first}
)"""


PLANTED = table(src.planted_columns("duckdb"))
PATCHES = table(src.patch_columns("duckdb"))
ACCEPTED = table(src.accepted_columns("duckdb"), where=src.ACCEPTED_WHERE)
_ANSWERS = table(src.outcome_columns("duckdb")) + " UNION ALL " + table(
    src.outcome_columns("duckdb") | {"http_status": src.LATER_STATUS}, where=src.LATER_WHERE)
OUTCOMES = f"""
  SELECT secret_sha256, CASE WHEN bool_or(coalesce(http_status BETWEEN 200 AND 299, false)) THEN 200
                             WHEN bool_or(coalesce(http_status IN (401, 403), false)) THEN 401 END AS http_status
  FROM ({_ANSWERS}) GROUP BY secret_sha256"""
ATTRIBUTES = "repo, commit_seq, \"commit\", author, email, date, summary"


def planted_findings(**options) -> str:
    return findings_ctes(PLANTED, **options)


def select_findings(ctes: str, columns: str = FINDING) -> str:
    return f"WITH {ctes} SELECT {columns} FROM findings"


def patch_ctes(patches: str) -> str:
    """Added lines of patches by line windows: a header counts only in header position."""
    return f"""
patches AS MATERIALIZED ({patches}),
patch_text AS (
  SELECT repo, commit_seq, unnest(string_split(t, {NL})) AS l, generate_subscripts(string_split(t, {NL}), 1) AS pos
  FROM (SELECT repo, commit_seq, {unix('patch')} AS t FROM patches)
),
lagged AS (
  SELECT *, lag(l) OVER w AS l1, coalesce(lag(l, 2) OVER w, '') AS l2 FROM patch_text
  WINDOW w AS (PARTITION BY repo, commit_seq ORDER BY pos)
),
marked AS (
  SELECT *, l LIKE '+++ %' AND l1 LIKE '--- %' AND NOT regexp_matches(l2, '^[-+@\\\\]') AS is_head,
         nullif(regexp_extract(l, '^@@ -[0-9]+(?:,[0-9]+)? \\+([0-9]+)(?:,[0-9]+)? @@', 1), '') AS start
  FROM lagged
),
filled AS (
  SELECT *,
    last_value(CASE WHEN is_head THEN CASE WHEN l = '+++ /dev/null' THEN ''
        ELSE regexp_replace(trim(substr(l, 5)), '^[ab]/', '') END END IGNORE NULLS) OVER w AS path,
    last_value(cast(start AS integer) IGNORE NULLS) OVER w AS hunk_start,
    count(start) OVER w AS hunk
  FROM marked
  WINDOW w AS (PARTITION BY repo, commit_seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
patch_lines AS (
  SELECT repo, commit_seq, path, pos,
         cast(hunk_start + row_number() OVER (PARTITION BY repo, commit_seq, hunk ORDER BY pos) - 1 AS integer) AS line,
         substr(l, 2) AS text
  FROM filled WHERE path <> '' AND l LIKE '+%' AND NOT is_head
)"""


def newest(n: int) -> str:
    ranked = f"SELECT *, row_number() OVER (PARTITION BY repo ORDER BY commit_seq DESC) AS nth FROM ({PATCHES}) WHERE NOT is_merge"
    return f"SELECT * EXCLUDE (nth) FROM ({ranked}) WHERE nth <= {n}"


def history_ctes(patches: str, **options) -> str:
    contents = f"""
  SELECT repo, commit_seq, c."commit", c.author, c.email, c.date, c.summary, path,
         string_agg(text, {NL} ORDER BY pos) AS content, list(line ORDER BY pos) AS real_lines
  FROM patch_lines JOIN patches c USING (repo, commit_seq) GROUP BY ALL"""
    return patch_ctes(patches) + "," + findings_ctes(
        contents, scope="repo", order="commit_seq", carry=ATTRIBUTES, lines="real_lines",
        source="git-history", name="history", prefix="h_", **options)


HISTORY = f"{FINDING}, {ATTRIBUTES}, \"commit\"[1:8] AS commit_short"
NON_MERGE = f"SELECT * FROM ({PATCHES}) WHERE NOT is_merge"


def verified_ctes() -> str:
    names = ", ".join(q(v) for v in REGISTERED_VERIFIERS)
    return planted_findings() + f""",
outcomes AS ({OUTCOMES}),
verified AS (
  SELECT f.* REPLACE (CASE
      WHEN verifier IS NULL OR verifier NOT IN ({names}) OR secret_sha256 IS NULL THEN 'skipped'
      WHEN http_status >= 200 AND http_status < 300 THEN 'valid'
      WHEN http_status = 401 OR http_status = 403 THEN 'invalid' ELSE 'unverified' END AS verification)
  FROM findings f LEFT JOIN outcomes USING (secret_sha256)
)"""


def control_ctes() -> str:
    rows = ", ".join(f"({q(c)}, {q(f)}, {q(i)}, {q(compliance.TITLES[i])})" for c, f, i in compliance.CONTROLS)
    keys = ", ".join(q(r) for r in compliance.KEY_RULES)
    return f"""
controls(rule_class, framework, control_id, title) AS (VALUES {rows}),
mapped AS (
  SELECT fingerprint, rule_id, framework, control_id, title
  FROM (SELECT *, CASE WHEN rule_id IN ({keys}) THEN 'key' WHEN rule_id = 'jwt' THEN 'jwt'
               ELSE 'credential' END AS rule_class FROM findings) JOIN controls USING (rule_class)
)"""


SUMMARY = ", ".join([
    "count(*) AS findings", "count(DISTINCT fingerprint) AS distinct_fingerprints",
    "cast(count_if(verification = 'valid') AS bigint) AS live",
    *[f"cast(count_if(severity = '{s}') AS bigint) AS severity_{s}" for s in SEVERITIES],
])


def oracle_sql() -> dict[str, str]:
    skip_dirs = ", ".join(q(s) for s in SKIP_DIRS)
    skip_ext = ", ".join(q(s) for s in SKIP_EXTENSIONS)
    rule_order = ", ".join(q(r.rule_id) for r in default_rule_pack().rules)
    names = ", ".join(q(v) for v in REGISTERED_VERIFIERS)
    pack = default_rule_pack()
    with_paths = RulePack(pack.rules, Allowlist(pack.allowlist.value_patterns, PATH_ALLOWLIST))
    frameworks = ", ".join(f"({q(f)})" for f in compliance.FRAMEWORKS)
    pages = table(src.planted_page_columns("duckdb"), f"({table(src.PAGE_AS_DOCUMENT, 'pages')})")
    turns = table(src.planted_turn_columns("duckdb"), f"({table(src.TURN_AS_DOCUMENT, 'conversations')})")
    entries = ("SELECT fingerprint, min(rule_id) AS rule_id, min(path) AS path, 'triaged' AS reason "
               "FROM findings GROUP BY fingerprint")
    states = ", ".join(q(v) for v in VERIFICATION_STATES)
    control_order = ", ".join(q(f + i) for _, f, i in compliance.CONTROLS)
    html_escape = "{0}"
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        html_escape = f"replace({html_escape}, {q(raw)}, {q(entity)})"
    cells = ", ".join(f"'<td>', {html_escape.format(c)}, '</td>'" for c in (
        "severity", "rule_id", "concat(path, ':', line)", "''", "verification", "preview"))
    return {
        "select_scannable_files": f"""
SELECT path, length FROM ({table(src.file_columns('duckdb'))})
WHERE length <= {src.FILE_MAX_BYTES}
  AND NOT list_has_any(string_split(path, '/'), [{skip_dirs}])
  AND CASE WHEN regexp_matches(path, '[^/]\\.[^./]+$')
           THEN lower(regexp_extract(path, '\\.[^./]+$')) NOT IN ({skip_ext}) ELSE true END
  AND NOT regexp_matches(hex(content)[:{SNIFF_BYTES * 2}], '^(..)*00')""",
        "exclude_ignored_paths": f"""
WITH planted AS ({PLANTED}), ignored AS (SELECT path FROM planted WHERE suffix(path, '.md'))
SELECT doc_id, path FROM planted p WHERE NOT EXISTS (SELECT 1 FROM ignored i WHERE i.path = p.path)""",
        "normalize_newlines": f"""
SELECT path, sha256({unix('content')}) AS text_sha256,
       cast(len(string_split({unix('content')}, {NL})) AS integer) AS n_lines FROM ({PLANTED})""",
        "decode_bytes": f"""
SELECT path, sha256(concat({unix('content')}, path)) AS text_sha256 FROM ({PLANTED})""",
        "detect_signatures": select_findings(planted_findings()),
        "detect_private_key_blocks": select_findings(planted_findings(pack=pack.only("private_key_block"))),
        "detect_entropy_tokens": select_findings(planted_findings(signatures=False, entropy=True)),
        "detect_all": select_findings(planted_findings(entropy=True)),
        "detect_custom_rules": select_findings(planted_findings(pack=parse_rule_pack(CUSTOM_PACK))),
        # Every quote in the tables is a double one; this dialect has no backreferences.
        "detect_quoted_rules": select_findings(planted_findings(pack=parse_rule_pack({"patterns": [
            {"id": "quoted_hex", "prefix": '(?:token|password) = "', "secret": "[0-9a-f]{24,40}", "suffix": '"', "severity": "high"},
            {"id": "quoted_key", "prefix": 'K = "', "secret": "AKIA[0-9A-Z]{16}", "suffix": '"'}]}))),
        "detect_every_rule": select_findings(findings_ctes(table(src.rule_columns("duckdb")))),
        "detector_errors": f"SELECT path, 'ValueError: refused' AS error FROM ({PLANTED}) WHERE suffix(path, '.md')",
        "skip_reasons": f"""
SELECT path, length, reason FROM (
  SELECT path, length, CASE
    WHEN regexp_matches(path, '[^/]\\.[^./]+$') AND lower(regexp_extract(path, '\\.[^./]+$')) IN ({skip_ext}) THEN 'extension'
    WHEN length > {src.FILE_MAX_BYTES} THEN 'size' END AS reason
  FROM ({table(src.file_columns('duckdb'))})) WHERE reason IS NOT NULL""",
        "detect_python_rules": select_findings(planted_findings(pack=parse_rule_pack({"patterns": [
            {"id": "blob_value", "prefix": '(?:blob |token = ")', "secret": "[A-Za-z0-9+/=]{20,}",
             "severity": "high"}]}))),
        "scan_pages": select_findings(findings_ctes(pages, entropy=True, scope="row_id", carry="page_id"),
                                      f"{FINDING}, page_id"),
        "scan_conversations": select_findings(findings_ctes(turns, entropy=True, scope="row_id")),
        "token_entropy": f"""
WITH tokens AS (SELECT DISTINCT unnest(regexp_extract_all(content, {q(TOKEN)}, 0)) AS token FROM ({PLANTED})),
chars AS (SELECT token, c, count(*) AS n FROM (SELECT token, unnest(string_split(token, '')) AS c FROM tokens) GROUP BY ALL)
SELECT sha256(token) AS token_sha256,
       round_even(round(sum(-(n / length(token)) * log2(n / length(token))), 12), 3) + 0.0 AS entropy
FROM chars GROUP BY token""",
        "redact_values": f"""
WITH vals AS (SELECT unnest(string_split(text, ' ')) AS value FROM documents UNION SELECT text FROM documents)
SELECT sha256(value) AS value_sha256, {preview_of('value')} AS preview FROM vals""",
        "fingerprint_values": f"""
SELECT path, substr(sha256(concat('whole_text:', content, ':', path)), 1, 16) AS fingerprint FROM ({PLANTED})""",
        "detect_without_allowlist": select_findings(planted_findings(pack=pack.without_allowlist())),
        "allowlist_paths": select_findings(planted_findings(pack=with_paths)),
        "pragma_marked_lines": f"""
SELECT path, cast(line AS integer) AS line FROM (
  SELECT path, unnest(string_split(t, {NL})) AS text, generate_subscripts(string_split(t, {NL}), 1) AS line
  FROM (SELECT path, {unix('content')} AS t FROM ({PLANTED})))
WHERE regexp_matches(text, {q(PRAGMA)}, 'i')""",
        "detect_ignoring_pragmas": select_findings(planted_findings(pragmas=False)),
        "detect_with_repeats": select_findings(planted_findings(dedup=False)),
        "dedup_findings": select_findings(findings_ctes(
            table(src.copy_columns("duckdb")), order="path, real_line, at_column")),
        "baseline_suppress": f"""
WITH {planted_findings()}, accepted AS ({ACCEPTED})
SELECT {FINDING} FROM findings f WHERE NOT EXISTS (SELECT 1 FROM accepted a WHERE a.fingerprint = f.fingerprint)""",
        "baseline_merge": f"""
WITH {planted_findings()}, accepted AS ({ACCEPTED}), fresh AS ({entries})
SELECT * FROM accepted UNION ALL
SELECT * FROM fresh WHERE fingerprint NOT IN (SELECT fingerprint FROM accepted)""",
        "baseline_overwrite": f"WITH {planted_findings()} {entries}",
        "patch_lines": f"WITH {patch_ctes(NON_MERGE)} SELECT repo, commit_seq, path, line, text FROM patch_lines",
        "newest_commits_per_repo": f'SELECT repo, commit_seq, "commit" FROM ({newest(NEWEST)})',
        "history_findings": f"WITH {history_ctes(NON_MERGE)} SELECT {HISTORY} FROM history",
        "history_findings_newest": f"WITH {history_ctes(newest(NEWEST), entropy=True)} SELECT {HISTORY} FROM history",
        "all_sources": f"""
WITH {planted_findings()}, {history_ctes(NON_MERGE)}
SELECT {FINDING} FROM findings UNION ALL BY NAME SELECT {HISTORY} FROM history""",
        "verification_queue": f"""
WITH {planted_findings()}
SELECT secret_sha256, arg_min(verifier, (path, line, "column", list_position([{rule_order}], rule_id))) AS verifier, count(*) AS n_findings
FROM findings WHERE verifier IN ({names}) AND secret_sha256 IS NOT NULL GROUP BY secret_sha256""",
        "recover_secrets": f"""
WITH {planted_findings()}
SELECT fingerprint, secret_sha256 FROM findings WHERE verifier IN ({names}) AND secret_sha256 IS NOT NULL""",
        "apply_verification": f"WITH {verified_ctes()} SELECT {FINDING} FROM verified",
        "by_severity": f"""
WITH {planted_findings(entropy=True)} SELECT severity, count(*) AS n, severity_rank FROM findings GROUP BY ALL""",
        "by_verification": f"WITH {verified_ctes()} SELECT verification, count(*) AS n FROM verified GROUP BY ALL",
        "compliance_rollup": f"""
WITH {planted_findings()}, {control_ctes()}, frameworks(framework) AS (VALUES {frameworks})
SELECT framework, control_id, title, count(fingerprint) AS n
FROM frameworks LEFT JOIN mapped USING (framework) GROUP BY ALL""",
        "finding_controls": f"WITH {planted_findings()}, {control_ctes()} SELECT * FROM mapped",
        "controls_implicated": f"""
WITH {planted_findings()}, {control_ctes()}
SELECT count(DISTINCT (framework, control_id)) AS controls_implicated,
       count(DISTINCT fingerprint) AS findings_mapped FROM mapped""",
        "scan_summary": f"""
WITH {planted_findings(entropy=True)}
SELECT {SUMMARY}, (SELECT count(*) FROM documents) AS files_scanned FROM findings""",
        "report_summary": f"""
WITH {verified_ctes()}, {control_ctes().replace("FROM findings", "FROM verified")},
sev AS (SELECT severity, severity_rank, count(*) AS n FROM verified GROUP BY ALL),
ver AS (SELECT verification, list_position([{states}], verification) AS pos, count(*) AS n FROM verified GROUP BY ALL),
con AS (SELECT framework, control_id, count(*) AS n, min(list_position([{control_order}], concat(framework, control_id))) AS pos
        FROM mapped GROUP BY ALL)
SELECT 'filesystem' AS scope, 'planted' AS root, (SELECT count(*) FROM documents) AS files_scanned,
       (SELECT count(*) FROM verified) AS count,
       (SELECT cast(count(*) AS integer) FROM con) AS controls_implicated,
       (SELECT concat('{{', string_agg(concat('"', severity, '":', n), ',' ORDER BY severity_rank DESC), '}}') FROM sev) AS by_severity,
       (SELECT concat('{{', string_agg(concat('"', verification, '":', n), ',' ORDER BY pos), '}}') FROM ver) AS by_verification,
       (SELECT string_agg(concat(framework, ' ', control_id, ' ', n), ', ' ORDER BY pos) FROM con) AS compliance""",
        "history_summary": f"""
WITH {history_ctes(NON_MERGE)}
SELECT {SUMMARY}, (SELECT count(*) FROM patches) AS commits_scanned FROM history""",
        "scan_stats": """
SELECT cast(count_if(doc_id % 17 <> 0) AS bigint) AS files_scanned, cast(count_if(doc_id % 17 = 0) AS bigint) AS files_skipped FROM documents""",
        "severity_gate": f"""
WITH {planted_findings()}
SELECT coalesce(bool_or(severity IN ('high', 'critical')), false) AS failed,
       cast(count_if(severity IN ('high', 'critical')) AS bigint) AS n FROM findings""",
        "live_gate": f"""
WITH {verified_ctes()}
SELECT coalesce(bool_or(verification = 'valid'), false) AS failed, cast(count_if(verification = 'valid') AS bigint) AS n FROM verified""",
        "findings_report_rows": f"""
WITH {planted_findings()}, {history_ctes(NON_MERGE)},
both_kinds AS (SELECT {FINDING} FROM findings UNION ALL BY NAME SELECT {HISTORY} FROM history)
SELECT rule_id, severity, path, line, preview, fingerprint, description, entropy, source, verifier,
       verification, commit_short AS "commit", author, date FROM both_kinds""",
        "stored_json_report": f"""
WITH {planted_findings()}
SELECT rule_id, severity, path, line, preview, fingerprint, description, entropy, source, verifier, verification,
       cast(NULL AS varchar) AS "commit", cast(NULL AS varchar) AS author, cast(NULL AS varchar) AS date FROM findings""",
        "scan_tree": f"""
WITH named AS (
  SELECT 's_' || regexp_replace(coalesce(source, ''), '[^A-Za-z0-9_-]', '_', 'g') || '/'
         || coalesce((doc_id // 100)::VARCHAR, 'null-' || left(sha256(coalesce(text, '')), 2)) || '.txt' AS relative,
         doc_id, coalesce(text, '') AS text
  FROM documents),
files AS (SELECT relative, string_agg(text, chr(10) || chr(30) || chr(10) ORDER BY doc_id, text) AS text
          FROM named GROUP BY relative),
sized AS (SELECT relative, text, strlen(text)::BIGINT AS length,
                 strpos(text, chr(0)) > 0 AND strlen(substr(text, 1, strpos(text, chr(0)) - 1)) < {SNIFF_BYTES} AS nul
          FROM files)
SELECT relative, length, CASE WHEN nul THEN NULL ELSE sha256(text) END AS content_sha256,
       CASE WHEN nul THEN 'binary' END AS reason
FROM sized WHERE length <= {MAX_BYTES}""",
        "stored_csv_report": f"""
WITH {planted_findings()}
SELECT severity, rule_id, path, line, source, verification, coalesce(verifier, '') AS verifier,
       fingerprint, description FROM findings""",
        "stored_baseline": f"WITH {planted_findings()} {entries}",
        "findings_csv_rows": f"""
WITH {planted_findings()}
SELECT severity, rule_id, path, line, source, verification, coalesce(verifier, '') AS verifier,
       fingerprint, description FROM findings""",
        "findings_listing": f"""
WITH {history_ctes(NON_MERGE)}
SELECT severity, severity_rank, rule_id, concat(path, ':', line) AS location,
       concat("commit"[1:8], ' ', author) AS commit_label, verification, preview FROM history""",
        "findings_html_rows": f"""
WITH {planted_findings()} SELECT concat('<tr>', {cells}, '</tr>') AS html, severity_rank FROM findings""",
    }
