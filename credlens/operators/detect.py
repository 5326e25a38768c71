"""Detection: documents x rules -> findings, in one pass and without a shuffle.

The plan is a chain of projections over one scan:

1. literal keyword gates decide per document which rules can match at all;
2. for those, ``regexp_extract_all`` finds the matches (all regexes are literals);
3. for rules with matches, ``split`` with the same regex gives the text between matches,
   and one running sum over these pieces gives the line and column of every match: the work
   is linear in the text, whatever the number of matches;
4. allowlist, entropy gate and inline pragmas are applied to the match arrays, equal values
   are reduced to their first occurrence, and only then the survivors are exploded.

The raw value lives between steps 2 and 4 of the same stage. The output has only the
redacted preview and the fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from credlens.functions import text as tx
from credlens.functions.text import any_of, bind, lit
from credlens.rules import ENTROPY_RULE_ID, Allowlist, Rule, RulePack, default_rule_pack
from credlens.schema import FILESYSTEM

# Inline markers, token alphabet and threshold of the entropy detector.
INLINE_PRAGMA = r"(?i)pragma:\s*allowlist[ _-]secret|gitleaks:allow"
INLINE_PRAGMA_KEYWORDS = ("pragma:", "gitleaks:allow")
# The lookbehind does not change the matches (a greedy match starts where a run starts); it
# saves trying every later character of a run.
ENTROPY_TOKEN = r"(?<![A-Za-z0-9+/=_\-])[A-Za-z0-9+/=_\-]{24,}"
ENTROPY_MINIMUM = 4.0
ENTROPY_LENGTH = 24

# Matches are summed in blocks, so that growing the result arrays stays linear.
BLOCK = 256
ENTROPIES = "_entropies"  # of the entropy detector's tokens
HIT = "struct<line:int,column:int,secret:string,one_line:boolean,entropy:double>"


def entropy_rule(minimum: float = ENTROPY_MINIMUM) -> Rule:
    """The entropy detector as one more rule, tried after all signatures."""
    return Rule(rule_id=ENTROPY_RULE_ID, secret=ENTROPY_TOKEN, severity="low",
                description="High-entropy string", min_entropy=minimum)


def value_allowed(secret: str, allowlist: Allowlist) -> str:
    """True for placeholder values."""
    regex = allowlist.value_regex
    return f"({secret} RLIKE {lit(regex)})" if regex else "false"


def path_allowed(path: str, allowlist: Allowlist) -> str:
    """True for allowlisted paths; an empty path is never allowlisted."""
    regex = allowlist.path_regex
    return f"({path} <> '' AND {path} RLIKE {lit(regex)})" if regex else "false"


def mixed_alphabet(token: str) -> str:
    return f"({token} RLIKE '[0-9]' AND {token} RLIKE '[A-Za-z]')"


def has_inline_pragma(line: str) -> str:
    return f"({line} RLIKE {lit(INLINE_PRAGMA)})"


def pragma_lines(text: str) -> str:
    """Per line, whether it carries an inline pragma; null when no line can."""
    maybe = any_of(f"contains(t, {lit(k)})" for k in INLINE_PRAGMA_KEYWORDS)
    lines = f"transform(split({text}, '\\n'), line -> {has_inline_pragma('line')})"
    return f"if({bind('t', f'lower({text})', maybe)}, {lines}, NULL)"


# A token of the entropy detector lies inside a space-delimited word that is as long. Cutting
# at spaces is several times cheaper than a regex pass, and most running text stops here.
_HAS_LONG_WORD = f"exists(split(_text, ' '), w -> octet_length(w) >= {ENTROPY_LENGTH})"

# Characters from rare to frequent in running text, used to order the keyword tests.
_RARITY = "_+=/:ZXQJKV-UGYFNBRDPMHLWCOTSIEAzxqj.vkbgypfmwculdhrsinoate"


def _rarest(keyword: str) -> str:
    ranked = [c for c in keyword if c in _RARITY]
    return min(ranked, key=_RARITY.index) if ranked else keyword[0]


class _Gates:
    """Keyword gates of a rule list.

    A keyword can only occur where its rarest character does. That test stops at the first
    such character, and when there is none it stands in for all keywords that share it.
    """

    def __init__(self, rules: list[Rule]) -> None:
        self._columns: dict[tuple[str, str], str] = {}
        self._by_rule: list[str | None] = [self._gate(r) for r in rules]

    def _test(self, side: str, keyword: str) -> str:
        column = self._columns.setdefault((side, _rarest(keyword)), f"_c{len(self._columns)}")
        return f"({column} AND contains({side}, {lit(keyword)}))"

    def _gate(self, rule: Rule) -> str | None:
        if rule.rule_id == ENTROPY_RULE_ID:
            return "_long_word"
        if not rule.keywords:
            return None
        if rule.exact_keywords and not rule.ignores_case:
            return any_of(self._test("_text", k) for k in rule.keywords)
        return any_of(self._test("_lower", k.lower()) for k in rule.keywords)

    def character_tests(self) -> list[str]:
        return [f"contains({side}, {lit(char)}) AS {column}"
                for (side, char), column in self._columns.items()]

    def guard(self, index: int, expression: str) -> str:
        gate = self._by_rule[index]
        return expression if gate is None else f"if({gate}, {expression}, NULL)"


def _gaps(pattern: str, found: str) -> str:
    """Text before each match (``split`` adds the text after the last one).

    When there is one match and its text occurs nowhere else, a literal search finds it;
    otherwise only the regex itself can tell which occurrences are matches.
    """
    once = (f"size({found}) = 1 AND "
            f"octet_length(substring_index(_text, {found}[0], 2)) = octet_length(_text)")
    return f"if({once}, array(substring_index(_text, {found}[0], 1)), split(_text, {pattern}, -1))"


def _pieces(rule: Rule, index: int, found: str) -> str:
    """Everything needed to place the matches of one rule: gaps, matches, prefix, value."""
    pattern, group = lit(rule.pattern), rule.value_group
    if group == 0:
        lead, value = f"array_repeat('', size({found}))", found
    else:
        lead, *more = (f"regexp_extract_all(_text, {pattern}, {g})" for g in rule.lead_groups)
        for part in more:
            lead = f"zip_with({lead}, {part}, (a, b) -> concat(a, b))"
        if rule.suffix or rule.wrapped:
            value = f"regexp_extract_all(_text, {pattern}, {group})"
        else:
            value = f"zip_with({found}, {lead}, (m, p) -> substring(m, length(p) + 1))"
    wanted, entropies = f"size({found}) > 0", "cast(array() AS array<double>)"
    if rule.rule_id == ENTROPY_RULE_ID:  # computed once, and carried to the hit
        wanted = f"exists({ENTROPIES}, e -> e >= {lit(rule.min_entropy)})"
        entropies = ENTROPIES
    return (f"if({wanted}, named_struct('rule', {index}, 'gap', {_gaps(pattern, found)}, "
            f"'match', {found}, 'lead', {lead}, 'value', {value}, 'entropy', {entropies}), NULL)")


def _measured(pieces: str) -> str:
    """One struct per match: value plus the newlines and tails of the text around it."""
    zipped = (f"filter(arrays_zip({pieces}.gap, {pieces}.match, {pieces}.lead, {pieces}.value, {pieces}.entropy), "
              "z -> z.match IS NOT NULL)")
    spans = f"""transform({zipped}, z -> named_struct(
        'secret', z.value, 'entropy', z.entropy,
        'one_line', NOT contains(z.match, '\\n'),
        'before', if(z.lead = '', z.gap, concat(z.gap, z.lead)),
        'after', substring(z.match, length(z.lead) + 1)))"""
    return f"""transform({spans}, s -> named_struct(
        'secret', s.secret, 'entropy', s.entropy, 'one_line', s.one_line,
        'nl_before', {tx.newline_count('s.before')}, 'tail_before', {tx.tail_length('s.before')},
        'nl_after', {tx.newline_count('s.after')}, 'tail_after', {tx.tail_length('s.after')}))"""


def _placed(measured: str) -> str:
    """Turn the measured matches of one rule into hits with 1-based line and column.

    The state holds the position after the last match. Hits are appended to an array of at
    most BLOCK items; full blocks are put aside and joined at the end.
    """
    none = f"cast(array() AS array<{HIT}>)"
    column = tx.column_after("acc.column", "m.nl_before", "m.tail_before")
    step = f"""named_struct(
        'line', acc.line + m.nl_before + m.nl_after,
        'column', {tx.column_after(f'({column})', 'm.nl_after', 'm.tail_after')},
        'hits', concat(acc.hits, array(named_struct(
            'line', acc.line + m.nl_before, 'column', {column},
            'secret', m.secret, 'one_line', m.one_line, 'entropy', m.entropy))))"""
    one_block = f"""aggregate(block,
        named_struct('line', st.now.line, 'column', st.now.column, 'hits', {none}),
        (acc, m) -> {step})"""
    blocks = (f"transform(sequence(0, cast((size({measured}) - 1) div {BLOCK} AS int)), "
              f"b -> slice({measured}, b * {BLOCK} + 1, {BLOCK}))")
    return f"""aggregate({blocks},
        named_struct('now', named_struct('line', 1, 'column', 1, 'hits', {none}),
                     'done', cast(array() AS array<array<{HIT}>>)),
        (st, block) -> named_struct('now', {one_block},
                                    'done', concat(st.done, array(st.now.hits))),
        st -> flatten(concat(st.done, array(st.now.hits))))"""


def _first_per_value(hits: str) -> str:
    """Keep the first hit of every value. Sorts only when a value does repeat."""
    ordered = "array_sort(transform(hs, (h, i) -> named_struct('secret', h.secret, 'i', i, 'hit', h)))"
    firsts = bind("o", ordered, (
        "transform(filter(o, (x, i) -> i = 0 OR try_element_at(o, i).secret <> x.secret), x -> x.hit)"))
    return bind("hs", hits, (
        f"if(size(array_distinct(transform(hs, h -> h.secret))) = size(hs), hs, {firsts})"))


def _lookup(values: Iterable, index: str, kind: str) -> str:
    """values[index]; the array is folded into one literal."""
    items = ", ".join(lit(v) for v in values)
    return f"element_at(cast(array({items}) AS array<{kind}>), {index} + 1)"


def detect(
    documents: DataFrame,
    pack: RulePack | None = None,
    *,
    path: str = "path",
    content: str = "content",
    keep: Iterable[str] = (),
    line_map: str | None = None,
    signatures: bool = True,
    entropy: bool = False,
    min_entropy: float = ENTROPY_MINIMUM,
    pragmas: bool = True,
    dedup: bool = True,
    secret_hash: bool = False,
    source: str = FILESYSTEM,
) -> DataFrame:
    """Find credentials in a table of texts; one output row per finding.

    ``keep`` names further input columns to carry to the findings. ``line_map`` names an
    ``array<int>`` column that gives the real line number of each content line. ``dedup``
    keeps the first finding per fingerprint of each input row.
    ``secret_hash`` adds ``secret_sha256`` for values that a verifier could check: the rule
    has a verifier hint and the match stands on one line.
    Works on batch and on streaming frames.
    """
    pack = pack or default_rule_pack()
    rules = list(pack.rules if signatures else ())
    if entropy:
        rules.append(entropy_rule(min_entropy))
    if not rules:
        raise ValueError("no detectors selected")
    keep = [f"`{c}`" for c in keep]
    rest = ["_path", *keep, *(["_line_map"] if line_map else [])]
    found = [f"_m{i}" for i in range(len(rules))]

    if pack.allowlist.path_regex:
        allowed = path_allowed(f"`{path}`", pack.allowlist)
        documents = documents.where(f"NOT coalesce({allowed}, false)")
    texts = documents.selectExpr(
        f"`{path}` AS _path", f"{tx.normalize_newlines(f'`{content}`')} AS _text", *keep,
        *([f"`{line_map}` AS _line_map"] if line_map else []),
    )
    gates = _Gates(rules)
    texts = texts.selectExpr("*", "lower(_text) AS _lower")
    if entropy:
        texts = texts.selectExpr("*", f"{_HAS_LONG_WORD} AS _long_word")
    texts = texts.selectExpr("*", *gates.character_tests())
    matched = texts.selectExpr(*rest, "_text", *[
        f"{gates.guard(i, f'regexp_extract_all(_text, {lit(rule.pattern)}, 0)')} AS {name}"
        for i, (rule, name) in enumerate(zip(rules, found, strict=True))
    ])

    if entropy:
        score = f"if({mixed_alphabet('t')}, {tx.shannon_entropy('t')}, 0D)"
        matched = matched.selectExpr("*", f"transform({found[-1]}, t -> {score}) AS {ENTROPIES}")
    any_match = any_of(f"coalesce(size({name}) > 0, false)" for name in found)
    pragma = f"if({any_match}, {pragma_lines('_text')}, NULL)" if pragmas else "cast(NULL AS array<boolean>)"
    pieces = ", ".join(_pieces(rule, i, name)
                       for i, (rule, name) in enumerate(zip(rules, found, strict=True)))
    located = matched.selectExpr(
        *rest, f"{pragma} AS _pragma", f"filter(array({pieces}), p -> p IS NOT NULL) AS _pieces")

    wanted = [f"NOT {value_allowed('h.secret', pack.allowlist)}"]
    if entropy:
        wanted.insert(0, f"(p.rule <> {len(rules) - 1} OR {mixed_alphabet('h.secret')})")
    if pragmas:
        wanted.append("NOT coalesce(try_element_at(_pragma, h.line), false)")
    minimum = _lookup([r.min_entropy for r in rules], "p.rule", "double")
    hits = bind("q", _measured("p"), _placed("q"))
    scored = f"""transform(filter({hits}, h -> {' AND '.join(wanted)}), h -> named_struct(
        'rule', p.rule, 'line', h.line, 'column', h.column, 'secret', h.secret,
        'one_line', h.one_line,
        'entropy', if({minimum} IS NULL, NULL, coalesce(h.entropy, {tx.shannon_entropy('h.secret')}))))"""
    survivors = f"filter({scored}, h -> h.entropy IS NULL OR h.entropy >= {minimum})"
    if dedup:
        survivors = _first_per_value(survivors)

    # An outer explode keeps Catalyst from inferring size(hits) > 0 and running the whole
    # detection a second time inside that inferred filter.
    exploded = located.selectExpr(
        *rest, f"explode_outer(flatten(transform(_pieces, p -> {survivors}))) AS _hit"
    ).where("_hit IS NOT NULL")

    rule_id = _lookup([r.rule_id for r in rules], "_hit.rule", "string")
    severity = _lookup([r.severity for r in rules], "_hit.rule", "string")
    verifier = _lookup([r.verifier for r in rules], "_hit.rule", "string")
    description = _lookup([r.description or r.rule_id for r in rules], "_hit.rule", "string")
    if entropy:
        description = (
            f"if(_hit.rule = {len(rules) - 1}, "
            f"format_string('High-entropy string (H=%.2f)', {tx.rounded_entropy('_hit.entropy', 2)}), "
            f"{description})")
    line = "coalesce(try_element_at(_line_map, _hit.line), _hit.line)" if line_map else "_hit.line"
    columns = {
        "rule_id": rule_id,
        "description": description,
        "severity": severity,
        "severity_rank": tx.severity_rank(severity),
        "path": "_path",
        "line": line,
        "column": "_hit.column",
        "preview": tx.redact("_hit.secret"),
        "fingerprint": tx.fingerprint(rule_id, "_hit.secret", "_path"),
        "source": lit(source),
        "entropy": tx.rounded_entropy("_hit.entropy"),
        "verifier": verifier,
        "verification": "'unverified'",
    }
    if secret_hash:
        columns["secret_sha256"] = f"if({verifier} IS NOT NULL AND _hit.one_line, sha2(_hit.secret, 256), NULL)"
    return exploded.selectExpr(*[f"{sql} AS `{name}`" for name, sql in columns.items()], *keep)
