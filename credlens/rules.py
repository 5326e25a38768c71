"""Rule packs: detection rules and the allowlist, read from a JSON or YAML file.

A rule pack is small configuration, so it lives on the driver and turns into literals in
the plan. A foldable pattern is compiled once per task by Spark; a pattern that came from
a join would be compiled again for every row.

A rule is written either as ``prefix`` / ``secret`` / ``suffix`` parts, or as one ``regex``
with an optional ``capture`` group index.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import cached_property, lru_cache
from importlib import resources
from pathlib import Path
from typing import Any

from credlens.dialect import DialectError, least_width, to_java
from credlens.schema import SEVERITIES

# Private-use characters that mark where a part of a rule begins and ends while it is translated.
_LEFT, _RIGHT = "\ue000", "\ue001"

ENTROPY_RULE_ID = "high_entropy_string"


class RulePackError(ValueError):
    """A rule pack that cannot be used; raised on the driver before any job starts."""


@dataclass(frozen=True)
class Rule:
    rule_id: str
    secret: str
    description: str = ""
    severity: str = "medium"
    prefix: str = ""
    suffix: str = ""
    flags: str = ""
    min_entropy: float | None = None
    verifier: str | None = None
    keywords: tuple[str, ...] = ()
    #: Keywords are searched as they are written; otherwise in either case.
    exact_keywords: bool = False
    #: A whole regex, for a value that does not stand at the top level: see ``wrap_capture``.
    wrapped: str = ""
    lead_groups: tuple[int, ...] = (1,)
    group: int = 0

    @property
    def source(self) -> str:
        """The regex as written, with groups around prefix and value, in Python's dialect."""
        if self.wrapped:
            return self.flags + self.wrapped
        if not self.prefix and not self.suffix:
            return self.flags + self.secret
        return f"{self.flags}(?:{self.prefix})({self.secret})(?:{self.suffix})"

    @cached_property
    def pattern(self) -> str:
        """The regex for Spark. Without a prefix and suffix the value is the whole match."""
        if self.wrapped:  # backreferences are numbered for the wrapped form already
            return "(?d)" + to_java(self.flags + self.wrapped)
        if not self.prefix and not self.suffix:
            return "(?d)" + to_java(self.flags + self.secret)
        # The group around the prefix comes first, so every other group's number grows by one.
        marked = to_java(f"{self.flags}{_LEFT}{self.prefix}{_RIGHT}({self.secret}){_LEFT}{self.suffix}{_RIGHT}", 1)
        lead, rest = marked.split(_RIGHT, 1)
        value, tail = rest.rsplit(_LEFT, 1)
        suffix = f"(?:{tail[:-1]})" if self.suffix else ""
        return "(?d)" + lead.replace(_LEFT, "(", 1) + ")" + value + suffix

    @property
    def value_group(self) -> int:
        """Group that holds the value (0: whole match)."""
        if self.wrapped:
            return self.group
        if not self.prefix and not self.suffix:
            return 0
        return 2 + re.compile(self.flags + (self.prefix or "")).groups

    @property
    def ignores_case(self) -> bool:
        return re.search(r"\(\?[a-zA-Z]*i", self.source) is not None

    def check(self) -> None:
        if self.severity not in SEVERITIES:
            raise RulePackError(f"{self.rule_id}: unknown severity {self.severity!r}")
        try:
            re.compile(self.source)
            _ = self.pattern
        except (re.error, DialectError) as exc:
            raise RulePackError(f"{self.rule_id}: bad regex: {exc}") from exc
        if not least_width(self.source):
            raise RulePackError(f"{self.rule_id}: the regex can match empty text")


@dataclass(frozen=True)
class Allowlist:
    """Case-insensitive patterns of values and paths that are never reported."""

    value_patterns: tuple[str, ...] = ()
    path_patterns: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for pattern in (*self.value_patterns, *self.path_patterns):
            try:
                to_java(pattern)
            except (re.error, DialectError) as exc:
                raise RulePackError(f"allowlist: bad regex {pattern!r}: {exc}") from exc

    @staticmethod
    def _any_of(patterns: Iterable[str]) -> str | None:
        parts, groups = [], 0
        for p in patterns:
            parts.append(f"(?:{to_java(p, groups)})")
            groups += re.compile(p).groups
        return "(?id)(?:" + "|".join(parts) + ")" if parts else None

    @property
    def value_regex(self) -> str | None:
        return self._any_of(self.value_patterns)

    @property
    def path_regex(self) -> str | None:
        return self._any_of(self.path_patterns)


@dataclass(frozen=True)
class RulePack:
    rules: tuple[Rule, ...]
    allowlist: Allowlist = Allowlist()

    def __post_init__(self) -> None:
        ids = [r.rule_id for r in self.rules]
        if len(ids) != len(set(ids)):
            raise RulePackError("rule ids must be unique")
        for rule in self.rules:
            rule.check()

    def rule_index(self) -> dict[str, Rule]:
        return {r.rule_id: r for r in self.rules}

    def without_allowlist(self) -> RulePack:
        return RulePack(self.rules, Allowlist())

    def only(self, *rule_ids: str) -> RulePack:
        return RulePack(tuple(r for r in self.rules if r.rule_id in rule_ids), self.allowlist)


_LEADING_FLAGS = re.compile(r"\(\?[a-zA-Z]+\)")
_TOKEN = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|[()|]|.", re.DOTALL)


def split_capture(regex: str, capture: int) -> tuple[str, str, str, str] | None:
    """Cut a regex at its capture group into (flags, prefix, secret, suffix).

    Works when the group stands at the top level, outside any alternation and not
    repeated; returns None otherwise, since the value's offset is then unknown.
    """
    flags = ""
    lead = _LEADING_FLAGS.match(regex)
    if lead:
        flags, regex = lead.group(0), regex[lead.end():]
    depth = group = 0
    start = end = None
    for token in _TOKEN.finditer(regex):
        text = token.group(0)
        if text == "|" and depth == 0:
            return None
        if text == "(":
            ahead = regex[token.end():token.end() + 2]
            if not ahead.startswith("?"):
                group += 1
                if group == capture:
                    if depth:
                        return None
                    start = token.start()
            depth += 1
        elif text == ")":
            depth -= 1
            if start is not None and end is None and depth == 0:
                end = token.end()
    if start is None or end is None or regex[end:end + 1] in {"?", "*", "+", "{"}:
        return None
    return flags, regex[:start], regex[start + 1:end - 1], regex[end:]


def wrap_capture(regex: str, capture: int) -> tuple[str, str, tuple[int, ...], int] | None:
    """(flags, regex, lead groups, value group) for a capture group inside other groups.

    At every level the stretch before the group that holds the value gets a group of its own;
    the stretches' lengths add up to the value's offset. Backreferences are renumbered. None if
    one of the enclosing groups is repeated or looks around, or if the way leads through an
    alternative, as the value may then be missing or stand elsewhere.
    """
    flags = ""
    lead = _LEADING_FLAGS.match(regex)
    if lead:
        flags, regex = lead.group(0), regex[lead.end():]
    opened: list[list] = []  # start of the body, number, alternatives inside
    whole = [0, None, False]
    way: list[list] | None = None
    closed: dict[int, int] = {}
    number = 0
    for token in _TOKEN.finditer(regex):
        text, at = token.group(0), token.start()
        if text == "|":
            (opened[-1] if opened else whole)[2] = True
        elif text == "(":
            ahead = regex[at + 1:at + 4]
            takes = not ahead.startswith("?") or ahead.startswith("?P<")
            plain = takes or ahead.startswith("?:")
            number += takes
            body = regex.index(">", at) + 1 if ahead.startswith("?P<") else at + (1 if takes else 3)
            opened.append([body, number if takes else None, False, at, plain])
            if takes and number == capture:
                way = list(opened)
        elif text == ")":
            closed[opened.pop()[3]] = token.end()
    if way is None or whole[2] or any(w[2] for w in way[:-1]) or not all(w[4] for w in way):
        return None
    if any(regex[closed[w[3]]:closed[w[3]] + 1] in {"?", "*", "+", "{"} for w in way):
        return None
    # Starts and ends of the stretches, then the regex with them wrapped.
    starts = [0, *[w[0] for w in way[:-1]]]
    stops = [w[3] for w in way]
    places = sorted([(a, "(") for a in starts] + [(b, ")") for b in stops], key=lambda p: (p[0], p[1] == ")"))
    wrapped, last = [], 0
    for at, mark in places:
        wrapped += [regex[last:at], mark]
        last = at
    text = "".join(wrapped) + regex[last:]
    # Where each new group comes in the order of opening brackets gives the new numbers.
    kinds = sorted([(a, 0, "new") for a in starts] + [(t.start(), 1, "old") for t in _TOKEN.finditer(regex)
                   if t.group(0) == "(" and (regex[t.start() + 1:t.start() + 2] != "?" or regex[t.start() + 1:t.start() + 4] == "?P<")])
    old = {}
    leads = []
    for place, (_, _, kind) in enumerate(kinds, 1):
        if kind == "new":
            leads.append(place)
        else:
            old[len(old) + 1] = place
    text = re.sub(r"(\\\\)|\\([1-9][0-9]?)", lambda m: m[0] if m[1] else f"(?:\\{old[int(m[2])]})", text)
    return flags, text, tuple(leads), old[capture]


def _rule_from(entry: Mapping[str, Any]) -> Rule:
    common = {
        "rule_id": entry["id"],
        "description": entry.get("description", entry["id"]),
        "severity": entry.get("severity", "medium"),
        "min_entropy": None if entry.get("min_entropy") is None else float(entry["min_entropy"]),
        "verifier": entry.get("verifier"),
        "keywords": tuple(entry.get("keywords", ())),
        "exact_keywords": bool(entry.get("exact_keywords", False)),
    }
    if "secret" in entry:
        return Rule(secret=entry["secret"], prefix=entry.get("prefix", ""),
                    suffix=entry.get("suffix", ""), **common)
    regex = entry["regex"]
    capture = int(entry.get("capture", 0))
    try:
        groups = re.compile(regex).groups
    except re.error as exc:
        raise RulePackError(f"{entry['id']}: bad regex: {exc}") from exc
    if not capture or not groups:
        return Rule(secret=regex, **common)
    if capture > groups:
        raise RulePackError(f"{entry['id']}: no group {capture}")
    parts = split_capture(regex, capture)
    if parts is not None:
        flags, prefix, secret, suffix = parts
        return Rule(flags=flags, prefix=prefix, secret=secret, suffix=suffix, **common)
    nested = wrap_capture(regex, capture)
    if nested is None:
        raise RulePackError(
            f"{entry['id']}: group {capture} is repeated, optional or one of several alternatives; "
            "use credlens.operators.custom.detect_with_python for such a rule"
        )
    flags, wrapped, leads, group = nested
    return Rule(secret=regex, flags=flags, wrapped=wrapped, lead_groups=leads, group=group, **common)


def parse_rule_pack(raw: Mapping[str, Any]) -> RulePack:
    section = raw.get("allowlist") or {}
    return RulePack(
        tuple(_rule_from(e) for e in raw.get("patterns") or ()),
        Allowlist(tuple(section.get("value_patterns") or ()),
                  tuple(section.get("path_patterns") or ())),
    )


def load_rule_pack(path: str | Path) -> RulePack:
    """Read a rule pack file (.json, or .yaml/.yml when PyYAML is installed)."""
    text = Path(path).read_text(encoding="utf-8")
    if Path(path).suffix.lower() in {".yaml", ".yml"}:
        try:
            import yaml
        except ImportError as exc:  # pragma: no cover - depends on the environment
            raise RulePackError("reading a YAML rule pack needs PyYAML; use JSON") from exc
        return parse_rule_pack(yaml.safe_load(text) or {})
    return parse_rule_pack(json.loads(text or "{}"))


@lru_cache(maxsize=1)
def default_rule_pack() -> RulePack:
    """The built-in pack of 28 rules."""
    text = resources.files("credlens.resources").joinpath("rules.json").read_text("utf-8")
    return parse_rule_pack(json.loads(text))
