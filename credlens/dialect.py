"""Rules are written in Python's regex dialect; Spark runs Java's. This turns one into the other.

The result means the same on every JDK: shorthand classes and word boundaries are spelled out for
Unicode text, ``$`` and ``.`` know only LF as a line end, brackets and ``&&`` in a class are plain
characters. What Java has no counterpart for is refused on the driver.
"""

from __future__ import annotations

import re
from re import _parser  # the standard library's own parser, for the width of a pattern

WORD, SPACE, DIGIT = r"\p{L}\p{N}_", r"\s\x1c-\x1f\x85\p{Z}", r"\p{Nd}"
_CLASSES = {"w": WORD, "s": SPACE, "d": DIGIT}
_BOUNDARY = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
_INSIDE = f"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))"
_TOKEN = re.compile(r"\\(?:[1-9][0-9]?|U[0-9A-Fa-f]{8}|N\{[^}]*\}|.)|\(\?P<\w+>|\(\?P=\w+\)|\(\?\(|\(\?[aiLmsux]+\)|\{,\d+\}|[\[()]|.", re.DOTALL)


class DialectError(ValueError):
    """A pattern that has no counterpart in the other dialect."""


def least_width(pattern: str) -> int:
    """The fewest characters that a match takes; 0 also for patterns that only look around."""
    return _parser.parse(pattern).getwidth()[0]


def _class(pattern: str, start: int) -> tuple[str, int]:
    """The Java form of the class that opens at ``start``, and where it ends."""
    at, out = start + 1, ["["]
    negated = pattern[at:at + 1] == "^"
    if negated:
        out.append("^")
        at += 1
    first = True
    while first or pattern[at] != "]":
        char = pattern[at]
        if char == "\\":
            kind = pattern[at + 1]
            if kind in _CLASSES:
                out.append(_CLASSES[kind])
            elif kind.lower() in _CLASSES:
                if negated:
                    raise DialectError(f"\\{kind} in a negated class")
                out.append(f"[^{_CLASSES[kind.lower()]}]")
            elif kind == "b":
                out.append(r"\x08")
            elif kind == "0":
                out.append(r"\x00")
            elif kind == "U":
                out.append(f"\\x{{{pattern[at + 2:at + 10]}}}")
                at += 8
            else:
                out.append(char + kind)
            at += 2
        else:
            out.append("\\" + char if char in "[]&^" else char)
            at += 1
        first = False
    return "".join(out) + "]", at + 1


def to_java(pattern: str, shift: int = 0) -> str:
    """The pattern for Java; group numbers in backreferences grow by ``shift``.

    Named groups become numbered ones.
    """
    names = re.compile(pattern).groupindex
    out, at = [], 0

    def group(number: int) -> str:
        digit = pattern[at:at + 1].isdigit()
        return f"(?:\\{number + shift})" if digit else f"\\{number + shift}"

    while at < len(pattern):
        token = _TOKEN.match(pattern, at)[0]
        if token == "[":
            text, at = _class(pattern, at)
            out.append(text)
            continue
        at += len(token)
        if token.startswith("(?P<"):
            out.append("(")
        elif token.startswith("(?P="):
            out.append(group(names[token[4:-1]]))
        elif token == "(?(":
            raise DialectError("conditional groups")
        elif re.fullmatch(r"\(\?[aiLmsux]+\)", token):
            flags = set(token[2:-1])
            if flags & {"a", "L"}:
                raise DialectError("ASCII and locale flags")
            flags.discard("u")
            out.append("(?" + "".join(sorted(flags)) + ")" if flags else "")
        elif token.startswith("{,"):
            out.append("{0" + token[1:])
        elif token[0] == "\\" and len(token) > 1:
            kind = token[1]
            if kind in "123456789":
                out.append(group(int(token[1:])))
            elif kind in _CLASSES:
                out.append(f"[{_CLASSES[kind]}]")
            elif kind.lower() in _CLASSES:
                out.append(f"[^{_CLASSES[kind.lower()]}]")
            elif kind == "b":
                out.append(_BOUNDARY)
            elif kind == "B":
                out.append(_INSIDE)
            elif kind == "Z":
                out.append(r"\z")
            elif kind == "0":
                out.append(r"\x00")
            elif kind == "U":
                out.append(f"\\x{{{token[2:]}}}")
            else:
                out.append(token)
        else:
            out.append(token)
    return "".join(out)
