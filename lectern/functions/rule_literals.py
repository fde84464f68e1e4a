"""The text that every match of a rule's pattern must hold.

A rule can only change a text in which its literal occurs, and looking for a
literal is far cheaper than running a pattern.  Only the top level of a pattern is
read: groups and classes give nothing, and whatever is not understood gives no
literal, which is always right.
"""

from __future__ import annotations

import re

_CONTROLS = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}
# Escapes that match one of several characters, or a place.
_OPEN_ESCAPES = frozenset("dDsSwWAz")
_COUNT = re.compile(r"\{\d+(?:,\d*)?\}")
# Letter case or layout that counts for nothing.
_LOOSE = re.compile(r"\(\?[a-zA-Z-]*[ix][a-zA-Z-]*[:)]")
# A class of one character, often used in place of an escape.
_SINGLE = re.compile(r"\[([^\^\[\]\\])\]", re.S)


def _class_end(pattern: str, at: int) -> int:
    """Place after the class that opens at ``at``."""
    at += 1
    if pattern[at : at + 1] == "^":
        at += 1
    if pattern[at : at + 1] == "]":
        at += 1
    depth = 1
    while depth:
        char = pattern[at]
        depth += (char == "[") - (char == "]")
        at += 2 if char == "\\" else 1
    return at


def _group_end(pattern: str, at: int) -> int:
    """Place after the group that opens at ``at``."""
    depth = 0
    while True:
        char = pattern[at]
        depth += (char == "(") - (char == ")")
        at = _class_end(pattern, at) if char == "[" else at + (2 if char == "\\" else 1)
        if not depth:
            return at


def required_literal(pattern: str) -> str:
    """The longest run of characters that each match holds at the top level; '' if none is known."""
    if _LOOSE.search(pattern):
        return ""
    runs, run, at = [], "", 0
    try:
        while at < len(pattern):
            char = pattern[at]
            if char == "|":
                return ""
            if single := _SINGLE.match(pattern, at):
                run, at = run + single[1], single.end()
            elif char in "[(":
                runs, run = [*runs, run], ""
                at = _class_end(pattern, at) if char == "[" else _group_end(pattern, at)
            elif char in ".^$":
                runs, run, at = [*runs, run], "", at + 1
            elif char in "*?+{":
                count = _COUNT.match(pattern, at)
                if char == "{" and not count:
                    return ""
                # What is repeated may be absent, or be followed by itself.
                runs, run = [*runs, run if char == "+" else run[:-1]], ""
                at = count.end() if count else at + 1
            elif char == "\\":
                escaped = pattern[at + 1]
                if escaped in _CONTROLS or (escaped.isascii() and not escaped.isalnum() and escaped not in "<>"):
                    run += _CONTROLS.get(escaped, escaped)
                elif escaped in _OPEN_ESCAPES:
                    runs, run = [*runs, run], ""
                else:
                    return ""
                at += 2
            else:
                run, at = run + char, at + 1
    except IndexError:
        return ""
    return max([*runs, run], key=len)
