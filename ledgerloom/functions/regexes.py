"""Texts that every match of a regular expression must hold."""

from __future__ import annotations

import re


def _class_end(pattern: str, at: int) -> int:
    """The place after a character class that begins at ``at``; classes nest."""
    depth, i, first = 0, at, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            depth, first = depth + 1, True
            if pattern[i + 1 : i + 2] == "^":
                i += 1
            i += 1
            continue
        elif c == "]" and not first:
            depth -= 1
            if not depth:
                return i + 1
        first = False
        i += 1
    return len(pattern)


def _group_end(pattern: str, at: int) -> int:
    """The place after a group that begins at ``at``."""
    depth, i = 0, at
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i = _class_end(pattern, i)
            continue
        depth += (c == "(") - (c == ")")
        i += 1
        if not depth:
            return i
    return len(pattern)


def _branches(pattern: str) -> list[str]:
    """The alternatives outside of groups and classes."""
    out, begin, i = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[":
            i = _class_end(pattern, i)
        elif c == "(":
            i = _group_end(pattern, i)
        elif c == "|":
            out.append(pattern[begin:i])
            i = begin = i + 1
        else:
            i += 2 if c == "\\" else 1
    return [*out, pattern[begin:]]


def _longest_run(branch: str) -> str:
    """The longest run of characters that a match of the branch must hold, the first of several."""
    runs, run, i = [], "", 0

    def end() -> None:
        nonlocal run
        runs.append(run)
        run = ""

    while i < len(branch):
        c = branch[i]
        if c == "\\":
            follows = branch[i + 1 : i + 2]
            if follows.isalnum() or not follows:
                end()
            else:
                run += follows
            i += 2
        elif c == "[":
            end()
            i = _class_end(branch, i)
        elif c == "(":
            end()
            i = _group_end(branch, i)
        elif c in "*?{":
            # what stands before may be absent, or stand more than once
            run = run[:-1]
            end()
            i = branch.find("}", i) + 1 if c == "{" and "}" in branch[i:] else i + 1
        elif c in "+.^$":
            end()
            i += 1
        else:
            run += c
            i += 1
    end()
    return max(runs, key=len)


def required_texts(pattern: str) -> list[str]:
    """Texts of which every match holds one at least, one for each alternative; none if some match needn't hold any.

    Groups, classes and repeated parts are passed over, so a text may be shorter than it could be, but never wrong.
    Patterns with comments, quoted parts or free spacing are not looked into.
    """
    if re.search(r"\(\?[a-z-]*x|\\[QE]", pattern):
        return []
    found = [_longest_run(b) for b in _branches(pattern)]
    return list(dict.fromkeys(found)) if all(found) else []
