"""Search patterns as regular expressions for the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_REGEX_CHARS = frozenset("+(){}|^$\\")
_GLOB_CHARS = frozenset("*?[]")


def is_regex(pattern: str) -> bool:
    return pattern.startswith("re:") or any(c in _REGEX_CHARS for c in pattern)


def is_glob(pattern: str) -> bool:
    return any(c in _GLOB_CHARS for c in pattern)


def _quoted(s: str) -> str:
    return re.sub(r"([\\.^$|?*+(){}\[\]&~#-])", r"\\\1", s)


def _set_regex(inner: str, any_char: str) -> str:
    """A bracket set; ranges that run backwards hold nothing."""
    negated, inner = inner.startswith("!"), inner[1:] if inner.startswith("!") else inner
    safe = lambda c: re.sub(r"([\\\[\]^&-])", r"\\\1", c)
    out, i = "", 0
    while i < len(inner):
        if i + 2 < len(inner) and inner[i + 1] == "-":
            if inner[i] <= inner[i + 2]:
                out += f"{safe(inner[i])}-{safe(inner[i + 2])}"
            i += 3
        else:
            out += safe(inner[i])
            i += 1
    if not out:
        return any_char if negated else "(?!)"
    return f"[{'^' if negated else ''}{out}]"


def glob_regex(pattern: str, any_char: str = "[\\s\\S]") -> str:
    """A shell glob as a regex: * ? [set] [!set]; an unclosed bracket stands for itself."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += any_char + "*"
        elif c == "?":
            out += any_char
        elif c == "[":
            j = i + (pattern[i : i + 1] == "!")
            j = pattern.find("]", j + (pattern[j : j + 1] == "]"))
            if j < 0:
                out += r"\["
            else:
                out += _set_regex(pattern[i:j], any_char)
                i = j + 1
        else:
            out += _quoted(c)
    return out


def _loose_glob(pattern: str, any_char: str) -> str:
    """The glob as it is also tried, unanchored, with brackets as plain characters."""
    return "".join(any_char + "*" if c == "*" else any_char if c == "?" else _quoted(c) for c in pattern)


def _inside_segment(raw: str) -> str:
    """A regex whose wildcards do not cross dots."""
    out, i = "", 0
    while i < len(raw):
        c = raw[i]
        if c == "\\" and i + 1 < len(raw):
            out += {"\\S": "[^\\s.]", "\\D": "[^\\d.]", "\\W": "[^\\w.]"}.get(raw[i : i + 2], raw[i : i + 2])
            i += 2
        elif c == "[":
            j = i + 1 + raw[i + 1 : i + 2].count("^")
            j = raw.find("]", j + 1)
            j = len(raw) - 1 if j < 0 else j
            body = raw[i : j + 1]
            out += body[:-1] + ".]" if body.startswith("[^") else body
            i = j + 1
        else:
            out += "[^.]" if c == "." else c
            i += 1
    return out


def segment_regex(pattern: str) -> str:
    """Regex for one whole path segment; a glob matches anchored, or anywhere in the segment."""
    if is_regex(pattern):
        return f"(?:{_inside_segment(pattern.removeprefix('re:'))})"
    if is_glob(pattern):
        return f"(?:{glob_regex(pattern, '[^.]')}|[^.]*{_loose_glob(pattern, '[^.]')}[^.]*)"
    return _quoted(pattern)


def path_tokens(pattern: str) -> list[str]:
    """Split at dots; two dots or more in a row are one ``..``."""
    out = []
    for part in re.split(r"(\.{2,})|\.", pattern):
        if part:
            out.append(".." if part.startswith("..") else part)
    return out


def path_regex(pattern: str) -> str:
    """Anchored regex for a whole dotted path. One segment alone matches any segment; ``..`` skips one segment or more."""
    parts = path_tokens(pattern)
    if not parts:
        return "(?!)"
    if len(parts) == 1 and parts[0] != "..":
        return rf"(?:^|.*\.){segment_regex(parts[0])}(?:\..*|$)"
    out, first = "^", True
    for k, part in enumerate(parts):
        if part == "..":
            if k == len(parts) - 1:
                out += r"[^.]*(?:\.[^.]*)*" if first else r"(?:\.[^.]*)+"
            else:
                out += r"[^.]*(?:\.[^.]*)*?" if first else r"(?:\.[^.]*)+?"
        else:
            out += ("" if first else r"\.") + segment_regex(part)
        first = False
    return out + "$"


def matches_path(path: Column, pattern: str, *, case_insensitive: bool = False) -> Column:
    return path.rlike(("(?i)" if case_insensitive else "") + path_regex(pattern))


def matches_segment(segment: Column, pattern: str, *, case_insensitive: bool = False) -> Column:
    if not is_regex(pattern) and not is_glob(pattern):
        return F.lower(segment) == pattern.lower() if case_insensitive else segment == pattern
    return segment.rlike(("(?i)" if case_insensitive else "") + f"^{segment_regex(pattern)}$")


def matches_name(name: Column, pattern: str, *, case_insensitive: bool = False) -> Column:
    """Regex: whole name; glob: whole name; else a substring, whatever the case."""
    flag = "(?i)" if case_insensitive else ""
    if is_regex(pattern):
        return name.rlike(f"{flag}^(?:{pattern.removeprefix('re:')})$")
    if is_glob(pattern):
        return name.rlike(f"{flag}^{glob_regex(pattern)}$")
    if "." in pattern:
        return name.rlike(flag + pattern)
    return F.contains(F.lower(name), F.lit(pattern.lower()))


def matches_equal_depth(path: Column, pattern: str, *, case_insensitive: bool = False) -> Column:
    """As many segments as the pattern, each matching its own."""
    flag = "(?i)" if case_insensitive else ""
    return path.rlike(flag + "^" + r"\.".join(segment_regex(p) if p else "" for p in pattern.split(".")) + "$")


def matches_port(port: Column, pattern: str) -> Column:
    """Exact whatever the case, or a glob that heeds it; brackets with digits are indices, brackets with * any index."""
    if not any(c in pattern for c in "*?"):
        return F.lower(port) == pattern.lower()
    glob = "".join("[^\\]]*" if c == "*" and pattern[:i].count("[") > pattern[:i].count("]") else "[\\s\\S]*" if c == "*" else "." if c == "?" else _quoted(c) for i, c in enumerate(pattern))
    return (F.lower(port) == pattern.lower()) | port.rlike(f"^{glob}$")


def matches_ignore(path: Column, pattern: str) -> Column:
    """Ignore rule: a glob on the path, its last part or any part; else a substring, whatever the case."""
    if is_glob(pattern):
        rx = f"(?i)^{glob_regex(pattern)}$"
        return path.rlike(rx) | F.exists(F.split(path, "/"), lambda s: s.rlike(rx))
    return F.contains(F.lower(path), F.lit(pattern.lower()))
