"""Patterns written for Python's ``re``, as Java patterns of the same meaning."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: White space that Python's ``\s`` has beyond Java's Unicode ``\s``.
_MORE_SPACE = r"\x1c-\x1f"
_FLAGS = {"IGNORECASE": "i", "DOTALL": "s", "MULTILINE": "m", "VERBOSE": "x", "I": "i", "S": "s", "M": "m", "X": "x"}


@dataclass(frozen=True)
class Translated:
    """A Java pattern and the numbers of its named groups."""

    pattern: str
    groups: dict[str, int]
    count: int
    #: Whether what it matches depends on what stands before or after: anchors, word ends, looking ahead or behind.
    looks_around: bool = True


def java_pattern(pattern: str, flags: tuple[str, ...] | list[str] = ()) -> Translated:
    """Translates ``pattern``; raises ValueError for what Java can't say.

    Classes become Unicode-aware (``U``) and lines end only at a newline (``d``), as in Python; ``\\s`` takes in the four
    separators that Java leaves out; named groups lose their ``P``.
    """
    unknown = [f for f in flags if f.upper() not in _FLAGS]
    if unknown:
        raise ValueError(f"unsupported regular expression flags: {unknown}")
    try:
        compiled = re.compile(pattern)
    except re.error as error:
        raise ValueError(f"invalid regular expression {pattern!r}: {error}") from error
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        two = pattern[i : i + 2]
        if c == "\\":
            if two == "\\s":
                out.append(rf"\s{_MORE_SPACE}" if in_class else rf"[\s{_MORE_SPACE}]")
            elif two == "\\S":
                if in_class:
                    raise ValueError(rf"\S within a class can't be translated: {pattern!r}")
                out.append(rf"[^\s{_MORE_SPACE}]")
            elif two == "\\Z":
                out.append(r"\z")
            else:
                out.append(two)
            i += 2
            continue
        if in_class:
            if c == "]" and out[-1] not in ("[", "[^"):
                in_class = False
            out.append("\\" + c if c in "[&~" else c)
            i += 1
            continue
        if c == "[":
            in_class = True
            out.append("[^" if pattern[i + 1 : i + 2] == "^" else "[")
            i += len(out[-1])
            if pattern[i : i + 1] == "]":
                out.append("\\]")
                i += 1
            continue
        if pattern.startswith("(?P<", i):
            name = pattern[i + 4 : pattern.index(">", i)]
            out.append(f"(?<{name.replace('_', 'U95')}>")
            i = pattern.index(">", i) + 1
            continue
        if pattern.startswith("(?P=", i):
            name = pattern[i + 4 : pattern.index(")", i)]
            out.append(rf"\k<{name.replace('_', 'U95')}>")
            i = pattern.index(")", i) + 1
            continue
        if pattern.startswith("(?(", i):
            raise ValueError(f"conditional groups can't be translated: {pattern!r}")
        out.append(c)
        i += 1
    letters = "".join(sorted({_FLAGS[f.upper()] for f in flags}))
    bare = re.sub(r"\\[^bBAZ]", "", re.sub(r"\[\^?\]?(?:\\.|[^\]\\])*\]", "", pattern))
    looks = re.search(r"[\^$]|\\[bBAZ]|\(\?<?[=!]", bare) is not None
    return Translated(f"(?dU{letters})" + "".join(out), dict(compiled.groupindex), compiled.groups, looks)


def java_replacement(template: str, names: dict[str, int] | None = None) -> str:
    """A replacement template for ``regexp_replace``: ``\\1``, ``\\g<1>`` and ``\\g<name>`` become ``$1``."""

    def group(m: re.Match) -> str:
        token = m[1] or m[2]
        return f"${token if token.isdigit() else (names or {})[token]}"

    parts, at = [], 0
    for m in re.finditer(r"\\(\d)|\\g<(\w+)>", template):
        parts += [template[at : m.start()].replace("\\", "\\\\").replace("$", "\\$"), group(m)]
        at = m.end()
    return "".join([*parts, template[at:].replace("\\", "\\\\").replace("$", "\\$")])
