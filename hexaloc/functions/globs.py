"""Globs over whole components, compiled on the driver to the cheapest Spark predicate.

``*`` and ``?`` also match slashes; ``?`` and classes match one byte. ``**`` between slashes (or
at an end) matches any directories, elsewhere it is ``*``. ``{a,b}`` are alternatives, which nest.
``[ab] [a-z] [!a] [^a]`` are classes. A backslash makes the next character literal.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of steps of a compiled glob.
ANY, ONE, FIRST_DIRS, MIDDLE_DIRS, LAST_DIRS = "any", "one", "first_dirs", "middle_dirs", "last_dirs"
REGEX = {ANY: ".*", ONE: ".", FIRST_DIRS: "(?:/?|.*/)", MIDDLE_DIRS: "(?:/|/.*/)", LAST_DIRS: "/.*"}


class GlobError(ValueError):
    """A glob that can't be compiled."""


@dataclass(frozen=True)
class Literal:
    text: str


@dataclass(frozen=True)
class Class:
    negated: bool
    ranges: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Choice:
    options: tuple[tuple, ...]


class _Reader:
    def __init__(self, glob: str):
        self.glob, self.at = glob, 0

    def sequence(self, inside: bool = False) -> list:
        """Steps up to the end, or inside braces up to the comma or brace that ends an option."""
        steps: list = []
        begins = True  # nothing but a slash or the beginning is before
        while self.at < len(self.glob):
            c = self.glob[self.at]
            if inside and c in ",}":
                break
            if c == "}":
                raise GlobError("a brace closes that wasn't opened")
            self.at += 1
            if c == "*":
                self._stars(steps, begins, inside)
                begins = self.glob[self.at - 1] == "/"
                continue
            if c == "?":
                steps.append(ONE)
            elif c == "[":
                steps.append(self._class())
            elif c == "{":
                steps.append(self._choice())
            else:
                if c == "\\":
                    if self.at == len(self.glob):
                        raise GlobError("nothing follows the backslash")
                    c = self.glob[self.at]
                    self.at += 1
                steps.append(Literal(c))
            begins = c == "/"
        return steps

    def _stars(self, steps: list, begins: bool, inside: bool) -> None:
        if self.glob[self.at : self.at + 1] != "*":
            steps.append(ANY)
            return
        self.at += 1
        rest = self.glob[self.at : self.at + 1]
        ends = rest == "" or (inside and rest in ",}")
        if not begins or not (ends or rest == "/"):
            steps += [ANY, ANY]
            return
        if rest == "/":
            self.at += 1
        if not steps:
            steps.append(ANY if ends and not inside else FIRST_DIRS)
        elif steps[-1] == Literal("/"):
            steps[-1] = LAST_DIRS if ends else MIDDLE_DIRS
        elif ends and steps[-1] != FIRST_DIRS:
            steps.append(ANY)

    def _class(self) -> Class:
        negated = self.glob[self.at : self.at + 1] in ("!", "^") and self.at < len(self.glob)
        self.at += negated
        chars: list[str] = []
        ranges: list[tuple[str, str]] = []
        first = True
        while True:
            if self.at >= len(self.glob):
                raise GlobError("a class isn't closed")
            c = self.glob[self.at]
            self.at += 1
            if c == "]" and not first:
                return Class(negated, tuple(ranges))
            after = self.glob[self.at : self.at + 1]
            if after == "-" and self.glob[self.at + 1 : self.at + 2] not in ("", "]"):
                high = self.glob[self.at + 1]
                if high < c:
                    raise GlobError(f"the range {c}-{high} is empty")
                ranges.append((c, high))
                self.at += 2
            else:
                ranges.append((c, c))
            first = False
            chars.append(c)

    def _choice(self) -> Choice:
        options = []
        while True:
            options.append(tuple(self.sequence(inside=True)))
            if self.at >= len(self.glob):
                raise GlobError("a brace isn't closed")
            self.at += 1
            if self.glob[self.at - 1] == "}":
                return Choice(tuple(options))


def _escaped(text: str, by_bytes: bool) -> str:
    if by_bytes:
        return "".join(f"\\x{b:02X}" if b > 127 or not chr(b).isalnum() else chr(b) for b in text.encode())
    return "".join(c if c.isalnum() or ord(c) > 127 else f"\\x{ord(c):02X}" for c in text)


def _regex(steps, by_bytes: bool) -> str:
    out = []
    for s in steps:
        if isinstance(s, Literal):
            out.append(_escaped(s.text, by_bytes))
        elif isinstance(s, Class):
            # a class matches a byte, so its characters count by their bytes
            ranges = []
            for a, b in s.ranges:
                low, high = a.encode(), b.encode()
                ranges += [f"\\x{low[0]:02X}-\\x{high[0]:02X}"] if len(low) == len(high) == 1 else [f"\\x{x:02X}" for x in sorted({*low, *high})]
            out.append(f"[{'^' if s.negated else ''}{''.join(ranges)}]")
        elif isinstance(s, Choice):
            options = [r for r in (_regex(o, by_bytes) for o in s.options) if r]
            out.append(f"(?:{'|'.join(options)})" if options else "")
        else:
            out.append(REGEX[s])
    return "".join(out)


def _by_bytes(steps) -> bool:
    return any(s == ONE or isinstance(s, Class) or isinstance(s, Choice) and any(map(_by_bytes, s.options)) for s in steps)


@dataclass(frozen=True)
class Glob:
    """A compiled glob. kind: all, equals, prefix, suffix or regex; regex is the body without anchors."""

    source: str
    kind: str
    text: str
    regex: str
    by_bytes: bool

    def predicate(self, c: Column) -> Column:
        if self.kind == "all":
            return F.lit(True)
        if self.kind == "equals":
            return c == self.text
        if self.kind == "prefix":
            return c.startswith(self.text)
        if self.kind == "suffix":
            return c.endswith(self.text)
        # characters of Latin-1 stand for bytes
        return (F.decode(F.encode(c, "UTF-8"), "ISO-8859-1") if self.by_bytes else c).rlike(self.anchored)

    @property
    def anchored(self) -> str:
        return rf"(?s)\A(?:{self.regex})\z"

    def matches(self, text: str) -> bool:
        """The same in Python, for the driver."""
        given = text.encode().decode("latin-1") if self.by_bytes else text
        return re.fullmatch(f"(?s:{self.regex})", given) is not None


def compile_glob(glob: str | None) -> Glob:
    """M4: a glob; none, or ``**``, matches everything."""
    glob = "**" if glob is None else glob
    reader = _Reader(glob)
    steps = reader.sequence()
    by_bytes = _by_bytes(steps)
    regex = _regex(steps, by_bytes)
    literal = lambda x: all(isinstance(s, Literal) for s in x)
    text = lambda x: "".join(s.text for s in x)
    while len(steps) > 1 and steps[0] in (ANY, FIRST_DIRS) and steps[1] == ANY:  # **/*x is *x, for * crosses slashes
        steps = steps[1:]
    if steps and all(s == ANY for s in steps):
        return Glob(glob, "all", "", regex, by_bytes)
    if literal(steps):
        return Glob(glob, "equals", text(steps), regex, by_bytes)
    if steps[0] == ANY and literal(steps[1:]):
        return Glob(glob, "suffix", text(steps[1:]), regex, by_bytes)
    if steps[-1] == ANY and literal(steps[:-1]):
        return Glob(glob, "prefix", text(steps[:-1]), regex, by_bytes)
    return Glob(glob, "regex", "", regex, by_bytes)
