"""Rule patterns, written in Python's ``re`` syntax, as Java patterns with what a scan wants to know about them.

The pattern is parsed once and the tree is written out again for Java, so nothing depends on how a construct was spelled.
Java and Python disagree on what ``\\s``, ``\\w`` and ``\\d`` cover, so these classes are spelled out; ``u`` folds case over
Unicode and ``d`` keeps ``\\n`` the only line terminator.

From the tree also come the literals of which every match contains one, the shortest match, and a form whose matches stay in
a line: where nothing but classes can take a line feed, classes without it find in a whole text what the pattern finds in its
lines.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, replace
from functools import cache
from itertools import product
from re import _constants as C
from re import _parser as parser

from secret_audit.functions.regex import DIGIT, FOLDS_TO_ASCII, SPACE, WORD

_BODIES = {C.CATEGORY_SPACE: SPACE, C.CATEGORY_WORD: WORD, C.CATEGORY_DIGIT: DIGIT}
_ASCII_BODIES = {C.CATEGORY_SPACE: r"\t-\r\x20", C.CATEGORY_WORD: r"0-9A-Za-z_", C.CATEGORY_DIGIT: "0-9"}
_OPPOSITE = {C.CATEGORY_NOT_SPACE: C.CATEGORY_SPACE, C.CATEGORY_NOT_WORD: C.CATEGORY_WORD, C.CATEGORY_NOT_DIGIT: C.CATEGORY_DIGIT}
_TAKES_LINE_FEED = {C.CATEGORY_SPACE, C.CATEGORY_NOT_WORD, C.CATEGORY_NOT_DIGIT}
_PLACES = {
    C.AT_BEGINNING: "^", C.AT_BEGINNING_STRING: r"\A", C.AT_END: "$", C.AT_END_STRING: r"\z", C.AT_BOUNDARY: r"\b", C.AT_NON_BOUNDARY: r"\B",
}
_FLAGS = {"i": C.SRE_FLAG_IGNORECASE, "s": C.SRE_FLAG_DOTALL, "m": C.SRE_FLAG_MULTILINE}
_CHARACTER = {C.LITERAL, C.NOT_LITERAL, C.IN, C.ANY}
_NEVER = "(?!)"
#: Most literals of a rule and most characters of one.
MOST_LITERALS, LITERAL_LENGTH = 32, 16


@dataclass(frozen=True)
class _Mode:
    flags: int
    folds: bool  # letters outside ASCII may fold to ASCII ones
    line: bool = False  # nothing takes a line feed

    @property
    def ignores_case(self) -> bool:
        return bool(self.flags & C.SRE_FLAG_IGNORECASE)

    @property
    def bodies(self) -> dict:
        return _ASCII_BODIES if self.flags & C.SRE_FLAG_ASCII else _BODIES


def escaped(c: int) -> str:
    if c < 128 and chr(c).isalnum():
        return chr(c)
    return f"\\u{c:04x}" if c < 0x10000 else f"\\x{{{c:x}}}"


def _listed(members: set[str], negated: bool, mode: _Mode) -> str:
    """Every character in both cases: Java then tests a class by one table look-up."""
    if mode.ignores_case:
        members = members | {c.swapcase() for c in members}
        if mode.folds and not mode.flags & C.SRE_FLAG_ASCII:
            members |= {f for f in FOLDS_TO_ASCII if {f.lower()[0], f.upper()[0].lower()} & members}
    if mode.line:
        members = members | {"\n"} if negated else members - {"\n"}
    if not members:
        return _NEVER
    return f"[{'^' if negated else ''}{''.join(escaped(ord(c)) for c in sorted(members))}]"


def _class(items: list, mode: _Mode) -> tuple[str, bool]:
    """A bracketed class, and whether both cases are listed in it."""
    negated = items[0][0] is C.NEGATE
    items = items[negated:]
    if all(op is C.LITERAL and v < 128 or op is C.RANGE and v[1] < 128 for op, v in items):
        members = {chr(c) for op, v in items for c in (range(v[0], v[1] + 1) if op is C.RANGE else (v,))}
        return _listed(members, negated, mode), True
    body, outside, feed = "", [], False
    for op, v in items:
        if op is C.CATEGORY:
            if v in _OPPOSITE:
                outside.append(mode.bodies[_OPPOSITE[v]])
            else:
                body += mode.bodies[v]
            feed |= v in _TAKES_LINE_FEED
        else:
            low, high = v if op is C.RANGE else (v, v)
            body += escaped(low) + (f"-{escaped(high)}" if high > low else "")
            feed |= low <= 10 <= high
    if negated:
        feed_too = r"\n" if mode.line else ""
        if not outside:
            return f"[^{body}{feed_too}]", False
        kept = [f"[{x}]" for x in outside] + ([f"[^{body}{feed_too}]"] if body or feed_too else [])
        return f"[{'&&'.join(kept)}]", False
    union = f"[{body}{''.join(f'[^{x}]' for x in outside)}]"
    return (f"[{union}&&[^\\n]]" if mode.line and feed else union), False


class _Writer:
    """Writes a parsed pattern for Java; refuses what Java lacks."""

    def sequence(self, nodes, mode: _Mode) -> str:
        return "".join(self.node(op, v, mode) for op, v in nodes)

    def character(self, op, v, mode: _Mode, quantifier: str = "") -> str:
        if op is C.ANY:
            if mode.flags & C.SRE_FLAG_DOTALL and not mode.line:
                return f"(?s).{quantifier}(?-s)"
            return "." + quantifier
        if op is C.LITERAL:
            return (_NEVER if mode.line and v == 10 else escaped(v)) + quantifier
        items = [(C.NEGATE, None), (C.LITERAL, v)] if op is C.NOT_LITERAL else v
        text, listed = _class(items, mode)
        if text == _NEVER:
            return f"(?:{text}){quantifier}"
        return f"(?-i){text}{quantifier}(?i)" if listed and mode.ignores_case else text + quantifier

    def node(self, op, v, mode: _Mode) -> str:
        if op in _CHARACTER:
            return self.character(op, v, mode)
        if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, body = v
            if high is C.MAXREPEAT:
                count = {0: "*", 1: "+"}.get(low, f"{{{low},}}")
            else:
                count = "?" if (low, high) == (0, 1) else f"{{{low}}}" if low == high else f"{{{low},{high}}}"
            count += {C.MIN_REPEAT: "?", C.POSSESSIVE_REPEAT: "+"}.get(op, "")
            if len(body) == 1 and body[0][0] in _CHARACTER:
                return self.character(*body[0], mode, count)
            text = self.sequence(body, mode)
            grouped = len(body) == 1 and body[0][0] is C.SUBPATTERN
            return (text if grouped else f"(?:{text})") + count
        if op is C.SUBPATTERN:
            group, add, drop, body = v
            inner = replace(mode, flags=(mode.flags | add) & ~drop)
            if group is not None:
                return f"({self.sequence(body, inner)})"
            on, off = ("".join(k for k, f in _FLAGS.items() if x & f) for x in (add, drop))
            return f"(?{on}{'-' + off if off else ''}:{self.sequence(body, inner)})"
        if op is C.BRANCH:
            return "(?:" + "|".join(self.sequence(x, mode) for x in v[1]) + ")"
        if op is C.AT:
            place = _PLACES[v]
            return f"(?m:{place})" if v in (C.AT_BEGINNING, C.AT_END) and mode.flags & C.SRE_FLAG_MULTILINE else place
        if op in (C.ASSERT, C.ASSERT_NOT):
            direction, body = v
            return f"(?{'<' if direction < 0 else ''}{'=' if op is C.ASSERT else '!'}{self.sequence(body, mode)})"
        if op is C.GROUPREF:
            return f"(?:\\{v})"
        if op is C.ATOMIC_GROUP:
            return f"(?>{self.sequence(v, mode)})"
        if op is C.FAILURE:
            return _NEVER
        if op is C.GROUPREF_EXISTS:
            raise ValueError("a condition on a group is not supported")
        raise ValueError(f"{str(op).lower()} is not supported")


def _parts(nodes):
    """All nodes of a tree."""
    for op, v in nodes:
        yield op, v
        if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            yield from _parts(v[2])
        elif op is C.SUBPATTERN:
            yield from _parts(v[3])
        elif op is C.BRANCH:
            for x in v[1]:
                yield from _parts(x)
        elif op in (C.ASSERT, C.ASSERT_NOT):
            yield from _parts(v[1])
        elif op is C.ATOMIC_GROUP:
            yield from _parts(v)


def _exact(op, v) -> set[str] | None:
    """The lower-case texts that a node matches, where these are few and ASCII."""
    if op is C.LITERAL:
        return {chr(v).lower()} if v < 128 else None
    if op is C.IN:
        if any(x is not C.LITERAL and x is not C.RANGE for x, _ in v):
            return None
        members = [range(x[0], x[1] + 1) if kind is C.RANGE else (x,) for kind, x in v]
        if sum(map(len, members)) > 16 or any(c > 127 for m in members for c in m):
            return None
        return {chr(c).lower() for m in members for c in m}
    if op is C.SUBPATTERN:
        return _exact_sequence(v[3])
    if op is C.ATOMIC_GROUP:
        return _exact_sequence(v)
    if op is C.BRANCH:
        found = [_exact_sequence(x) for x in v[1]]
        return None if any(f is None for f in found) else _few(set().union(*found))
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and v[0] == v[1] <= LITERAL_LENGTH:
        return _exact_sequence([x for _ in range(v[0]) for x in v[2]])
    return None


def _few(texts: set[str]) -> set[str] | None:
    return texts if len(texts) <= MOST_LITERALS else None


def _exact_sequence(nodes) -> set[str] | None:
    out = {""}
    for op, v in nodes:
        own = _exact(op, v)
        if own is None or len(out) * len(own) > MOST_LITERALS:
            return None
        out = {a + b for a, b in product(out, own)}
    return out


def _needed(nodes) -> set[str] | None:
    """Lower-case texts of which every match of the sequence contains one: the longest such set."""
    sets, run = [], {""}
    for op, v in nodes:
        own = _exact(op, v)
        if own is not None and len(run) * len(own) <= MOST_LITERALS:
            run = {a + b for a, b in product(run, own)}
            continue
        sets.append(run)
        run = own or {""}
        if own is None:
            if op is C.SUBPATTERN:
                sets.append(_needed(v[3]))
            elif op is C.ATOMIC_GROUP:
                sets.append(_needed(v))
            elif op is C.BRANCH:
                found = [_needed(x) for x in v[1]]
                sets.append(None if any(f is None for f in found) else _few(set().union(*found)))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and v[0] > 0:
                sets.append(_needed(v[2]))
    sets.append(run)
    usable = [s for s in sets if s and "" not in s]
    return max(usable, key=lambda s: (min(min(map(len, s)), LITERAL_LENGTH), -len(s))) if usable else None


def _run(nodes) -> tuple[frozenset, int]:
    """Characters outside which no match of the sequence goes in some stretch of that length: the longest one, 0 if unknown."""
    best = frozenset(), 0
    for op, v in nodes:
        if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and len(v[2]) == 1 and v[2][0][0] is C.IN:
            items = v[2][0][1]
            if all(kind is C.LITERAL and x < 128 or kind is C.RANGE and x[1] < 128 for kind, x in items):
                members = {chr(c) for kind, x in items for c in (range(x[0], x[1] + 1) if kind is C.RANGE else (x,))}
                found = frozenset(members | {c.swapcase() for c in members}), v[0]
                best = max(best, found, key=lambda r: r[1])
        elif op in (C.SUBPATTERN, C.ATOMIC_GROUP):
            best = max(best, _run(v[3] if op is C.SUBPATTERN else v), key=lambda r: r[1])
    return best


@dataclass(frozen=True)
class Pattern:
    """A rule's pattern for Java.

    ``plain`` is the form for texts without letters that fold to ASCII, ``line`` and ``line_plain`` the forms whose matches in a
    whole text are those in its lines, None where there is no such form. ``literals`` are lower case, none if nothing is needed.
    ``run`` holds ASCII characters in both cases and how many of these, or of letters that fold to them, stand in a row in
    every match.
    """

    java: str
    plain: str
    line: str | None
    line_plain: str | None
    literals: tuple[str, ...]
    min_length: int
    run: tuple[frozenset, int]


@cache
def parse(pattern: str, ignore_case: bool = True) -> Pattern:
    """Raises ValueError with the reason where a pattern is wrong, matches the empty text or has no Java form."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", FutureWarning)  # of class syntax that Python may give a meaning one day
            tree = parser.parse(pattern, C.SRE_FLAG_IGNORECASE if ignore_case else 0)
            empty = re.compile(pattern).match("")
        if empty:
            raise ValueError("it matches the empty string")
        flags = tree.state.flags
        if flags & C.SRE_FLAG_LOCALE:
            raise ValueError("the locale flag is not supported")
        parts = list(_parts(tree))
        bounded = any(op is C.AT and v in (C.AT_BOUNDARY, C.AT_NON_BOUNDARY) for op, v in parts)
        if flags & C.SRE_FLAG_ASCII and (bounded or not flags & C.SRE_FLAG_IGNORECASE) or any(op is C.SUBPATTERN and v[1] & C.SRE_FLAG_ASCII for op, v in parts):
            raise ValueError("the ASCII flag is supported for whole patterns without word boundaries only")
        # Case folding beyond ASCII and word boundaries need the full form at all times.
        wide = bounded or any(op is C.LITERAL and v > 127 for op, v in parts) or not pattern.isascii()
        alone = any(
            op in (C.ASSERT, C.ASSERT_NOT) or op is C.LITERAL and v == 10 or op is C.AT and v not in (C.AT_BOUNDARY, C.AT_NON_BOUNDARY)
            for op, v in parts
        )

        def written(folds: bool, line: bool) -> str:
            if flags & C.SRE_FLAG_ASCII:
                return "(?id)" + _Writer().sequence(tree, _Mode(flags, False, line))
            folds = folds or wide
            prefix = ("(?iuUd)" if folds else "(?id)") if flags & C.SRE_FLAG_IGNORECASE else "(?Ud)"
            return prefix + _Writer().sequence(tree, _Mode(flags, folds, line))

        literals = _needed(tree) or set()
        return Pattern(
            written(True, False), written(False, False), None if alone else written(True, True), None if alone else written(False, True),
            tuple(sorted({x[:LITERAL_LENGTH] for x in literals})), tree.getwidth()[0],
            _run(tree),
        )
    except (re.error, ValueError, OverflowError, RecursionError) as e:
        raise ValueError(f"{e}: {pattern!r}") from None


def to_java(pattern: str, ignore_case: bool = True, folds: bool = True) -> str:
    """The Java form; ``folds=False`` gives a faster one for texts without any of FOLDS_TO_ASCII, where ASCII letters have two cases."""
    found = parse(pattern.removeprefix("(?i)"), ignore_case)
    return found.java if folds else found.plain
