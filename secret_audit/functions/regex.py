"""Character classes of Python's ``re`` spelled out, SQL literals, and globs as Java patterns. Rules: ``patterns``."""

from __future__ import annotations

import re

# Characters for which Python's \s is true, as the body of a Java character class.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Python's \w and \d over str.
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
# Non-ASCII letters that fold to an ASCII letter when case is ignored.
FOLDS_TO_ASCII = ("\u017f", "\u212a", "\u0131", "\u0130")

def sql_literal(text: str) -> str:
    """Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def glob_to_java(glob: str) -> str:
    """Path glob: ``**/`` is any number of folders, ``*`` and ``?`` stay inside one name."""
    out = ""
    parts = glob.strip("/").split("/")
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += ".+" if last else "(?:[^/]+/)*"
            continue
        out += _wildcard(part, "[^/]*", "[^/]") + ("" if last else "/")
    return rf"(?s)^{out}\z"


def fnmatch_to_java(glob: str) -> str:
    """Shell match over the whole path: ``*`` also crosses ``/``."""
    return rf"(?s)^{_wildcard(glob, '.*', '.')}\z"


def _wildcard(text: str, star: str, single: str) -> str:
    out = ""
    for token in re.findall(r"\*+|\?|\[!?\]?[^\]]*\]|.", text, re.DOTALL):
        if token[0] == "*":
            out += star
        elif token == "?":
            out += single
        elif token[0] == "[" and len(token) > 2:
            body = token[1:-1].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
        else:
            out += re.escape(token)
    return out
