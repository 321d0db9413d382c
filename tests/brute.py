"""Plain-Python statements of the semantics, for comparison on small inputs."""

import math
import re
from collections import Counter


def content_matches(content, rules):
    for i, rule in enumerate(rules):
        for k, m in enumerate(re.finditer(rule.pattern, content, re.IGNORECASE)):
            yield i, k, m.group(), content.count("\n", 0, m.start()) + 1, content.count("\n", 0, m.end()) + 1


def line_matches(content, rules):
    for n, line in enumerate(content.split("\n"), 1):
        for i, rule in enumerate(rules):
            for k, m in enumerate(re.finditer(rule.pattern, line, re.IGNORECASE)):
                yield n, i, k, m.group()


def entropy(s):
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) if s else 0.0


def tokens(content, threshold=4.5):
    for n, line in enumerate(content.split("\n"), 1):
        for k, m in enumerate(re.finditer(r"[A-Za-z0-9+/=_-]{20,}", line)):
            if entropy(m.group()) >= threshold:
                yield n, k, m.group()


def snippet(content, start, end):
    lines = content.split("\n")
    return "\n".join(
        f"{'>>> ' if start <= n <= end else '    '}{n:4d}: {lines[n - 1]}"
        for n in range(max(1, start - 3), min(len(lines), end + 3) + 1)
    )


def first_wins(rows, key):
    seen = {}
    for row in rows:
        seen.setdefault(key(row), row)
    return list(seen.values())
