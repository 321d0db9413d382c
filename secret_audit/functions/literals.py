"""Index of a large rule pack by the literals that its rules need.

The literals of all rules become one pattern in the shape of a trie, so one pass over a text tells which of them it holds. A
table leads from a literal to the rules that need it; only these are tried on the text.
"""

from __future__ import annotations

from secret_audit.functions.patterns import escaped

#: Shorter literals are in most texts and don't tell rules apart.
SHORTEST = 3


def prefix_free(literals: set[str]) -> dict[str, str]:
    """For each literal the shortest one that begins it: what is looked for, so that one place holds one at most."""
    out: dict[str, str] = {}
    last = None
    for literal in sorted(literals):
        if last is None or not literal.startswith(last):
            last = literal
        out[literal] = last
    return out


def trie_pattern(literals) -> str:
    """Java pattern whose first group is the literal that begins at a place; it takes no characters, so none is missed."""
    root: dict = {}
    for literal in literals:
        node = root
        for c in literal:
            node = node.setdefault(c, {})

    def written(node: dict) -> str:
        out = ""
        while len(node) == 1:  # a chain of characters without a choice
            ((c, node),) = node.items()
            out += escaped(ord(c))
        if node:
            out += "(?:" + "|".join(escaped(ord(c)) + written(x) for c, x in sorted(node.items())) + ")"
        return out

    return f"(?=({written(root)}))"


def literal_index(hints: list[tuple[str, ...]]) -> tuple[str | None, list[tuple[str, int, list[str]]], list[int]]:
    """The pattern that finds literals, rows (literal, rule, the rule's literals before it), and the rules without an index.

    A text that holds several literals of a rule leads to it once: by the first of them.
    """
    rules = {i: h for i, h in enumerate(hints) if h and min(map(len, h)) >= SHORTEST}
    known = prefix_free({x for h in rules.values() for x in h})
    rows = []
    for i, h in rules.items():
        own = sorted({known[x] for x in h})
        rows += [(x, i, own[:k]) for k, x in enumerate(own)]
    return trie_pattern(set(known.values())) if known else None, rows, [i for i in range(len(hints)) if i not in rules]
