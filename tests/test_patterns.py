"""Patterns written for Java, their line forms and literals, and packs of thousands of rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from secret_audit.functions.literals import literal_index, prefix_free
from secret_audit.functions.patterns import parse
from secret_audit.functions.regex import FOLDS_TO_ASCII
from secret_audit.operators import detect as D
from secret_audit.rules import CONTENT_PACK, PACKS, Rule, compile_pack, read_rules, read_rules_with_rejects

PATTERNS = [
    "a(?#note)bb", "x{,3}y", r"(?x) a \s* b  # note", r"\v\0?z", r"\101b+?", r"(?P<q>['\"])x*?(?P=q)", r"[^\S\n]+a", "(?s)a.b", r"[\s\S]k", "a{2,5}?b++(?>c|d)", "(?i:AbC)d",
    "(?-i:AbC)d", r"(?a)\w+é", "[[&&]x", r"[^\w\s]{2}", r"[\W\d]+k", r"\bkey\B", "s(?=k)", "(?<![ab])c|d+", "(ab|cd|[e-g]h)+i", r"gh[ops]_\d{2,}", r"[^x\W]+\Z", r"^a", r"(?m)^b$",
    "(?:a|b(?:c|d){2})x", r"\U0001F600+|日本", r"[\n-\r]+b", "[^a]b", r"\x20{2}",
]
ALPHABET = list("abcdefghikxyzABKS _'\"0123\n\n\t\r\v\0[&é") + ["k", "key", "ghp_12", "日本", "\U0001f600", "ſ", "K", "  "]


def subjects(n=250):
    rnd = random.Random(3)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


def matches(spark, texts, pattern):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").coalesce(2)
    return [r.m for r in df.select("i", F.regexp_extract_all("s", F.lit(pattern), F.lit(0)).alias("m")).orderBy("i").collect()]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_forms_and_literals(spark, pattern):
    texts, found = subjects(), parse(pattern)
    expression = re.compile(pattern, re.I)
    want = [[m.group() for m in expression.finditer(t)] for t in texts]
    assert matches(spark, texts, found.java) == want
    plain = [i for i, t in enumerate(texts) if not set(t) & set(FOLDS_TO_ASCII)]
    assert matches(spark, [texts[i] for i in plain], found.plain) == [want[i] for i in plain]
    if found.line:
        lines = [[m.group() for x in t.split("\n") for m in re.finditer(pattern, x, re.I)] for t in texts]
        assert matches(spark, texts, found.line) == lines
        assert matches(spark, [texts[i] for i in plain], found.line_plain) == [lines[i] for i in plain]
    for i in plain:
        for m in want[i]:
            assert len(m) >= found.min_length and (not found.literals or any(x in m.lower() for x in found.literals))


@pytest.mark.parametrize("pattern", ["(a)?(?(1)b|c)b", "(", "a*", "(?L)a", "[z-a]", "(?<=a+)b"])
def test_refused_with_a_reason(pattern):
    with pytest.raises(ValueError, match=".+: "):
        parse(pattern)


def test_literals_of_the_packs():
    for rules in PACKS.values():
        for r in rules:
            derived = parse(r.pattern)
            assert derived.min_length == r.min_length and bool(derived.literals) == bool(r.hints)
    assert parse("gh[ops]_[a-z]{3}").literals == ("gho_", "ghp_", "ghs_")
    assert parse("(?:foo|bar)x?(?:secret|token)").literals == ("secret", "token")[:2] and parse("[a-z]+").literals == ()


def test_index():
    assert prefix_free({"abc", "ab", "abd", "b", "xy"}) == {"ab": "ab", "abc": "ab", "abd": "ab", "b": "b", "xy": "xy"}
    pattern, rows, rest = literal_index([("abcd", "xyz"), (), ("ab",), ("abc",), ("xyz1",)])
    assert rest == [1, 2] and sorted(rows) == [("abc", 0, []), ("abc", 3, []), ("xyz", 0, ["abc"]), ("xyz", 4, [])]
    text = "xabcdxyz1 abxyz"
    assert [m[1] for m in re.finditer(pattern.replace(r"\u0031", "1"), text)] == ["abc", "xyz", "xyz"]


def big_pack(n):
    rnd = random.Random(1)
    name = lambda: "".join(rnd.choice("bcdfghjklmnpqrstvwz") for _ in range(rnd.randint(4, 7)))
    kinds = [lambda: f"{name()}_[0-9a-f]{{6}}", lambda: f"(?:{name()}|{name()})\\s*=\\s*['\"][^'\"]{{4,}}['\"]", lambda: f"\\b{name()}\\d+", lambda: f"^{name()}:.*$"]
    return [Rule(f"r{i}", "k", 0.5, kinds[i % 4]()) for i in range(n)] + [Rule("hex", "k", 0.5, "[0-9a-f]{12}"), Rule("short", "k", 0.5, "zq[0-9]")]


def planted(rules, n):
    rnd = random.Random(2)
    out = []
    for i in range(n):
        parts = ["".join(rnd.choice("abcdefgh 0123\n") for _ in range(60))]
        for r in rnd.sample(rules[:-2], 3):
            word = rnd.choice(re.findall("[b-z]{4,7}", r.pattern))
            parts.append(rnd.choice([f"{word}_0a1b2c", f"{word.upper()} = 'hunter22'", f"{word}77", f"\n{word}: x y", f"zq{i % 10} é {word.replace('k', 'K')}_ffffff", "\0 deadbeef0123"]))
        out.append((i, rnd.choice([" ", "\n"]).join(parts)))
    return out


def test_large_pack_equals_rule_by_rule(spark, monkeypatch):
    rules = big_pack(300)
    df = spark.createDataFrame(planted(rules, 150), "i int, content string").repartition(3)
    scans = {
        "content": lambda: D.scan_content(df, rules).select("i", "rule", "match_ord", "line_start", "line_end", "secret"),
        "lines": lambda: D.scan_lines(df, rules).select("i", "rule", "line_start", "match_ord", "secret", "line"),
        "entropy": lambda: D.scan_lines_with_entropy(df, rules, threshold=2.5).select("i", "type", "line_start", "match_ord", "fingerprint"),
        "counts": lambda: D.rule_hit_counts(df, rules),
    }
    large = {k: sorted(map(tuple, f().collect())) for k, f in scans.items()}
    monkeypatch.setattr(D, "SMALL_PACK", 1000)
    assert all(len(v) > 100 for v in large.values())
    for k, f in scans.items():
        assert sorted(map(tuple, f().collect())) == large[k], k
    want = sorted((i, r.name, m.group()) for i, t in planted(rules, 150) for r in rules for m in re.finditer(r.pattern, t, re.I))
    assert sorted((i, rule, secret) for i, rule, _, _, _, secret in large["content"]) == want


def test_lines_equal_python(spark):
    rules = [*PACKS["commit"], Rule("start", "k", 0.5, "^akia.{4}"), Rule("gap", "k", 0.5, r"a\s+b"), Rule("feed", "k", 0.5, r"x\ny")]
    texts = ["a\nb a  b", "akia1234 akia5678\nAKIA9999\0", "x\ny\0a b", "Bearer\nabc\nbearer x\n-----BEGIN\nPRIVATE KEY-----", "", "\n", "a b\0\na \0b", "é\na b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    got = sorted((r.i, r.rule, r.line_start, r.match_ord, r.secret, r.line) for r in D.scan_lines(df, rules).collect())
    want = sorted(
        (i, r.name, n, k, m.group(), x) for i, t in enumerate(texts) for n, x in enumerate(t.split("\n"), 1) for r in rules for k, m in enumerate(re.finditer(r.pattern, x, re.I))
    )
    assert got == want


def test_rejected_rules(spark, tmp_path):
    lines = [
        '{"name": "ok", "kind": "k", "confidence": 0.5, "pattern": "a(?#note)bb|x{,3}y", "ord": 1}', '{"name": "if", "kind": "k", "confidence": 0.5, "pattern": "(a)?(?(1)b|c)b", "ord": 2}',
        '{"name": "ok", "kind": "k", "confidence": 0.5, "pattern": "zz", "ord": 3}', '{"name": "many", "kind": "k", "confidence": 0.5, "pattern": "a{3000000000}", "ord": 4}',
        '{"kind": "k", "confidence": 0.5, "pattern": "q", "ord": 5}', '{"name": "back", "kind": "k", "confidence": 0.5, "pattern": "(c)\\\\1", "ord": 6}',
    ]
    (tmp_path / "rules.json").write_text("\n".join(lines))
    rules, rejects = read_rules_with_rejects(spark, str(tmp_path / "rules.json"))
    assert [r.name for r in rules] == ["ok", "back"]
    reasons = {(r["name"], r["pattern"]): r["reason"] for r in rejects.collect()}
    assert set(reasons) == {("if", "(a)?(?(1)b|c)b"), ("ok", "zz"), ("many", "a{3000000000}"), (None, "q")} and all(reasons.values())
    df = spark.createDataFrame([("abb xxy y cc",)], "content string")
    assert sorted(r.secret for r in D.scan_content(df, rules).collect()) == ["abb", "cc", "xxy", "y"]
    with pytest.raises(ValueError, match="if: "):
        read_rules(spark, str(tmp_path / "rules.json"))
    assert compile_pack(spark, [])[0] == () and len(CONTENT_PACK) == 10


def test_runs_of_a_class():
    run = lambda p, **k: (lambda r: ("".join(sorted(r[0])), r[1]))(parse(p, **k).run)
    assert run("[a-c]{40}") == run("x([A-C]{40,})y[ab]{3}") == ("ABCabc", 40)
    assert run("[^a]{9}")[1] == run("a|[ab]{9}")[1] == run("(?:[ab]{9})?c")[1] == run(r"[\w]{9}")[1] == 0


def test_rules_behind_the_token_test_lose_nothing(spark):
    """A rule without literals is tried only where a token is, or a letter that folds to one of a token's."""
    rules = [Rule("part", "k", 0.5, "[A-Za-z0-9/+=]{22}"), Rule("short", "k", 0.5, "[0-9a-f]{19}"), Rule("other", "k", 0.5, "[a-z.]{22}")]
    texts = ["x " + "aB3/" * 6, "\u017f" * 30, "ab\u212a" * 8, "0123456789abcdef012", "a.b." * 6 + "\nc", "aaaa bbbb " * 9, "a\n" * 30, None, "q" * 21]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    got = sorted((r.i, r.rule_ord, r.line_start, r.match_ord) for r in D.scan_lines_with_entropy(df, rules).where("engine = 'regex'").collect())
    want = sorted(
        (i, o, n, k) for i, t in enumerate(texts) if t for n, x in enumerate(t.split("\n"), 1) for o, r in enumerate(rules) for k, _ in enumerate(re.finditer(r.pattern, x, re.I))
    )
    assert got == want and {i for i, *_ in got} == {0, 1, 2, 3, 4}
