"""Detection: text rows in, one row per match out.

A pack is a list known when the plan is built. A scan has two steps. The first finds which rules may match a text and drops
texts without any; almost all text ends there. A pack of up to ``SMALL_PACK`` rules enters the plan as literal patterns,
tested in generated code and compiled once per task. A larger one is indexed by the literals that its rules need: one pass
over the text finds these, and a broadcast table of the pack leads to the rules. The second step marks the matches of one
rule in one text in a single pass and explodes them. Per-line scans take the same steps on lines: cutting a text into them
costs far less than searching all of it a second time for each rule that matches somewhere.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secret_audit.functions import entropy as E
from secret_audit.functions.literals import literal_index
from secret_audit.functions.mask import evidence_hash, fingerprint, mask_by_kind
from secret_audit.functions.patterns import parse
from secret_audit.functions.regex import FOLDS_TO_ASCII, sql_literal
from secret_audit.rules import CONTENT_PACK, Rule, check_pack

ENTROPY_KIND = "high_entropy_string"
#: Packs up to this size are tested rule by rule; larger ones by the index of their literals.
SMALL_PACK = 64
# Set around matches in a copy of the text; texts that hold it are searched without marks.
_MARK = "\0"

_RULE_FIELDS = {
    "rule": "string", "type": "string", "severity": "string", "confidence": "double", "mask": "string",
    "description": "string", "remediation": "string",
}


def newlines(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))


def split_lines(df: DataFrame, content: str = "content") -> DataFrame:
    """One row per line with 1-based ``line_no``; only the line feed separates lines."""
    keys = [c for c in df.columns if c != content]
    return df.select(*keys, F.posexplode(F.split(content, "\n", -1)).alias("pos", "line")).select(
        *keys, (F.col("pos") + 1).alias("line_no"), "line"
    )


def line_at(content: Column, line_no: Column) -> Column:
    """Text of a 1-based line, empty past the end."""
    return F.coalesce(F.get(F.split(content, "\n", -1), line_no - 1), F.lit(""))


def _folds(text: Column) -> Column:
    """The text holds a letter outside ASCII that folds to an ASCII letter, so lower-case hints may miss it."""
    found = reduce(lambda a, b: a | b, [text.contains(c) for c in FOLDS_TO_ASCII])
    return (F.octet_length(text) != F.length(text)) & found


def _prepared(files: DataFrame, keys: list[str], content: str) -> DataFrame:
    """The keys with the text, its lower-case copy and whether it has letters that fold to ASCII."""
    text = F.col(content)
    return files.where(text.isNotNull()).select(*keys, text.alias("_text"), F.lower(text).alias("_lower"), _folds(text).alias("_folds"))


def _gate(rule: Rule, entropy_length: int | None = None) -> str:
    """Cheap SQL condition that every text with a match passes; with ``entropy_length`` it may use that a text has a token."""
    gate = f"octet_length(_text) >= {rule.min_length}"
    if rule.hints:
        seen = " OR ".join([f"contains(_lower, {sql_literal(h)})" for h in rule.hints] + ["_folds"])
        gate += f" AND ({seen})"
    elif entropy_length is not None:
        (own, n), (token, least) = parse(rule.pattern).run, parse(E.token_pattern(entropy_length), ignore_case=False).run
        if n >= least and own <= token:
            gate += " AND (_token OR _folds)"
    return gate


def _present(rules: tuple[Rule, ...], entropy_length: int | None = None, among: list[int] | None = None) -> Column:
    """Ordinals of the rules that match a text; only functions that compile to code."""
    def matches(r: Rule) -> str:
        test = f"_text RLIKE {sql_literal(r.java_plain)}"
        return test if r.java_plain == r.java else f"({test} OR _folds AND _text RLIKE {sql_literal(r.java)})"

    flags = [f"IF({_gate(rules[i], entropy_length)} AND {matches(rules[i])}, {i}, -1)" for i in (range(len(rules)) if among is None else among)]
    if entropy_length is not None:
        flags.append(f"IF(_token, {len(rules)}, -1)")
    return F.expr(f"array_remove(array({', '.join(flags)}), -1)") if flags else F.array().cast("array<int>")


def _matched(text: DataFrame, keys: list[str], rules: tuple[Rule, ...], entropy_length: int | None = None) -> DataFrame:
    """A row per text and rule that may match it: the keys, _text, _folds and rule_ord."""
    if entropy_length is not None:
        tokens = sql_literal(E.candidate_pattern(entropy_length))
        text = text.withColumn("_token", F.expr(f"octet_length(_text) >= {entropy_length} AND _text RLIKE {tokens}"))
    if len(rules) <= SMALL_PACK:
        return text.select(*keys, "_text", "_folds", F.explode(_present(rules, entropy_length)).alias("rule_ord"))
    pattern, rows, rest = literal_index([r.hints for r in rules])
    index = text.sparkSession.createDataFrame(rows, "_literal string, _ord int, _before array<string>")
    # Letters that fold to ASCII are written as such, so that literals are found in their place.
    plain = F.when(F.col("_folds"), F.lower(F.translate("_text", "".join(FOLDS_TO_ASCII), "skii"))).otherwise(F.col("_lower"))
    found = F.array_distinct(F.regexp_extract_all(plain, F.lit(pattern), F.lit(1))) if pattern else F.array().cast("array<string>")
    steps = [rest[i : i + SMALL_PACK] for i in range(0, len(rest), SMALL_PACK)] or [[]]
    own = [_present(rules, entropy_length if i == 0 else None, step) for i, step in enumerate(steps)]
    wanted = F.concat(
        F.transform("_found", lambda x: F.struct(x.alias("literal"), F.lit(None).cast("int").alias("ord"))),
        *[F.transform(o, lambda i: F.struct(F.lit(None).cast("string").alias("literal"), i.alias("ord"))) for o in own],
    )
    rows = text.withColumn("_found", found).select(*keys, "_text", "_folds", "_found", F.explode(wanted).alias("_want"))
    joined = rows.join(F.broadcast(index), F.col("_want.literal") == F.col("_literal"), "left")  # the pack's own literals
    first = F.coalesce(~F.arrays_overlap("_found", "_before"), F.lit(True))
    led = joined.withColumn("rule_ord", F.coalesce("_want.ord", "_ord")).where(F.col("rule_ord").isNotNull() & first)
    return led.select(*keys, "_text", "_folds", "rule_ord")


def _constant(values: list, schema: str) -> Column:
    """A constant array of any length."""
    return F.from_json(F.lit(json.dumps(values)), schema)


def _pattern(rules: tuple[Rule, ...], entropy_length: int | None = None) -> Column:
    """Pattern of the rule named by ``rule_ord``. It is compiled again only when a row has another rule."""
    tokens = [E.candidate_pattern(entropy_length)] if entropy_length is not None else []
    plain, full = ([r.java_plain for r in rules] + tokens, [r.java for r in rules] + tokens)
    at = F.expr(f"rule_ord + IF(_folds, {len(plain)}, 0)")
    if len(rules) > SMALL_PACK:
        return F.get(_constant(plain + full, "array<string>"), at)
    return F.get(F.array(*map(F.lit, plain + full)), at)


def _marked(pattern: Column) -> Column:
    """The text with a mark before and after each match; null where the text holds the mark."""
    return F.when(~F.contains("_text", F.lit(_MARK)), F.regexp_replace("_text", pattern, F.lit(f"{_MARK}$0{_MARK}")))


def _between_marks(text: Column) -> Column:
    """(n, secret): what stands between the marks, n being the number of the mark behind it."""
    pieces = F.transform(F.split(text, _MARK, -1), lambda p, i: F.struct(i.alias("n"), p.alias("secret")))
    return F.filter(pieces, lambda x: x["n"] % 2 == 1)


def _start_lines(content: Column, pattern: Column) -> Column:
    """Line number of every match, in match order.

    One byte is put in front of each match, so a line grows by the number of matches that start in it. The work
    is linear in the text however many matches there are.
    """
    marked = F.split(F.regexp_replace(content, pattern, F.lit(".$0")), "\n", -1)
    grown = F.zip_with(marked, F.split(content, "\n", -1), lambda a, b: F.octet_length(a) - F.octet_length(b))
    return F.flatten(F.transform(grown, lambda n, i: F.array_repeat(i + 1, n)))


def _found_in_text(pattern: Column) -> tuple[Column, Column]:
    """Lines of the marks in ``_marked`` (kept as ``_places``), and secret, line_start and line_end of the matches in ``_text``, from its copy ``_marked`` where there is one."""
    def marks(line: Column) -> Column:
        return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(_MARK), F.lit("")))

    lines = F.flatten(F.transform(F.split("_marked", "\n", -1), lambda x, i: F.array_repeat(i + 1, marks(x))))
    quick = F.transform(_between_marks(F.col("_marked")), lambda x: F.struct(
        x["secret"].alias("secret"), F.get(F.col("_places"), x["n"] - 1).alias("line_start"), F.get(F.col("_places"), x["n"]).alias("line_end"),
    ))
    plain = F.zip_with(
        F.regexp_extract_all("_text", pattern, F.lit(0)), _start_lines(F.col("_text"), pattern),
        lambda s, n: F.struct(s.alias("secret"), n.alias("line_start"), (n + newlines(s)).alias("line_end")),
    )
    return lines, F.when(F.col("_marked").isNotNull(), quick).otherwise(plain)


def snippet(lines: Column, start: Column, end: Column, around: int = 3) -> Column:
    """Numbered lines around a match; the lines of the match carry an arrow."""
    first = F.greatest(F.lit(0), start - 1 - around)
    count = F.least(F.size(lines), end + around) - first

    def numbered(line: Column, i: Column) -> Column:
        n = first + i + 1
        arrow = F.when((n >= start) & (n <= end), ">>> ").otherwise("    ")
        return F.concat(arrow, F.lpad(n.cast("string"), F.greatest(F.lit(4), F.length(n.cast("string"))), F.lit(" ")),
                        F.lit(": "), line)

    return F.array_join(F.transform(F.slice(lines, first + 1, count), numbered), "\n")


def _rule_attributes(rules: tuple[Rule, ...], rule_ord: Column) -> Column:
    """The rule's fields from a constant array, so no join is needed."""
    fields = ("name", "kind", "severity", "confidence", "mask", "description", "remediation")
    table = [dict(zip(_RULE_FIELDS, (getattr(r, f) for f in fields))) for r in rules]
    schema = "array<struct<" + ",".join(f"{k}:{v}" for k, v in _RULE_FIELDS.items()) + ">>"
    return F.get(_constant(table, schema), rule_ord)


def scan_content(
    files: DataFrame, rules=CONTENT_PACK, content: str = "content", context: bool = False
) -> DataFrame:
    """Whole-text scan. Matches may span lines.

    Adds rule_ord, match_ord, secret, line_start, line_end and the rule's fields to the key columns, and ``context`` on
    request; the text itself is dropped.
    """
    rules = check_pack(rules)
    keys = [c for c in files.columns if c != content]
    pattern = _pattern(rules)
    matched = _matched(_prepared(files, keys, content), keys, rules).withColumn("_marked", _marked(pattern))
    places, found = _found_in_text(pattern)
    # Columns of their own, so that the text is marked and split once and not once per match.
    matched = matched.withColumn("_places", places)
    if context:
        matched = matched.withColumn("_lines", F.split("_text", "\n", -1))
    fields = ["secret", "line_start", "line_end"]
    if context:
        fields.append("context")
        found = F.transform(found, lambda m: F.struct(
            m["secret"].alias("secret"), m["line_start"].alias("line_start"), m["line_end"].alias("line_end"),
            snippet(F.col("_lines"), m["line_start"], m["line_end"]).alias("context"),
        ))
    out = matched.select(*keys, "rule_ord", F.posexplode(found).alias("match_ord", "_hit"))
    return _with_rule(out.select(*keys, "rule_ord", "match_ord", *[F.col(f"_hit.{f}").alias(f) for f in fields]), rules)


def _with_rule(hits: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    keep = hits.columns
    return hits.withColumn("_rule", _rule_attributes(rules, F.col("rule_ord"))).select(*keep, "_rule.*")


def scan_text(df: DataFrame, text: str, rules=CONTENT_PACK) -> DataFrame:
    """Scan of any text column as one unnamed input: line 1 throughout, path ``<input>``."""
    found = scan_content(df.withColumn("file_path", F.lit("<input>")), rules, content=text)
    return found.withColumn("line_start", F.lit(1)).withColumn("line_end", F.lit(1))


def _hit_lines(files: DataFrame, content: str, rules: tuple[Rule, ...], entropy=None) -> DataFrame:
    """Matches of rules and, with ``entropy`` = (threshold, minimum length), of high-entropy tokens, line by line.

    The entropy test is made inside the array, so it runs once per token and drops tokens before they become rows.
    """
    keys = [*[c for c in files.columns if c != content], "line_no"]
    threshold, token_length = entropy or (None, None)
    matched = _matched(_prepared(split_lines(files, content), keys, "line"), keys, rules, token_length)
    secrets = F.regexp_extract_all("_text", _pattern(rules, token_length), F.lit(0))
    hits = F.transform(secrets, lambda s, k: F.struct(
        k.alias("match_ord"), s.alias("secret"),
        (F.when(_is_entropy(rules), E.shannon_entropy(s)) if entropy else F.lit(None).cast("double")).alias("entropy"),
    ))
    if entropy:
        hits = F.filter(hits, lambda t: t["entropy"].isNull() | E.passes(t["entropy"], threshold))
    return matched.select(*keys, "_text", "rule_ord", F.inline(hits)).select(
        *keys[:-1], F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), F.col("_text").alias("line"),
        "rule_ord", "match_ord", "secret", "entropy",
    )


def _is_entropy(rules: tuple[Rule, ...]) -> Column:
    """Entropy tokens come after the rules of the pack."""
    return F.col("rule_ord") == len(rules)


def scan_lines(files: DataFrame, rules, content: str = "content") -> DataFrame:
    """Per-line scan: every rule on every line, all matches. Keeps the line of the match as ``line``."""
    rules = check_pack(rules)
    return _with_rule(_hit_lines(files, content, rules).drop("entropy"), rules)


def entropy_candidates(
    files: DataFrame, threshold: float = E.ENTROPY_THRESHOLD, min_length: int = E.MIN_LENGTH, content: str = "content"
) -> DataFrame:
    """Tokens of at least ``min_length`` characters whose entropy reaches the threshold, with their line."""
    return _hit_lines(files, content, (), (threshold, min_length)).drop("rule_ord")


def mask_hits(hits: DataFrame) -> DataFrame:
    """Adds fingerprint and masked_preview; callers drop the secret next."""
    secret = F.col("secret")
    return hits.withColumn("fingerprint", fingerprint(secret)).withColumn(
        "masked_preview", mask_by_kind(secret, F.col("mask"))
    )


def scan_lines_with_entropy(
    files: DataFrame,
    rules,
    threshold: float = E.ENTROPY_THRESHOLD,
    min_length: int = E.MIN_LENGTH,
    confidence: str = "scaled",
    drop_rule_shapes: bool = False,
    content: str = "content",
) -> DataFrame:
    """Rules and entropy in one pass over the lines, secrets already masked and fingerprinted.

    ``confidence`` is ``scaled`` (entropy / 6, at most 0.9) or ``raw`` (entropy plus boosts, which later clamps to 1).
    ``drop_rule_shapes`` drops entropy tokens that begin like a known rule.
    """
    rules = check_pack(rules)
    hits = _hit_lines(files, content, rules, (threshold, min_length))
    is_entropy = _is_entropy(rules)
    secret = F.col("secret")
    keep = ~E.is_false_positive(secret)
    if drop_rule_shapes:
        keep = keep & ~E.starts_like_rule(secret)
    if confidence == "scaled":
        value = E.entropy_confidence(F.col("entropy"))
        keep = keep & (value >= E.MIN_CONFIDENCE)
    elif confidence == "raw":
        value = E.likely_secret_score(secret, F.col("entropy"))
        keep = keep & E.passes(value, threshold)
    else:
        raise ValueError(f"unknown confidence: {confidence!r}")
    hits = hits.where(~is_entropy | keep)
    cols = [c for c in hits.columns if c != "entropy"]
    rule = _rule_attributes(rules, F.col("rule_ord"))
    out = hits.select(
        *cols,
        F.when(is_entropy, "entropy").otherwise("regex").alias("engine"),
        F.coalesce(rule["type"], F.lit(ENTROPY_KIND)).alias("type"),
        F.when(is_entropy, value).otherwise(rule["confidence"]).alias("confidence"),
        F.coalesce(rule["mask"], F.lit("generic")).alias("mask"),
    )
    return mask_hits(out).drop("secret", "mask")


def findings_from_content(files: DataFrame, rules=CONTENT_PACK, context: bool = False) -> DataFrame:
    """Whole-text matches as findings without the secret: hash, mask and fingerprint only.

    ``context`` adds the numbered snippet with secrets starred out.
    """
    hits = mask_hits(scan_content(files, rules, context=context))
    out = hits.withColumn(
        "evidence_hash", evidence_hash(F.col("secret"), F.col("line_start"), F.col("line_end"))
    ).withColumn("engine", F.lit("regex"))
    if context:
        out = out.withColumn("context", hide_secrets(F.col("context"), F.col("secret"), tuple(rules)))
    return out.drop("secret", "mask")


def hide_secrets(context: Column, secret: Column, rules: tuple[Rule, ...]) -> Column:
    """Star out every rule match inside a snippet and each line of the finding's own secret.

    A neighbouring secret that spans lines and is cut by the edge of the snippet can stay visible in part.
    """
    hidden = F.regexp_replace(context, "|".join(r.java for r in rules), "***")
    pieces = F.filter(F.split(secret, "\n", -1), lambda piece: F.length(piece) > 0)
    return F.aggregate(pieces, hidden, lambda acc, piece: F.replace(acc, piece, F.lit("***")))


def rule_summary(df: DataFrame) -> DataFrame:
    """Per pack: number of rules and their name, type, severity and confidence in rule order."""
    entry = F.struct("ord", "name", F.col("kind").alias("type"), "severity", "confidence")
    return df.groupBy("pack").agg(
        F.count("*").alias("total_patterns"), F.sort_array(F.collect_list(entry)).alias("patterns")
    )


def rule_hit_counts(files: DataFrame, rules=CONTENT_PACK, content: str = "content") -> DataFrame:
    """Every rule against every text: per rule the number of texts with a match and of matches, zeros kept."""
    rules = check_pack(rules)
    if len(rules) > SMALL_PACK:
        found = _matched(_prepared(files, [], content), [], rules).select("rule_ord", F.regexp_count("_text", _pattern(rules)).alias("n"))
        counts = found.groupBy("rule_ord").agg(F.count_if(F.col("n") > 0).alias("texts"), F.sum("n").alias("matches"))
        names = files.sparkSession.createDataFrame([(i, r.name) for i, r in enumerate(rules)], "rule_ord int, rule string")
        zero = F.lit(0).cast("long")
        return names.join(counts, "rule_ord", "left").select("rule", *[F.coalesce(c, zero).alias(c) for c in ("texts", "matches")])
    lowered = _prepared(files, [], content)
    counts = lowered.select(*[
        F.expr(
            f"IF({_gate(r)}, regexp_count(_text, IF(_folds, {sql_literal(r.java)}, {sql_literal(r.java_plain)})), 0)"
        ).alias(f"n{i}")
        for i, r in enumerate(rules)
    ])
    totals = counts.agg(*[
        F.struct(
            F.lit(r.name).alias("rule"),
            F.count_if(F.col(f"n{i}") > 0).alias("texts"),
            F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias("matches"),
        ).alias(f"r{i}")
        for i, r in enumerate(rules)
    ])
    return totals.select(F.inline(F.array(*[F.col(f"r{i}") for i in range(len(rules))])))
