"""Secret scans over a trigram inverted index, in DataFrame operations only.

1. Each rule's regular expression is turned into a Boolean trigram query: an OR of branches, each an AND of
   lower-case trigrams that every match must contain. A rule without mandatory trigrams scans every text.
2. The index holds, for each trigram that some query names, the keys of the distinct texts that contain it,
   in blocks of texts so that no posting list outgrows a task.
3. Within each block the posting lists of a branch are intersected. The surviving (text key, rule) pairs are the candidates.
4. Candidates are verified with the regular expression on the whole text; spans are code points.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, free, table

Branches = frozenset[frozenset[str]]


@dataclass(frozen=True)
class Rule:
    """``need``: the least length of group ``group`` of a match; shorter matches are dropped without a retry."""

    kind: str
    pattern: str
    group: int = 0
    need: int = 1


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("google", r"\bAIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"\b[sr]k_live_[0-9A-Za-z]{16,}"),
)
BASE = ("assign", "access", "hex")
BLOCK_TEXTS = 1024
#: Candidates (key and rule mask, some 50 bytes each in a hash table) up to this number are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 300_000


# -- Boolean trigram queries ------------------------------------------------------------------------------

TRUE: Branches = frozenset([frozenset()])


def _and(a: Branches, b: Branches) -> Branches:
    out = {x | y for x, y in product(a, b)}
    return frozenset(x for x in out if not any(y < x for y in out)) if len(out) <= 64 else TRUE


def _of(exact: set[str]) -> Branches:
    out = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in exact}
    return frozenset(x for x in out if not any(y < x for y in out))


def _walk(items, exact: set[str], query: Branches) -> tuple[set[str], Branches]:
    """exact: all strings that what was read since the last flush can be, in lower case."""
    for op, arg in items:
        op, options, body = str(op), None, None
        if op == "LITERAL":
            options = {chr(arg).lower()}
        elif op == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 8:
            options = {chr(c).lower() for _, c in arg}
        elif op == "SUBPATTERN":
            body = [arg[-1]]
        elif op == "BRANCH":
            body = arg[1]
        elif op == "MAX_REPEAT":
            low, high, inner = arg
            sub, subquery = _walk(inner, {""}, TRUE)
            if subquery == TRUE and high <= 1:
                options = sub | ({""} if low == 0 else set())
            elif subquery == TRUE and low == high and low <= 3:
                options = {"".join(x) for x in product(sub, repeat=int(low))}
            elif low >= 1:
                query = _and(query, subquery)
        elif op == "AT":
            continue
        if body is not None:
            subs = [_walk(b, {""}, TRUE) for b in body]
            if all(q == TRUE for _, q in subs) and None not in [s for s, _ in subs] and all("\0" not in "".join(s) for s, _ in subs):
                options = set().union(*(s for s, _ in subs))
            else:
                query = _and(query, frozenset().union(*(_and(q, _of(s)) for s, q in subs)))
        if options is not None and len(exact) * len(options) <= 64 and "\0" not in "".join(options):
            exact = {a + b for a, b in product(exact, options)}
        else:  # anything may stand here: what was read so far is final
            if options is not None:
                query = _and(query, _of(options))
            query, exact = _and(query, _of({x for e in exact for x in [e.rpartition("\0")[2]]})), {"\0"}
            continue
    return exact, query


def trigram_query(pattern: str) -> Branches:
    """The branches of a pattern; ``TRUE`` (one empty branch) if some match has no mandatory trigram."""
    from re import _parser

    exact, query = _walk(_parser.parse(pattern), {""}, TRUE)
    query = _and(query, _of({e.rpartition("\0")[2] for e in exact}))
    return TRUE if frozenset() in query else query


# -- index, intersection, verification ----------------------------------------------------------------------


def build_index(texts: DataFrame, text: str, terms: list[str], n_blocks: int) -> DataFrame:
    """(block, term, keys): which distinct texts contain which of the terms; keys are text hashes."""
    low = texts.select(F.xxhash64(text).alias("key"), F.lower(text).alias("low"))
    # No filter on what was found: it would be pushed below and look for every term a second time.
    posts = low.select("key", F.explode(F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in terms]))).alias("term")).distinct()
    block = F.pmod(F.xxhash64("key"), F.lit(n_blocks)).alias("block")
    return posts.groupBy("term", block).agg(F.collect_list("key").alias("keys"))


def candidates(index: DataFrame, queries: dict[int, Branches]) -> DataFrame:
    """(key, rules): the texts that satisfy a rule's query, with the numbers of all such rules."""
    spark = index.sparkSession
    rows = [(b, rule, len(branch), term) for b, (rule, branch) in enumerate((r, x) for r, q in sorted(queries.items()) for x in sorted(map(sorted, q))) for term in branch]
    named = spark.createDataFrame(rows, "branch int, rule int, need int, term string")  # as long as the rules
    lists = index.join(F.broadcast(named), "term").groupBy("block", "branch", "rule", "need").agg(F.collect_list("keys").alias("lists"))
    both = lists.where("size(lists) = need").select("rule", F.explode(F.expr("aggregate(slice(lists, 2, need), lists[0], (a, x) -> array_intersect(a, x))")).alias("key"))
    return both.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def _spans(text: str, rule: Rule, order: int) -> Column:
    """Array of (s, e, k): leftmost non-overlapping matches of the rule that are long enough."""
    rx = rule.pattern.replace("\\", "\\\\").replace("'", "\\'")
    found = f"regexp_extract_all({text}, '{rx}', 0)"
    sized = found if rule.group == 0 else f"regexp_extract_all({text}, '{rx}', {rule.group})"
    return F.expr(
        f"""aggregate(
          arrays_zip({found}, {sized}, slice(split({text}, '{rx}', -1), 2, 2000000000)),
          named_struct('pos', length(split({text}, '{rx}', 2)[0]), 'out', CAST(array() AS ARRAY<STRUCT<s: INT, e: INT, k: INT>>)),
          (acc, x) -> named_struct(
            'pos', acc.pos + length(x.`0`) + length(x.`2`),
            'out', IF(length(x.`1`) >= {rule.need}, concat(acc.out, array(named_struct('s', acc.pos, 'e', acc.pos + length(x.`0`), 'k', {order}))), acc.out)),
          acc -> acc.out)"""
    )


def find_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, out: str = "secret_spans") -> DataFrame:
    """``docs`` with ``out``: all matches as (s, e, k), by start, then by the rule's place k in ``rules``, of which there may be any number.

    A null text counts as empty; however long texts are they are searched whole. Rows are independent: repeated rows and null ids give a
    row each, and an empty table gives an empty table. A column of ``docs`` named ``out`` is replaced, all others pass through.
    """
    t, found_rules, spans_, key, key2 = free(docs, "t", "rules", "found", "key", "key2")
    base = docs.drop(out).withColumn(t, F.coalesce(F.col(text).cast("string"), F.lit("")))
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) != TRUE}
    terms = sorted({x for q in queries.values() for b in q for x in b})
    if queries:
        n_blocks = docs.count() // BLOCK_TEXTS + 1
        found = cut(candidates(build_index(base, t, terms, n_blocks), queries), "candidates")
        small = found.count() <= BROADCAST_ROWS
        found = found.select(F.col("key").alias(key2), F.col("rules").alias(found_rules))
        base = base.withColumn(key, F.xxhash64(t)).join(F.broadcast(found) if small else found, F.col(key) == F.col(key2), "left")
    none = F.expr("CAST(array() AS ARRAY<STRUCT<s: INT, e: INT, k: INT>>)")
    per_rule = []
    for i, r in enumerate(rules):
        spans = F.when(F.col(t).rlike(r.pattern), _spans(t, r, i)).otherwise(none)
        per_rule.append(F.when(F.array_contains(found_rules, i), spans).otherwise(none) if i in queries else spans)
    base = base.withColumn(spans_, F.concat(*per_rule) if per_rule else none)
    order = f"array_sort({spans_}, (x, y) -> CASE WHEN x.s < y.s THEN -1 WHEN x.s > y.s THEN 1 WHEN x.k < y.k THEN -1 WHEN x.k > y.k THEN 1 ELSE 0 END)"
    return base.withColumn(out, F.when(F.size(spans_) > 1, F.expr(order)).otherwise(F.col(spans_))).drop(t, found_rules, spans_, key, key2)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; overlapping spans become one mark. All other columns stay as they are."""
    (spans,) = free(docs, "spans")
    found = find_secrets(docs, text, rules, spans)
    new = F.expr(
        f"""aggregate({spans}, named_struct('at', 0, 'out', ''),
          (acc, x) -> named_struct(
            'at', greatest(acc.at, x.e),
            'out', IF(x.s < acc.at, acc.out, concat(acc.out, substring(`{text}`, acc.at + 1, x.s - acc.at), '{mark}'))),
          acc -> concat(acc.out, substring(`{text}`, acc.at + 1, length(`{text}`))))"""
    )
    return found.withColumn(text, F.when(F.size(spans) > 0, new).otherwise(F.col(text))).drop(spans)


def _joined(spans: str, rules: tuple[Rule, ...]) -> Column:
    names = ", ".join(f"'{r.kind}'" for r in rules)
    return F.expr(f"array_join(transform({spans}, x -> concat(element_at(array({names}), x.k + 1), ':', x.s, ':', x.e)), ',')")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = [F.expr(f"CAST(size(filter(secret_spans, x -> x.k = {i})) AS LONG)").alias(f"n_{k}") for i, k in enumerate(BASE)]
    out = out.select("doc_id", *n, F.expr(f"filter(secret_spans, x -> x.k < {len(BASE)})").alias("__base"), "secret_spans")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined("__base", RULES).cast("binary"), 256).alias("base_sha256"), _joined("secret_spans", RULES).alias("spans"))


def _duck_rule(i: int, r: Rule) -> str:
    rx = r.pattern.replace("'", "''")
    return f"""list_filter(list_transform(range(1, len(m{i}) + 1), lambda j: {{
        's': (list_sum(list_transform(p{i}[1:j], lambda z: length(z))) + coalesce(list_sum(list_transform(m{i}[1:j-1], lambda z: length(z))), 0))::BIGINT,
        'n': length(m{i}[j])::BIGINT, 'k': {i}, 'ok': length(regexp_extract_all(t, '{rx}', {r.group})[j]) >= {r.need}}}), lambda x: x.ok)"""


def _duck_sql(rules: tuple[Rule, ...] = RULES) -> str:
    parts = ", ".join(f"regexp_extract_all(t, '{(rx := r.pattern.replace(chr(39), chr(39) * 2))}') AS m{i}, string_split_regex(t, '{rx}') AS p{i}" for i, r in enumerate(rules))
    kinds = ", ".join(f"'{r.kind}'" for r in rules)
    found = ", ".join(_duck_rule(i, r) for i, r in enumerate(rules))
    show = f"lambda x: [{kinds}][x.k + 1] || ':' || x.s || ':' || (x.s + x.n)"
    return f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, t, {parts} FROM a),
c AS (SELECT doc_id, list_sort(list_transform(flatten([{found}]), lambda x: {{'s': x.s, 'k': x.k, 'n': x.n}})) AS spans FROM b)
SELECT doc_id, len(list_filter(spans, lambda x: x.k = 0))::BIGINT AS n_assign, len(list_filter(spans, lambda x: x.k = 1))::BIGINT AS n_access,
  len(list_filter(spans, lambda x: x.k = 2))::BIGINT AS n_hex,
  sha256(coalesce(array_to_string(list_transform(list_filter(spans, lambda x: x.k < {len(BASE)}), {show}), ','), '')) AS base_sha256,
  coalesce(array_to_string(list_transform(spans, {show}), ','), '') AS spans
FROM c"""


SQL = _duck_sql()
