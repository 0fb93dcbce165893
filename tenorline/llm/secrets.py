"""Secret scan over a trigram inverted index, in DataFrame operations only.

Each rule's regex is turned into a Boolean trigram query: an OR of clauses, each an AND of trigrams that every match of
one alternative must hold. ``trigram_index`` posts (trigram, document) for the trigrams any query asks for;
``candidates`` intersects the postings of a clause; ``verify`` runs the regex on the candidates alone. A rule that has
an alternative without any trigram is run on every text.

Defined cases: a null text is empty; an empty text has no spans; equal rows give equal results, one per row; rows with a
null ``doc_id`` are scanned like others; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost, non-overlapping matches; those whose ``group`` has under ``least`` characters are dropped."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0


# The kinds of secrets and their patterns, in the order in which spans are listed.
BASE = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # runs are maximal, so this equals runs of any length of which 16 and more are kept
]
MORE = [
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
]
RULES = BASE + MORE


def trigram_query(pattern: str) -> list[list[str]]:
    """Clauses of lower-case trigrams: a match holds all trigrams of one clause at least. An empty clause holds always."""
    clauses = set()
    for pieces in _alternatives(_parser.parse(pattern)):
        text = [run.lower() for run in "".join("\0" if p is None else p for p in pieces).split("\0")]
        clauses.add(frozenset(run[i:i + 3] for run in text for i in range(len(run) - 2) if run[i:i + 3].isascii()))
    kept = [c for c in clauses if not any(other < c for other in clauses)]
    return sorted(sorted(c) for c in kept)


def _alternatives(parsed) -> list[tuple]:
    """Sequences of literal strings and ``None`` for anything, one per alternative of the parsed pattern."""
    sequences: list[tuple] = [()]
    for op, value in parsed:
        if op is sre.LITERAL:
            options = [(chr(value),)]
        elif op is sre.IN and all(kind is sre.LITERAL for kind, _ in value):
            options = [(chr(code),) for _, code in value]
        elif op is sre.SUBPATTERN:
            options = _alternatives(value[-1])
        elif op is sre.BRANCH:
            options = [o for branch in value[1] for o in _alternatives(branch)]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = value
            once = _alternatives(inner)
            if (low, high) == (0, 1):
                options = [(), *once]
            else:
                options = [o if (low, high) == (1, 1) else (*o, None) for o in once] if low else [(None,)]
                if low > 1 or high != low:
                    options = [(*o, None) for o in options]
        elif op is sre.AT:
            options = [()]
        else:
            options = [(None,)]
        if len(sequences) * len(options) > MAX_ALTERNATIVES:
            options = [(None,)]
        sequences = [s + o for s in sequences for o in options]
    return sequences


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_key, text); the key tells texts under one id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("doc_key"), text.alias("text"))


def trigram_index(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id, doc_key) of the given trigrams."""
    lowered = texts.select("doc_id", "doc_key", F.lower("text").alias("low"))  # once per text: a projection of its own
    found = F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams])
    return lowered.select(F.explode(F.array_compact(found)).alias("trigram"), "doc_id", "doc_key")


def candidates(index: DataFrame, queries: dict[str, list[list[str]]]) -> DataFrame:
    """(doc_id, doc_key, rules): documents in the postings of every trigram of a clause. The clauses come from the rules alone, so their number is fixed."""
    clauses = [(name, f"{name}/{k}", len(clause), t) for name, query in queries.items() for k, clause in enumerate(query) for t in clause]
    wanted = F.create_map(*[x for t in sorted({c[3] for c in clauses}) for x in (F.lit(t), F.array(*[
        F.struct(F.lit(n).alias("rule"), F.lit(c).alias("clause"), F.lit(size).alias("size")) for n, c, size, of in clauses if of == t]))])
    asked = index.select("doc_id", "doc_key", "trigram", F.explode(wanted[F.col("trigram")]).alias("c"))
    held = asked.distinct().groupBy("doc_id", "doc_key", "c").count().where(F.col("count") == F.col("c.size"))
    return held.groupBy("doc_id", "doc_key").agg(F.collect_set("c.rule").alias("rules"))


def spans(texts: DataFrame, rules: list[Rule], only: Column | None = None) -> DataFrame:
    """(doc_id, doc_key, kind, start, stop) of the matches, in code points. ``only``: array of the rule names to run on a row."""
    def found(rule: Rule) -> Column:
        p = F.lit(rule.pattern)
        part = F.regexp_extract_all("text", p, F.lit(rule.group))
        cells = F.arrays_zip(F.split("text", rule.pattern, -1).alias("gap"), F.regexp_extract_all("text", p, F.lit(0)).alias("hit"), part.alias("part"))
        lengths = F.transform(cells, lambda x: F.struct(
            F.lit(rule.name).alias("kind"), F.length(x["gap"]).cast("long").alias("gap"),
            F.coalesce(F.length(x["hit"]), F.lit(0)).cast("long").alias("len"), (F.length(x["part"]) >= rule.least).alias("kept")))
        held = F.lit(True) if only is None else F.array_contains(only, rule.name)
        return F.when(held & F.regexp_like("text", p), lengths)

    per_rule = texts.select("doc_id", "doc_key", F.explode(F.array_compact(F.array(*[found(r) for r in rules]))).alias("cells"))
    rows = per_rule.select("doc_id", "doc_key", F.posexplode("cells").alias("pos", "cell")).select("doc_id", "doc_key", "pos", "cell.*").distinct()  # equal rows give equal cells
    before = Window.partitionBy("doc_id", "doc_key", "kind").orderBy("pos")
    stop = F.sum(F.col("gap") + F.col("len")).over(before)
    return rows.select("doc_id", "doc_key", "kind", (stop - F.col("len")).alias("start"), stop.alias("stop"), "kept").where("kept").drop("kept")


def find_secrets(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, doc_key, kind, start, stop) of every span of every text; equal rows are listed once."""
    queries = {r.name: trigram_query(r.pattern) for r in rules}
    open_rules = [r for r in rules if not all(queries[r.name])]
    indexed = [r for r in rules if all(queries[r.name])]
    texts = keyed(docs).where(F.col("text") != "")
    parts = []
    if indexed:
        asked = {r.name: queries[r.name] for r in indexed}
        index = trigram_index(texts, sorted({t for query in asked.values() for clause in query for t in clause}))
        chosen = candidates(index, asked).withColumnRenamed("doc_id", "cand_id").withColumnRenamed("doc_key", "cand_key")
        read = texts.join(chosen, F.col("doc_id").eqNullSafe(F.col("cand_id")) & (F.col("doc_key") == F.col("cand_key")))
        parts.append(spans(read.select("doc_id", "doc_key", "text", "rules"), indexed, F.col("rules")))
    if open_rules:
        parts.append(spans(texts, open_rules))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def scan_secrets(docs: DataFrame, rules: list[Rule] = RULES, base: list[Rule] = BASE) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts ``n_<kind>`` of the base kinds, base_sha256 and spans (texts ``kind:start:end``)."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    label = F.concat_ws(":", "kind", "start", "stop")
    found = find_secrets(docs, rules).select("doc_id", "doc_key", "kind", F.struct(F.col("start"), order[F.col("kind")].alias("place"), label.alias("span")).alias("s"))

    def joined(kinds: list[Rule]) -> Column:
        listed = F.sort_array(F.collect_list(F.when(F.col("kind").isin([r.name for r in kinds]), F.col("s"))))
        return F.array_join(F.transform(listed, lambda x: x["span"]), ",")

    counts = [F.count(F.when(F.col("kind") == r.name, 1)).alias(f"n_{r.name}") for r in base]
    per_doc = found.groupBy(F.col("doc_id").alias("of_id"), F.col("doc_key").alias("of_key")).agg(
        *counts, joined(base).alias("base_spans"), joined(rules).alias("spans"))
    rows = keyed(docs).select("doc_id", "doc_key")
    both = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("doc_key") == F.col("of_key")), "left")
    return both.select("doc_id", *[F.coalesce(f"n_{r.name}", F.lit(0).cast("long")).alias(f"n_{r.name}") for r in base],
                       F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
