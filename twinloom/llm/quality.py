"""Quality rules: a table of thresholds compiled into one projection.

Each text is measured once (words, symbols, stop words, lines, repeated passages) with built-in functions; every rule
compares one measure with a share of another in whole numbers, so no rounding decides a verdict. The plan has no
shuffle and no Python: a document never leaves its task.

NULL and empty texts have no words and fail; a text of one very long word, rows that repeat and columns with the names
of measures are all fine (``judge`` reads the id and the text, and hands the id on under its own name).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from twinloom.llm.common import whole, words

WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """Reject when ``times * measure`` lies ``side`` (``<`` or ``>``) of ``bound * unit``; only texts of ``at_least``
    words are asked. ``unit`` is a measure, or None for the plain number."""

    name: str
    measure: str
    side: str
    bound: int
    unit: str | None = None
    times: int = 1
    at_least: int = 0


#: The rules that decide ``base_failed``.
BASE = (
    Rule("too few words", "n_words", "<", 20),
    Rule("repeated passages", "n_repeat_words", ">", 30, "n_words", times=100),
)

#: The method's own rules.
RULES = (
    Rule("short words", "word_chars", "<", 2, "n_words"),
    Rule("long words", "word_chars", ">", 20, "n_words"),
    Rule("symbols", "n_symbols", ">", 10, "n_words", times=100),
    Rule("repeated lines", "n_dup_lines", ">", 60, "n_lines", times=100),
    Rule("few stop words", "n_stop", "<", 1, "n_words", times=100, at_least=100),
)

#: Frequent words of the languages the rules know; a list for other languages is an argument of ``judge``.
STOP_WORDS = (
    "the of and to in a is that for it with as was on be by at this are or from not have an "
    "de la le les et des un une du en que qui dans pour par sur au est ne pas il "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch es "
    "el los las y del se por con para su al lo como más o no"
).split()


def compiled(rule: Rule) -> Column:
    """True where the rule rejects."""
    left = F.lit(rule.times) * F.col(rule.measure)
    right = F.lit(rule.bound) * (F.col(rule.unit) if rule.unit else F.lit(1))
    verdict = left < right if rule.side == "<" else left > right
    return verdict & (F.col("n_words") >= rule.at_least) if rule.at_least else verdict


def measured(docs: DataFrame, keys: list[str], text: str = "text", stop_words: list[str] | None = None) -> DataFrame:
    """``keys`` and one column per measure."""
    stop = sorted({x for w in (stop_words or STOP_WORDS) for x in (w, w.capitalize())})
    body = F.coalesce(F.col(text), F.lit(""))
    held = docs.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        words(F.col(text)).alias("_words"),
        F.length(F.regexp_replace(body, r"[\x20\x09-\x0D]+", "")).alias("word_chars"),
        (F.length(body) - F.length(F.regexp_replace(body, r"[#*$%&|<>]", ""))).alias("n_symbols"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    n = F.size("_words")
    window = lambda i: F.slice("_words", i, WINDOW)
    held = held.select(
        "*",
        n.alias("n_words"),
        F.size(F.filter("_words", lambda w: w.isin(stop))).alias("n_stop"),
        F.size("_lines").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.when(n >= WINDOW, F.transform("_words", lambda w: F.xxhash64(w))).alias("_h"),
    )
    for step in (1, 2, 4):  # hashes of two, four and eight words
        held = held.withColumn("_h", doubled("_h", step))
    held = held.withColumn("_h", F.slice("_h", F.lit(1), F.col("n_words") - (WINDOW - 1)))
    # windows found more than once: equal hashes are brought side by side, and the words themselves compared
    paired = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i"))))
    held = held.withColumn("_p", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), paired))
    twin = lambda p, q: (p["h"] == q["h"]) & (window(p["i"]) == window(q["i"]))
    found = F.filter("_p", lambda p, k: (k > 0) & F.coalesce(twin(p, F.get("_p", k - 1)), F.lit(False)) | F.coalesce(twin(p, F.get("_p", k + 1)), F.lit(False)))
    held = held.withColumn("_at", F.sort_array(F.transform(found, lambda p: p["i"])))
    covered = F.transform("_at", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", k + 1) - i, F.lit(WINDOW))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    held = held.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)))
    # the task number keeps a caller's filter above the measures; moved below them, it would work each out many times
    held = held.withColumn("n_words", n + F.least(F.spark_partition_id(), F.lit(0)))
    names = [*MEASURES, "n_stop", "n_lines"]
    return held.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *[F.col(m).cast("long").alias(m) for m in names])


def doubled(hashes: str, step: int) -> Column:
    """Each hash with the one ``step`` places on."""
    return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + step)))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", stop_words: list[str] | None = None) -> DataFrame:
    """``key``, the measures, ``base_failed``, ``kept`` and ``reasons`` (names of the rules that reject)."""
    held = measured(docs, [key], text, stop_words)
    return held.select(key, *MEASURES, *verdicts(rules))


def verdicts(rules: tuple[Rule, ...]) -> list[Column]:
    base = F.lit(False)
    for r in BASE:
        base = base | compiled(r)
    kept = ~base
    for r in rules:
        kept = kept & ~compiled(r)
    reasons = F.array_compact(F.array(*[F.when(compiled(r), F.lit(r.name)) for r in (*BASE, *rules)]))
    return [base.alias("base_failed"), kept.alias("kept"), reasons.alias("reasons")]


def accepted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", stop_words: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns as they were. The stop words known are those of four
    languages (``STOP_WORDS``); pass a list, or rules without that one, for texts in others."""
    held = measured(docs.select(whole(docs).alias("row"), docs[f"`{text}`"].alias("t")), ["row"], "t", stop_words)
    return held.where(verdicts(rules)[1]).select("row.*")
