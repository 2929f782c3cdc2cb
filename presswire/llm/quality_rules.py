"""Quality rules over whole texts, by DataFrame functions alone, ordered as a short-circuit cascade.

A rule is a condition that rejects a text. On a bounded sample, drawn by a hash of the texts, each rule is run by itself on what the
cascade will have at hand, which gives its seconds per row and the share that it rejects; rules are then ordered by rejections per second,
and one CASE expression tries them in that order, so that a text is done with at the first rule that rejects it. The order changes the
time, never the verdict.

A null text is an empty one. Words are ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswire.llm.scratch import written

SPACES = r"[\x20\x09-\x0D]+"
#: The characters that count as symbols; a fixed value.
SYMBOLS = "[^#*$%&|<>]+"
#: Rows of the sample on which costs and selectivities are estimated, about.
SAMPLE_ROWS = 400


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), SYMBOLS, "")).cast("long")


def lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_repeat_words(w: Column, size: int = 5) -> Column:
    """Words inside windows of ``size`` words that are found twice or more among ``w``; windows are told apart by 64-bit hashes."""

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, F.lit(1), F.size(h) - (size - 1)), lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, size))))

    def covered(h: Column) -> Column:
        at = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        pairs = let(at, lambda s: F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda p, q: F.when(p["h"] == q["h"], F.array(p["i"], q["i"]))))
        places = F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda a, p: F.struct((p + size).alias("end"), (a["n"] + F.least(F.lit(size), p + size - a["end"])).alias("n")), lambda a: a["n"])

    def repeated(h: Column) -> Column:
        return let(windows(h), lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), 0).otherwise(covered(x)))

    return F.when(F.size(w) <= size, 0).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), repeated)).cast("long")


def facts(text: Column, w: Column) -> dict[str, Column]:
    """What rules ask of a text and its words, each as an expression that is only run where a rule needs it."""
    kept = lines(text)
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": n_symbols(text),
        "n_lines": F.size(kept).cast("long"),
        "n_dup_lines": let(kept, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": n_repeat_words(w),
        "n_upper": F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[A-Z]")),
        "n_digits": F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[0-9]")),
        "n_bullets": F.size(F.filter(kept, lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))),
    }


#: Facts that only rules ask for, taken of a text where the cascade comes to such a rule.
ON_DEMAND = ("n_upper", "n_digits", "n_bullets")


@dataclass(frozen=True)
class Rule:
    """``rejects`` makes of facts the condition under which a text goes."""

    name: str
    rejects: Callable[[dict[str, Column]], Column]


#: Under ten words, or over a fifth of the words in windows that repeat.
BASE_RULES = (
    Rule("few_words", lambda f: f["n_words"] < 10),
    Rule("repeated_windows", lambda f: 100 * f["n_repeat_words"] > 20 * f["n_words"]),
)
#: Rules of the method itself. Limits are loose, so that prose, lists and short code pass.
METHOD_RULES = (
    Rule("symbols", lambda f: 100 * f["n_symbols"] > 30 * f["n_words"]),
    Rule("shouting", lambda f: 100 * f["n_upper"] > 50 * f["word_chars"]),
    Rule("repeated_lines", lambda f: (f["n_lines"] >= 4) & (100 * f["n_dup_lines"] > 50 * f["n_lines"])),
    Rule("numbers", lambda f: 100 * f["n_digits"] > 60 * f["word_chars"]),
    Rule("bullets", lambda f: (f["n_lines"] >= 4) & (100 * f["n_bullets"] > 90 * f["n_lines"])),
    Rule("word_length", lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 25 * f["n_words"])),
)


def with_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, text, w): each row of ``docs`` as a struct, so that no name can clash, and its words, cut once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.struct("*").alias("row"), text.alias("text"), F.explode(F.array(words(text))).alias("w"))


def rejected_by(found: dict[str, Column], rules: list[Rule] | tuple[Rule, ...]) -> Column:
    """The name of the first of ``rules``, in their order, that rejects the text; else null."""
    out = F.when(F.lit(False), "")
    for rule in rules:
        out = out.when(rule.rejects(found), rule.name)
    return out


def sampled(docs: DataFrame, text_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text): about ``rows`` texts, those of the smallest hashes, from all over the table, written to the shared folder; equal texts go together."""
    below = min(2**63 - 1, rows * 2**63 // max(docs.count(), 1))
    return written(docs.select(F.col(f"`{text_col}`").alias("text")).where(F.shiftrightunsigned(F.xxhash64("text"), 1) <= below), "sample")


def ordered(sample: DataFrame, found: dict[str, Column], rules: Iterable[Rule]) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a row, share rejected) with the most rejections per second first; an empty sample keeps the given order.

    ``found``: the facts as the cascade has them, over the columns of ``sample``. A rule's seconds are those of a run over the sample
    without those of a run that only reads it, each the faster of two.
    """
    sample, rules = sample.coalesce(1), list(rules)
    total = sample.count()
    if not total:
        return [(rule, 0.0, 0.0) for rule in rules]

    def run(rejects: Column) -> tuple[float, int]:
        times = []
        for _ in range(2):
            began = time.perf_counter()
            n = sample.agg(F.count_if(rejects)).first()[0]
            times.append(time.perf_counter() - began)
        return min(times), n

    least = run(F.lit(False))[0]
    measured = [(rule, *run(rule.rejects(found))) for rule in rules]
    return sorted(((rule, max(s - least, 1e-4) / total, n / total) for rule, s, n in measured), key=lambda x: -x[2] / x[1])


def signals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, text, f): each row of ``docs`` as a struct and all its facts as the struct ``f``."""
    cut = with_words(docs, text_col)
    found = facts(F.col("text"), F.col("w"))
    for k in ON_DEMAND:
        del found[k]
    return cut.select("row", "text", F.explode(F.array(F.struct(*(c.alias(k) for k, c in found.items())))).alias("f"))


def judged(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = METHOD_RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(row, f, base_failed, rejected_by): all facts of each text, whether a base rule rejects it, and else which of ``rules`` does.

    Facts are asked for, so they are taken of every text; what they don't tell is looked at rule by rule, in the cascade's order. A null
    text is an empty one and fails; repeated rows are each judged; an empty table stays empty.
    """
    full, sample = signals(docs, text_col), written(signals(sampled(docs, text_col, sample_rows)), "sample")
    known = facts(F.col("text"), F.lit(None)) | {k: F.col(f"f.{k}") for k in full.schema["f"].dataType.names}
    order = [rule for rule, _, _ in ordered(sample, known, rules)]
    failed = BASE_RULES[0].rejects(known) | BASE_RULES[1].rejects(known)
    return full.select("row", "f", failed.alias("base_failed"), F.when(~failed, rejected_by(known, order)).alias("rejected_by"))


def passing(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = BASE_RULES + METHOD_RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Those of ``docs`` that no rule rejects; null and empty texts go where a rule asks for words. Repeated rows each stay or go."""
    found = facts(F.col("text"), F.col("w"))
    order = [rule for rule, _, _ in ordered(with_words(sampled(docs, text_col, sample_rows)), found, rules)]
    return with_words(docs, text_col).where(rejected_by(found, order).isNull()).select("row.*")
