"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document: the ledger keeps the measurements and one bit per failed rule. A policy
is a version with a mask of the rules it enforces; applying another version, or asking what a rule does, reads
the ledger only. Everything is a native column expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _filled(parts: Column) -> Column:
    return F.filter(parts, lambda part: part != "")


def _windows(words: Column) -> Column:
    """Three-word windows in order; words hold no blanks, so joining them is unambiguous."""
    return F.transform(
        F.sequence(F.lit(1), F.size(words) - 2),
        lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)),
    )


def _covered(windows: Column) -> Column:
    """Words in windows that occur more than once: equal windows are neighbours after sorting with positions."""
    placed = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def repeated(ordered: Column) -> Column:
        same = lambda k, other: F.get(ordered, k)["w"] == F.get(ordered, other)["w"]
        at = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)),
        )
        return F.transform(at, lambda k: F.get(ordered, k)["i"])

    def words_of(places: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(i, i + 1, i + 2)))))

    return let(let(placed, repeated), words_of)


def repeat_words(words: Column) -> Column:
    """Words in three-word windows found twice or more, the first included."""
    counted = let(
        _windows(words),
        lambda windows: F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_covered(windows)),
    )
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(counted)


def measured(text: Column) -> Column:
    """Struct of all measurements (long) of a whole text; null text has no words and no lines."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        _filled(F.split(text, BLANK)),
        lambda words: let(
            lines,
            lambda rows: F.struct(
                *[
                    value.cast("long").alias(name)
                    for name, value in {
                        "n_words": F.size(words),
                        "word_chars": F.length(F.array_join(words, "")),
                        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
                        "n_dup_lines": F.size(rows) - F.size(F.array_distinct(rows)),
                        "n_repeat_words": repeat_words(words),
                        "n_lines": F.size(rows),
                        "n_capitals": F.regexp_count(text, F.lit("[A-Z]")),
                    }.items()
                ]
            ),
        ),
    )


# The place of a rule gives its bit; new rules are added at the end.
RULE_NAMES = ["few_words", "repeated_words", "many_symbols", "repeated_lines", "capitals", "word_length"]
BIT = {name: 1 << i for i, name in enumerate(RULE_NAMES)}
POLICIES = {
    "base": BIT["few_words"] | BIT["repeated_words"],
    "v1": sum(BIT.values()),
}


def failed_bits(m: Column) -> Column:
    """Bit i is set if rule i of RULE_NAMES fails; measurements are numbers, so no rule is undecided."""
    failures = {
        "few_words": m["n_words"] < 50,
        "repeated_words": 100 * m["n_repeat_words"] > 50 * m["n_words"],
        "many_symbols": 100 * m["n_symbols"] > 20 * m["n_words"],
        "repeated_lines": 100 * m["n_dup_lines"] > 50 * m["n_lines"],
        "capitals": 100 * m["n_capitals"] > 40 * m["word_chars"],
        "word_length": (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"]),
    }
    total = F.lit(0).cast("long")
    for name in RULE_NAMES:
        total = total.bitwiseOR(F.when(failures[name], F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return total


def verdict(version: str = "v1", text_col: str = "text") -> Column:
    """Whether a policy keeps a document, as a condition on its text."""
    failed = let(measured(F.col(text_col)), failed_bits)
    return failed.bitwiseAND(F.lit(POLICIES[version])) == 0


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the measurements and ``failed`` (bit i set: rule i of RULE_NAMES failed) of every row.

    A null or empty text fails ``few_words``. Repeated rows are repeated, a null id stays null, an empty table
    gives an empty one; other columns are not carried.
    """
    entry = let(measured(F.col(text_col)), lambda m: F.struct(m.alias("m"), failed_bits(m).alias("failed")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.inline(F.array(entry)))
    return rows.select("doc_id", *[F.col("m")[name].alias(name) for name in MEASURES], "failed")


def apply_policy(rows: DataFrame, version: str = "v1") -> DataFrame:
    """Add ``kept``: no rule that the version enforces has failed."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablation(rows: DataFrame, version: str = "v1") -> DataFrame:
    """What each rule of a policy does: ``rule, enforced, n_failed, n_only`` (rejected by this rule alone).

    Failure patterns are counted first (at most 2 ** rules rows), so the ledger is read once.
    """
    mask = POLICIES[version]
    patterns = rows.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(
        F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in BIT.items()])
    )
    enforced = F.col("failed").bitwiseAND(F.lit(mask))
    return (
        patterns.select("failed", "n", rules.alias("r"))
        .select("failed", "n", "r.rule", "r.bit")
        .groupBy("rule", "bit")
        .agg(
            F.coalesce(F.sum(F.when(F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when((enforced == F.col("bit")) & (F.col("bit") > 0), F.col("n"))), F.lit(0)).alias("n_only"),
            F.bit_or(enforced).alias("seen"),
        )
        .select("rule", (F.col("bit").bitwiseAND(F.lit(mask)) != 0).alias("enforced"), "n_failed", "n_only")
    )


def judge(docs: DataFrame, version: str = "v1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger with ``base_failed`` (too few or too many repeated words) and ``kept``."""
    base = F.col("failed").bitwiseAND(F.lit(POLICIES["base"])) != 0
    judged = apply_policy(ledger(docs, id_col, text_col), version).withColumn("base_failed", base)
    return judged.withColumn("kept", F.col("kept") & ~F.col("base_failed"))
