"""Operator 8: quality rules whose cutoffs have a proven bound on false rejection.

Texts are measured with built-in functions. For each stratum, signal and cutoff of a fixed
grid, labelled good rows that the cutoff would reject are counted. The cutoff counts as
safe if so few rejections would be unlikely (an exact binomial tail) were the true share
of good rows that it rejects above the signal's part of the allowed risk. All tests of all
strata share the error level (Bonferroni), and the signals share the risk, so with
probability 1 - error no stratum loses more than that risk of its good rows to the rules.
Among safe cutoffs the one that rejects most bad rows, less good ones, is taken.

Only DataFrame functions; the joins are by key and by stratum, the counts are combined
before the shuffle, and the driver learns one number, that of the strata.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelake.llm.rows import staged_rows

#: White space between words, and the signs that count as symbols (fixed values).
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
FEWEST_WORDS = 20
MOST_REPEATED = 30
#: Share of good rows that may be lost in a stratum, and the chance that more are.
RISK, ERROR = 0.05, 0.05
#: Each signal: counted, of, and cutoffs in thousandths; a row at or above one is rejected.
SIGNALS = {
    "symbols": ("n_symbols", "word_chars", (20, 30, 50, 75, 100, 150, 200, 300)),
    "dup_lines": ("n_dup_lines", "n_lines", (100, 200, 300, 400, 500, 650, 800)),
    "repeats": ("n_repeat_words", "n_words", (50, 100, 150, 200, 250, 300)),
    "capitals": ("n_capitals", "word_chars", (150, 200, 300, 400, 500, 700)),
}


def _without(text: Column, signs: str) -> Column:
    """Code points of the text that are none of the signs."""
    return F.length(F.translate(text, signs, ""))


def measured(docs: DataFrame, text: str) -> DataFrame:
    """The rows with words, lines, symbols and repeats counted.

    Windows of words are told apart by 64-bit hashes, within one text only.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    words = docs.withColumn("words", F.array_remove(F.split(whole, r"[ \t\n\x0B\f\r]+"), ""))
    counted = words.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": _without(whole, SPACES).cast("long"),
            "n_symbols": (F.length(whole) - _without(whole, SYMBOLS)).cast("long"),
            "n_capitals": (F.length(whole) - _without(whole, CAPITALS)).cast("long"),
            "lines": F.filter(F.split(whole, "\n"), lambda line: _without(line, SPACES) > 0),
            "hashes": F.when(
                F.size("words") > WINDOW,
                F.transform(
                    F.sequence(F.lit(1), F.size("words") - WINDOW + 1),
                    lambda i: F.xxhash64(F.slice("words", i, F.lit(WINDOW))),
                ),
            ),
        }
    )
    distinct = F.size(F.array_distinct("hashes"))
    sorted_pairs = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    paired = counted.withColumns(
        {
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            # Only texts with a repeated window are sorted.
            "pairs": F.when(distinct < F.size("hashes"), sorted_pairs),
        }
    ).drop("words", "lines", "hashes")

    def repeated(pair: Column, k: Column) -> Column:
        left = (k > 0) & (F.get("pairs", k - 1)["h"] == pair["h"])
        right = (k + 1 < F.size("pairs")) & (F.get("pairs", k + 1)["h"] == pair["h"])
        return left | right

    starts = F.sort_array(F.transform(F.filter("pairs", repeated), lambda pair: pair["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda seen, i: F.struct(
            (seen["n"] + i + WINDOW - F.greatest(seen["end"], i)).alias("n"),
            (i + WINDOW).alias("end"),
        ),
        lambda seen: seen["n"],
    )
    return paired.withColumn(
        "n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")
    ).drop("pairs")


def _share(signal: str) -> Column:
    part, whole, _ = SIGNALS[signal]
    return F.when(F.col(whole) > 0, F.col(part) * 1000 / F.col(whole)).otherwise(0.0)


def log_tail(k: Column, n: Column, p: float) -> Column:
    """log P(X <= k) of a binomial (n, p) variable, summed exactly in logarithms."""
    odds = math.log(p) - math.log1p(-p)
    first = n * math.log1p(-p)

    def add(seen: Column, i: Column) -> Column:
        term = seen["term"] + F.log((n - i + 1) / i) + F.lit(odds)
        top = F.greatest(seen["sum"], term)
        total = top + F.log(F.exp(seen["sum"] - top) + F.exp(term - top))
        return F.struct(term.alias("term"), total.alias("sum"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    start = F.struct(first.alias("term"), first.alias("sum"))
    return F.aggregate(terms, start, add, lambda seen: seen["sum"])


def safe_cutoffs(
    rows: DataFrame, labels: DataFrame, key: str, label_key: str, good: str,
    risk: float = RISK, error: float = ERROR,
) -> DataFrame:
    """stratum and, for each signal, the cutoff taken (null where none is safe).

    rows are measured rows with key and stratum; a key's label is good if any of its
    labels is, so a doubtful row counts for the bound; rows without a label, or with a
    null one, are left out. A stratum with too few labels has no safe cutoff.
    """
    known = labels.select(F.col(f"`{label_key}`").alias("labelled"), F.col(f"`{good}`").alias("good"))
    known = known.where("labelled is not null and good is not null").groupBy("labelled").agg(F.max("good").alias("good"))
    held = rows.where("not base_failed").join(known, rows[key] == known["labelled"])
    sums = []
    for signal, (_, _, grid) in SIGNALS.items():
        for cutoff in grid:
            hit = _share(signal) >= cutoff
            for name, label in (("lost", F.col("good") > 0), ("won", F.col("good") <= 0)):
                sums.append(F.count_if(hit & label).alias(f"{name}_{signal}_{cutoff}"))
    total = F.count_if(F.col("good") > 0).alias("n_good")
    counts = staged_rows(held.groupBy("stratum").agg(total, *sums), "cutoffs")
    tests = sum(len(grid) for _, _, grid in SIGNALS.values()) * max(1, counts.count())
    entries = [
        F.struct(
            F.lit(signal).alias("signal"),
            F.lit(cutoff).alias("cutoff"),
            F.col(f"lost_{signal}_{cutoff}").alias("lost"),
            F.col(f"won_{signal}_{cutoff}").alias("won"),
        )
        for signal, (_, _, grid) in SIGNALS.items()
        for cutoff in grid
    ]
    each = counts.select("stratum", "n_good", F.explode(F.array(*entries)).alias("e"))
    each = each.select("stratum", "n_good", "e.*")
    part = risk / len(SIGNALS)
    level = F.lit(error / tests)
    # Above the expected number no tail is small; the sum is not needed there.
    likely = F.when(
        F.col("lost") < F.col("n_good") * part,
        log_tail(F.col("lost"), F.col("n_good"), part),
    ).otherwise(0.0)
    safe = each.where((likely <= F.log(level)) & (F.col("won") > F.col("lost")))
    gain = (F.col("won") - F.col("lost")).alias("gain")
    best = F.max(F.struct(gain, "cutoff"))["cutoff"]
    # The cutoffs in use: one row for each stratum.
    return safe.groupBy("stratum").pivot("signal", list(SIGNALS)).agg(best)


def quality_verdicts(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
    stratum: str = "lang", label_key: str = "doc_id", good: str = "quality",
    risk: float = RISK, error: float = ERROR,
) -> DataFrame:
    """Key, the counts, base_failed, kept, and for each signal whether it rejected the row.

    A null text counts as empty, which fails the base rules. Null strata are one stratum.
    Rows of a stratum without safe cutoffs are kept unless the base rules fail. Repeated
    rows are measured each; empty tables of rows or labels are fine; other columns of
    either table are not read.
    """
    base = docs.select(
        F.col(f"`{key}`").alias("key"),
        F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("")).alias("stratum"),
        F.col(f"`{text}`").alias("text"),
    )
    few = F.col("n_words") < FEWEST_WORDS
    repeats = 100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    rows = measured(base, "text").drop("text").withColumn("base_failed", few | repeats)
    # Measured once: the numbers of a row are read for the cutoffs and for the verdicts.
    rows = staged_rows(rows, "measured")
    cutoffs = safe_cutoffs(rows, labels, "key", label_key, good, risk, error)
    judged = rows.join(cutoffs, "stratum", "left")
    fails = {
        f"by_{signal}": F.coalesce(_share(signal) >= F.col(signal), F.lit(False)) for signal in SIGNALS
    }
    judged = judged.withColumns(fails)
    failed = F.col("base_failed")
    for name in fails:
        failed = failed | F.col(name)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(
        F.col("key").alias(key), *counts, "base_failed", (~failed).alias("kept"), *fails
    )
