r"""Quality rules whose cutoffs carry a guarantee on falsely rejected documents.

Every rule is a share of a document that is high in junk. A cutoff may be used in a stratum (a
language) only if the labelled good documents prove it harmless: with ``x`` of ``n`` good ones
rejected, the exact binomial probability of seeing no more than ``x`` at a rate of ``risk`` must
not exceed the rule's error level. The level ``DELTA`` is divided over all strata and rules
(Bonferroni). Inside one stratum and rule the cutoffs are tried in a fixed order, the most
lenient first, up to the first that fails, which needs no further correction. ``ALPHA``, the share
of good documents that may be lost in a stratum, is divided over the rules. So with probability
``1 - DELTA`` no stratum loses more than ``ALPHA`` of its good documents to all rules together.
Among the proven cutoffs the one with most rejected bad documents, ``PRICE`` good ones counting
against each, is taken; a stratum with too few labels proves none and keeps everything.

Labels are holdouts: rules and cutoffs are fixed beforehand, none is fitted. All is columns: words
and three-word windows are arrays of one document and never leave its row, measures are written
once, and what meets the documents again is one row per stratum.

Words are ``[^\x20\x09-\x0D]+``. Windows are compared by 64-bit hashes inside one document.
Defined results. NULL text: no words, base failed. NULL language: a stratum of its own. NULL or
repeated ids: each row by its own text; a label holds for all rows of its id, and an id with
several labels is good if all say so. No labels: only the base rules decide.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taquilla.llm.common import written

ALPHA = 0.02
DELTA = 0.05
PRICE = 10
# Shares from which a rule may reject, the most lenient first.
CUTOFFS = [c / 40 for c in range(39, 0, -1)]
LEAST_WORDS = 50
SPACES = "\t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _share(part: str, whole: str) -> Column:
    return F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double"))


RULES = {
    "symbols": lambda: _share("n_symbols", "word_chars"),
    "repeated_words": lambda: _share("n_repeat_words", "n_words"),
    "repeated_lines": lambda: _share("n_dup_lines", "n_lines"),
    "shouting": lambda: _share("n_shouts", "word_chars"),
    "few_words": lambda: 1.0 - _share("n_distinct_words", "n_words"),
}


def _without(text: Column, characters: str, other: str = "") -> Column:
    """``text`` with each of the characters replaced; plain replacement scans bytes and is many
    times faster than ``translate``, which looks up every character."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(other)), characters, text)


def _removed(text: Column, characters: str) -> Column:
    """Number of characters of ``text`` that are among ``characters``."""
    return F.length(text) - F.length(_without(text, characters))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` and a struct ``__m`` of counts and base verdict; other columns stay as they are."""
    text = F.coalesce(F.col("text"), F.lit(""))
    flat = _without(text, SPACES, " ")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(_without(x, SPACES, " ")) != "")
    counted = docs.withColumns(
        {
            "__words": F.array_remove(F.split(flat, " "), ""),
            "__lines": lines,
            "__chars": F.length(_without(flat, " ")),
            "__symbols": _removed(text, SYMBOLS),
            "__shouts": _removed(text, "!"),
        }
    )
    windows = F.transform(
        F.sequence(F.lit(1), F.size("__words") - 2),
        lambda i: F.xxhash64(
            F.element_at("__words", i),
            F.element_at("__words", i + 1),
            F.element_at("__words", i + 2),
        ),
    )
    hashed = counted.withColumn(
        "__windows", F.when(F.size("__words") >= 3, windows).otherwise(F.array().cast("array<long>"))
    )
    # Few documents repeat a window; only theirs are sorted.
    placed = F.array_sort(F.transform("__windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    ordered = hashed.withColumn(
        "__sorted",
        F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), placed),
    )
    same = F.filter(
        "__sorted",
        lambda e, j: (
            (j > 0) & (F.get("__sorted", j - 1)["h"] == e["h"])
            | F.coalesce(F.get("__sorted", j + 1)["h"] == e["h"], F.lit(False))
        ),
    )
    found = ordered.withColumn("__at", F.array_sort(F.transform(same, lambda e: e["i"])))
    steps = F.transform(
        "__at", lambda x, j: F.when(j == 0, 3).otherwise(F.least(F.lit(3), x - F.get("__at", j - 1)))
    )
    repeated = F.coalesce(F.aggregate(steps, F.lit(0), lambda a, b: a + b), F.lit(0))
    counts = {
        "n_words": F.size("__words"),
        "word_chars": F.col("__chars"),
        "n_symbols": F.col("__symbols"),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": repeated,
        "n_lines": F.size("__lines"),
        "n_shouts": F.col("__shouts"),
        "n_distinct_words": F.size(F.array_distinct("__words")),
    }
    m = F.struct(*[c.cast("long").alias(name) for name, c in counts.items()])
    helpers = [c for c in found.columns if c not in docs.columns]
    return found.withColumn("__m", m).drop(*helpers)


def _row_key() -> Column:
    """Tells rows of one id apart; rows that agree in it have one verdict."""
    return F.xxhash64("text", "lang")


def _base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > 50 * F.col("n_words")
    )


def _flat(rows: DataFrame) -> DataFrame:
    """Counts, base verdict and rule values of measured rows as plain columns."""
    flat = rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"),
        _row_key().alias("row_key"),
        "__m.*",
    )
    return flat.withColumn("base_failed", _base_failed()).withColumns(
        {f"rule_{name}": F.coalesce(value(), F.lit(0.0)) for name, value in RULES.items()}
    )


def harmless(n: Column, x: Column, risk: float, level: Column) -> Column:
    """P(Bin(n, risk) <= x) <= level, summed in logarithms from the exact terms."""
    odds = F.log(F.lit(risk / (1 - risk)))
    n = n.cast("double")
    first = n * F.log(F.lit(1 - risk))
    start = F.struct(first.alias("term"), first.alias("total"))

    def add(acc: Column, j: Column) -> Column:
        term = acc["term"] + F.log((n - j + 1) / j) + odds
        high, low = F.greatest(acc["total"], term), F.least(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    terms = F.when(x >= 1, F.sequence(F.lit(1).cast("long"), x)).otherwise(
        F.array().cast("array<long>")
    )
    tail = F.aggregate(terms, start, add, lambda acc: acc["total"])
    # at or above its mean the probability is at least near one half: no cutoff passes there
    return F.when(x >= n * risk, False).otherwise(tail <= F.log(level))


def calibrated(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The cutoff of every stratum and rule that has a proven one worth its price."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("quality").alias("quality")
    )
    risk = ALPHA / len(RULES)
    values = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("rule"), F.col(f"rule_{name}").alias("value"))
                for name in RULES
            ]
        )
    )
    labelled = (
        rows.where("not base_failed")
        .join(known.where("quality is not null"), "doc_id")
        .select("stratum", "quality", values.alias("v"))
    )
    # cutoffs at or below the value reject the row: count rows per interval, then add them up
    place = F.aggregate(
        F.array(*map(F.lit, CUTOFFS)),
        F.lit(0),
        lambda a, c: a + F.when(F.col("v.value") < c, 1).otherwise(0),
    )
    per_interval = (
        labelled.groupBy("stratum", F.col("v.rule").alias("rule"), place.alias("place"))
        .agg(
            F.count_if(F.col("quality") == 1).alias("good"),
            F.count_if(F.col("quality") == 0).alias("bad"),
        )
    )
    cells = per_interval.groupBy("stratum", "rule").agg(
        F.sum("good").alias("n_good"),
        F.collect_list(F.struct("place", "good", "bad")).alias("held"),
    )
    at = F.explode(F.sequence(F.lit(0), F.lit(len(CUTOFFS) - 1))).alias("at")

    def rejected(field: str) -> Column:
        return F.aggregate(
            "held",
            F.lit(0).cast("long"),
            lambda a, h: a + F.when(h["place"] <= F.col("at"), h[field]).otherwise(0),
        )

    strata = cells.select("stratum").distinct().agg(F.count("*").alias("n_strata"))
    tried = (
        cells.crossJoin(strata)  # one row
        .select("stratum", "rule", "n_good", "held", "n_strata", at)
        .withColumns({"good": rejected("good"), "bad": rejected("bad")})
    )
    level = F.lit(DELTA / len(RULES)) / F.col("n_strata")
    order = Window.partitionBy("stratum", "rule").orderBy("at")
    proven = tried.withColumn(
        "proven",
        F.min(harmless(F.col("n_good"), F.col("good"), risk, level)).over(order),
    ).where("proven")
    worth = F.col("bad") - PRICE * F.col("good")
    cutoff = F.element_at(F.array(*map(F.lit, CUTOFFS)), F.col("at") + 1)
    return (
        proven.withColumns({"worth": worth, "cutoff": cutoff})
        .where("worth > 0")
        .groupBy("stratum", "rule")
        .agg(F.max_by("cutoff", F.struct("worth", "cutoff")).alias("cutoff"))
    )


def _verdicts(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    by_stratum = cutoffs.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    by_stratum = by_stratum.select(
        "stratum", *[F.col(f"`{name}`").alias(f"cut_{name}") for name in RULES]
    )
    failed = reduce(
        Column.__or__,
        [
            F.coalesce(F.col(f"rule_{name}") >= F.col(f"cut_{name}"), F.lit(False))
            for name in RULES
        ],
    )
    return rows.join(by_stratum, "stratum", "left").withColumn(
        "kept", ~F.col("base_failed") & ~failed
    )


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Measures and verdict per row of ``docs``."""
    rows = written(_flat(measured(docs)))
    return _verdicts(rows, written(calibrated(rows, labels))).select(
        "doc_id", *MEASURES, "base_failed", "kept"
    )


def without_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept. Measures and verdicts are made on written rows: a filter
    on the verdict would otherwise be pushed down to the texts and measure them many times over."""
    rows = written(_flat(measured(docs)))
    gone = (
        _verdicts(rows, written(calibrated(rows, labels)))
        .where("not kept")
        .select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"))
        .distinct()
    )
    same = docs["doc_id"].cast("long").eqNullSafe(gone["__id"]) & (_row_key() == gone["__key"])
    return docs.join(gone, same, "left_anti")
