"""Learned decision lists over text statistics, with DataFrame functions only.

``text_statistics`` measures whole texts; ``fit_decision_list`` learns an ordered list of threshold
conjunctions by sequential covering (grow on one part of the labelled rows, prune on the other);
``DecisionList.verdict`` is one ordered Spark conditional expression. Every count that the learner
looks at is an aggregate over all labelled rows; the driver sees only counts per (feature, bin).

Defined cases: a null or empty text has no words and all statistics 0; a null statistic satisfies no
condition, so no rule rejects it; rows with a null label are not learned from; with no labelled rows
or only one class the list is empty and keeps everything; repeated rows count as often as they occur.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from probcast.llm.common import stored

SEPARATORS = r"[\x20\x09-\x0D]+"
NON_WORD = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "upper_per_char": "n_upper / greatest(word_chars, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "echo_share": "n_echo_words / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "duplicate_line_share": "n_dup_lines / greatest(n_lines, 1)",
}
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper",
              "n_distinct_words", "n_echo_words", "n_lines")


def text_statistics(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and the statistics of every whole text.

    Words are compared by 64-bit hashes. ``n_repeat_words`` counts words inside any window of eight
    words that occurs twice or more; equal windows are found by sorting window hashes, so a long
    text costs n log n.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(body, SEPARATORS, -1), "")
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.length(F.translate(x, NON_WORD, "")) > 0)
    step = docs.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)],
        F.transform(words, lambda w: F.xxhash64(w)).alias("_w"),
        F.length(F.translate(body, NON_WORD, "")).alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).alias("n_symbols"),
        F.length(F.regexp_replace(body, r"\P{Lu}+", "")).alias("n_upper"),
        lines.alias("_lines"))
    count = F.size("_w")
    window = F.transform(
        F.sequence(F.lit(0), count - WINDOW),
        lambda i: F.xxhash64(*[F.get("_w", i + j) for j in range(WINDOW)]))
    step = step.select(
        "*", count.alias("n_words"),
        F.size("_lines").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.size(F.array_distinct("_w")).alias("n_distinct_words"),
        F.size(F.filter("_w", lambda w, i: w == F.get("_w", i - 1))).alias("n_echo_words"),
        F.when(count >= WINDOW, window).otherwise(F.array().cast("array<bigint>")).alias("_h")
    ).drop("_w", "_lines")
    step = step.select("*", F.when(
        F.size(F.array_distinct("_h")) < F.size("_h"),
        F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s")).drop("_h")
    twice = F.filter("_s", lambda x, i: (x["h"] == F.get("_s", i - 1)["h"])
                     | (x["h"] == F.get("_s", i + 1)["h"]))
    step = step.select("*", F.array_sort(F.transform(twice, lambda x: x["i"])).alias("_p")).drop("_s")
    covered = F.aggregate(
        F.transform("_p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", i + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda a, b: a + b)
    step = step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)))
    return step.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
                       *[F.col(c).cast("long").alias(c) for c in STATISTICS])


def base_failed() -> Column:
    """The fixed rule: too few words, or more than 30 % of them in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    cut: float

    def column(self) -> Column:
        x = F.expr(FEATURES.get(self.feature, self.feature))
        return F.coalesce(x >= self.cut if self.at_least else x < self.cut, F.lit(False))

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.cut:g}"


@dataclass
class DecisionList:
    """Ordered rules; the first whose conditions all hold rejects the row, otherwise it is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def rule_number(self) -> Column:
        """Position of the deciding rule (from 1), null when none holds."""
        out = F.lit(None).cast("int")
        for n, rule in reversed(list(enumerate(self.rules, 1))):
            out = F.when(reduce(Column.__and__, [c.column() for c in rule]), n).otherwise(out)
        return out

    def verdict(self) -> Column:
        return self.rule_number().isNull()

    def __str__(self) -> str:
        return "\n".join(f"if {' and '.join(map(str, r))}: reject" for r in self.rules) + "\nelse: keep"


def _candidate_cuts(rows: DataFrame, features: Sequence[str], cuts: int) -> dict[str, list[float]]:
    """Quantiles of each feature within each class: at most ``2 * cuts`` values per feature."""
    points = [(i + 1) / (cuts + 1) for i in range(cuts)]
    found = rows.groupBy("_y").agg(*[F.percentile_approx(f, points, 2000).alias(f) for f in features]).collect()
    return {f: sorted({float(v) for r in found for v in (r[f] or ())}) for f in features}


def _counts(cells: DataFrame, features: Sequence[str], covered: Column) -> dict:
    """(part, feature, bin, class) -> rows, over the cells that satisfy ``covered``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in features]))
    rows = (cells.filter(covered).select("_y", "_grow", "_n", pairs.alias("_c"))
            .groupBy("_grow", "_c.f", "_c.b", "_y").agg(F.sum("_n").alias("n")).collect())
    return {(r["_grow"], r["f"], r["b"], r["_y"]): r["n"] for r in rows}


def _split(counts: dict, grow: bool, feature: str, cut: int, at_least: bool) -> tuple[int, int]:
    """Rejected and kept rows on the chosen side of one cut (bins are 1 + number of cuts passed)."""
    out = [0, 0]
    for (g, f, b, y), n in counts.items():
        if g == grow and f == feature and b > 0 and (b > cut + 1) == at_least:
            out[y] += n
    return out[0], out[1]


def fit_decision_list(rows: DataFrame, label: str = "quality", key: str = "doc_id", cuts: int = 32,
                      max_rules: int = 12, max_conditions: int = 3, min_precision: float = 0.9,
                      min_covered: int = 5) -> DecisionList:
    """Learn rules that reject rows with ``label`` 0 from rows with statistics and a label.

    Features are cut at class quantiles and rows are pre-aggregated into cells of equal bins, so
    each growing step is one small aggregation. Two thirds of the rows (by key hash) grow rules with
    the FOIL gain; the rest prunes trailing conditions and accepts a rule only at
    ``min_precision`` with ``min_covered`` rejected rows.
    """
    features = list(FEATURES)
    rows = rows.filter(F.col(label).isNotNull()).select(
        (F.col(label) != 0).cast("int").alias("_y"),
        (F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(3)) != 0).alias("_grow"),
        *[F.expr(FEATURES[f]).alias(f) for f in features])
    rows = stored(rows)
    edges = _candidate_cuts(rows, features, cuts)

    def binned(f: str) -> Column:
        passed = sum(((F.col(f) >= c).cast("int") for c in edges[f]), F.lit(1))
        return F.when(F.col(f).isNotNull(), passed).otherwise(F.lit(0))  # bin 0: no value

    cells = stored(rows.select("_y", "_grow", *[binned(f).alias(f) for f in features])
                   .groupBy("_y", "_grow", *features).agg(F.count("*").alias("_n")))

    def holds(c: tuple[str, int, bool]) -> Column:
        f, cut, at_least = c
        return (F.col(f) > cut + 1) if at_least else F.col(f).between(1, cut + 1)

    learned: list[list[tuple[str, int, bool]]] = []
    left = F.lit(True)
    while len(learned) < max_rules:
        rule: list[tuple[str, int, bool]] = []
        inside, history = left, []
        while len(rule) < max_conditions:
            counts = _counts(cells, features, inside)
            total = [sum(n for (g, f, _, y), n in counts.items() if g and f == features[0] and y == k) for k in (0, 1)]
            history.append({g: [sum(n for (h, f, _, y), n in counts.items() if h == g and f == features[0] and y == k)
                                for k in (0, 1)] for g in (True, False)})
            if total[0] == 0 or (rule and total[1] == 0):
                break
            before = math.log2(total[0] / (total[0] + total[1]))
            best, gain = None, 1e-9
            for f in features:
                for cut in range(len(edges[f])):
                    for at_least in (True, False):
                        p, n = _split(counts, True, f, cut, at_least)
                        if p and p * (math.log2(p / (p + n)) - before) > gain:
                            best, gain = (f, cut, at_least), p * (math.log2(p / (p + n)) - before)
            if best is None:
                break
            rule.append(best)
            inside = inside & holds(best)
        if not rule:
            break
        if len(history) <= len(rule):
            counts = _counts(cells, features[:1], inside)
            history.append({g: [sum(n for (h, _, _, y), n in counts.items() if h == g and y == k)
                                for k in (0, 1)] for g in (True, False)})

        def worth(k: int) -> float:
            p, n = history[k][False]
            return (p - n) / (p + n) if p + n else -1.0

        length = max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))
        rule = rule[:length]
        p, n = (sum(x) for x in zip(history[length][True], history[length][False]))
        q, m = history[length][False]
        if p < min_covered or p < min_precision * (p + n) or (q + m and q < min_precision * (q + m)):
            break
        learned.append(rule)
        left = left & ~reduce(Column.__and__, [holds(c) for c in rule])
    return DecisionList([[Condition(f, side, edges[f][cut]) for f, cut, side in rule] for rule in learned])


def apply_decision_list(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """Statistics with ``base_failed``, the deciding ``rule`` and ``kept``."""
    return (stats.withColumn("base_failed", base_failed())
            .withColumn("rule", rules.rule_number())
            .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()))


def labelled_statistics(stats: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Statistics of the labelled rows that may be learned from."""
    from probcast.llm.common import held_out

    return stats.join(labels.select("doc_id", label), "doc_id").filter(~held_out(F.col("doc_id")))
