"""Quality rules: a learned decision list as ordered conditional expressions.

Statistics of a text are DataFrame expressions. From the statistics of labelled rows, sequential
covering learns rules one after another: a rule grows by the threshold condition with the highest
FOIL gain, is pruned back on rows that it did not grow on, and is taken while it is precise enough
there; the rows it covers then leave. The rules become one ordered conditional expression, so the
verdict on all rows is part of the scan's projection, with no shuffle and no Python.

Only the fit sees a sample: the TRAIN_ROWS labelled rows whose id hashes lowest.

Words are counted in windows of three inside the row: the window's hash (38 bits) and place (26
bits) share one long, longs are sorted, and neighbours of one hash are compared word by word. Where
two of one hash differ, and where a text has more words than places, the windows are sorted by their words
instead, so the count is exact for any text.

Cases: a null or empty text has no words and fails the base rule; without labels there are no rules
and the base rule alone decides; repeated rows and null ids give a row each; a labelled id that
stands in several rows is learned from once for each label it has, by its lowest statistics; other columns are never read; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .shared import let

#: Labelled rows that the rules are learned from at most.
TRAIN_ROWS = 20_000
#: Rules and conditions at most, thresholds tried for each statistic, rows and precision a rule needs on rows it did not grow on.
RULES, CONDITIONS, CUTS, LEAST_ROWS, PRECISION = 12, 3, 40, 8, 0.85
PLACE_BITS = 26


def _repeated(w: Column) -> Column:
    """Words of the array w that stand in windows of three found twice or more."""
    n, top = F.size(w), (1 << PLACE_BITS) - 1
    mask = F.lit(top)

    def packed(i: Column) -> Column:
        print_ = F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        return print_.bitwiseAND(F.lit(-top - 1)).bitwiseOR(i.cast("long"))

    def beside(s: Column) -> Column:
        """For each window and the one after it in order: 0 for other hashes, 1 for the same words, 2 for other words of one hash."""

        def code(a: Column, j: Column) -> Column:
            b = F.get(s, j + 1)
            p, q = a.bitwiseAND(mask).cast("int"), b.bitwiseAND(mask).cast("int")
            same = (F.get(w, p) == F.get(w, q)) & (F.get(w, p + 1) == F.get(w, q + 1)) & (F.get(w, p + 2) == F.get(w, q + 2))
            return F.when(F.shiftright(a, PLACE_BITS) != F.shiftright(b, PLACE_BITS), 0).when(same, 1).when(b.isNull(), 0).otherwise(2)

        return F.transform(s, code)

    def again(s: Column, alike: Column, place: Callable[[Column], Column]) -> Column:
        """Places of the windows that are like the one after them or the one before."""
        return F.sort_array(F.transform(F.filter(s, lambda x, j: (F.get(alike, j) == 1) | ((j > 0) & (F.get(alike, j - 1) == 1))), place))

    def by_words(of: Column) -> Column:
        windows = F.sort_array(F.transform(of, lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.cast("long").alias("i"))))
        same = lambda s: F.transform(s, lambda x, j: F.when((x["a"] == F.get(s, j + 1)["a"]) & (x["b"] == F.get(s, j + 1)["b"]) & (x["c"] == F.get(s, j + 1)["c"]), 1).otherwise(0))
        return let(windows, lambda s: let(same(s), lambda alike: again(s, alike, lambda x: x["i"])))

    def by_hash(of: Column) -> Column:
        windows = F.sort_array(F.transform(of, packed))
        places = lambda s, alike: F.when(F.array_contains(alike, 2), by_words(of)).otherwise(again(s, alike, lambda x: x.bitwiseAND(mask)))
        return let(windows, lambda s: let(beside(s), lambda alike: places(s, alike)))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, k + 1), x + 3) - x))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

    starts = F.sequence(F.lit(0), n - 3)
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(let(F.when(n > top, by_words(starts)).otherwise(by_hash(starts)), covered))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text, with struct _pf: counts of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    white = F.lit(" \t\n\u000b\f\r")
    lines = F.filter(F.split("_pf_text", "\n"), lambda x: F.ltrim(x, white) != "")
    words = F.filter(F.split("_pf_text", "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    of_lines = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    def of_words(w: Column) -> Column:
        # What is neither white nor a-z is little, and is looked through again and again.
        bare = F.array_join(w, "")
        return let(F.translate(bare, "abcdefghijklmnopqrstuvwxyz", ""), lambda rest: of_rest(w, bare, rest))

    def of_rest(w: Column, bare: Column, rest: Column) -> Column:
        those = lambda chars: (F.length(rest) - F.length(F.translate(rest, chars, ""))).cast("long")
        return F.struct(
            F.length(bare).cast("long").alias("word_chars"),
            those("#*$%&|<>").alias("n_symbols"),
            those("|").alias("n_bars"),
            those("0123456789").alias("n_digits"),
            those("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
            those(".,;:!?").alias("n_stops"),
            those("!").alias("n_shouts"),
            F.size(w).cast("long").alias("n_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            _repeated(w).alias("n_repeat_words"),
        )

    kept = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    counts = F.struct(let(lines, of_lines).alias("lines"), let(words, of_words).alias("words"))
    return docs.select(*kept, text.alias("_pf_text")).select(*kept, counts.alias("_pf"))


def features() -> dict[str, Column]:
    """What rules may test: ratios of the counts in _pf."""
    c = lambda name: F.col(f"_pf.{name}").cast("double")
    chars, words = F.greatest(c("words.word_chars"), F.lit(1.0)), F.greatest(c("words.n_words"), F.lit(1.0))
    return {
        "n_words": c("words.n_words"),
        "word_length": c("words.word_chars") / words,
        "symbols": c("words.n_symbols") / chars,
        "bars": c("words.n_bars") / chars,
        "digits": c("words.n_digits") / chars,
        "capitals": c("words.n_capitals") / chars,
        "stops": c("words.n_stops") / chars,
        "shouts": c("words.n_shouts") / chars,
        "dup_lines": c("lines.n_dup_lines") / F.greatest(c("lines.n_lines"), F.lit(1.0)),
        "words_a_line": c("words.n_words") / F.greatest(c("lines.n_lines"), F.lit(1.0)),
        "distinct": c("words.n_distinct") / words,
        "repeated": c("words.n_repeat_words") / words,
    }


@dataclass(frozen=True)
class Rule:
    """Low quality where every (statistic, above, threshold) holds."""

    conditions: tuple[tuple[str, bool, float], ...]
    precision: float
    rows: int

    def column(self, of: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, above, cut in self.conditions:
            out = out & ((of[name] > cut) if above else (of[name] <= cut))
        return out


def _holds(x: np.ndarray, conditions: list[tuple[int, bool, float]]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, cut in conditions:
        out &= (x[:, f] > cut) if above else (x[:, f] <= cut)
    return out


def _grow(x: np.ndarray, bad: np.ndarray) -> list[tuple[int, bool, float]]:
    """Conditions by FOIL gain, until no good row is left in or none gains."""
    rule, inside = [], np.ones(len(x), bool)
    while len(rule) < CONDITIONS and (~bad & inside).any() and (bad & inside).any():
        p0, n0 = (bad & inside).sum(), (~bad & inside).sum()
        best = (1e-9, None)
        for f in range(x.shape[1]):
            values = x[inside, f]
            order = np.argsort(values, kind="stable")
            v, b = values[order], bad[inside][order]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, CUTS), method="inverted_cdf"))[:-1]
            below = np.searchsorted(v, cuts, side="right")
            bad_below = np.concatenate(([0], np.cumsum(b)))[below]
            for above, p, n in ((True, p0 - bad_below, (len(v) - below) - (p0 - bad_below)), (False, bad_below, below - bad_below)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0)
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), (f, above, float(cuts[gain.argmax()])))
        if best[1] is None:
            break
        rule.append(best[1])
        inside = _holds(x, rule)
    return rule


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], fold: np.ndarray) -> list[Rule]:
    """Sequential covering over rows of statistics. fold: True for rows to prune on."""
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < RULES:
        grow, prune = left & ~fold, left & fold
        conditions = _grow(x[grow], bad[grow]) if (bad & grow).any() else []
        best = (0.0, 0, [])
        for k in range(1, len(conditions) + 1):
            hit = _holds(x[prune], conditions[:k])
            p, n = (hit & bad[prune]).sum(), (hit & ~bad[prune]).sum()
            if p + n >= LEAST_ROWS and p / (p + n) > best[0]:
                best = (p / (p + n), int(p + n), conditions[:k])
        if best[0] < PRECISION:
            break
        rules.append(Rule(tuple((names[f], above, cut) for f, above, cut in best[2]), float(best[0]), best[1]))
        left &= ~_holds(x, best[2])
    return rules


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """The decision list, from the statistics of at most TRAIN_ROWS labelled rows (label 0: low quality)."""
    some = labels.select(F.col(id_col).alias("_pf_id"), F.col(label_col).alias("_pf_label")).dropna().distinct().orderBy(F.xxhash64("_pf_id"), "_pf_id", "_pf_label").limit(TRAIN_ROWS)
    # Bounded by TRAIN_ROWS rows of two numbers, so every task can have them.
    rows = docs.select(F.col(f"`{id_col}`").alias("_pf_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(some), "_pf_id")
    of = features()
    names = list(of)
    fold = (F.pmod(F.xxhash64("_pf_id", F.lit("fold")), F.lit(3)) == 0).alias("fold")
    measured = statistics(rows).select("_pf_id", "_pf_label", fold, F.struct(*(of[n].alias(n) for n in names)).alias("x"))
    got = measured.groupBy("_pf_id", "_pf_label", "fold").agg(F.min("x").alias("x")).collect()  # a row for each of TRAIN_ROWS at most
    if not got:
        return []
    got.sort(key=lambda r: (str(r._pf_id), r._pf_label))
    x = np.array([tuple(r.x) for r in got], float)
    return learn(x, np.array([r._pf_label == 0 for r in got]), names, np.array([r.fold for r in got]))


def quality_rules(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule (place of the rule that holds, from 1)."""
    stats = statistics(docs.select(F.col(f"`{id_col}`").alias("_pf_id"), F.col(f"`{text_col}`").alias("text")))
    of = features()
    n_words, again = F.col("_pf.words.n_words"), F.col("_pf.words.n_repeat_words")
    failed = (n_words < 50) | (100 * again > 50 * n_words)
    verdict = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        verdict = F.when(rule.column(of), F.lit(k)).otherwise(verdict)
    return stats.select(
        F.col("_pf_id").alias(id_col),
        n_words.alias("n_words"),
        F.col("_pf.words.word_chars").alias("word_chars"),
        F.col("_pf.words.n_symbols").alias("n_symbols"),
        F.col("_pf.lines.n_dup_lines").alias("n_dup_lines"),
        again.alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & verdict.isNull()).alias("kept"),
        verdict.alias("rule"),
    )
