"""Quality rules as learned decision lists: sequential covering over labelled document statistics.

`fit` grows conjunctions of thresholds one literal at a time by FOIL gain on two thirds of a bounded labelled
sample, prunes them on the rest, and removes what they cover; `DecisionList.verdict` is one ordered CASE
expression. All statistics are DataFrame expressions; nothing runs in Python on the executors.

Cases: a null text counts as no words; an empty text fails the base check; ties between literals go to the
first feature and threshold in order; repeated rows are judged alike; without usable labels the list is empty
and keeps what the base check keeps; extra input columns are ignored and cannot clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows the list is fitted on at most (those with the smallest hash of their id).
SAMPLE_ROWS = 4000
MAX_RULES, MAX_LITERALS, THRESHOLDS = 8, 4, 24
#: A rule must be right this often on the pruning rows it covers, and cover this share of the sample.
MIN_PRECISION, MIN_COVERAGE = 0.9, 0.004

_BLANK = r"[ \x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"
#: Positions take the low bits of a window's code, its hash the rest.
_BITS = 26
_MASK = (1 << _BITS) - 1


def with_words(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, t (text, null as empty), w (its words) and the columns `more`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("t"), *more).withColumn("w", F.filter(F.split("t", _BLANK), lambda x: x != ""))


def repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words inside 3-word windows that occur twice or more in the text.

    Codes of a window's hash and place are sorted, and neighbours of equal hash compared word by word. Texts in which
    two different windows share a hash, or whose places do not fit the code, have their windows sorted by their
    words instead; so the result is exact for all.
    """
    three = lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    code = lambda i: three(i).bitwiseAND(F.lit(~_MASK)).bitwiseOR(i.cast("long"))
    at = lambda x: x.bitwiseAND(F.lit(_MASK)).cast("int")
    n = F.size("w")
    small = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), code))
    df = df.withColumn("_s", F.when((n >= 3) & (n <= _MASK), small).otherwise(F.array().cast("array<long>")))

    def like_last(x: Column, k: Column) -> Column:
        """0: other hash than the code before; 1: the same words; 2: the same hash, other words."""
        y = F.get("_s", k - 1)
        words_equal = [F.get("w", at(x) + j) == F.get("w", at(y) + j) for j in range(3)]
        other = (k == 0) | (F.shiftright(x, _BITS) != F.shiftright(y, _BITS))
        return F.when(other, 0).when(words_equal[0] & words_equal[1] & words_equal[2], 1).otherwise(2).cast("byte")

    df = df.withColumn("_k", F.transform("_s", like_last))
    again = F.filter("_s", lambda x, k: (F.get("_k", k) == 1) | F.coalesce(F.get("_k", k + 1) == 1, F.lit(False)))
    fast = F.sort_array(F.transform(again, lambda x: x.bitwiseAND(F.lit(_MASK))))

    # windows by their words; each run of equal ones gives the places of all its windows if it has two or more
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(*(F.get("w", i + j).alias(f"w{j}") for j in range(3)), i.cast("long").alias("at"))))
    same = lambda x, y: (x.w0 == y.w0) & (x.w1 == y.w1) & (x.w2 == y.w2)
    df = df.withColumn("_x", F.when(F.array_contains("_k", F.lit(2).cast("byte")) | (n > _MASK), windows))
    slow = F.filter("_x", lambda x, k: F.coalesce(same(x, F.get("_x", k - 1)), F.lit(False)) | F.coalesce(same(x, F.get("_x", k + 1)), F.lit(False)))
    places = F.when(F.col("_x").isNotNull(), F.sort_array(F.transform(slow, lambda x: x.at))).otherwise(fast)
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-3).cast("long").alias("last"))
    step = lambda acc, p: F.struct((acc.total + F.least(F.lit(3).cast("long"), p - acc.last)).alias("total"), p.alias("last"))
    df = df.withColumn("n_repeat_words", F.aggregate(places, start, step, lambda acc: acc.total))
    return df.drop("_s", "_k", "_x")


def base_columns(df: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to `with_words`."""
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]"))
    df = df.withColumn("_l", lines).select(
        "*",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
    )
    df = repeat_words(df).drop("_l")
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def features() -> dict[str, Column]:
    """Statistics that the thresholds test, by name, over `base_columns`."""
    c = F.col
    share = lambda pattern: _ratio(F.length("t") - F.length(F.regexp_replace("t", pattern, "")), F.length("t"))
    return {
        "words": c("n_words").cast("double"),
        "word_length": _ratio(c("word_chars"), c("n_words")),
        "symbols_per_word": _ratio(c("n_symbols"), c("n_words")),
        "dup_lines": _ratio(c("n_dup_lines"), c("n_lines")),
        "repeat_words": _ratio(c("n_repeat_words"), c("n_words")),
        "words_per_line": _ratio(c("n_words"), c("n_lines")),
        "distinct_words": _ratio(F.size(F.array_distinct("w")), c("n_words")),
        "upper": share("[A-Z]+"),
        "digits": share("[0-9]+"),
        "punctuation": share("[.,;:!?]+"),
    }


@dataclass(frozen=True)
class Literal:
    """feature >= threshold, or feature < threshold."""

    feature: str
    above: bool
    threshold: float

    def column(self, columns: dict[str, Column]) -> Column:
        return columns[self.feature] >= self.threshold if self.above else columns[self.feature] < self.threshold


@dataclass
class DecisionList:
    """Ordered conjunctions that reject; what none covers is kept."""

    rules: list[tuple[Literal, ...]] = field(default_factory=list)

    def verdict(self, columns: dict[str, Column]) -> Column:
        """True: kept."""
        out = None
        for rule in self.rules:
            test = rule[0].column(columns)
            for literal in rule[1:]:
                test = test & literal.column(columns)
            out = F.when(test, False) if out is None else out.when(test, False)
        return F.lit(True) if out is None else out.otherwise(True)

    def __str__(self) -> str:
        return "; ".join("reject if " + " and ".join(f"{x.feature} {'>=' if x.above else '<'} {x.threshold:g}" for x in r) for r in self.rules) or "keep all"


def cover(rows: list[tuple[list[float], bool]], names: list[str]) -> DecisionList:
    """Sequential covering; rows are (feature values, is bad). Row sets are bit masks, so a literal costs one AND."""
    everything = (1 << len(rows)) - 1
    bad = sum(1 << i for i, (_, b) in enumerate(rows) if b)
    grow = sum(1 << i for i in range(len(rows)) if (i * 2654435761 >> 9) % 3)  # scattered: labels may follow the order of ids
    literals: list[tuple[Literal, int]] = []
    for k, name in enumerate(names):
        values = sorted(r[0][k] for r in rows)
        cuts = sorted({values[len(values) * q // THRESHOLDS] for q in range(1, THRESHOLDS)})
        for cut in cuts:
            mask = sum(1 << i for i, (v, _) in enumerate(rows) if v[k] >= cut)
            literals += [(Literal(name, True, cut), mask), (Literal(name, False, cut), everything & ~mask)]
    found, left = DecisionList(), everything
    while len(found.rules) < MAX_RULES:
        rule: list[tuple[Literal, int]] = []
        covered = left & grow
        while len(rule) < MAX_LITERALS and covered & ~bad:
            p0, n0 = (covered & bad).bit_count(), (covered & ~bad).bit_count()
            if not p0:
                break
            now = math.log2(p0 / (p0 + n0))
            best = max(literals, key=lambda x: (p := (covered & x[1] & bad).bit_count()) and p * (math.log2(p / (covered & x[1]).bit_count()) - now))
            if not (covered & best[1] & bad) or (covered & best[1]) == covered:
                break
            rule.append(best)
            covered &= best[1]

        def worth(part: list[tuple[Literal, int]], left: int = left) -> tuple[float, int]:
            area = left & ~grow
            for _, mask in part:
                area &= mask
            p, n = (area & bad).bit_count(), (area & ~bad).bit_count()
            return ((p + 1) / (p + n + 2), p)

        if not rule:
            break
        best_end = max(range(1, len(rule) + 1), key=lambda k: (round(worth(rule[:k])[0], 3), -k))
        rule = rule[:best_end]
        precision, hits = worth(rule)
        area = left
        for _, mask in rule:
            area &= mask
        if precision < MIN_PRECISION or (area & bad).bit_count() < MIN_COVERAGE * len(rows):
            break
        found.rules.append(tuple(x for x, _ in rule))
        left &= ~area
    return found


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DecisionList:
    """Learn from at most `sample_rows` labelled documents; the label column is `quality` (0: bad).

    Documents that the base check rejects teach nothing and are left out.
    """
    sample = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    named = features()
    # base_failed is tested here: a filter would push the window expressions into nested loops
    table = base_columns(with_words(chosen, "quality"))
    table = table.select("doc_id", "quality", "base_failed", *[v.alias(k) for k, v in named.items()])
    rows = sorted((r["doc_id"], [float(r[k]) for k in named], r["quality"] == 0) for r in table.collect() if not r["base_failed"])
    return cover([(v, b) for _, v, b in rows], list(named)) if rows else DecisionList()


def _fenced(df: DataFrame, *columns: str | Column) -> DataFrame:
    """A selection that filters are not pushed through: pushed, they would nest the window expressions in loops."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept, for every whole text."""
    df = base_columns(with_words(docs))
    kept = (~F.col("base_failed") & rules.verdict(features())).alias("kept")
    return _fenced(df, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept)


def keep(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The documents that `judge` keeps, in their own columns."""
    df = base_columns(with_words(docs.select("doc_id", "text", F.struct("*").alias("_row")), "_row"))
    kept = (~F.col("base_failed") & rules.verdict(features())).alias("_kept")
    return _fenced(df, "_row", kept).where("_kept").select("_row.*")
