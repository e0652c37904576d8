"""Quality rules: a decision list learned from labelled statistics, applied as ordered conditions.

Counts of each text come from built-in expressions alone. They become whole-number features of a
bounded range, so the rows of every (feature, value, label) can be counted exactly, over all
labelled rows, by one small aggregation. Sequential covering grows a conjunction of thresholds by
the information gained on two thirds of the labelled rows, prunes it on the last third, takes the
rows it covers away and goes on with the rest. The list is one `when ... when ... otherwise`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.tables import settle

# Fixed values of the base rules.
SEPARATOR = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
REPEAT_PERCENT = 50
REPEAT_WIDTH = 3

#: Bounds of a list and of a rule; growing stops earlier when nothing more is gained.
MAX_RULES = 16
MAX_CONDITIONS = 6
#: Rows of its class that a rule has to cover among the growing rows.
MIN_COVER = 5
#: Of so many shares of the labelled rows, one is for pruning.
SHARES = 3

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "length", "word_length", "line_length", "symbols", "capitals", "digits", "marks", "dup_lines", "repeats", "distinct",
)


@dataclass(frozen=True)
class Condition:
    """`feature >= bound`, or `feature <= bound` where `above` is false."""

    feature: str
    above: bool
    bound: int

    def column(self) -> Column:
        return F.col(self.feature) >= self.bound if self.above else F.col(self.feature) <= self.bound

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.bound}"


@dataclass(frozen=True)
class Rule:
    """A conjunction and the class of the rows that meet it."""

    conditions: tuple[Condition, ...]
    good: bool

    def column(self) -> Column:
        return conjunction(self.conditions)

    def __str__(self) -> str:
        return f"{'keep' if self.good else 'drop'} if {' and '.join(map(str, self.conditions))}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first that a row meets decides, and `default` where none does."""

    rules: tuple[Rule, ...]
    default: bool

    def column(self) -> Column:
        if not self.rules:
            return F.lit(self.default)
        verdict = F.when(self.rules[0].column(), F.lit(self.rules[0].good))
        for rule in self.rules[1:]:
            verdict = verdict.when(rule.column(), F.lit(rule.good))
        return verdict.otherwise(F.lit(self.default))

    def __str__(self) -> str:
        return "\n".join([*map(str, self.rules), f"otherwise {'keep' if self.default else 'drop'}"])


def conjunction(conditions: Sequence[Condition]) -> Column:
    out = F.lit(True)
    for condition in conditions:
        out = out & condition.column()
    return out


def measure(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """`keep` plus the counts of BASE and the whole-number features, a row per row; texts stay behind.

    A null text counts as empty: all counts 0. Memory of a task is some tens of bytes for each byte
    of its longest text. Repeated rows are measured alike, empty tables stay empty; columns of the
    input that are not kept may have any name.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*[F.col(c).alias(f"__keep_{c}") for c in keep], text.alias("text"))
    # Each step names what the next ones use more than once; Catalyst does not inline those.
    rows = rows.select("*", F.split("text", SEPARATOR, -1).alias("pieces"), F.split("text", "\n", -1).alias("all_lines"))
    rows = rows.select(
        "*",
        F.array_remove("pieces", "").alias("words"),
        F.filter("all_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    w = F.col("words")
    gram = lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(REPEAT_WIDTH)])
    rows = rows.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.sort_array(
            F.when(
                F.size(w) > REPEAT_WIDTH,
                F.transform(
                    F.sequence(F.lit(0), F.greatest(F.size(w) - REPEAT_WIDTH, F.lit(0))),
                    lambda i: F.struct(gram(i).alias("k"), i.alias("i")),
                ),
            ).otherwise(F.array().cast("array<struct<k:string,i:int>>"))
        ).alias("grams"),
    )
    g = F.col("grams")
    # Equal windows stand side by side once sorted; those with an equal neighbour occur twice or more.
    same = lambda x, j: F.coalesce(F.get(g, j)["k"] == x["k"], F.lit(False))
    twice = F.filter(g, lambda x, j: same(x, j - 1) | same(x, j + 1))
    covered = F.flatten(F.transform(twice, lambda x: F.array(*[x["i"] + k for k in range(REPEAT_WIDTH)])))
    rows = rows.select(
        *[F.col(f"__keep_{c}").alias(c) for c in keep],
        "n_words",
        (F.length("text") - F.size("pieces") + 1).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(covered)).cast("long").alias("n_repeat_words"),
        F.length("text").cast("long").alias("__chars"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("__capitals"),
        F.regexp_count("text", F.lit("[0-9]")).cast("long").alias("__digits"),
        F.regexp_count("text", F.lit(r"[!?;:]")).cast("long").alias("__marks"),
        F.size("lines").cast("long").alias("__lines"),
        F.size(F.array_distinct("words")).cast("long").alias("__distinct"),
    )
    return rows.select(*keep, *BASE, *features())


def features() -> list[Column]:
    """Whole numbers of a bounded range: thousandths, and logarithms in parts of 1/64."""
    share = lambda a, b: F.expr(f"1000 * `{a}` DIV greatest(1, `{b}`)").cast("int")
    log = lambda x: F.floor(64 * F.log2(1 + x)).cast("int")
    one = F.lit(1)
    return [
        log(F.col("n_words")).alias("length"),
        log(F.col("word_chars") / F.greatest(one, "n_words")).alias("word_length"),
        log(F.col("n_words") / F.greatest(one, "__lines")).alias("line_length"),
        share("n_symbols", "__chars").alias("symbols"),
        share("__capitals", "word_chars").alias("capitals"),
        share("__digits", "word_chars").alias("digits"),
        share("__marks", "word_chars").alias("marks"),
        share("n_dup_lines", "__lines").alias("dup_lines"),
        share("n_repeat_words", "n_words").alias("repeats"),
        share("__distinct", "n_words").alias("distinct"),
    ]


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def labelled(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Features of the rows that have a label, with `good` (0 or 1) and `pruning`.

    Of several labels of an id the smallest counts; null ids and null labels give none. The share
    for pruning is picked by a hash of the id.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("good")).where("__id IS NOT NULL AND good IS NOT NULL")
    known = known.groupBy("__id").agg(F.min("good").alias("good"))
    joined = measured.join(known, F.col(id_col) == F.col("__id"))
    pruning = F.pmod(F.xxhash64("__id"), F.lit(SHARES)) == 0
    return joined.select(*FEATURES, (F.col("good") > 0).cast("int").alias("good"), pruning.alias("pruning"))


def value_counts(rows: DataFrame, names: Sequence[str]) -> dict[str, list[tuple[int, int, int]]]:
    """By feature: (value, good rows, bad rows) in order of the value.

    At most some thousand values a feature, as features are bounded; it does not grow with the rows.
    """
    stacked = rows.select("good", F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("v")) for n in names])).alias("x"))
    counted = stacked.groupBy("x.f", "x.v").agg(F.sum("good").alias("g"), F.count("*").alias("n")).collect()
    out: dict[str, list[tuple[int, int, int]]] = {n: [] for n in names}
    for f, v, g, n in sorted(map(tuple, counted)):
        out[f].append((v, g, n - g))
    return out


def best_condition(counts: dict[str, list[tuple[int, int, int]]], good: bool, least: int = MIN_COVER) -> tuple[float, Condition, int, int] | None:
    """(gain, condition, rows of the class, others) with the highest gain of information.

    Bounds lie halfway between two neighbouring values. Equal gains go to the earlier feature, then
    `>=`, then the smaller bound. None where no condition leaves rows of the other class out.
    """
    best = None
    for name, values in counts.items():
        wins = [g if good else b for _, g, b in values]
        rest = [b if good else g for _, g, b in values]
        p0, n0 = sum(wins), sum(rest)
        if not p0 or not n0:
            return None
        before = math.log2(p0 / (p0 + n0))
        tried = []
        p, n = p0, n0
        for i in range(1, len(values)):
            p, n = p - wins[i - 1], n - rest[i - 1]
            middle = (values[i - 1][0] + values[i][0] + 1) // 2
            tried.append((True, middle, p, n))
            tried.append((False, middle - 1, p0 - p, n0 - n))
        for above, bound, p, n in sorted(tried, key=lambda t: (not t[0], t[1])):
            if p < least:
                continue
            gain = p * (math.log2(p / (p + n)) - before)
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                best = (gain, Condition(name, above, bound), p, n)
    return best


def grow(rows: DataFrame, good: bool) -> list[Condition]:
    """Conditions added one by one until no row of the other class is covered or nothing is gained."""
    found: list[Condition] = []
    while len(found) < MAX_CONDITIONS:
        best = best_condition(value_counts(rows.where(conjunction(found)), FEATURES), good)
        if best is None:
            break
        found.append(best[1])
        if best[3] == 0:
            break
    return found


def prune(rows: DataFrame, conditions: Sequence[Condition], good: bool) -> list[Condition]:
    """The first conditions, as many as give the best (p - n) / (p + n) on the pruning rows; none if that is not above 0."""
    if not conditions:
        return []
    own = F.col("good") == int(good)
    sums = []
    for k in range(1, len(conditions) + 1):
        met = conjunction(conditions[:k])
        sums += [F.count_if(met & own).alias(f"p{k}"), F.count_if(met & ~own).alias(f"n{k}")]
    row = rows.agg(*sums).first()
    worth = [(row[f"p{k}"] - row[f"n{k}"]) / max(1, row[f"p{k}"] + row[f"n{k}"]) for k in range(1, len(conditions) + 1)]
    best = max(worth)
    return list(conditions[: worth.index(best) + 1]) if best > 0 else []


def learn(rows: DataFrame, max_rules: int = MAX_RULES) -> DecisionList:
    """A decision list from labelled features (FEATURES, good, pruning), over all of them.

    Each round grows and prunes a rule for the rarer class of the rows left, and ends when only one
    class is left or a rule does not hold on the pruning rows. The commoner class of the rows left
    is the default. Without labels of both classes there are no rules, and every row is kept.
    """
    rules: list[Rule] = []
    left = rows
    while True:
        counted = {(r.good, r.pruning): r["count"] for r in left.groupBy("good", "pruning").count().collect()}
        total = [sum(n for (g, _), n in counted.items() if g == c) for c in (0, 1)]
        if not rules and not all(total):
            return DecisionList((), True)
        default = total[1] >= total[0]
        if not all(total) or len(rules) == max_rules:
            return DecisionList(tuple(rules), default)
        good = not default
        conditions = prune(left.where("pruning"), grow(left.where("NOT pruning"), good), good)
        if not conditions:
            return DecisionList(tuple(rules), default)
        rules.append(Rule(tuple(conditions), good))
        left = left.where(~rules[-1].column())


def judge(measured: DataFrame, decisions: DecisionList) -> DataFrame:
    """Measured rows with `base_failed` and `kept`: false where the base rules fail, else the list's verdict."""
    failed = base_failed()
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & decisions.column())


def quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> tuple[DataFrame, DecisionList]:
    """The judged rows (id, BASE, features, base_failed, kept) of all documents, and the list learned.

    Texts are read once and never moved: the counts are settled and serve learning and judging.
    Rows of null or repeated ids are judged like any other; null texts fail the base rules; empty
    tables give no rows, and missing labels an empty list.
    """
    measured = settle(measure(docs.withColumnRenamed(id_col, "__rule_id"), text_col, ["__rule_id"]).withColumnRenamed("__rule_id", id_col), "measured")
    known = settle(labelled(measured, labels, id_col, label_col), "labelled")
    decisions = learn(known)
    return judge(measured, decisions), decisions
