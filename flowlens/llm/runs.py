"""Runs of repeated word sequences inside texts, found by seeds on diagonals.

A run of period q and enough length has two equal word sequences q words apart whose length is
guaranteed: 16 words for periods up to 16, 32 for those up to 32, and so on, never less than the
period. Word sequences of these lengths are named by doubling (a sequence of 2k words is a pair of
names of k words), so equal names are equal words. Occurrences of a name that follow each other in a
text give the seeds (place, lag) on the diagonal of their lag; within a run of that period no
occurrence lies between. Each seed is extended to both sides unless the table of its lag says that
the place is covered already, so no stretch is walked twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Least words of a run, and least periods in it.
MIN_WORDS = 24
MIN_PERIODS = 3
#: Rows of a batch that are unpacked at a time.
SLICE = 256

_RUN = "array<struct<start:long,length:long,period:long>>"
_FIELD = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def guaranteed(min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> int:
    """Words that two places a period apart share at least, whatever the period; never less than 1."""
    return max(1, min(max(min_words - q, (min_periods - 1) * q) for q in range(1, min_words + 1)))


def names(numbers: np.ndarray, width: int) -> np.ndarray:
    """Names of all `width`-word sequences, from the names of single words: equal names, equal words."""
    held, k = numbers, 1
    while k < width:
        step = min(k, width - k)
        held = pairs(held[: len(held) - step], held[step:])
        k += step
    return held


def pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of pairs of names."""
    if not len(left):
        return left
    return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1]


def seeds(named: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of neighbouring occurrences of a name with a lag above `low` and up to `high`, by place."""
    order = np.argsort(named, kind="stable")
    lag = np.diff(order)
    fit = (named[order[1:]] == named[order[:-1]]) & (lag > low) & (lag <= high)
    place, lag = order[:-1][fit], lag[fit]
    by_place = np.argsort(place, kind="stable")
    return place[by_place], lag[by_place]


def reach(words: np.ndarray, place: int, lag: int) -> int:
    """How many words from `place` on equal those `lag` further on, looked at in growing blocks."""
    n, at, block = len(words), place, 64
    while at + lag < n:
        stop = min(at + block, n - lag)
        differ = np.flatnonzero(words[at:stop] != words[at + lag : stop + lag])
        if len(differ):
            return at + int(differ[0]) - place
        at, block = stop, block * 2
    return at - place


def back(words: np.ndarray, place: int, lag: int) -> int:
    """How many words before `place` equal those `lag` further on."""
    at, block = place, 64
    while at > 0:
        start = max(0, at - block)
        differ = np.flatnonzero(words[start:at] != words[start + lag : at + lag])
        if len(differ):
            return place - (start + int(differ[-1]) + 1)
        at, block = start, block * 2
    return place - at


def find(words: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word numbers, by start, then period."""
    n = len(words)
    found: list[tuple[int, int, int]] = []
    if n < min_words:
        return found
    width, low = guaranteed(min_words, min_periods), 0
    named = names(words, width)
    while len(named):
        furthest: dict[int, int] = {}
        for place, lag in zip(*(x.tolist() for x in seeds(named, low, width))):
            if place < furthest.get(lag, 0):
                continue
            ahead, behind = reach(words, place, lag), back(words, place, lag)
            furthest[lag] = place + ahead
            length = behind + ahead + lag
            if length >= max(min_words, min_periods * lag):
                found.append((place - behind, length, lag))
        low, width = width, 2 * width
        if low * min_periods >= n or len(np.unique(named)) == len(named):
            break
        named = pairs(named[: max(0, len(named) - low)], named[low:])
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run contains after its first period, joined by one space."""
    if not found:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    left = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return b" ".join([words[i] for i in left.tolist()])


def find_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    min_periods: int = MIN_PERIODS,
) -> DataFrame:
    """A row per row: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    Words are runs of bytes that are no white space of ASCII. A run is a stretch with smallest
    period q, of `min_words` words and `min_periods` periods at least, that no neighbouring word
    extends. Rows are independent and nothing is shuffled: a null or empty text has no words, no runs
    and collapses to an empty text, repeated rows repeat their runs, empty tables stay empty,
    null ids stay null, other columns of any name are not read. Memory of a task is some hundred bytes
    for each word of its longest text. `min_periods` is 3 at least.
    """
    if min_periods < 3:
        raise ValueError("shared words of runs of fewer than three periods may be too few for a seed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                counts, found, kept = [], [], []
                for text in part.column(1):
                    words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                    runs = find(numbered(words), min_words, min_periods) if len(words) >= min_words else []
                    counts.append(len(words))
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                    kept.append(collapsed(words, runs).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(found, _FIELD), pa.array(kept, pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id long, n_words long, runs {_RUN}, collapsed string"
    )


def digests(found: DataFrame) -> DataFrame:
    """The columns of the check: the run of the greatest length / period, and digests of runs and words."""
    # a/b > c/d as a*d > c*b, so that the comparison is exact; ties keep the earlier run.
    top = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))),
        F.get("runs", F.lit(0)),
        lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best),
    )
    shown = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.withColumn("top", top)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.expr("1000 * top.length DIV top.period").alias("exponent_milli"),
        F.sha2(F.array_join(shown, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of the check: in one of ten, picked by the id, words from some place on repeat a period."""
    h = F.crc32(F.col(id_col).cast("string"))
    words = F.array_remove(F.split(F.col(text_col).cast("string"), r"[\x20\x09-\x0D]", -1), "")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.when(h % 10 == 0, words).alias("words"),
        F.floor(h / 10).alias("g"),
    )
    n = F.size("words").cast("long")
    rows = rows.select("*", n.alias("n"), F.when(n > 0, F.col("g") % n).alias("a"))
    rows = rows.select("*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).alias("p"))
    place = lambda i: F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i)
    moved = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", place(i).cast("int"))), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, moved).otherwise(F.col("text")).alias("text"))


def oracle_sql(min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> str:
    """The same by all pairs of equal word sequences of one document, joined along their diagonals."""
    k = guaranteed(min_words, min_periods)
    gram = f"array_to_string(w[i + 1:i + {k}], ' ')"
    crc = "".join(
        [
            # CRC-32 of the decimal digits, bit by bit.
            "list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), ",
            "lambda c: [ascii(c) + 4294967296, 0, 0, 0, 0, 0, 0, 0, 0]))), lambda x, y: CASE WHEN y >= 4294967296 ",
            "THEN xor(x, y - 4294967296) WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)",
        ]
    )
    return rf"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o, xor(CAST({crc} AS BIGINT), 4294967295) AS h FROM documents
),
params AS (SELECT *, CAST(len(o) AS BIGINT) AS n, h // 10 AS g FROM texts),
planted AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM params),
placed AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM planted),
words AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN o
    ELSE list_transform(range(0, n), lambda i: CASE WHEN i >= a THEN o[a + (i - a) % p + 1] ELSE o[i + 1] END) END AS w
  FROM placed
),
grams AS (SELECT doc_id, n, i, {gram} AS k FROM (SELECT *, unnest(range(0, n - {k} + 1)) AS i FROM words WHERE n >= {min_words})),
again AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM grams) WHERE c > 1),
seeds AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM again x JOIN again y ON x.doc_id = y.doc_id AND x.k = y.k
  AND y.i > x.i AND (y.i - x.i) * {min_periods} <= x.n
),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM seeds),
stretches AS (SELECT doc_id, q, min(i) AS start, max(i) - min(i) + {k} + q AS length FROM islands GROUP BY doc_id, q, island),
runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest({min_words}, {min_periods} * q)
  GROUP BY doc_id, start, length
),
summed AS (
  SELECT doc_id, count(*) AS n_runs,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS shown,
    list({{'start': start, 'length': length, 'period': period}} ORDER BY start, period) AS held
  FROM runs GROUP BY doc_id
),
ranked AS (
  SELECT x.* FROM runs x WHERE NOT EXISTS (
    SELECT 1 FROM runs y WHERE y.doc_id = x.doc_id AND (y.length * x.period > x.length * y.period
      OR (y.length * x.period = x.length * y.period AND (y.start < x.start OR (y.start = x.start AND y.period < x.period))))
  )
),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.i) AS t
  FROM (SELECT doc_id, unnest(range(0, n)) AS i, unnest(w) AS word FROM words) e
  LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i WHERE g.i IS NULL GROUP BY e.doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, r.start, r.length, r.period,
       1000 * r.length // r.period AS exponent_milli,
       sha256(coalesce(shown, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN summed s ON d.doc_id = s.doc_id LEFT JOIN ranked r ON d.doc_id = r.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
