"""Interaction of text filters: what each removes in every order they can be applied in.

Whether a text repeats one of a smaller id is found with a counting Bloom filter: each text adds
one to a few cells of a block; partial counts are made next to the scan and merged by the
aggregation. A text with a cell of its own is unique for certain and takes no further part. Only the
possible repeats move their full texts, to find the smallest id of each text exactly. All filters
of a row become one bit mask; rows are counted by part and mask, and every order of the filters is
read off those counts alone.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.tables import BROADCAST_BYTES, settle

SEPARATOR = r"[\x20\x09-\x0D]"
FILTERS = "ABCDE"
REPEAT = FILTERS.index("E")

#: Cells of a block (the bits of a long), cells a text adds to, and texts a block is made for.
CELLS = 64
HASHES = 3
TEXTS_PER_BLOCK = 4
#: Bytes of a possible repeat's id and hash in a broadcast table.
ROW_BYTES = 64


def content_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, h1, h2, mask) of each row: the bits of filters A to D and two hashes of the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        text.alias("text"),
    )
    rows = rows.select("*", F.array_remove(F.split("text", SEPARATOR, -1), "").alias("words"))
    n = F.size("words").cast("long")
    failing = [
        n < 50,
        100 * F.size(F.array_distinct("words")).cast("long") < 65 * n,
        100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 5 * F.length("text").cast("long"),
        F.col("text").rlike("[#$%&*|]"),
    ]
    mask = sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(failing)), F.lit(0))
    return rows.select("doc_id", "part", *_hashes(F.col("text")), mask.cast("int").alias("mask"))


def _hashes(text: Column) -> list[Column]:
    # The literal comes first, so that the second hash is no function of the first.
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def _cells() -> Column:
    """The distinct cells of a text in its block, from bits of the second hash."""
    bits = CELLS.bit_length() - 1
    return F.array_distinct(F.array(*[F.shiftrightunsigned("h2", bits * k).bitwiseAND(F.lit(CELLS - 1)).cast("int") for k in range(HASHES)]))


def crowded_cells(rows: DataFrame, blocks: int) -> DataFrame:
    """The merged sketch: (block, crowded), the bits of the cells that two rows or more added to."""
    added = rows.select(F.pmod("h1", F.lit(blocks)).alias("block"), F.explode(_cells()).alias("cell"))
    counted = added.groupBy("block", "cell").agg(F.count("*").alias("n")).where("n > 1")
    return counted.groupBy("block").agg(F.bit_or(F.expr("shiftleft(1L, cell)")).alias("crowded"))


def possible_repeats(rows: DataFrame) -> DataFrame:
    """(doc_id, h1, h2) of the rows whose cells are all crowded; no repeated text is missing.

    Rows without an id are no repeat and make none, so they stay out.
    """
    rows = rows.where("doc_id IS NOT NULL").select("doc_id", "h1", "h2")
    blocks = max(1, -(-rows.count() // TEXTS_PER_BLOCK))
    sketch = settle(crowded_cells(rows, blocks), "sketch")
    own = F.aggregate(_cells(), F.lit(0).cast("long"), lambda acc, c: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), c)))
    met = rows.withColumn("block", F.pmod("h1", F.lit(blocks))).withColumn("own", own).join(sketch, "block")
    return met.where("(own & crowded) = own").select("doc_id", "h1", "h2").distinct()


def repeats(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", bytes_limit: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, h1, h2) of the rows whose text stands at a smaller id, too.

    Possible repeats are looked up in the scan of the texts by a broadcast table of a checked size,
    by a shuffled join beyond it. Then the smallest id of every full text is found by aggregation.
    """
    possible = settle(possible_repeats(rows), "possible")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).where("doc_id IS NOT NULL")
    texts = texts.select("doc_id", "text", _hashes(F.col("text"))[0])
    small = possible.count() * ROW_BYTES <= bytes_limit
    wanted = possible.select("doc_id", "h1")
    held = texts.join(F.broadcast(wanted) if small else wanted.hint("merge"), ["doc_id", "h1"], "left_semi")
    first = held.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", *_hashes(F.col("text")))
    return possible.join(settle(first, "first"), ["doc_id", "h1", "h2"], "left_anti")


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, mask) of each row, all five filters in the mask."""
    rows = settle(content_masks(docs, id_col, text_col, part_col), "masks")
    again = settle(repeats(docs, rows, id_col, text_col), "repeats").withColumn("again", F.lit(1 << REPEAT))
    joined = rows.join(again, ["doc_id", "h1", "h2"], "left")
    return joined.select("doc_id", "part", F.col("mask").bitwiseOR(F.coalesce("again", F.lit(0))).cast("int").alias("mask"))


def mask_counts(masked: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): rows by part and mask, and those of them with quality 1 and with toxic 1.

    An id counts as good or toxic if any of its labels says so.
    """
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long")).alias("toxic"),
    )
    return masked.join(known, "doc_id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
        F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"),
    )


def _steps() -> Column:
    """All steps of all orders: (filter_order, step, own bit, bits of the filters before)."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            own = 1 << FILTERS.index(letter)
            rows.append({"filter_order": "".join(order), "step": step, "own": own, "before": before})
            before |= own
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order:string,step:int,own:int,before:int>>")


def orders(counts: DataFrame) -> DataFrame:
    """A row per part, order and step, from at most 32 counts a part."""
    each = counts.select("*", F.explode(_steps()).alias("s"))
    mask, own, before = F.col("mask"), F.col("s.own"), F.col("s.before")
    fails = mask.bitwiseAND(own) != 0
    alive = mask.bitwiseAND(before) == 0
    among = lambda what, column: F.sum(F.when(what, F.col(column)).otherwise(0)).cast("long")
    first = F.expr("CASE WHEN mask = 0 THEN 0 ELSE n * (120 DIV bit_count(mask)) END")
    # Among the orders of all filters, each failing filter comes first in an equal share of them.
    return each.groupBy("part", F.col("s.filter_order").alias("filter_order"), F.col("s.step").alias("step")).agg(
        among(alive & ~fails, "n").alias("kept"),
        among(alive & fails, "n").alias("removed"),
        among(~alive & fails, "n").alias("redundant"),
        among(mask == own, "n").alias("unique_fails"),
        among(alive & fails, "good").alias("good_lost"),
        among(alive & fails, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, first).otherwise(0)).cast("long").alias("shapley"),
    )


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """One row per part, order of the five filters and step; see `orders` for the columns.

    Null texts are empty, null parts the empty string. Rows without an id are counted, repeat
    nothing and have no labels; rows of one id and one text do not repeat each other; rows of one
    id are counted each. Ties are settled by the smallest id. Empty tables give no rows, and other
    columns of any name are not read.
    """
    return orders(mask_counts(masks(docs, id_col, text_col, part_col), labels, id_col))


def oracle_sql() -> str:
    letters = ", ".join(f"('{c}', {1 << k})" for k, c in enumerate(FILTERS))
    picks = " ".join(f"JOIN letters l{k} ON {' AND '.join(f'l{k}.bit <> l{j}.bit' for j in range(k))}" for k in range(1, 5))
    steps = " UNION ALL ".join(
        f"""SELECT {' || '.join(f'l{j}.letter' for j in range(5))} AS filter_order, {k + 1} AS step, l{k}.bit AS own,
    {' + '.join([f'l{j}.bit' for j in range(k)] or ['0'])} AS before FROM letters l0 {picks}"""
        for k in range(5)
    )
    words = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
    return f"""
WITH letters(letter, bit) AS (VALUES {letters}),
steps AS ({steps}),
texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, {words} AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM texts),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
          FROM labels GROUP BY doc_id),
masked AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN first_id < doc_id THEN 16 ELSE 0 END AS mask
  FROM split LEFT JOIN known USING (doc_id)
),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masked GROUP BY part, mask)
SELECT part, filter_order, step,
       CAST(sum(CASE WHEN mask & before = 0 AND mask & own = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
       CAST(sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
       CAST(sum(CASE WHEN mask & before <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
       CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
       CAST(sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
       CAST(sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
       CAST(sum(CASE WHEN mask & own <> 0 THEN n * (120 // bit_count(mask)) ELSE 0 END) AS BIGINT) AS shapley
FROM counts JOIN steps ON true GROUP BY part, filter_order, step
"""
