"""Removal of boilerplate lines by the number of distinct sites they stand on.

Each line that is not empty gets a 128-bit hash. HyperLogLog sketches of the sites are built per
hash next to the scan and merged by the aggregation, so a line of any frequency costs one small
sketch per task.
Lines whose estimate is clearly above the threshold are boilerplate; lines within the error of the
sketch are counted exactly, over their distinct (line, site) pairs only. Everything is built-in
expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.tables import settle, unused

#: A line is boilerplate from so many sites on, or from so many hundredths of all sites where that is less.
MIN_SITES = 10
SITE_PERCENT = 80
#: Shorter lines, without the white space around them, must also occur more often: for each missing
#: character, as many times again as a line needs sites.
MIN_CHARS = 12
#: log2 of the sketch registers: a relative standard error of 1.6 %.
REGISTERS = 12
#: Relative half-width of the band that is counted exactly: five standard errors.
BAND = 0.082


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def sites_needed(docs: DataFrame, site_col: str = "source", min_sites: int = MIN_SITES) -> int:
    """`min_sites`, or SITE_PERCENT of the distinct sites where that is less; never below two."""
    enough = -(-min_sites * 100 // SITE_PERCENT)
    found = docs.select(F.col(site_col).cast("string").alias("site")).where("site IS NOT NULL").distinct().limit(enough).count()
    return max(2, min(min_sites, -(-found * SITE_PERCENT // 100)))


def boilerplate(
    docs: DataFrame, site_col: str = "source", text_col: str = "text", min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS
) -> DataFrame:
    """(h1, h2) of the lines that stand on enough distinct sites, and often enough for their length.

    Null sites count for none; how many sites are enough says `sites_needed`. A line of `min_chars`
    characters or more needs as many occurrences as sites, so only shorter ones need more.
    """
    needed = sites_needed(docs, site_col, min_sites)
    each = docs.select(
        F.col(site_col).cast("string").alias("site"), F.explode(_lines(F.col(text_col).cast("string"))).alias("line")
    )
    each = each.where("site IS NOT NULL").withColumn("line", _key(F.col("line"))).where("line != ''")
    each = _hashed(each).withColumn("least", needed * F.greatest(F.lit(1), min_chars + 1 - F.length("line"))).drop("line")
    spread = settle(
        each.groupBy("h1", "h2")
        .agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(REGISTERS))).alias("sites"),
            F.count("*").alias("times"),
            F.max("least").alias("least"),
        )
        .where((F.col("sites") >= int(needed * (1 - BAND))) & (F.col("times") >= F.col("least"))),
        "spread",
    )
    sure = spread.where(F.col("sites") > needed * (1 + BAND) + 1).select("h1", "h2")
    near = spread.where(F.col("sites") <= needed * (1 + BAND) + 1).select("h1", "h2")
    exact = (
        each.join(near, ["h1", "h2"], "left_semi")
        .select("h1", "h2", "site")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("sites"))
        .where(F.col("sites") >= needed)
        .select("h1", "h2")
    )
    return settle(sure.unionByName(exact), "boilerplate")


def _key(line: Column) -> Column:
    """The line without white space of ASCII at its ends."""
    return F.btrim(line, F.lit(" \t\r\x0b\x0c"))


def _hashed(df: DataFrame) -> DataFrame:
    # The hash is chained over its arguments: only with the literal first is h2 no function of h1.
    return df.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line"))


def drop_boilerplate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = MIN_SITES,
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """The documents with boilerplate lines taken out of their texts, plus n_lines and n_removed.

    A line is compared without white space at its ends. All rows and columns stay; columns named
    n_lines and n_removed are replaced. A null text stays null with 0 lines; the lines of an empty
    text are one empty line. A null site counts for no site; null and repeated ids are allowed, as
    rows are matched by id and text: rows equal in both lose the same lines. A text of which
    nothing is left becomes empty. Empty tables stay empty.
    """
    lines = boilerplate(docs, site_col, text_col, min_sites, min_chars)
    text = F.col(text_col).cast("string")
    kept = docs.drop("n_lines", "n_removed")
    key, own_id, own_text, own_places = unused(kept, "__boiler_key", "__boiler_id", "__boiler_text", "__boiler_places")
    keyed = kept.withColumn(key, F.xxhash64(text))
    each = keyed.select(
        F.col(id_col).alias(own_id), F.col(key).alias(own_text), F.posexplode(_lines(text)).alias("place", "line")
    )
    each = _hashed(each.withColumn("line", _key(F.col("line"))).where("line != ''")).drop("line")
    gone = (
        each.join(lines, ["h1", "h2"])
        .groupBy(own_id, own_text)
        .agg(F.collect_set("place").alias(own_places))
    )
    gone = settle(gone, "gone")
    joined = keyed.join(gone, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_text)), "left")
    parts = _lines(text)
    places = F.sequence(F.lit(0), F.size(parts) - 1)
    left = F.array_join(F.transform(F.array_except(places, own_places), lambda i: F.get(parts, i)), "\n")
    return (
        joined.withColumn("n_lines", F.coalesce(F.when(text.isNotNull(), F.size(parts)), F.lit(0)).cast("long"))
        .withColumn("n_removed", F.coalesce(F.when(F.col(own_places).isNotNull(), F.size(own_places)), F.lit(0)).cast("long"))
        .withColumn(text_col, F.when(F.col(own_places).isNull(), text).otherwise(left))
        .drop(own_id, key, own_places, own_text)
    )


def oracle_sql(min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> str:
    return rf"""
WITH needed AS (
  SELECT greatest(2, least({min_sites}, (count(DISTINCT source) * {SITE_PERCENT} + 99) // 100)) AS sites FROM documents
),
split AS (
  SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents
),
each AS (
  SELECT doc_id, source, generate_subscripts(lines, 1) AS place, unnest(lines) AS line FROM split
),
keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS k FROM each),
spread AS (
  SELECT k FROM keyed, needed WHERE k <> '' AND source IS NOT NULL
  GROUP BY k, sites
  HAVING count(DISTINCT source) >= sites AND count(*) >= sites * greatest(1, {min_chars} + 1 - length(k))
),
cut AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE s.k IS NOT NULL) AS n_removed,
         string_agg(line, chr(10) ORDER BY place) FILTER (WHERE s.k IS NULL) AS kept
  FROM keyed LEFT JOIN spread s ON keyed.k = s.k
  GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN cut ON d.doc_id = cut.doc_id
"""
