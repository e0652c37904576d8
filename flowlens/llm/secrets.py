"""Secret scans with native expressions: fixed patterns plus windows of high character entropy.

Base patterns are matched by Spark's regular expressions. The entropy part takes candidate
strings (long runs over an alphabet), slides a window over each, keeps the counts of the window's
characters up to date by one step in and one step out, and marks windows whose Shannon entropy
reaches the threshold of the alphabet. Candidates that consist of words, numbers or alphabets are left out. Entropy is kept
as an integer sum of c*log2(c), so every engine finds the same windows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# The base patterns and the length each must reach.
ASSIGN = r"""((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
ASSIGN_LENGTH = 8

#: Weights c * log2(c) are rounded to this many parts.
SCALE = 1_000_000


@dataclass(frozen=True)
class Alphabet:
    """A character class: its letters in order, the window and the entropy (bits) a window must reach."""

    name: str
    letters: str
    window: int
    bits: float
    #: What a candidate has to hold besides.
    holds: str = ""

    @property
    def run(self) -> str:
        # A hyphen stands last in the letters, so they form a character class as they are.
        return f"(?<![{self.letters}])[{self.letters}]{{{self.window},}}+"

    @property
    def limit(self) -> int:
        """Largest sum of c*log2(c) of a window that still counts."""
        return math.floor(SCALE * self.window * (math.log2(self.window) - self.bits))


_BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: A URL-safe run has a hyphen or low line; others are base64 already.
ALPHABETS = (
    Alphabet("entropy_hex", "0123456789abcdef", 24, 3.2),
    Alphabet("entropy_base64", _BASE64 + "+/", 24, 4.1),
    Alphabet("entropy_hex_upper", "0123456789ABCDEF", 24, 3.2),
    Alphabet("entropy_urlsafe", _BASE64 + "_-", 24, 4.1, "[_-]"),
)

#: Allow list: candidates that look random but are none. Stock words and alphabets count only where
#: they make up the whole candidate, so that no random rest goes with them.
ALLOWED = (
    r"^[A-Za-z]?[a-z]*$",
    r"^[A-Z]*$",
    r"^[0-9]*$",
    r"^[A-Za-z]+/[A-Za-z/]*$",
    r"(?i)^(?:0123456789|abcdefghijklm|nopqrstuvwxyz|abcdef|example|sample|test|dummy|placeholder|[-_+/])+$",
)

KINDS = ("assign", "access", "hex", *(a.name for a in ALPHABETS))


def weights(window: int) -> list[int]:
    return [0, *(round(SCALE * c * math.log2(c)) for c in range(1, window + 1))]


def _found(text: Column, pattern: str) -> Column:
    """(start, word) of all matches, in code points; matches do not overlap."""
    pieces = F.split(text, pattern, -1)
    words = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(pieces.alias("before"), words.alias("word"))

    def block(part: Column, at: Column) -> Column:
        """Positions within some matches; `at` is where the first piece begins."""
        return F.aggregate(
            part,
            F.struct(at.alias("at"), F.array().cast("array<struct<start:int,word:string>>").alias("out")),
            lambda acc, m: F.struct(
                (acc["at"] + F.length(m["before"]) + F.coalesce(F.length(m["word"]), F.lit(0))).alias("at"),
                F.when(m["word"].isNull(), acc["out"])
                .otherwise(
                    F.concat(
                        acc["out"],
                        F.array(F.struct((acc["at"] + F.length(m["before"])).alias("start"), m["word"].alias("word"))),
                    )
                )
                .alias("out"),
            ),
        )

    # Matches are taken in blocks, so that appending costs no square of a text's matches.
    size = 256
    blocks = F.transform(
        F.sequence(F.lit(0), ((F.size(both) - 1) / size).cast("int")),
        lambda k: F.slice(both, k * size + 1, size),
    )
    walked = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,word:string>>>").alias("out")),
        lambda acc, part: F.transform(F.array(block(part, acc["at"])), lambda done: F.struct(
            done["at"].alias("at"), F.concat(acc["out"], F.array(done["out"])).alias("out")
        ))[0],
    )
    none = F.array().cast("array<struct<start:int,word:string>>")
    return F.when(text.rlike(pattern), F.flatten(walked["out"])).otherwise(none)


def _span(kind: str, start: Column, end: Column) -> Column:
    return F.struct(
        start.cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("order"), F.lit(kind).alias("kind"),
        end.cast("int").alias("end"),
    )


def _whole(kind: str, found: Column) -> Column:
    return F.transform(found, lambda m: _span(kind, m["start"], m["start"] + F.length(m["word"])))


def _hot_windows(word: Column, alphabet: Alphabet) -> Column:
    """(from, to) of the merged windows of a candidate that reach the threshold, end exclusive."""
    w = alphabet.window
    weight = F.array(*[F.lit(v) for v in weights(w)])
    letters = F.lit(alphabet.letters)
    number = lambda i: F.instr(letters, F.substring(word, i, F.lit(1)))
    spans = "array<struct<a:int,b:int>>"

    def step(acc: Column, i: Column) -> Column:
        come = number(i)
        gone = F.when(i > w, number(i - w)).otherwise(0)
        # One step: the sum changes only by the character that goes and the one that comes.
        held = acc["counts"][gone - 1]
        less = F.when(gone > 0, weight[held - 1] - weight[held]).otherwise(0)
        base = acc["counts"][come - 1] - F.when(gone == come, 1).otherwise(0)
        total = acc["total"] + less + weight[base + 1] - weight[base]
        counts = F.transform(
            acc["counts"],
            lambda c, j: c + F.when(j == come - 1, 1).otherwise(0) - F.when(j == gone - 1, 1).otherwise(0),
        )
        hot = (i >= w) & (total <= alphabet.limit)
        joined = hot & (acc["b"] >= i - w)
        return F.struct(
            counts.alias("counts"),
            total.cast("long").alias("total"),
            F.when(joined, acc["a"]).when(hot, i - w).otherwise(acc["a"]).cast("int").alias("a"),
            F.when(hot, i).otherwise(acc["b"]).cast("int").alias("b"),
            F.when(hot & ~joined & (acc["b"] > 0), F.concat(acc["out"], F.array(F.struct(acc["a"].alias("a"), acc["b"].alias("b")))))
            .otherwise(acc["out"])
            .alias("out"),
        )

    start = F.struct(
        F.array_repeat(F.lit(0), len(alphabet.letters)).alias("counts"),
        F.lit(0).cast("long").alias("total"),
        F.lit(-1).alias("a"),
        F.lit(-1).alias("b"),
        F.array().cast(spans).alias("out"),
    )
    return F.aggregate(
        F.sequence(F.lit(1), F.length(word)),
        start,
        step,
        lambda acc: F.when(acc["b"] > 0, F.concat(acc["out"], F.array(F.struct(acc["a"].alias("a"), acc["b"].alias("b"))))).otherwise(
            acc["out"]
        ),
    )


def _possessive(pattern: str) -> str:
    """The pattern without a way back into its repetitions, which long candidates would overflow the stack with."""
    return pattern.replace(")+$", ")++$")


def _entropy(text: Column, alphabet: Alphabet) -> Column:
    fit = lambda word: ~_any([word.rlike(_possessive(p)) for p in ALLOWED]) & (word.rlike(alphabet.holds) if alphabet.holds else F.lit(True))
    candidates = F.filter(_found(text, alphabet.run), lambda m: fit(m["word"]))
    return F.flatten(
        F.transform(
            candidates,
            lambda m: F.transform(
                _hot_windows(m["word"], alphabet),
                lambda s: _span(alphabet.name, m["start"] + s["a"], m["start"] + s["b"]),
            ),
        )
    )


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for condition in conditions[1:]:
        out = out | condition
    return out


def scan(docs: DataFrame, text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """Add `out_col`: all spans as structs (start, order, kind, end), sorted by start, then kind.

    Positions are code points, ends exclusive. Rows stay in place and are independent: a null or
    empty text has no spans, repeated rows repeat their spans, an empty table stays empty, other
    columns are kept and one named `out_col` is replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    assign = F.transform(
        F.filter(_found(text, "(?i)" + ASSIGN), lambda m: _value_length(m["word"]) >= ASSIGN_LENGTH),
        lambda m: _span("assign", m["start"], m["start"] + F.length(m["word"])),
    )
    spans = [
        assign,
        _whole("access", _found(text, ACCESS)),
        _whole("hex", _found(text, HEX)),
        *(_entropy(text, a) for a in ALPHABETS),
    ]
    return docs.withColumn(out_col, F.array_sort(F.concat(*spans)))


def _value_length(word: Column) -> Column:
    return F.length(F.regexp_extract(word, "(?i)^" + ASSIGN, 2))


def digests(scanned: DataFrame, spans: str = "secrets") -> DataFrame:
    """The columns of the check, from the spans."""
    base = ("assign", "access", "hex")
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda column: F.concat_ws(",", F.transform(column, shown))
    only = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *[only(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(joined(F.filter(spans, lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"),
        joined(F.col(spans)).alias("spans"),
    )


def oracle_sql() -> str:
    """The same spans in SQL; letters of the key words are spelled in both cases."""
    assign = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    assign = rf"""((?:{assign})["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
    patterns = {"assign": assign, "access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}"}
    patterns |= {a.name: f"[{a.letters}]{{{a.window},}}" for a in ALPHABETS}
    quote = lambda text: "'" + text.replace("'", "''") + "'"
    found = "\n  UNION ALL ".join(
        f"""SELECT doc_id, {quote(kind)} AS kind, {KINDS.index(kind)} AS ord, string_split_regex(t, {quote(p)}) AS gaps,
    regexp_extract_all(t, {quote(p)}) AS hits, {f"regexp_extract_all(t, {quote(p)}, 2)" if kind == "assign" else "NULL"} AS vals
  FROM texts WHERE regexp_matches(t, {quote(p)})"""
        for kind, p in patterns.items()
    )
    allowed = " OR ".join(f"regexp_matches(word, {quote(p)})" for p in ALLOWED)
    windows = "\n  UNION ALL ".join(
        f"""SELECT doc_id, kind, ord, start, i, {a.limit} AS most, {a.window} AS w, unnest(string_split(substr(word, i + 1, {a.window}), '')) AS ch,
    {weights(a.window)} AS weight
  FROM (SELECT *, unnest(range(0, length(word) - {a.window} + 1)) AS i FROM matches
        WHERE kind = {quote(a.name)}{f" AND regexp_matches(word, {quote(a.holds)})" if a.holds else ""} AND NOT ({allowed}))"""
        for a in ALPHABETS
    )
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  {found}
),
numbered AS (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM found),
matches AS (
  SELECT doc_id, kind, ord, hits[k] AS word, length(vals[k]) AS value_length,
         CAST(list_sum(list_transform(gaps[1:k], lambda g: length(g)))
           + coalesce(list_sum(list_transform(hits[1:k - 1], lambda h: length(h))), 0) AS BIGINT) AS start
  FROM numbered
),
letters AS (
  {windows}
),
counted AS (
  SELECT doc_id, kind, ord, start, i, any_value(most) AS most, any_value(w) AS w, any_value(weight) AS weight, ch, count(*) AS c
  FROM letters GROUP BY doc_id, kind, ord, start, i, ch
),
hot AS (
  SELECT doc_id, kind, ord, start, i, any_value(w) AS w FROM counted
  GROUP BY doc_id, kind, ord, start, i HAVING sum(weight[c + 1]) <= any_value(most)
),
breaks AS (
  SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id, ord, start ORDER BY i) <= w THEN 0 ELSE 1 END AS fresh FROM hot
),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, ord, start ORDER BY i) AS island FROM breaks),
spans AS (
  SELECT doc_id, kind, ord, start AS a, start + length(word) AS b FROM matches
  WHERE kind IN ('access', 'hex') OR kind = 'assign' AND value_length >= {ASSIGN_LENGTH}
  UNION ALL
  SELECT doc_id, any_value(kind), ord, start + min(i), start + max(i) + any_value(w) FROM islands GROUP BY doc_id, ord, start, island
),
joined AS (
  SELECT doc_id,
         count(*) FILTER (WHERE kind = 'assign') AS n_assign,
         count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ord) FILTER (WHERE ord < 3) AS base,
         string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, ord) AS spans
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN joined j USING (doc_id)
"""
