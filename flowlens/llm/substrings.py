"""Removal of repeated passages by a relative Lempel-Ziv parse against indexed reference blocks.

A text is cut into phrases at content-defined anchors: the
smallest hash among the short word groups of a window picks the anchor, so two equal windows have
equal anchors wherever they stand, and every window belongs to the one phrase that holds it
together with its anchor. A text can share a window only with phrases of the same anchor; these
are its reference, and anchors are dealt into blocks of bounded size.

A phrase that stands elsewhere as a whole is one factor, known from counts of phrase hashes. Where
the anchor is known but the words differ from every other phrase of that anchor, the phrase goes to
the block of its anchor and is factored there: the block lines its phrases up at their anchors, and
from the first window that lies in no factor yet the longest match with any other phrase becomes the
next factor. Factors shorter than a window are dropped. The next factor starts at the first window
that reaches over the end of the last one, so windows on factor boundaries are checked as well.
Phrases whose anchor occurs in more different phrases than a block may hold are checked by counts of
(anchor, window), one window at a time. Phrases with an anchor of their own are never looked at again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm import words as W
from flowlens.llm.tables import BROADCAST_BYTES, documents, release, settle

WORDS = "space"
WINDOW = 35
#: Words of an anchor.
ANCHOR = 6

#: Phrases of a block, on average, and different phrases of one anchor that a block may hold.
BLOCK = 8192
WIDE = 4096
#: Bytes a word up to which a phrase travels as text, which compresses, and not as word hashes.
LETTERS = 12

#: Phrase found elsewhere as a whole; phrase to factor; whole phrase that also stands for its copies as reference.
FULL, BOUNDARY, REFERENCE = 1, 2, 3

_U = np.uint64
_BASE = 0xC2B2AE3D27D4EB4F
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=2)
def _ladder(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    out = []
    for base in (_BASE, _INVERSE):
        powers = np.full(n, base, _U)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


class Parse:
    """Phrases of a run of documents."""

    def __init__(self, raw: list[bytes], width: int):
        self.buf, self.starts, self.ends, self.bounds = W.split(raw, WORDS, lower=False)
        hashed = W.hashes(self.buf, self.starts, self.ends)
        n = len(hashed)
        powers, self.inverse = _ladder(1 << max(4, n.bit_length()))
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(hashed * powers[:n], dtype=_U)])
        anchor = min(ANCHOR, width)
        span = width - anchor + 1
        low = W.mix(self._joined(np.arange(max(0, n - anchor + 1)), anchor) ^ _U(0x51ED270B9F652295))
        at = np.arange(len(low))
        # Smallest anchor of each window, leftmost among equals, by doubling the reach.
        reach, best, place = 1, low, at
        while reach < span:
            step = min(reach, span - reach)
            left, right = best[: len(best) - step], best[step:]
            place = np.where(right < left, place[step:], place[: len(place) - step])
            best = np.minimum(left, right)
            reach += step
        doc = np.searchsorted(self.bounds, np.arange(len(place)), "right") - 1
        fits = np.arange(len(place)) + width <= self.bounds[doc + 1] if len(place) else np.zeros(0, bool)
        first = np.flatnonzero(fits)
        owner = place[first]
        fresh = np.ones(len(first), bool)
        fresh[1:] = (owner[1:] != owner[:-1]) | (first[1:] != first[:-1] + 1)
        heads = np.flatnonzero(fresh)
        self.low = first[heads]
        self.high = first[np.append(heads[1:], len(first)) - 1] if len(heads) else first
        self.anchor = low[owner[heads]]
        self.hashed = hashed
        lengths = self.high - self.low + width
        #: First word of the anchor, counted from the phrase's first word.
        self.inside = owner[heads] - self.low
        inside = self.inside.astype(_U)
        self.full = W.mix(self._joined(self.low, lengths) + inside * _U(0x9E3779B97F4A7C15) + lengths.astype(_U))
        #: First phrase of each document and the total.
        self.phrases = np.searchsorted(self.low, self.bounds, "left")

    def _joined(self, start: np.ndarray, length) -> np.ndarray:
        """Hash of `length` words from each start."""
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]

    def windows(self, start: np.ndarray, width: int) -> np.ndarray:
        return W.mix(self._joined(start, width))

    def raw(self) -> bytes:
        if not hasattr(self, "_raw"):
            self._raw = self.buf.tobytes()
        return self._raw

    def words(self, d: int) -> list[bytes]:
        raw = self.raw()
        a, b = self.bounds[d], self.bounds[d + 1]
        return [raw[i:j] for i, j in zip(self.starts[a:b].tolist(), self.ends[a:b].tolist())]


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def phrases(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, n_words, whole_sha, anchors, fulls of each row."""
    arrow = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("text_key", pa.int64()),
            ("n_words", pa.int64()),
            ("whole_sha", pa.string()),
            ("anchors", pa.list_(pa.int64())),
            ("fulls", pa.list_(pa.int64())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for first, raw in W.chunks(batch.column(2).to_pylist()):
                parse = Parse(raw, width)
                ends = pa.array(parse.phrases, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, len(raw)),
                        keys.slice(first, len(raw)),
                        pa.array(np.diff(parse.bounds)),
                        pa.array([_sha(text.split()) for text in raw]),
                        pa.ListArray.from_arrays(ends, pa.array(parse.anchor.view(np.int64))),
                        pa.ListArray.from_arrays(ends, pa.array(parse.full.view(np.int64))),
                    ],
                    schema=arrow,
                )

    schema = "doc_id long, text_key long, n_words long, whole_sha string, anchors array<long>, fulls array<long>"
    return docs.select("doc_id", "text_key", "text").mapInArrow(run, schema)


def _checked(batches: Iterator[pa.RecordBatch], width: int, wide: bool) -> Iterator[tuple]:
    """Parsed chunks of pending rows: parse, phrases to look at, their kinds and a picker of row columns."""
    for batch in batches:
        marks = batch.column(3).to_pylist()
        for offset, raw in W.chunks(batch.column(2).to_pylist()):
            parse = Parse(raw, width)
            kind = np.zeros(len(parse.low), np.int8)
            for d in range(len(raw)):
                for mark in marks[offset + d] or ():
                    if mark["wide"] == wide:
                        kind[parse.phrases[d] + mark["place"]] = mark["kind"]
            checked = np.flatnonzero(kind >= BOUNDARY)
            yield parse, checked, kind, lambda column, doc: batch.column(column).take(pa.array(offset + doc))


def _sequences(pending: DataFrame, width: int) -> DataFrame:
    """Phrases to factor and their reference: anchor, place of the anchor, and text, or word hashes where the words are long."""
    arrow = pa.schema(
        [
            ("anchor", pa.int64()),
            ("doc_id", pa.int64()),
            ("text_key", pa.int64()),
            ("first", pa.int64()),
            ("inside", pa.int32()),
            ("asked", pa.bool_()),
            ("phrase", pa.binary()),
            ("words", pa.list_(pa.int64())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parse, checked, kind, pick in _checked(batches, width, wide=False):
            low, high = parse.low[checked], parse.high[checked] + width
            start, end = parse.starts[low], parse.ends[high - 1]
            plain = end - start <= LETTERS * (high - low)
            raw = parse.raw()
            texts = [raw[a:b] if short else None for a, b, short in zip(start.tolist(), end.tolist(), plain.tolist())]
            hashed = [
                None if short else parse.hashed[a:b].view(np.int64)
                for a, b, short in zip(low.tolist(), high.tolist(), plain.tolist())
            ]
            doc = np.searchsorted(parse.bounds, low, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(parse.anchor[checked].view(np.int64)),
                    pick(0, doc),
                    pick(1, doc),
                    pa.array(low - parse.bounds[doc]),
                    pa.array(parse.inside[checked].astype(np.int32)),
                    pa.array(kind[checked] == BOUNDARY),
                    pa.array(texts, pa.binary()),
                    pa.array(hashed, pa.list_(pa.int64())),
                ],
                schema=arrow,
            )

    return (
        pending.where(F.exists("marks", lambda m: ~m.wide & (m.kind >= BOUNDARY)))
        .select("doc_id", "text_key", "text", "marks")
        .mapInArrow(
            run,
            "anchor long, doc_id long, text_key long, first long, inside int, asked boolean, phrase binary, words array<long>",
        )
    )


def _refined(rows: np.ndarray, group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that share group and value with another row, and the number of that finer group."""
    order = np.lexsort((value, group))
    rows, group, value = rows[order], group[order], value[order]
    fresh = np.ones(len(rows) + 1, bool)
    fresh[1:-1] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
    shared = ~(fresh[:-1] & fresh[1:])
    return rows[shared], np.cumsum(fresh[:-1])[shared]


def greedy_factors(
    anchor: np.ndarray, inside: np.ndarray, sizes: np.ndarray, words: np.ndarray, asked: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors of the asked phrases of a block: (phrase, first word within it, length), `width` words or more.

    `words` holds the word hashes of all phrases one after another. Column c of the grid is the
    same place relative to the anchor in every phrase.
    """
    reach = int(inside.max())
    begin = reach - inside
    end = begin + sizes
    ends = np.cumsum(sizes)
    grid = np.zeros((len(sizes), int(end.max())), _U)
    place = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(begin, sizes)
    grid[np.repeat(np.arange(len(sizes)), sizes), place] = words
    powers, _ = _ladder(1 << max(4, grid.shape[1].bit_length()))
    sums = np.zeros((len(sizes), grid.shape[1] + 1), _U)
    np.cumsum(grid * powers[: grid.shape[1]], axis=1, out=sums[:, 1:])
    family = np.unique(anchor, return_inverse=True)[1]
    at = begin.copy()
    found = []
    for start in range(reach + 1):
        open_ = asked & (at == start) & (start + width <= end)
        if not open_.any():
            continue
        rows = np.flatnonzero((begin <= start) & (start + width <= end))
        rows, group = _refined(rows, family[rows], sums[rows, start + width] - sums[rows, start])
        longest = np.zeros(len(sizes), np.int64)
        size = width
        while len(rows):
            longest[rows] = size
            more = start + size < end[rows]
            rows, group = rows[more], group[more]
            if len(rows):
                rows, group = _refined(rows, group, grid[rows, start + size])
            size += 1
        hit = np.flatnonzero(open_ & (longest > 0))
        found.append((hit, start - begin[hit], longest[hit]))
        at = np.where(open_, start + np.maximum(1, longest - width + 1), at)
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(part) for part in zip(*found))


def _factors(sequences: DataFrame, width: int, blocks: int) -> DataFrame:
    """doc_id, text_key, start, length of the factors found in the blocks of all anchors."""
    arrow = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])

    def run(held: pa.Table) -> pa.Table:
        held = held.combine_chunks()
        buf, starts, ends, bounds = W.split([text or b"" for text in held["phrase"].to_pylist()], WORDS, lower=False)
        lengths = pc.fill_null(pc.list_value_length(held["words"]), 0).to_numpy().astype(np.int64)
        sizes = np.diff(bounds) + lengths
        words, listed = np.empty(sizes.sum(), _U), np.repeat(lengths > 0, sizes)
        words[~listed] = W.hashes(buf, starts, ends)
        words[listed] = pc.list_flatten(held["words"]).to_numpy().view(_U)
        anchor, inside, asked = (held[name].to_numpy() for name in ("anchor", "inside", "asked"))
        row, start, length = greedy_factors(anchor, inside.astype(np.int64), sizes, words, asked, width)
        pick = pa.array(row)
        return pa.table(
            [held["doc_id"].take(pick), held["text_key"].take(pick), held["first"].to_numpy()[row] + start, length],
            schema=arrow,
        )

    dealt = sequences.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(run, "doc_id long, text_key long, start long, length long")


def _wide_windows(pending: DataFrame, width: int) -> DataFrame:
    """Windows of phrases with a very frequent anchor: hash, document, first word, and whether its verdict is needed."""
    arrow = pa.schema(
        [
            ("anchor", pa.int64()),
            ("window", pa.int64()),
            ("doc_id", pa.int64()),
            ("text_key", pa.int64()),
            ("start", pa.int64()),
            ("asked", pa.bool_()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parse, checked, kind, pick in _checked(batches, width, wide=True):
            sizes = parse.high[checked] - parse.low[checked] + 1
            owner = np.repeat(checked, sizes)
            start = parse.low[owner] + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            doc = np.searchsorted(parse.bounds, start, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(parse.anchor[owner].view(np.int64)),
                    pa.array(parse.windows(start, width).view(np.int64)),
                    pick(0, doc),
                    pick(1, doc),
                    pa.array(start - parse.bounds[doc]),
                    pa.array(kind[owner] == BOUNDARY),
                ],
                schema=arrow,
            )

    return (
        pending.where(F.exists("marks", lambda m: m.wide & (m.kind >= BOUNDARY)))
        .select("doc_id", "text_key", "text", "marks")
        .mapInArrow(run, "anchor long, window long, doc_id long, text_key long, start long, asked boolean")
    )


def _cleaned(pending: DataFrame, width: int) -> DataFrame:
    """doc_id, n_words, spans (word positions, end exclusive), kept words and their digest of marked documents."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    arrow = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_words", pa.int64()),
            ("spans", pa.list_(span)),
            ("kept", pa.string()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, repeats = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for offset, raw in W.chunks(batch.column(1).to_pylist()):
                parse = Parse(raw, width)
                rows = []
                for d in range(len(raw)):
                    base, n = parse.bounds[d], int(parse.bounds[d + 1] - parse.bounds[d])
                    change = np.zeros(n + 1, np.int64)
                    for mark in marks[offset + d] or ():
                        if mark["kind"] != BOUNDARY:
                            j = parse.phrases[d] + mark["place"]
                            change[parse.low[j] - base] += 1
                            change[parse.high[j] - base + width] -= 1
                    for factor in repeats[offset + d] or ():
                        change[factor["start"]] += 1
                        change[factor["start"] + factor["length"]] -= 1
                    gone = np.cumsum(change)[:n] > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    kept = [word for word, out in zip(parse.words(d), gone.tolist()) if not out]
                    rows.append(
                        {
                            "doc_id": ids[offset + d],
                            "n_words": n,
                            "spans": [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])],
                            "kept": b" ".join(kept).decode("utf-8", "surrogatepass"),
                        }
                    )
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return pending.select("doc_id", "text", "marks", "repeats").mapInArrow(
        run, "doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept string"
    )


def _split(pending: DataFrame, repeats: DataFrame) -> DataFrame:
    """`pending` with `may`: true for all rows of `repeats` and few others, for every row if they are too many to be sent.

    A broadcast map has one bit for each row of `repeats`, 16 times as many bits as rows.
    """
    bits = 1 << max(15, (16 * repeats.count()).bit_length())
    if bits // 8 > BROADCAST_BYTES:
        return pending.withColumn("may", F.lit(True))
    at = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(bits)) + 1
    chunk, bit = F.bitmap_bucket_number(at).alias("chunk"), F.bitmap_bit_position(at)
    held = repeats.groupBy(chunk).agg(F.bitmap_construct_agg(bit).alias("map"))
    asked = pending.select("*", chunk, bit.cast("int").alias("bit"))
    byte = F.conv(F.hex(F.expr("substring(map, cast(bit div 8 + 1 as int), 1)")), 16, 10).cast("int")
    may = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, bit % 8)")) > 0, F.lit(False))
    return asked.join(F.broadcast(held), "chunk", "left").select(*pending.columns, may.alias("may"))


def _same_row(left: str, right: str) -> Column:
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (
        F.col(f"{left}.text_key") == F.col(f"{right}.text_key")
    )


def repeated_passages(
    docs: DataFrame,
    width: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = BLOCK,
    wide: int = WIDE,
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans of every document row.

    A word goes if a window of `width` consecutive words around it also starts anywhere else, in
    the same document or another one. Words are runs of non-space bytes, unchanged; the kept words
    are joined by one space. Null and empty texts have no words; texts shorter than a window keep
    everything. Every row is a document: rows that repeat id and text are copies of each other and
    lose their windows; a null id is treated like any other. An empty table stays empty; other
    columns are not read.
    """
    plain = documents(docs, id_col, text_col)
    plain = plain.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("text_key", F.xxhash64("text"))
    parsed = settle(phrases(plain, width), "phrases")
    each = parsed.select(
        "doc_id", "text_key", F.posexplode(F.arrays_zip("anchors", "fulls")).alias("place", "phrase")
    ).select("doc_id", "text_key", "place", "phrase.anchors", "phrase.fulls")
    ticket = F.xxhash64("doc_id", "text_key", "place")

    # The reference index: how often each phrase stands, and how many phrases share its anchor.
    counted = each.groupBy("anchors", "fulls").agg(F.count("*").alias("n"), F.min(ticket).alias("chosen"))
    counted = settle(counted, "reference")
    mixed = counted.groupBy("anchors").agg(F.count("*").alias("kinds")).where("kinds > 1")
    mixed = settle(mixed.select("anchors", F.lit(True).alias("mixed"), (F.col("kinds") > wide).alias("wide")), "mixed")
    index = counted.join(mixed, "anchors", "left").where("n > 1 OR mixed").na.fill(False, ["mixed", "wide"])
    index = settle(index, "index")
    release(counted, mixed)

    kind = F.when(F.col("n") == 1, BOUNDARY).when(F.col("mixed") & (ticket == F.col("chosen")), REFERENCE)
    marks = (
        each.join(index, ["anchors", "fulls"])
        .select("doc_id", "text_key", "place", kind.otherwise(FULL).alias("kind"), "wide")
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set(F.struct("place", "kind", "wide")).alias("marks"), F.count("*").alias("rows"))
        .select("doc_id", "text_key", "marks", (F.col("rows") / F.size("marks")).cast("long").alias("copies"))
    )
    marks = settle(marks, "marks")
    pending = settle(
        plain.alias("d").join(marks.alias("m"), _same_row("d", "m")).select("d.*", "m.marks", "m.copies"), "pending"
    )

    # Rows that repeat id and text hold the same reference phrases; one of them is enough.
    once = _sequences(pending.where("copies > 1"), width).dropDuplicates(["doc_id", "text_key", "first"])
    sequences = _sequences(pending.where("copies = 1"), width).unionByName(once)
    blocks = max(1, -(-index.where("mixed AND NOT wide").count() // block))
    windows = settle(_wide_windows(pending, width), "windows")
    keys = ["anchor", "window"]
    twice = settle(windows.groupBy(keys).agg(F.count("*").alias("n")).where("n > 1").select(keys), "twice")
    single = windows.where("asked").join(twice, keys).select("doc_id", "text_key", "start")
    found = _factors(sequences, width, blocks).unionByName(single.withColumn("length", F.lit(width).cast("long")))
    repeats = found.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "length")).alias("repeats"))
    repeats = settle(repeats, "repeats")
    release(windows, twice, index)
    # Most marked texts hold no factor: they are cleaned where they lie, only the others are shuffled to their factors.
    split = _split(pending, repeats)
    joined = split.where("may").alias("d").join(repeats.alias("m"), _same_row("d", "m"), "left").select("d.*", "m.repeats")
    layout = repeats.schema["repeats"].dataType
    cleaned = _cleaned(joined.unionByName(split.where("NOT may").withColumn("repeats", F.lit(None).cast(layout))), width).select(
        "doc_id",
        "n_words",
        F.coalesce(F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)"), F.lit(0)).alias("n_removed"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
        "spans",
    )
    free = parsed.alias("d").join(marks.alias("m"), _same_row("d", "m"), "left_anti").select(
        "doc_id",
        "n_words",
        F.lit(0).cast("long").alias("n_removed"),
        F.col("whole_sha").alias("kept_sha256"),
        F.array().cast("array<struct<start:long,end:long>>").alias("spans"),
    )
    return cleaned.unionByName(free)


def oracle_sql(width: int = WINDOW) -> str:
    return rf"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - {width} + 2)) AS i, w FROM split WHERE len(w) >= {width}
),
keyed AS (SELECT doc_id, i, array_to_string(w[i:i + {width} - 1], ' ') AS k FROM windows),
twice AS (SELECT k FROM keyed GROUP BY k HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {width})) AS p FROM keyed SEMI JOIN twice USING (k)
),
lists AS (SELECT doc_id, list(p) AS p FROM gone GROUP BY doc_id),
kept AS (
  SELECT s.doc_id, len(w) AS n_words, coalesce(len(p), 0) AS n_removed,
         CASE WHEN p IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(p, i)), lambda i: w[i]) END AS k
  FROM split s LEFT JOIN lists USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
