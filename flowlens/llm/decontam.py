"""Benchmark decontamination with a positional inverted index over the training documents.

The index is split by documents: each row is a segment of some documents with, for every term of
the test items, the positions at which it stands. It is stored in the shared folder and serves
every search. A search takes the terms of a phrase from the rarest (over the whole corpus) to the
most common one and intersects their lists, each moved by the term's offset in the phrase, so
that only places that hold all terms are left. Proximity search asks the same of unordered terms
within a distance.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from flowlens.llm import words as W
from flowlens.llm.tables import BROADCAST_BYTES, checked_broadcast, documents, release, settle

WORDS = "alnum"
#: Words of an item window; an item of fewer words is one window.
WINDOW = 13
#: Windows of a piece of an item, at most; longer items are cut into several.
PIECE = 4096
#: Bytes of text of a segment of the index.
SEGMENT_BYTES = 2_000_000
#: A document is contaminated if hit words times this reach its words.
SHARE = 20

_SEGMENT = T.StructType(
    [
        T.StructField("rows", T.ArrayType(T.LongType())),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("n_words", T.ArrayType(T.LongType())),
        T.StructField("terms", T.BinaryType()),
        T.StructField("counts", T.BinaryType()),
        T.StructField("positions", T.BinaryType()),
    ]
)


def item_terms(texts: Sequence[str | None]) -> list[np.ndarray]:
    """Word hashes of each item text."""
    out = []
    for _, raw in W.chunks(list(texts)):
        buf, starts, ends, bounds = W.split(raw, WORDS, lower=True)
        hashed = W.hashes(buf, starts, ends)
        out += [hashed[a:b] for a, b in zip(bounds, bounds[1:])]
    return out


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and a number of each row, which holds for a table that is read once or settled."""
    return documents(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())


def build_index(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """Segments of the positional index of numbered documents for the given sorted term hashes.

    One segment holds the documents of about 2 MB of text. Positions count words within the
    segment; documents are apart by their word counts. Null texts have no words.
    """
    shared = checked_broadcast(docs.sparkSession, terms, terms.nbytes, "the terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in (piece for whole in batches for piece in W.pieces(whole, 1, SEGMENT_BYTES)):
            ids, texts, rows = (batch.column(i).to_pylist() for i in range(3))
            for first, raw in W.chunks(texts, SEGMENT_BYTES):
                buf, starts, ends, bounds = W.split(raw, WORDS, lower=True)
                hashed = W.hashes(buf, starts, ends)
                place = np.searchsorted(wanted, hashed)
                place[place == len(wanted)] = 0
                known = np.flatnonzero(wanted[place] == hashed) if len(wanted) else np.zeros(0, np.int64)
                order = known[np.argsort(place[known], kind="stable")]
                found, counts = np.unique(place[known], return_counts=True)
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "rows": rows[first : first + len(raw)],
                            "doc_ids": ids[first : first + len(raw)],
                            "n_words": np.diff(bounds).tolist(),
                            "terms": wanted[found].tobytes(),
                            "counts": counts.astype(np.int32).tobytes(),
                            "positions": order.astype(np.int32).tobytes(),
                        }
                    ],
                    schema=_ARROW,
                )

    return docs.select("doc_id", "text", "row").mapInArrow(run, _SEGMENT)


_ARROW = pa.schema(
    [
        ("rows", pa.list_(pa.int64())),
        ("doc_ids", pa.list_(pa.int64())),
        ("n_words", pa.list_(pa.int64())),
        ("terms", pa.binary()),
        ("counts", pa.binary()),
        ("positions", pa.binary()),
    ]
)


def term_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Occurrences of each of the sorted terms over the whole index."""
    total = T.StructType([T.StructField("term", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(terms, np.int64)),
                        pa.array(np.frombuffer(counts, np.int32).astype(np.int64)),
                    ],
                    names=["term", "n"],
                )

    found = index.select("terms", "counts").mapInArrow(run, total).groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms), np.int64)
    out[np.searchsorted(terms, found.column("term").to_numpy().view(np.uint64))] = found.column("n").to_numpy()
    return out


class Segment:
    """Lists of one segment."""

    def __init__(self, row: dict):
        self.doc_ids = row["doc_ids"]
        self.n_words = np.array(row["n_words"], np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.n_words)])
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.ends = np.concatenate([[0], np.cumsum(np.frombuffer(row["counts"], np.int32))])
        self.positions = np.frombuffer(row["positions"], np.int32)
        # The same lists seen from the positions: which list a place belongs to.
        self.term_at = np.full(int(self.bounds[-1]) + 1, -1, np.int32)
        self.term_at[self.positions] = np.repeat(np.arange(len(self.terms), dtype=np.int32), np.diff(self.ends))

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """Numbers of terms in this segment, -2 where a term does not occur."""
        if not len(self.terms):
            return np.full(len(terms), -2, np.int32)
        place = np.searchsorted(self.terms, terms)
        place[place == len(self.terms)] = 0
        return np.where(self.terms[place] == terms, place, -2).astype(np.int32)

    def phrases(self, phrases: np.ndarray, widths: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places at which phrases begin: (phrase, position). `order`: offsets, rarest term first.

        The list of a phrase's rarest term is moved back by its offset; each further list keeps
        the places that it holds, too. Phrases lie within one document.
        """
        numbers = self.numbers(phrases.ravel()).reshape(phrases.shape)
        inside = np.arange(phrases.shape[1])[None, :] < widths[:, None]
        alive = np.flatnonzero(((numbers >= 0) | ~inside).all(axis=1))
        lead = order[alive, 0]
        lists = numbers[alive, lead]
        sizes = self.ends[lists + 1] - self.ends[lists]
        owner = np.repeat(alive, sizes)
        step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = self.positions[np.repeat(self.ends[lists], sizes) + step].astype(np.int64) - np.repeat(lead, sizes)
        keep = (place >= 0) & (place + widths[owner] <= self.bounds[-1])
        owner, place = owner[keep], place[keep]
        for k in range(1, phrases.shape[1]):
            more = k < widths[owner]
            offset = np.where(more, order[owner, np.minimum(k, phrases.shape[1] - 1)], 0)
            keep = ~more | (self.term_at[np.minimum(place + offset, len(self.term_at) - 1)] == numbers[owner, offset])
            owner, place = owner[keep], place[keep]
        doc = np.searchsorted(self.bounds, place, "right") - 1
        keep = place + widths[owner] <= self.bounds[doc + 1]
        return owner[keep], place[keep]

    def near(self, terms: np.ndarray, distance: int) -> np.ndarray:
        """Places of the rarest of some terms with all others within `distance` words, in one document."""
        numbers = np.unique(self.numbers(terms))
        if numbers[0] < 0:
            return np.zeros(0, np.int64)
        sizes = self.ends[numbers + 1] - self.ends[numbers]
        numbers = numbers[np.argsort(sizes, kind="stable")]
        place = self.positions[self.ends[numbers[0]] : self.ends[numbers[0] + 1]].astype(np.int64)
        for number in numbers[1:]:
            held = self.positions[self.ends[number] : self.ends[number + 1]].astype(np.int64)
            doc = np.searchsorted(self.bounds, place, "right") - 1
            low = np.maximum(place - distance, self.bounds[doc])
            high = np.minimum(place + distance, self.bounds[doc + 1] - 1)
            place = place[np.searchsorted(held, high, "right") > np.searchsorted(held, low, "left")]
        return place


def windows(items: list[tuple[str, np.ndarray]], width: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(item ids, window terms padded to `width`, widths, item number) of all windows of the items."""
    names, rows, widths, owner = [], [], [], []
    for name, terms in items:
        n = min(width, len(terms))
        for i in range(len(terms) - n + 1 if n else 0):
            rows.append(np.concatenate([terms[i : i + n], np.zeros(width - n, np.uint64)]))
            widths.append(n)
            owner.append(len(names))
        names.append(name)
    held = np.array(rows, np.uint64).reshape(len(rows), width)
    return names, held, np.array(widths, np.int64), np.array(owner, np.int64)


def search(index: DataFrame, items: list[tuple[str, np.ndarray]], width: int, terms: np.ndarray, counts: np.ndarray) -> DataFrame:
    """A row per document: id, words, hit words (within any window found) and the ids of the items.

    `terms` are those of the index, sorted, and `counts` their occurrences.
    """
    names, phrases, widths, owner = windows(items, width)
    place = np.searchsorted(terms, phrases)
    frequency = np.append(counts, 0)[place]
    frequency[np.arange(width)[None, :] >= widths[:, None]] = np.iinfo(np.int64).max
    order = np.argsort(frequency, axis=1, kind="stable")
    size = phrases.nbytes * 3 + sum(map(len, names))
    shared = checked_broadcast(index.sparkSession, (names, phrases, widths, owner, order), size, "the windows")
    schema = "row long, doc_id long, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>"
    arrow = pa.schema(
        [
            ("row", pa.int64()),
            ("doc_id", pa.int64()),
            ("n_words", pa.int64()),
            ("n_hit", pa.int64()),
            ("item_ids", pa.list_(pa.string())),
            ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, phrases, widths, owner, order = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                stored = batch.slice(k, 1).to_pylist()[0]
                segment = Segment(stored)
                found, place = segment.phrases(phrases, widths, order)
                doc = np.searchsorted(segment.bounds, place, "right") - 1
                rows = [
                    {
                        "row": i, "doc_id": d, "n_words": int(n), "n_hit": 0, "item_ids": [], "spans": [],
                    }
                    for i, d, n in zip(stored["rows"], segment.doc_ids, segment.n_words)
                ]
                sort = np.lexsort((place, doc))
                doc, place, found = doc[sort], place[sort], found[sort]
                edges = np.flatnonzero(np.diff(doc, prepend=-1))
                for a, b in zip(edges, [*edges[1:], len(doc)]):
                    start = place[a:b] - segment.bounds[doc[a]]
                    end = start + widths[found[a:b]]
                    reach = np.maximum.accumulate(end)
                    cut = np.concatenate([[0], np.flatnonzero(start[1:] > reach[:-1]) + 1])
                    last = np.concatenate([cut[1:], [len(start)]]) - 1
                    row = rows[doc[a]]
                    row["spans"] = [{"start": int(x), "end": int(y)} for x, y in zip(start[cut], reach[last])]
                    row["n_hit"] = int((reach[last] - start[cut]).sum())
                    row["item_ids"] = sorted({names[i] for i in owner[found[a:b]]})
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return index.mapInArrow(run, schema)


def proximity(index: DataFrame, queries: list[tuple[str, np.ndarray]], distance: int) -> DataFrame:
    """(doc_id, query, n): how often a query's terms stand together within `distance` words of its rarest term."""
    size = sum(t.nbytes + len(q) for q, t in queries)
    shared = checked_broadcast(index.sparkSession, queries, size, "the queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                segment = Segment(batch.slice(k, 1).to_pylist()[0])
                rows = []
                for name, terms in shared.value:
                    place = segment.near(terms, distance) if len(terms) else np.zeros(0, np.int64)
                    doc, n = np.unique(np.searchsorted(segment.bounds, place, "right") - 1, return_counts=True)
                    rows += [(segment.doc_ids[d], name, int(c)) for d, c in zip(doc, n)]
                columns = list(zip(*rows)) or [[], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64()))],
                    names=["doc_id", "query", "n"],
                )

    return index.mapInArrow(run, "doc_id long, query string, n long")


def item_pieces(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """(item_id, at, n, words): the word hashes of the items, cut so that every window lies in one piece.

    `n` is the number of windows that begin in the piece, `piece` at most. A null id stands as the
    empty string; null and wordless texts have no pieces.
    """
    arrow = pa.schema([("item_id", pa.string()), ("at", pa.int64()), ("n", pa.int64()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in W.pieces(whole, 1)):
            for name, terms in zip(batch.column(0).to_pylist(), item_terms(batch.column(1).to_pylist())):
                begins = max(1, len(terms) - width + 1) if len(terms) else 0
                for at in range(0, begins, piece):
                    n = min(piece, begins - at)
                    held = [[name], [at], [n], [terms[at : at + n + width - 1].tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(held, arrow)], schema=arrow)

    held = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return held.where("text IS NOT NULL").mapInArrow(run, "item_id string, at long, n long, words binary")


def item_parts(pieces: DataFrame, width: int, part_bytes: int) -> Iterator[list[tuple[str, np.ndarray]]]:
    """The pieces in parts whose windows take about `part_bytes` at most, always in the same order."""
    size = F.col("n") * _window_bytes(width) + F.octet_length("item_id")
    total = pieces.agg(F.sum(size)).first()[0] or 0
    slots = max(1, -(-total // part_bytes))
    slot = F.pmod(F.xxhash64("item_id", "at"), F.lit(slots))
    for k in range(slots):
        held, taken = [], 0
        # Hashes deal pieces out unevenly, so what is over a part goes to a further one.
        for row in sorted(pieces.where(slot == k).withColumn("size", size).collect(), key=lambda r: (r["item_id"], r["at"], r["words"])):
            if held and taken + row["size"] > part_bytes:
                yield held
                held, taken = [], 0
            held.append((row["item_id"], np.frombuffer(row["words"], np.uint64)))
            taken += row["size"]
        if held:
            yield held


def _window_bytes(width: int) -> int:
    """Bytes that a window takes while it is searched: terms, frequencies and order of its words, and two numbers."""
    return (3 * width + 2) * 8


def term_groups(parts: Iterator[list[tuple[str, np.ndarray]]], limit: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of parts, their terms) of runs of parts whose terms together take `limit` bytes at most."""
    n, terms = 0, np.zeros(0, np.uint64)
    for part in parts:
        more = np.unique(np.concatenate([t for _, t in part]))
        both = np.union1d(terms, more)
        if n and both.nbytes > limit:
            yield n, terms
            n, both = 0, more
        n, terms = n + 1, both
    yield n, terms


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WINDOW,
    part_bytes: int = BROADCAST_BYTES // 2,
    piece: int = PIECE,
) -> DataFrame:
    """A row per document row: doc_id, n_words, n_hit, item_ids (sorted), contaminated.

    Items of any number and length are searched: long ones are cut into pieces of windows, pieces are
    dealt out to parts that fit the broadcast bound, and as many parts share an index as their terms
    fit it. Null and empty texts have no words, no hits and are never contaminated; null, empty and
    wordless items match nothing; a null item id stands as the empty string; items with equal ids
    count once; repeated document rows each get a row; empty tables give no rows or no hits. Other
    columns are not read.
    """
    pieces = settle(item_pieces(items, item_col, item_text_col, width, piece), "pieces")
    groups = list(term_groups(item_parts(pieces, width, part_bytes), part_bytes))
    held = numbered(docs, id_col, text_col)
    if len(groups) > 1:
        held = settle(held, "numbered")
    parts = item_parts(pieces, width, part_bytes)
    if sum(n for n, _ in groups) <= 1:
        index = settle(build_index(held, groups[0][1]), "postings")
        return verdicts(search(index, next(parts, []), width, groups[0][1], term_counts(index, groups[0][1])))
    found = None
    for n, terms in groups:
        index = settle(build_index(held, terms), "postings")
        counts = term_counts(index, terms)
        for part in islice(parts, n):
            rows = settle(search(index, part, width, terms, counts), "found")
            found = rows if found is None else found.unionByName(rows)
        release(index)
    return verdicts(merged(found))


def merged(found: DataFrame) -> DataFrame:
    """One row per document row from the rows of several parts of the items."""
    together = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
    )
    # Hit words: each span counts from where the spans before it have ended.
    walked = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["to"], s["end"]).alias("to"),
            (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["to"]))).cast("long").alias("n"),
        ),
    )
    return together.withColumn("n_hit", walked["n"])


def verdicts(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "item_ids",
        ((F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words"))).alias("contaminated"),
    )


def oracle_sql(width: int = WINDOW, share: int = SHARE) -> str:
    words = (
        r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
        r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    )
    return f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {words} AS w FROM benchmark),
wanted AS (
  SELECT DISTINCT item_id, least(len(w), {width}) AS n, array_to_string(w[i:i + {width} - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {width} + 1, 1) + 1)) AS i FROM items WHERE len(w) > 0)
),
docs AS (SELECT doc_id, {words} AS w FROM documents),
widths AS (SELECT DISTINCT n FROM wanted),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, widths WHERE len(w) >= n),
hits AS (
  SELECT doc_id, i, p.n, item_id FROM places p JOIN wanted q ON p.n = q.n AND array_to_string(w[i:i + p.n - 1], ' ') = q.k
),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {share} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
