"""Near-duplicate groups: MinHash bands, signature and set checks, alternating star contraction.

1. A task turns each text into its set of word shingles and takes the minima of many universal
   hash functions. Texts with equal sets fall together at once (a 128-bit digest is the node), so
   copies cost one node however many there are.
2. Rows of minima form bands; nodes that agree in a band share a bucket. Each bucket is compared
   with its most central node only, so work is linear in the bucket, not in its pairs.
3. Pairs pass a size test and a comparison of one-bit signatures, then the exact test on full sets.
4. Components come from alternating large-star and small-star steps.
5. Buckets that still hold several components are finished exactly: nodes outside the bucket's
   main component meet that component's nodes and each other on full sets, in bounded blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm import words as W
from flowlens.llm.tables import documents, settle

WORDS = "space"
BANDS, ROWS = 48, 6
#: One-bit minima kept per node, in longs.
SKETCH = 4
#: Standard deviations by which the one-bit signature may fall short of the threshold: a pair at the
#: threshold falls short by more with a probability of 2e-12 (binomial, 65 or more of 256 bits).
SLACK = 8.0
#: Members of a bucket whose pairs may be listed, and nodes of a block of a hub.
SMALL_BUCKET, BLOCK = 16, 128

_U = np.uint64


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 2**63, n, _U) * _U(2) + _U(1), rng.integers(0, 2**63, n, _U)


def _sets(texts: list[str | None], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for first, raw in W.chunks(texts):
        buf, starts, ends, bounds = W.split(raw, WORDS, lower=True)
        yield first, *W.shingle_hashes(W.hashes(buf, starts, ends), bounds, width)


def _digests(held: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """128 bits of each set."""
    out = np.empty((len(heads), 2), _U)
    for k, salt in enumerate((0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)):
        out[:, k] = W.mix(np.add.reduceat(W.mix(held ^ _U(salt)), heads) + sizes.astype(_U))
    return [row.tobytes() for row in out]


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, node (null for an empty set), bands, sketch of each row."""
    arrow = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_shingles", pa.int64()),
            ("node", pa.binary()),
            ("bands", pa.list_(pa.int64())),
            ("sketch", pa.list_(pa.int64())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, shift = _family(BANDS * ROWS)
        for batch in (piece for whole in batches for piece in W.pieces(whole, 1)):
            ids = batch.column(0).to_pylist()
            for first, held, bounds in _sets(batch.column(1).to_pylist(), width):
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                nodes: list = [None] * len(sizes)
                bands: list = [None] * len(sizes)
                sketch: list = [None] * len(sizes)
                if len(full):
                    heads = bounds[:-1][full]
                    minima = np.empty((BANDS * ROWS, len(full)), _U)
                    hashed = np.empty_like(held)
                    for k in range(BANDS * ROWS):
                        np.multiply(held, factor[k], out=hashed)
                        np.add(hashed, shift[k], out=hashed)
                        minima[k] = np.minimum.reduceat(hashed, heads)
                    grouped = minima.reshape(BANDS, ROWS, len(full))
                    keys = np.zeros((BANDS, len(full)), _U) + np.arange(1, BANDS + 1, dtype=_U)[:, None]
                    for r in range(ROWS):
                        keys = W.mix(keys * _U(0x9E3779B97F4A7C15) + grouped[:, r])
                    bits = (W.mix(minima[: 64 * SKETCH]) & _U(1)).astype(np.uint8).T
                    packed = np.packbits(np.ascontiguousarray(bits), axis=1).view(np.int64)
                    digests = _digests(held, heads, sizes[full])
                    for j, d in enumerate(full):
                        nodes[d], bands[d], sketch[d] = digests[j], keys[:, j].view(np.int64), packed[j]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[first : first + len(sizes)], pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(nodes, pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                        pa.array(sketch, pa.list_(pa.int64())),
                    ],
                    schema=arrow,
                )

    schema = "doc_id long, n_shingles long, node binary, bands array<long>, sketch array<long>"
    return docs.mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """node and shingles (distinct hashes) of each row with a non-empty set."""
    arrow = pa.schema([("node", pa.binary()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in W.pieces(whole, 1)):
            for _, held, bounds in _sets(batch.column(1).to_pylist(), width):
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                if len(full):
                    heads = bounds[:-1][full]
                    lists = pa.ListArray.from_arrays(
                        pa.array(np.append(heads, len(held)), pa.int32()), pa.array(held.view(np.int64))
                    )
                    nodes = pa.array(_digests(held, heads, sizes[full]), pa.binary())
                    yield pa.RecordBatch.from_arrays([nodes, lists], schema=arrow)

    return docs.mapInArrow(run, "node binary, shingles array<long>")


def _limit(percent: int) -> int:
    """Bits by which the signatures of a pair at the threshold may differ."""
    bits = 64 * SKETCH
    share = (1 - percent / 100) / 2
    return int(bits * share + SLACK * (bits * share * (1 - share)) ** 0.5)


def _alike(percent: int) -> Column:
    """Size and signature tests of two nodes a and b; they never refuse a pair at the threshold by size."""
    apart = sum(
        (F.bit_count(F.col("a.sketch")[i].bitwiseXOR(F.col("b.sketch")[i])) for i in range(1, SKETCH)),
        F.bit_count(F.col("a.sketch")[0].bitwiseXOR(F.col("b.sketch")[0])),
    )
    small, large = F.least("a.n_shingles", "b.n_shingles"), F.greatest("a.n_shingles", "b.n_shingles")
    return (small * 100 >= large * percent) & (apart <= _limit(percent))


def _sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """node and shingles of the wanted nodes, from the text of one document each."""
    ids = settle(wanted.join(nodes.select("node", "doc_id"), "node").select("doc_id").distinct(), "needed")
    sets = shingle_sets(docs.join(ids, "doc_id", "left_semi"), width)
    return settle(sets.dropDuplicates(["node"]), "sets")


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, docs, width)
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    total = F.size("set_a") + F.size("set_b") - common
    return both.where(common * 100 >= total * percent).select("a", "b")


def star_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of an undirected link table (a, b): the root is the component's smallest node.

    Alternates large-star and small-star until every node hangs on one root; self-links and repeated
    links do no harm. Each step is written out, and the driver only learns whether it was the last.
    """
    edges = settle(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settle(both.groupBy("u").agg(F.min("v").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = settle(large, "large")
        least = settle(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settle(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node has two smaller neighbours or both a smaller and a larger one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("head")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("head"))
    )
    ends = ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("head").alias("head"))
    return ends.where("child > 1 OR child = 1 AND head = 1").isEmpty()


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document row.

    Words are runs of non-space bytes with A-Z in lower case; a set holds the distinct `width`-word
    shingles, or the whole sequence of a shorter text. Documents are linked if the Jaccard
    similarity of their sets is at least `percent` hundredths; component_id is the smallest id
    reachable, kept marks that document. Null, empty and wordless texts have 0 shingles and stand
    alone. A null id takes no part: its component_id is null and it is kept. Rows that repeat an id
    are judged one by one and share nothing but the id. An empty table stays empty; other columns
    are not read.

    Links found are exact. A link of exactly 80 % is lost with a probability of 5e-7: 5e-7 by the
    bands, and 2e-12 by the signature test of pairs in buckets of up to SMALL_BUCKET nodes and of
    pairs with a centre; higher similarities are lost less often.
    """
    plain = documents(docs, id_col, text_col)
    marked = settle(signatures(plain, width), "signatures")
    nodes = settle(
        marked.where("node IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
            F.first("sketch").alias("sketch"),
        ),
        "nodes",
    )
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    sizes = settle(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    live = settle(rows.join(sizes, "bucket"), "live")
    # A node in many large buckets is close to much of its group: it makes the best centre.
    weight = live.groupBy("node").agg(F.round(F.sum(F.log2("n")), 3).alias("weight"))
    info = settle(nodes.select("node", "n_shingles", "sketch").join(weight, "node"), "info")
    members = settle(live.where("n > 1").join(info, "node"), "members")
    centres = settle(
        members.groupBy("bucket").agg(
            F.max_by(F.struct("node", "n_shingles", "sketch"), F.struct("weight", "node")).alias("c")
        ).select("bucket", "c.*"),
        "centres",
    )
    a, b = centres.alias("a"), members.alias("b")
    pairs = a.join(b, F.col("a.bucket") == F.col("b.bucket")).where((F.col("a.node") != F.col("b.node")) & _alike(percent))
    pairs = settle(pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct(), "pairs")
    links = settle(_confirmed(pairs, nodes, plain, width, percent), "links")
    roots = settle(star_components(links), "roots")

    more = _closing_links(members, roots, pairs, nodes, plain, width, percent)
    joined = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = settle(star_components(settle(joined.unionByName(more), "links")), "roots")

    labelled = settle(
        marked.select("doc_id", "n_shingles", "node")
        .join(roots, "node", "left")
        .select("doc_id", "n_shingles", F.coalesce("root", "node").alias("root")),
        "labelled",
    )
    first = settle(labelled.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("first_id")), "first")
    out = labelled.join(first, "root", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("first_id", "doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _closing_links(
    members: DataFrame, roots: DataFrame, tested: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int
) -> DataFrame:
    """Links between nodes that share a bucket but, so far, no component.

    One side of such a link is always outside the bucket's largest component, so buckets of one
    component cost nothing. In small buckets the pairs are listed and confirmed. In large ones the
    outsiders of all buckets with the same largest component, the hub, meet the hub's nodes and
    each other once, in blocks of bounded size, on full sets; a node passes on one link per
    component it reaches.
    """
    labelled = settle(
        members.where("n > 2").drop("weight").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")),
        "labelled",
    )
    per = labelled.groupBy("bucket", "root").agg(F.count("*").alias("k"))
    mixed = settle(
        per.groupBy("bucket")
        .agg(F.count("*").alias("parts"), F.max_by("root", F.struct("k", "root")).alias("main"))
        .where("parts > 1")
        .drop("parts"),
        "mixed",
    )
    rows = settle(labelled.join(mixed, "bucket"), "mixed_rows")
    small = F.col("n") <= SMALL_BUCKET
    a, b = rows.where(small & (F.col("root") != F.col("main"))).alias("a"), rows.where(small).alias("b")
    few = a.join(b, F.col("a.bucket") == F.col("b.bucket")).where(
        (F.col("a.root") != F.col("b.root"))
        & ((F.col("b.root") == F.col("b.main")) | (F.col("a.node") < F.col("b.node")))
        & _alike(percent)
    )
    ordered = lambda df, x, y: df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    few = ordered(few, "a.node", "b.node").distinct().join(ordered(tested, "a", "b"), ["a", "b"], "left_anti")
    few = _confirmed(settle(few, "pairs"), nodes, docs, width, percent)

    outside = settle(
        rows.where(~small & (F.col("root") != F.col("main"))).select(F.col("main").alias("hub"), "node", "root").distinct(),
        "outside",
    )
    hubs = settle(outside.groupBy("hub").agg(F.count("*").alias("k")), "hubs")
    own = roots.join(hubs.select("hub"), F.col("root") == F.col("hub")).select("hub", "node", "root")
    alone = hubs.select("hub", F.col("hub").alias("node"), F.col("hub").alias("root"))
    inside = settle(own.unionByName(alone).unionByName(outside).distinct(), "inside")
    size = inside.groupBy("hub").agg(F.count("*").alias("m")).join(hubs, "hub")
    size = settle(
        size.select("hub", F.ceil(F.col("k") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("m") / BLOCK).cast("int").alias("columns")),
        "blocks",
    )
    sets = _sets_of(inside.select("node").distinct(), nodes, docs, width)
    number = lambda parts: F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    full = lambda df, i, j: df.join(size, "hub").withColumn("i", i).withColumn("j", j).join(sets, "node").select(
        *[F.col(c).alias(c) for c in ("hub", "i", "j", "node", "root", "shingles")]
    )
    left, right = full(outside, number("rows"), every("columns")), full(inside, every("rows"), number("columns"))
    arrow = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[bytes, bytes]] = []
        if left.num_rows and right.num_rows:
            theirs, roots = right.column("node").to_pylist(), right.column("root").to_pylist()
            held, ends = _flat(right)
            owner = np.repeat(np.arange(len(theirs)), np.diff(ends))
            order = np.argsort(held, kind="stable")
            held, owner, sizes = held[order], owner[order], np.diff(ends)
            mine, bounds = _flat(left)
            for k, (node, root) in enumerate(zip(left.column("node").to_pylist(), left.column("root").to_pylist())):
                own = mine[bounds[k] : bounds[k + 1]]
                low, high = np.searchsorted(held, own, "left"), np.searchsorted(held, own, "right")
                count = high - low
                at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
                common = np.bincount(owner[at], minlength=len(theirs))
                linked = np.flatnonzero(common * 100 >= (len(own) + sizes - common) * percent)
                reached = {roots[j]: theirs[j] for j in linked if roots[j] != root}
                out += [(node, other) for other in reached.values()]
        columns = list(zip(*out)) or [[], []]
        return pa.table([pa.array(c, pa.binary()) for c in columns], schema=arrow)

    many = left.groupBy("hub", "i", "j").cogroup(right.groupBy("hub", "i", "j")).applyInArrow(meet, "a binary, b binary")
    return few.unionByName(many)


def _flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of a table one after another, and the bounds of each row."""
    lists = table.column("shingles").combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def oracle_sql(width: int, percent: int) -> str:
    return rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width} - 1], ' '))) END AS s
  FROM split
),
nodes AS (SELECT min(doc_id) AS node, any_value(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
items AS (SELECT node, len(s) AS n, unnest(s) AS g FROM nodes),
common AS (
  SELECT a.node AS a, b.node AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
  FROM items a JOIN items b ON a.g = b.g AND a.node < b.node AND a.n * 100 >= b.n * {percent} AND b.n * 100 >= a.n * {percent}
  GROUP BY ALL
),
links AS (
  SELECT a, b FROM common WHERE k * 100 >= (na + nb - k) * {percent}
),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT node, node AS other FROM nodes
  UNION
  SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a
),
root AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
classes AS (SELECT min(doc_id) OVER (PARTITION BY list_sort(s)) AS node, doc_id, len(s) AS n FROM sets)
SELECT c.doc_id, n AS n_shingles, CASE WHEN n = 0 THEN c.doc_id ELSE r.component END AS component_id,
       (n = 0 OR c.doc_id = r.component) AS kept
FROM classes c LEFT JOIN root r ON c.node = r.node AND c.n > 0
"""
