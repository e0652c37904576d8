"""Deduplication operators against brute force."""

import random
import re
from collections import Counter

import numpy as np

from flowlens.llm import lines, minhash, substrings


def _corpus(seed, n=60):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(pick.choice(words) for _ in range(pick.randint(1, 120))) for _ in range(n)]
    passage = " ".join(pick.choice(words) for _ in range(60))
    out = list(base)
    for text in base[:20]:
        parts = text.split()
        for k in range(max(1, len(parts) // 30)):
            parts[pick.randrange(len(parts))] = pick.choice(words)
        out.append(" ".join(parts).upper() if pick.random() < 0.3 else "  ".join(parts))
    out += base[:5] + [t + " " + passage + " " + t[::-1] for t in base[20:30]]
    out += [passage + " " + passage, " ".join(["again"] * 90), "one", "One", "one two", "", "  \n", None, "é b c"]
    return [(i, t) for i, t in enumerate(out)]


def _sets(text, width):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def _components(rows, width, percent):
    sets = {i: _sets(t, width) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                common = len(sets[x] & sets[y])
                if 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                    a, b = sorted((find(x), find(y)))
                    root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    for width in (2, 5):
        rows = _corpus(3)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, width).collect()}
        assert got == _components(rows, width, 80)


def test_near_duplicates_in_a_dense_group(spark):
    """A base, copies around it, and copies of copies that are not like the base."""
    pick = random.Random(9)
    words = [f"v{i}" for i in range(4000)]
    base = pick.sample(words, 200)
    rows, chain = [], base
    for i in range(120):
        source = base if i % 3 else chain
        parts = list(source)
        for k in pick.sample(range(200), 8):
            parts[k] = pick.choice(words)
        chain = parts
        rows.append((i, " ".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 2).collect()}
    assert got == _components(rows, 2, 80)


def test_near_duplicates_edges(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (1, "q r s", "x"), (None, "a b c", "x"), (5, "A B C", None), (6, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = sorted(minhash.near_duplicates(docs, 2).collect(), key=repr)
    assert [(r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, None, True)]
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id) == [
        (1, 1, True), (1, 1, True), (1, 1, True), (5, 1, False), (6, 6, True)
    ]
    assert minhash.near_duplicates(docs.limit(0), 2).count() == 0


def test_star_components(spark):
    pick = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 90) if i % 13] + [(200, k) for k in range(100, 160)] + [(7, 7), (50, 51)]
    pick.shuffle(pairs)
    links = spark.createDataFrame([(a, b) for a, b in pairs], "a long, b long")
    got = {r.node: r.root for r in minhash.star_components(links).collect()}
    root = {}
    for a, b in pairs:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(100):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if k in got} and len(got) >= len(root) - 1


def _passages(rows, width):
    texts = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    seen = Counter(tuple(w[k : k + width]) for _, w in texts for k in range(len(w) - width + 1))
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), [(x) for x in range(len(w)) if x in gone]))
    return out


def test_passages_equal_brute_force(spark):
    for width in (35, 8, 4, 1):
        rows = _corpus(5)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
        got = sorted(substrings.repeated_passages(docs, width).collect(), key=lambda r: r.doc_id)
        ours = [
            (r.doc_id, r.n_words, r.n_removed, [x for s in r.spans for x in range(s.start, s.end)]) for r in got
        ]
        assert ours == _passages(rows, width), width


def test_passages_of_any_block_size(spark):
    """Small blocks, anchors too frequent for a block, and both at once give the same passages."""
    rows = _corpus(8)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for block, wide in ((3, 4096), (8192, 0), (5, 2)):
        got = sorted(substrings.repeated_passages(docs, 7, block=block, wide=wide).collect(), key=lambda r: r.doc_id)
        ours = [
            (r.doc_id, r.n_words, r.n_removed, [x for s in r.spans for x in range(s.start, s.end)]) for r in got
        ]
        assert ours == _passages(rows, 7), (block, wide)


def test_factors_are_the_longest_matches():
    """Every factor is as long as any other phrase of the anchor allows, and every shared window lies in one."""
    pick = random.Random(9)
    width = 5
    for _ in range(200):
        base = [[pick.randrange(2) for _ in range(9)] for _ in range(4)]
        cut = [(pick.randrange(5), pick.randrange(5, 10)) for _ in range(12)]
        cut = [(a, max(b, a + width)) for a, b in cut if a + width <= 9]
        phrases = sorted({(pick.randrange(2), a, tuple(pick.choice(base)[a:b])) for a, b in cut})
        anchor = np.array([p[0] for p in phrases])
        inside = np.array([4 - p[1] for p in phrases])
        sizes = np.array([len(p[2]) for p in phrases])
        words = np.array([w for p in phrases for w in p[2]], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        asked = np.array([pick.random() < 0.8 for _ in phrases])
        got = {}
        for row, start, length in zip(*substrings.greedy_factors(anchor, inside, sizes, words, asked, width)):
            got.setdefault(int(row), []).append((int(start), int(length)))

        def longest(i, start):
            _, begin, mine = phrases[i]
            best = 0
            for j, (key, other, theirs) in enumerate(phrases):
                shift = begin + start - other
                if j != i and key == phrases[i][0] and 0 <= shift:
                    n = 0
                    while start + n < len(mine) and shift + n < len(theirs) and mine[start + n] == theirs[shift + n]:
                        n += 1
                    best = max(best, n)
            return best if best >= width else 0

        for i in range(len(phrases)):
            expected, start = [], 0
            while start + width <= len(phrases[i][2]):
                n = longest(i, start)
                if n:
                    expected.append((start, n))
                start += max(1, n - width + 1)
            assert got.get(i, []) == (expected if asked[i] else []), phrases


def test_copies_of_a_reference(spark):
    """Repeated rows stand for one reference; a variant that shares windows with them still loses these."""
    passage = [f"p{i}" for i in range(70)]
    variant = passage[:40] + ["other"] + passage[41:]
    rows = [(1, " ".join(passage))] * 30 + [(None, " ".join(passage))] * 5 + [(2, " ".join(variant)), (3, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substrings.repeated_passages(docs).collect())
    assert got == [(0, 70, 70)] * 5 + [(1, 70, 70)] * 30 + [(2, 70, 40), (3, 2, 0)]


def test_passages_of_long_words(spark):
    """Phrases of long words travel as hashes and meet phrases that travel as text."""
    words = [f"p{i}" if i % 9 else f"p{i}" + "y" * 150 for i in range(90)]
    texts = [words[:45] + [f"z{k}"] * 5 + words[50:] for k in range(3)] + [["x"] * 3 + words[1:40], words[40:] + ["u" * 5000]]
    rows = list(enumerate(" ".join(t) for t in texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for width in (35, 10):
        got = sorted(substrings.repeated_passages(docs, width).collect(), key=lambda r: r.doc_id)
        ours = [(r.doc_id, r.n_words, r.n_removed, [x for s in r.spans for x in range(s.start, s.end)]) for r in got]
        assert ours == _passages(rows, width), width


def test_passages_edges(spark):
    long = " ".join(f"x{i}" for i in range(50))
    rows = [(1, long, 0), (1, long, 0), (None, "short text", 0), (None, None, 0), (3, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, marks int")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substrings.repeated_passages(docs).collect())
    assert got == [(0, 0, 0), (0, 2, 0), (1, 50, 50), (1, 50, 50), (3, 0, 0)]
    assert substrings.repeated_passages(docs.limit(0)).count() == 0


def test_boilerplate(spark):
    shared, near = "All rights are reserved here.", "This line is on nine sites."
    rows = [(i, f"own line number {i}\n  {shared} \n{near if i < 9 else 'x'}\nshort", f"s{i}", 1) for i in range(12)]
    rows += [(50, shared, None, 1), (50, shared, None, 1), (None, None, "s1", 1), (51, "", "s1", 1)]
    rows += [(60 + i, "many times on one site only", "s0", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _id int").repartition(4)
    docs = docs.selectExpr("*", "_id AS n_lines", "_id AS line", "_id AS h1")
    got = lines.drop_boilerplate(docs)
    assert got.columns == ["doc_id", "text", "source", "_id", "line", "h1", "n_lines", "n_removed"]
    found = {}
    for r in got.collect():
        found.setdefault(r.doc_id, []).append((r.text, r.n_lines, r.n_removed))
    assert found[3] == [(f"own line number 3\n{near}\nshort", 4, 1)]
    assert found[50] == [("", 1, 1)] * 2
    assert found[None] == [(None, 0, 0)] and found[51] == [("", 1, 0)]
    assert found[60] == [("many times on one site only", 1, 0)]
    assert lines.drop_boilerplate(docs.limit(0)).count() == 0


def test_boilerplate_estimates_and_exact_counts(spark):
    """Far more sites than registers resolve exactly: both sides of the threshold are told apart."""
    rows = [(k, f"line of spread {n}", f"site{j}") for k, n in enumerate((980, 999, 1000, 1001, 1500)) for j in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = lines.drop_boilerplate(docs, min_sites=1000).where("n_removed > 0").select("doc_id").distinct()
    assert sorted(r.doc_id for r in out.collect()) == [2, 3, 4]


def test_short_lines_are_boilerplate_when_they_recur(spark):
    """On 20 sites 'Les.' needs nine times ten occurrences, 'Le treque.' three times, 'Oh' eleven times."""
    text = lambda s, i: f"Text {s} {i}\n" + ("\nOh" if i == 0 else "")
    rows = [(s * 10 + i, f"Les.\n Le treque.\n{text(s, i)}", f"s{s}") for s in range(20) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.drop_boilerplate(docs).collect()}
    assert got == {s * 10 + i: (text(s, i), 2) for s in range(20) for i in range(5)}


def test_boilerplate_of_few_sites(spark):
    rows = [(s, f"This line is on every site.\nThis one is on two sites only.\n{s}" if s < 2 else f"This line is on every site.\n{s}", f"s{s}") for s in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert lines.sites_needed(docs) == 4 and lines.sites_needed(docs.where("source = 's0'")) == 2
    got = {r.doc_id: r.text for r in lines.drop_boilerplate(docs).collect()}
    assert got == {0: "This one is on two sites only.\n0", 1: "This one is on two sites only.\n1", 2: "2", 3: "3"}


def test_line_hashes_are_independent(spark):
    row = lines._hashed(spark.sql("SELECT 'a line' AS line")).selectExpr("h2", "xxhash64(1, 'a line') AS own", "xxhash64('a line', 1) AS chained").first()
    assert row.h2 == row.own != row.chained
