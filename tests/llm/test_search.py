"""Secret scans, top-k search and decontamination against brute force."""

import math
import random
import re

import numpy as np

from flowlens.llm import decontam, secrets, topk


def _spans(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[1]) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    for k, a in enumerate(secrets.ALPHABETS):
        for m in re.finditer(f"[{a.letters}]+", text):
            if len(m[0]) < a.window or any(re.search(p, m[0]) for p in secrets.ALLOWED):
                continue
            if a.name == "entropy_urlsafe" and not set(m[0]) & set("-_"):
                continue
            spans = []
            for i in range(len(m[0]) - a.window + 1):
                part = m[0][i : i + a.window]
                counts = [part.count(c) for c in set(part)]
                if sum(round(secrets.SCALE * c * math.log2(c)) for c in counts) <= a.limit:
                    if spans and spans[-1][1] >= i:
                        spans[-1][1] = i + a.window
                    else:
                        spans.append([i, i + a.window])
            out += [(m.start() + x, 3 + k, a.name, m.start() + y) for x, y in spans]
    return sorted(out)


def test_secrets_equal_brute_force(spark):
    pick = random.Random(2)
    alphabet = "".join(chr(c) for c in range(33, 127))
    key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzK3Yq9v8"
    texts = [
        None, "", "token=secret: abcdefgh1", 'PASSWORD = "hunter2hunter2"', "api_key: short", "é😀 secret=abc/def+12345 x",
        "AKIA" + "ABCD1234EFGH5678", "AKIAAKIA12", "id " + "0123456789abcdef" * 3, "deadbeef" * 5, f"x {key} y {key * 3}",
        "a" * 40 + key + "b" * 40, "thisisaverylongwordwithoutanydigitsatall", "f" * 31 + " " + "f" * 32, "9f86d081884c7d659a2feaa0c55ad015",
        "password=" * 400 + "12345678", " ".join(["token: abcdefgh12"] * 700),
    ]
    texts += ["".join(pick.choice(alphabet + "  ") for _ in range(300)) for _ in range(60)]
    texts += ["".join(pick.choice("0123456789abcdefXYZ ") for _ in range(400)) for _ in range(40)]
    texts += ["".join(pick.choice("0123456789ABCDEF ") if pick.random() < 0.97 else "_" for _ in range(300)) for _ in range(20)]
    texts += ["".join(pick.choice(alphabet.replace("+", "_")[10:]) if pick.random() < 0.1 else pick.choice("abcXYZ019-_ghijKLMN") for _ in range(200)) for _ in range(20)]
    texts += ["test" * 9, "example-" * 8 + "X1", "0123456789abcdef" * 2, "ABCDEF" * 6 + "1", "Sample_" * 5]
    texts += [" ".join("".join(pick.choice("abcdefABCDEF0123456789+/") for _ in range(60)) for _ in range(4)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for row in secrets.scan(docs).collect():
        got = [(s["start"], s["order"], s["kind"], s["end"]) for s in row.secrets]
        assert got == _spans(row.text), row.text[:100]


def test_secret_classes_and_stock_words(spark):
    """Upper-case hex, URL-safe tokens and random rests after stock words are found; stock words alone are not."""
    upper, safe = "9F86D081884C7D659A2FEAA0C55AD015", "wJalrXUtn-FEMIK7_MDENGbPxRf-iCYzK3Yq9v8"
    rest = "wJalrXUtnFEMIK7MDENGbPxRfiCYzK3Yq9v8"
    texts = [upper, safe, "test" + rest, "0123456789" + rest, "0123456789abcdef" * 3, "exampleplaceholder_sample-test", "test" * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {s["kind"]: (s["start"], s["end"]) for s in r.secrets} for r in secrets.scan(docs).collect()}
    assert got[0] == {"entropy_hex_upper": (0, 32)}
    assert set(got[1]) == {"entropy_urlsafe"} and got[1]["entropy_urlsafe"][1] == len(safe)
    for i in (2, 3):
        assert set(got[i]) == {"entropy_base64"} and got[i]["entropy_base64"][1] == len(texts[i])
    # The base pattern for hex still takes the repeated alphabet; its entropy is not looked at.
    assert set(got[4]) == {"hex"} and not got[5] and not got[6]


def test_secret_edges(spark):
    docs = spark.createDataFrame([(1, "token=abcdefghij", "x"), (1, "token=abcdefghij", "x"), (None, None, None)], "doc_id long, text string, secrets string")
    out = secrets.scan(docs)
    assert out.columns == ["doc_id", "text", "secrets"]
    assert sorted(len(r.secrets) for r in out.collect()) == [0, 1, 1]
    assert secrets.scan(docs.limit(0)).count() == 0


def _best(rows, k, every):
    held = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            held[i] = [math.floor(64 * x) for x in v]
    out = []
    for q in sorted(held):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(held[q], v)), i) for i, v in held.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return out


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 200)
    monkeypatch.setattr(topk, "QUERIES", 20)
    pick = random.Random(6)
    rows = [(i, [pick.gauss(i % 5, 0.3) for _ in range(6)]) for i in range(900)]
    rows += [(900 + i, [1.0, 1.0, 0.5, 0.0, -1.0, 2.0]) for i in range(300)]
    rows += [(None, [1.0] * 6), (2000, None), (2001, [1.0, None] * 3), (2002, [float("nan")] * 6), (2020, [float("inf")] * 6), (-20, [-1.0] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(5)
    got = sorted(tuple(r) for r in topk.top_k(df, k=7, every=20).collect())
    assert got == sorted(_best(rows, 7, 20))
    assert topk.top_k(df.where("vec_id in (0, 3)")).count() == 1
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_of_huge_components():
    ids = np.arange(30)
    points = np.random.default_rng(1).integers(-(2**30), 2**30, (30, 3))
    best = topk.search_block(ids[:3], points[:3], ids, points, 4)
    for q in range(3):
        exact = sorted((-sum(int(a) * int(b) for a, b in zip(points[q], points[i])), i) for i in range(30) if i != q)[:4]
        assert best.id[q].tolist() == [i for _, i in exact]


def _words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def _contaminated(docs, items, width):
    wanted = {}
    for name, text in items:
        w = _words(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wanted.setdefault(tuple(w[i : i + n]), set()).add(str(name))
    out = []
    for i, text in docs:
        w, hit, names = _words(text), set(), set()
        for n in {len(k) for k in wanted}:
            for s in range(len(w) - n + 1):
                if found := wanted.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    names |= found
        out.append((i, len(w), len(hit), sorted(names), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def _fixture():
    pick = random.Random(8)
    words = ["the", "of", "Über", "X1", "and", "fox", "日本", *(f"t{i}" for i in range(40))]
    items = [(i, " ".join(pick.choice(words) for _ in range(pick.randint(1, 30)))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "..."), (93, items[0][1]), (94, "the")]
    docs = []
    for i in range(150):
        parts = [pick.choice(words) for _ in range(pick.randint(0, 200))]
        if i % 3 == 0:
            parts[len(parts) // 2 : 0] = pick.choice(items[:25])[1].upper().split()
        docs.append((i, ", ".join(parts)))
    return docs + [(500, None), (501, ""), (502, "fox " * 3000)], items


def test_decontamination_equals_brute_force(spark):
    docs, items = _fixture()
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    right = spark.createDataFrame(items, "item_id long, text string")
    # One part; several parts on one index; parts whose terms need several indexes.
    for part_bytes in (1 << 20, 20_000, 300):
        got = decontam.contaminated(left, right.limit(12) if part_bytes == 300 else right, part_bytes=part_bytes).collect()
        ours = sorted((r.doc_id, r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in got)
        assert ours == _contaminated(docs, right.limit(12).collect() if part_bytes == 300 else items, 13), part_bytes


def test_long_items_are_cut_into_pieces(spark):
    pick = random.Random(4)
    long = [f"t{pick.randint(0, 900)}" for _ in range(2000)]
    items = [("long", " ".join(long)), (None, "alone here"), ("b", "w " * 70)]
    docs = [(i, " ".join([*(f"u{k}" for k in range(20)), *long[at : at + n]])) for i, (at, n) in enumerate([(0, 13), (95, 40), (1987, 13), (1988, 12)])]
    docs += [(9, "Alone, here"), (10, "w " * 13), (10, "w " * 13)]
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame(items, "item_id string, text string")
    pieces = decontam.item_pieces(right, piece=100).collect()
    assert max(r.n for r in pieces) == 100 and sum(r.n for r in pieces) == 1988 + 1 + 58
    for part_bytes in (1 << 20, 40_000):
        got = decontam.contaminated(left, right, part_bytes=part_bytes, piece=100).collect()
        ours = sorted((r.doc_id, r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in got)
        assert ours == _contaminated(docs, [(n or "", t) for n, t in items], 13)


def test_decontamination_edges(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (1, "a b", 1), (1, "a b", 1)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([("x", "B", 2)], "item_id string, text string, doc_id int")
    got = sorted((r.doc_id or 0, r.n_hit, r.contaminated) for r in decontam.contaminated(docs, items).collect())
    assert got == [(0, 1, True), (1, 1, True), (1, 1, True)]
    assert [r.n_hit for r in decontam.contaminated(docs, items.limit(0)).collect()] == [0, 0, 0]
    assert decontam.contaminated(docs.limit(0), items).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red a b c fox"), (2, "fox b red"), (3, "red"), (4, None)], "doc_id long, text string")
    queries = list(zip(["near", "none"], decontam.item_terms(["red fox", "red zebra"])))
    terms = np.unique(np.concatenate([t for _, t in queries]))
    index = decontam.build_index(decontam.numbered(docs), terms)
    got = lambda d: sorted(tuple(r) for r in decontam.proximity(index, queries, d).collect())
    assert got(2) == [(2, "near", 1)]
    assert got(4) == [(1, "near", 1), (2, "near", 1)]
