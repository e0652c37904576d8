"""Encoders and counters against the libraries."""

import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from flowlens.llm import sentencepieces, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _texts():
    pick = random.Random(4)
    units = ["a", "th", "the", "ing", " ", "  ", "▁", "\n", "é", "日", "😀", "12", ".,", "\t", "\x1f", "́", "<s>", "<0x0A>", "<|endoftext|>", "'s", "="]
    mixed = ["".join(pick.choice(units) for _ in range(pick.randint(1, 50))) for _ in range(700)]
    wild = ["".join(chr(pick.choice([pick.randint(1, 0x2FF), pick.randint(0x300, 0xD7FF), pick.randint(0xE000, 0x1FFFF)])) for _ in range(20)) for _ in range(300)]
    return ["", " ", *(" " * n + "x" for n in range(40)), *mixed, *wild, "word " * 30_000, "x" * 5000]


def test_pieces_equal_library():
    ours = sentencepieces.PieceCodec(open(MODEL, "rb").read())
    theirs = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for text in _texts():
        ids = theirs.encode(text)
        assert list(ours.encode(text)) == ids, text[:80]
        assert ours.decode(ids) == theirs.decode(ids)


def test_decoding_of_any_ids():
    ours = sentencepieces.PieceCodec(open(MODEL, "rb").read())
    theirs = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    pick = random.Random(5)
    for _ in range(500):
        ids = [pick.choice([pick.randrange(3, 32000), pick.randrange(3, 260)]) for _ in range(8)]
        assert ours.decode(ids) == theirs.decode(ids), ids


def test_counts_equal_library():
    ours = token_counts.TokenCounter(open(VOCABULARY, "rb").read())
    theirs = Tokenizer.from_file(VOCABULARY)
    for text in _texts():
        assert ours.count(text) == len(theirs.encode(text, add_special_tokens=False).ids), text[:80]


def test_encode_edges(spark):
    rows = [(1, "hello  world", "a"), (1, "hello  world", "a"), (None, None, None), (2, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = sentencepieces.encode_decode(docs, MODEL)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    found = sorted(out.collect(), key=repr)
    assert len(found) == 4
    assert all(row.decoded == (row.text or "") and (len(row.ids) > 0) == bool(row.text) for row in found)
    assert sentencepieces.encode_decode(docs.limit(0), MODEL).count() == 0


def test_count_edges(spark):
    docs = spark.createDataFrame([(1, "é a", 7), (None, None, 7), (2, "", 7), (2, "x " * 2000, 7)], "doc_id long, text string, n_tokens int")
    out = token_counts.count_tokens(docs, VOCABULARY).orderBy("n_bytes").collect()
    assert [r.n_bytes for r in out] == [0, 0, 4, 4000]
    assert [r.over_limit for r in out] == [False, False, False, True]
    assert token_counts.count_tokens(docs.limit(0), VOCABULARY).count() == 0


def test_unsupported_vocabulary():
    with pytest.raises((ValueError, KeyError)):
        token_counts.TokenCounter(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read())
