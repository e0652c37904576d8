"""Token counts of byte-level byte-pair vocabularies by a heap over a linked list of symbols.

The count of a piece is its number of bytes less its number of merges. Only merges are counted;
no identifier is looked up or returned.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from flowlens.llm.tables import checked_broadcast

#: The split pattern of byte-level vocabularies, with white space as Unicode defines it.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Remembered pieces of a Python worker; a full table is emptied.
REMEMBERED = 500_000
REMEMBERED_CHARS = 48


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class TokenCounter:
    """Counts the tokens of one vocabulary file of byte-level BPE kind."""

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        before = spec.get("pre_tokenizer") or {}
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("only byte-level vocabularies with the usual split are supported")
        if spec.get("normalizer") or spec["model"].get("dropout") or spec["model"].get("ignore_merges"):
            raise ValueError("normalization, dropout and ignored merges are not supported")
        letters = _byte_letters()
        self.symbols = letters
        self.ranks: dict[tuple[str, str], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[left, right] = rank
        added = [t for t in spec.get("added_tokens", [])]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("special tokens that take in their surroundings are not supported")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.pieces = regex.compile(PIECES)
        self._done: dict[str, int] = {}

    def count_piece(self, piece: str) -> int:
        """Symbols left of one piece after all merges."""
        symbols: list[str | None] = [self.symbols[b] for b in piece.encode()]
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        ranks = self.ranks
        heap = [
            (rank, i, i + 1, symbols[i], symbols[i + 1])
            for i in range(n - 1)
            if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None
        ]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, j, left, right = heapq.heappop(heap)
            if symbols[i] is not left or symbols[j] is not right or after[i] != j:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = left + right, None
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rank := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (rank, i, k, symbols[i], symbols[k]))
            h = before[i]
            if h >= 0 and (rank := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (rank, h, i, symbols[h], symbols[i]))
        return n - merges

    def count(self, text: str) -> int:
        """Tokens of a whole text; each special string in it is one token."""
        if self.special is None or not self.special.search(text):
            return self._count_plain(text)
        plain = self.special.split(text)
        return len(plain) - 1 + sum(map(self._count_plain, plain))

    def _count_plain(self, text: str) -> int:
        total, done = 0, self._done
        for piece in self.pieces.findall(text):
            n = done.get(piece)
            if n is None:
                n = self.count_piece(piece)
                if len(piece) <= REMEMBERED_CHARS:
                    if len(done) >= REMEMBERED:
                        done.clear()
                    done[piece] = n
            total += n
        return total


@lru_cache(maxsize=2)
def counter(vocabulary: bytes) -> TokenCounter:
    return TokenCounter(vocabulary)


def token_count(docs: DataFrame, vocabulary_path: str, text: Column) -> Column:
    """A column with the number of tokens of `text` (null counts as empty: 0 tokens)."""
    with open(vocabulary_path, "rb") as file:
        vocabulary = file.read()
    shared = checked_broadcast(docs.sparkSession, vocabulary, len(vocabulary), "the vocabulary")

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = counter(shared.value)
        for batch in batches:
            yield pa.array((tokens.count(t or "") for t in batch.to_pylist()), pa.int64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, "long")(text)


def count_tokens(
    docs: DataFrame, vocabulary_path: str, text_col: str = "text", limit: int = 1024
) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit (more than `limit` tokens) to every row.

    Rows stay where they are (no shuffle); other columns are kept, same-named ones replaced. A null
    or empty text has 0 bytes and 0 tokens. Every row stands alone, so repeated rows and ties need
    no rule; an empty table stays empty.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (
        docs.withColumn("n_bytes", F.octet_length(text).cast("long"))
        .withColumn("n_tokens", token_count(docs, vocabulary_path, text))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
