"""SentencePiece encoding and decoding with a table of last tokens.

For every prefix of a text there is exactly one token that its encoding ends with. The table is
filled from left to right: an automaton gives the pieces that end at a position, and a piece is
the last token if it and the last token of the prefix before it stay apart when the two alone are
merged. The ids are then read off backwards. No merge queue runs over the text.

Texts fall apart at places that no piece of the vocabulary spans (before a word mark, around
characters that are in no piece); these parts are encoded on their own and remembered in a
bounded table, as most words repeat.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F, types as T

from flowlens.llm.tables import checked_broadcast

MARK = "▁"
#: Remembered parts and pairs of a Python worker; a full table is emptied, so memory stays bounded.
REMEMBERED = 300_000
#: Longer parts are encoded but not remembered.
REMEMBERED_CHARS = 48


class PieceCodec:
    """Encoder and decoder of one byte-fallback BPE model with identity normalization.

    Begin, end and unknown ids are never produced; their strings in a text are ordinary text.
    """

    def __init__(self, model: bytes):
        source = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = source.get_piece_size()
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = [-1] * 256
        #: Bytes that a token shows; None for control and unknown tokens, which end a run of byte tokens.
        self.shown: list[bytes | None] = [None] * size
        self.unknown = source.unk_id()
        self.is_byte = bytearray(size)
        for i in range(size):
            piece = source.id_to_piece(i)
            if source.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.shown[i], self.is_byte[i] = i, bytes([value]), 1
            elif not source.is_control(i) and not source.is_unknown(i):
                if source.is_unused(i):
                    raise ValueError("models with unused pieces are not supported")
                self.ids[piece], self.scores[piece] = i, source.get_score(i)
                self.shown[i] = piece.replace(MARK, " ").encode()
        if min(self.byte_ids) < 0:
            raise ValueError("the model has no byte fallback")
        probe = "ﬁ  x "
        if source.normalize(probe) != (MARK + probe.replace(" ", MARK)):
            raise ValueError("only identity normalization with a leading word mark is supported")
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        known = {c for piece in self.ids for c in piece}
        if not known <= self.ids.keys():
            raise ValueError("a character of some piece is no piece itself")
        inside = [(a, b) for piece in self.ids for a, b in zip(piece, piece[1:])]
        groups = [known - {MARK}]
        if not any(a.isalpha() != b.isalpha() for a, b in inside if a != MARK):
            groups = [{c for c in groups[0] if c.isalpha()}, {c for c in groups[0] if not c.isalpha()}]
        classes = ["".join(map(re.escape, sorted(group))) for group in groups if group]
        if any(a != MARK and b == MARK for a, b in inside):
            self.parts = re.compile(f"(?s)[{MARK}{''.join(classes)}]+|.")
        else:
            self.parts = re.compile("(?s)" + "".join(f"{MARK}*[{c}]+|" for c in classes) + f"{MARK}+|.")
        #: By left token: whether it and a right token stay apart.
        self._apart: dict[str, dict[str, bool]] = {}
        self._pairs = 0
        self._done: dict[str, array] = {}

    def _merged(self, text: str) -> list[str]:
        """The symbols of a short text after all merges, best score first, leftmost among equals."""
        symbols, scores = list(text), self.scores
        while len(symbols) > 1:
            at, best = -1, None
            for i in range(len(symbols) - 1):
                score = scores.get(symbols[i] + symbols[i + 1])
                if score is not None and (best is None or score > best):
                    at, best = i, score
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _compatible(self, left: str, right: str) -> bool:
        """Whether two tokens side by side are what their joined text is merged to; left may be none."""
        if self._pairs >= REMEMBERED:
            self._apart.clear()
            self._pairs = 0
        self._pairs += 1
        found = self._merged(left + right) == ([left, right] if left else [right])
        self._apart.setdefault(left, {})[right] = found
        return found

    def _encode_part(self, part: str) -> array:
        if part not in self.ids and len(part) == 1:
            return array("i", [self.byte_ids[b] for b in part.encode()])
        n = len(part)
        last: list[str | None] = [None] * (n + 1)
        last[0] = ""
        apart, compatible, none = self._apart, self._compatible, {}
        for end, piece in self.automaton.iter(part):
            if last[end + 1] is not None:
                continue
            left = last[end + 1 - len(piece)]
            if left is None:
                continue
            found = apart.get(left, none).get(piece)
            if found or found is None and compatible(left, piece):
                last[end + 1] = piece
        out, at = [], n
        while at:
            piece = last[at]
            if piece is None:
                raise ValueError(f"no last token at {at} of {part!r}")
            out.append(self.ids[piece])
            at -= len(piece)
        out.reverse()
        return array("i", out)

    def forget(self) -> None:
        """Empty the tables of words and pairs seen; idle workers keep only the model."""
        self._done.clear()
        self._apart.clear()
        self._pairs = 0

    def encode(self, text: str) -> array:
        """Ids of a whole text."""
        ids = array("i")
        if not text:
            return ids
        done = self._done
        for part in self.parts.findall(MARK + text.replace(" ", MARK)):
            got = done.get(part)
            if got is None:
                got = self._encode_part(part)
                if len(part) <= REMEMBERED_CHARS:
                    if len(done) >= REMEMBERED:
                        done.clear()
                    done[part] = got
            ids += got
        return ids

    def decode(self, ids) -> str:
        """Text of some ids; bytes that form no character become replacement characters."""
        if not len(ids):
            return ""
        shown = self.shown
        try:
            text = b"".join([shown[i] for i in ids]).decode()
        except (TypeError, UnicodeDecodeError):
            text = self._decode_broken(ids)
        first = ids[0]
        marked = shown[first] is not None and not self.is_byte[first] and shown[first].startswith(b" ")
        return text[1:] if marked else text

    def _decode_broken(self, ids) -> str:
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += self.shown[i]
                continue
            while run:
                for width in (1, 2, 3, 4):
                    try:
                        out.append(run[:width].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    width = 1
                del run[:width]
            if i is not None and self.shown[i] is not None:
                out.append(self.shown[i].decode())
            elif i == self.unknown:
                out.append(" ⁇ ")
        return "".join(out)


@lru_cache(maxsize=2)
def codec(model: bytes) -> PieceCodec:
    return PieceCodec(model)


def encode_decode(
    docs: DataFrame,
    model_path: str,
    text_col: str = "text",
    ids_col: str = "ids",
    decoded_col: str = "decoded",
) -> DataFrame:
    """Add the ids of every text and the text decoded from them.

    All columns and rows of the input are kept in place (no shuffle); columns named like the two
    new ones are replaced. A null or empty text has no ids and decodes to the empty text. Repeated
    rows and ties need no rule, as every row stands alone; an empty table stays empty. The model
    file is read on the driver and broadcast (at most 64 MB).
    """
    with open(model_path, "rb") as file:
        model = file.read()
    shared = checked_broadcast(docs.sparkSession, model, len(model), "the model")
    kept = docs.drop(ids_col, decoded_col)
    schema = T.StructType(
        [*kept.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(decoded_col, T.StringType())]
    )
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece_codec = codec(shared.value)
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    flat, ends, texts = array("i"), array("i", [0]), []
                    for text in part.column(at).to_pylist():
                        ids = piece_codec.encode(text or "")
                        texts.append(piece_codec.decode(ids))
                        flat += ids
                        ends.append(len(flat))
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                    names = [*part.schema.names, ids_col, decoded_col]
                    yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(texts, pa.string())], names=names)
        finally:
            piece_codec.forget()

    return kept.mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """The columns of the check: counts and hashes of ids and decoded text."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
