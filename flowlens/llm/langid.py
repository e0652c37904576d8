"""Language identification of mixed texts by expectation-maximisation.

Each language is a distribution over hashed byte trigrams of words. A text is a mixture: the words
are drawn from languages in unknown proportions, which expectation-maximisation estimates from the
words' likelihoods. How many languages a text has is chosen by penalised likelihood among nested
sets of its strongest languages, from one up to all. The prediction is the language with the largest
proportion.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm import words as W
from flowlens.llm.tables import checked_broadcast, unused

#: Trigram cells of a language.
CELLS = 1 << 15
#: At most about this many labelled rows are learned from, picked by a hash of their ids.
TRAIN_ROWS = 20_000
#: Estimation ends for a text when no proportion moves by more than this in a round.
SETTLED = 1e-4
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")


@dataclass
class Languages:
    names: list[str]
    #: Log probability of each cell in each language: cells x languages.
    cells: np.ndarray


def _trigrams(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the trigrams of some words with a mark at both ends, and the first trigram of each word."""
    lengths = ends - starts
    total = np.concatenate([[0], np.cumsum(lengths)])
    place = np.arange(total[-1]) - np.repeat(total[:-1], lengths)
    at = place + np.repeat(starts, lengths)
    byte = buf[at].astype(np.uint32)
    before = np.where(place == 0, 1, buf[np.maximum(at - 1, 0)]).astype(np.uint32)
    last = place == np.repeat(lengths, lengths) - 1
    after = np.where(last, 2, buf[np.minimum(at + 1, len(buf) - 1)]).astype(np.uint32)
    code = (before << np.uint32(16)) | (byte << np.uint32(8)) | after
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - CELLS.bit_length() + 1)).astype(np.int32), total


def _word_runs(texts: list[str | None]):
    """(first text, buffer, starts, ends, bounds) of runs of texts; words hold no ASCII but letters."""
    for first, raw in W.chunks([t.lower() if isinstance(t, str) else t for t in texts]):
        yield first, *W.split(raw, "letters", lower=True)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, key: Column | None = None) -> Languages:
    """Learn from labelled rows, at most about `rows` of them; null texts and labels teach nothing.

    Trigrams are counted per task and summed by Spark; the driver gets one row per language and cell.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = known.count()
    key = F.xxhash64(text_col) if key is None else key
    if n > rows:
        known = known.where(F.pmod(key, F.lit(1_000_000)) < int(1_000_000 * rows / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in (piece for whole in batches for piece in W.pieces(whole)):
            langs = batch.column(1).to_pylist()
            for first, buf, starts, ends, bounds in _word_runs(batch.column(0).to_pylist()):
                cells, total = _trigrams(buf, starts, ends)
                for d in range(len(bounds) - 1):
                    part = cells[total[bounds[d]] : total[bounds[d + 1]]]
                    held = sums.setdefault(langs[first + d], np.zeros(CELLS, np.int64))
                    held += np.bincount(part, minlength=CELLS)
        for lang, held in sums.items():
            found = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int32)), pa.array(held[found])],
                names=["lang", "cell", "n"],
            )

    counted = known.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")).mapInArrow(
        run, "lang string, cell int, n long"
    )
    table = counted.groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    langs = table.column("lang").to_pylist()
    names = sorted(set(langs))
    counts = np.full((CELLS, len(names)), 0.5)
    where = {name: i for i, name in enumerate(names)}
    counts[table.column("cell").to_numpy(), [where[x] for x in langs]] += table.column("n").to_numpy()
    return Languages(names, np.log(counts / counts.sum(axis=0)) if names else counts)


def _mixture(p: np.ndarray, doc: np.ndarray, heads: np.ndarray, n: np.ndarray, allowed: np.ndarray):
    """Proportions and log likelihood of each text; `allowed` marks the languages of its set.

    Each text has as many rounds as it needs by itself, so its neighbours do not change its result.
    """
    share = allowed / allowed.sum(axis=1, keepdims=True)
    going, rows, of, first = np.arange(len(n)), p, doc, heads
    while len(going):
        part = rows * share[going][of]
        part /= part.sum(axis=1, keepdims=True)
        new = np.add.reduceat(part, first, axis=0) / n[going][:, None]
        still = np.abs(new - share[going]).max(axis=1) > SETTLED
        share[going] = new
        if not still.all():
            rows, going = rows[still[of]], going[still]
            of = np.repeat(np.arange(len(going)), n[going])
            first = np.cumsum(n[going]) - n[going]
    fit = np.add.reduceat(np.log((p * share[doc]).sum(axis=1)), heads)
    return share, fit


def proportions(model: Languages, texts: list[str | None]) -> np.ndarray:
    """Language proportions of each text after the choice of its set; zeros without words."""
    out = np.zeros((len(texts), len(model.names)))
    if not model.names:
        return out
    for first, buf, starts, ends, bounds in _word_runs(texts):
        counts = np.diff(bounds)
        full = np.flatnonzero(counts)
        if not len(full):
            continue
        _, one, back = np.unique(W.hashes(buf, starts, ends), return_index=True, return_inverse=True)
        cells, total = _trigrams(buf, starts[one], ends[one])
        each = np.add.reduceat(model.cells[cells], total[:-1], axis=0)
        each = np.exp(np.maximum(each - each.max(axis=1, keepdims=True), -60.0))[back]
        n, heads, doc = counts[full], bounds[:-1][full], np.repeat(np.arange(len(full)), counts[full])
        share, most = _mixture(each, doc, heads, n, np.ones((len(full), len(model.names))))
        rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1)
        best, score = None, None
        # Each further language has to pay for one more free proportion and its choice.
        price = 0.5 * np.log(n) + np.log(len(model.names))
        for size in range(1, len(model.names) + 1):
            # No set fits better than all languages together, up to what is left of the estimation.
            if best is not None and (most + SETTLED * n - (size - 1) * price <= score).all():
                break
            part, fit = _mixture(each, doc, heads, n, (rank < size).astype(float))
            value = fit - (size - 1) * price
            if best is None:
                best, score = part, value
            else:
                better = value > score
                best[better], score[better] = part[better], value[better]
        out[first + full] = best
    return out


def identify(
    docs: DataFrame,
    model: Languages,
    text_col: str = "text",
    pred_col: str = "lang_pred",
    score_col: str = "score",
    shares_col: str = "lang_shares",
) -> DataFrame:
    """Add the predicted language, its proportion (0 to 1) and the proportions of the language set.

    A null text, or one without any letter (a character of the category L), is `und` with score 0 and no proportions; so is every
    text if no language was learned. Ties go to the language first in the alphabet. All rows and
    columns stay in place, columns with the new names are replaced, an empty table stays empty.
    """
    shared = checked_broadcast(docs.sparkSession, model, model.cells.nbytes, "the language model")
    text = F.col(text_col).cast("string")
    schema = f"{pred_col} string, {score_col} double, {shares_col} map<string,double>"
    arrow = pa.struct([(pred_col, pa.string()), (score_col, pa.float64()), (shares_col, pa.map_(pa.string(), pa.float64()))])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        languages = shared.value
        for batch in batches:
            rows = []
            for piece in W.pieces(batch):
                texts = piece.to_pylist()
                for text, share in zip(texts, proportions(languages, texts)):
                    if text is None or not share.any() or not _LETTER.search(text):
                        rows.append({pred_col: UNKNOWN, score_col: 0.0, shares_col: []})
                        continue
                    top = int(share.argmax())
                    held = [(languages.names[i], float(share[i])) for i in np.flatnonzero(share)]
                    rows.append(
                        {pred_col: languages.names[top], score_col: min(1.0, float(share[top])), shares_col: held}
                    )
            yield pa.array(rows, arrow)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    found = F.arrow_udf(run, schema)(text)
    kept = docs.drop(pred_col, score_col, shares_col)
    (held,) = unused(kept, "__language")
    return kept.withColumn(held, found).select(*kept.columns, f"{held}.*")
