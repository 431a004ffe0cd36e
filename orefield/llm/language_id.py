"""Language of texts by unigrams of vocabulary pieces, summed over all segmentations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.llm.quality import held_out
from orefield.llm.shared import bounded_batches
from orefield.llm.textnum import Stretches, buffers, hashes, runs

#: Letters of a text stand alone between spaces when it comes here.
LETTERS = np.ones(256, np.uint8)
LETTERS[32] = 0
#: Keeps products of probabilities in range; it cancels out.
SCALE = 24.0
#: Sums are brought back to one after so many bytes.
RESCALE = 8
#: So many bytes of words are summed at once, or one word.
ROOM = 1 << 15
#: So many words' scores a task remembers.
MOST_SEEN = 500_000


def vocabulary(model_file: str) -> list[bytes]:
    """The distinct pieces, lower-cased and without their mark of a word's begin, and every single byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    found = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            found.add(model.id_to_piece(i).replace("▁", "").lower().encode())
    return sorted(found - {b""})


class Pieces:
    """Finds pieces in many words at once."""

    def __init__(self, pieces: list[bytes]):
        self.size, self.longest = len(pieces), max(map(len, pieces))
        self.tables = []
        for length in range(1, self.longest + 1):
            ids = np.array([i for i, p in enumerate(pieces) if len(p) == length], np.int64)
            data = np.frombuffer(b"".join(pieces[i] for i in ids), np.uint8)
            start = np.arange(len(ids)) * length
            value = hashes(data, start, start + length)
            order = np.argsort(value)
            self.tables.append((value[order], ids[order]))

    def find(self, words: np.ndarray) -> np.ndarray:
        """[word, end, length - 1]: the piece of that length that ends there; ``size`` where none does. words: [word, byte]."""
        n, width = words.shape
        stretches = Stretches(words.ravel())
        out = np.full((n, width + 1, self.longest), self.size, np.int32)
        for length in range(1, min(width, self.longest) + 1):
            known, ids = self.tables[length - 1]
            if len(known):
                at = (np.arange(n)[:, None] * width + np.arange(width - length + 1)).ravel()
                value = stretches.hashes(at, at + length)
                place = np.minimum(np.searchsorted(known, value), len(known) - 1)
                hit = np.where(known[place] == value, ids[place], self.size)
                out[:, length:, length - 1] = hit.reshape(n, -1)
        return out


def _steps(found: np.ndarray, size: int) -> list[list[int]]:
    """For each end the lengths of the pieces that end there in some word."""
    met = (found != size).any(axis=0)
    return [(np.flatnonzero(m) + 1).tolist() for m in met]


def forward(found: np.ndarray, scaled: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """[word, language]: the natural log of the sum over all segmentations of the products of piece probabilities, times SCALE per byte; and the sums up to each end.

    The sums of as many ends as the longest piece has bytes are held and brought back to one now and then, so a word may have any length.
    With ``keep``, (sum, log of what it was divided by) of every end comes too.
    """
    n, ends, longest = found.shape
    window = np.zeros((longest, n, scaled.shape[1]))
    window[0] = 1
    offset, kept = np.zeros(window.shape[1:]), [(window[0].copy(), np.zeros(window.shape[1:]))] if keep else []
    new = window[0]
    for end, lengths in enumerate(_steps(found, len(scaled) - 1)):
        if not end:
            continue
        new = np.zeros(window.shape[1:])
        for length in lengths:
            new += window[(end - length) % longest] * scaled[found[:, end, length - 1]]
        window[end % longest] = new
        if keep:
            kept.append((new.copy(), offset.copy()))
        if end % RESCALE == 0:
            offset += np.log(new)
            window /= new
            new = window[end % longest]
    return np.log(new) + offset, kept


def backward(found: np.ndarray, scaled: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sum, log of what it was divided by) over all segmentations from each end to the word's last."""
    n, ends, longest = found.shape
    window = np.zeros((longest, n, scaled.shape[1]))
    last, steps = ends - 1, _steps(found, len(scaled) - 1)
    window[last % longest] = 1
    offset, kept = np.zeros(window.shape[1:]), [(window[last % longest].copy(), np.zeros(window.shape[1:]))]
    starts: list[list[tuple[int, int]]] = [[] for _ in range(ends)]
    for end, lengths in enumerate(steps):
        for length in lengths:
            starts[end - length].append((end, length))
    for begin in range(last - 1, -1, -1):
        new = np.zeros(window.shape[1:])
        for end, length in starts[begin]:
            new += window[end % longest] * scaled[found[:, end, length - 1]]
        window[begin % longest] = new
        kept.append((new.copy(), offset.copy()))
        if (last - begin) % RESCALE == 0:
            offset += np.log(new)
            window /= new
    return kept[::-1]


def scale(probability: np.ndarray, pieces: list[bytes]) -> np.ndarray:
    """Piece probabilities times SCALE per byte, and a row of zeros for no piece."""
    lengths = np.array([len(p) for p in pieces])
    return np.concatenate([probability * SCALE ** lengths[:, None], np.zeros((1, probability.shape[1]))])


def lettered(text: Column) -> Column:
    """A text's letters in lower case, a space for each run of anything else."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")


@dataclass
class LanguageModel:
    languages: list[str]
    pieces: list[bytes]
    scaled: np.ndarray

    def word_scores(self, finder: Pieces, data: np.ndarray, start: np.ndarray, width: np.ndarray) -> np.ndarray:
        """[word, language]: log probability of each stretch of bytes."""
        out = np.zeros((len(start), len(self.languages)))
        order = np.argsort(width, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(width[order])) + 1) if len(order) else []:
            size = int(width[some[0]])
            for part in np.array_split(some, len(some) * (size + 1) // ROOM + 1):
                if len(part):
                    found = finder.find(data[start[part][:, None] + np.arange(size)])
                    out[part] = forward(found, self.scaled)[0] - size * np.log(SCALE)
        return out

    def totals(self, finder: Pieces, data: np.ndarray, offsets: np.ndarray, seen: "Seen | None" = None) -> np.ndarray:
        """[row, language]: log probability of a row's letters; each distinct word is summed once, and not again if ``seen`` knows it."""
        seen = seen or Seen(len(self.languages))
        start, end, row = runs(LETTERS[data], offsets)
        value, first, inverse = np.unique(hashes(data, start, end), return_index=True, return_inverse=True)
        known, score = seen.get(value)
        new = np.flatnonzero(~known)
        score[new] = self.word_scores(finder, data, start[first[new]], (end - start)[first[new]])
        seen.add(value[new], score[new])
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        if len(row):
            begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            out[row[begin]] = np.add.reduceat(score[inverse.ravel()], begin)
        return out


class Seen:
    """Scores of words by hash; beyond MOST_SEEN it starts anew."""

    def __init__(self, n_languages: int):
        self.keys, self.scores = np.empty(0, np.uint64), np.empty((0, n_languages))

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros((len(keys), self.scores.shape[1]))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, self.scores[at]

    def add(self, keys: np.ndarray, scores: np.ndarray) -> None:
        if len(self.keys) + len(keys) > MOST_SEEN:
            self.keys, self.scores = keys, scores
            return
        both = np.concatenate((self.keys, keys))
        order = np.argsort(both, kind="stable")
        self.keys, self.scores = both[order], np.concatenate((self.scores, scores))[order]


def learn(words: list[tuple[str, bytes, int]], pieces: list[bytes], rounds: int = 3, smoothing: float = 0.5) -> LanguageModel:
    """Piece probabilities per language by expectation maximisation over (language, word, count)."""
    languages = sorted({w[0] for w in words})
    finder = Pieces(pieces)
    probability = np.full((len(pieces), len(languages)), 1 / len(pieces))
    groups = []
    for i, language in enumerate(languages):
        by_width: dict[int, list] = {}
        for name, word, n in words:
            if name == language:
                by_width.setdefault(len(word), []).append((word, n))
        for width, own in by_width.items():
            data = np.frombuffer(b"".join(w for w, _ in own), np.uint8).reshape(-1, width)
            for part in np.array_split(np.arange(len(own)), len(own) * (width + 1) // ROOM + 1):
                if len(part):
                    groups.append((i, width, data[part], np.array([own[j][1] for j in part], float)))
    for _ in range(rounds):
        scaled, counts = scale(probability, pieces), np.full((len(pieces) + 1, len(languages)), smoothing)
        for i, width, data, n in groups:
            found = finder.find(data)
            own = scaled[:, i : i + 1]
            total, before = forward(found, own, keep=True)
            after = backward(found, own)
            for end, lengths in enumerate(_steps(found, len(pieces))):
                for length in lengths:
                    ids = found[:, end, length - 1]
                    (a, log_a), (b, log_b) = before[end - length], after[end]
                    share = n * (a * b * np.exp(log_a + log_b - total))[:, 0] * own[ids, 0]
                    counts[:, i] += np.bincount(ids, share, minlength=len(counts))
        counts = counts[:-1]
        probability = counts / counts.sum(0)
    return LanguageModel(languages, pieces, scale(probability, pieces))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of a batch."""
    for batch in batches:
        counts: dict[tuple[str, bytes], int] = {}
        langs = batch.column("lang").to_pylist()
        for first, data, offsets in buffers(batch.column("text")):
            for a, b, r in zip(*(x.tolist() for x in runs(LETTERS[data], offsets))):
                key = langs[first + r], data[a:b].tobytes()
                counts[key] = counts.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.binary()), pa.array(counts.values(), pa.int64())], names=["lang", "word", "n"])


def fit_languages(docs: DataFrame, model_file: str, rows_each: int = 300, max_bytes: int = 20_000) -> LanguageModel | None:
    """A model from ``docs`` (doc_id, text, lang): of each language about ``rows_each`` rows of at most ``max_bytes`` bytes, chosen by a hash of the id.

    None where no row has a language.
    """
    docs = docs.filter(F.col("lang").isNotNull() & (F.octet_length("text") <= max_bytes) & F.col("text").rlike(r"\p{L}"))
    sizes = docs.groupBy("lang").count()
    some = docs.join(F.broadcast(docs.sparkSession.createDataFrame(sizes.collect(), sizes.schema)), "lang")  # a row per language
    some = some.filter(F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30)) * F.col("count") <= F.lit(rows_each << 30))
    words = some.select("lang", lettered(F.col("text")).alias("text")).mapInArrow(_counted, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    table = words.toArrow()
    found = sorted(zip(table.column("lang").to_pylist(), table.column("word").to_pylist(), table.column("n").to_pylist()))
    return learn(found, vocabulary(model_file)) if found else None


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        finder = Pieces(model.pieces)
        names, seen = np.array(model.languages, object), Seen(len(model.languages))
        for batch in batches:
            for first, data, offsets in buffers(batch.column("text")):
                total = model.totals(finder, data, offsets, seen)
                best = total.argmax(1)
                share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                part = batch.slice(first, len(best))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), part.column("known"), pa.array(names[best].tolist(), pa.string()), pa.array(share)], names=["doc_id", "held_out", "known", "lang_pred", "score"])

    return run


def predict_language(docs: DataFrame, model_file: str, modulus: int = 3, remainder: int = 1, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the language's share of the probability of all) of every row of ``docs``.

    Learns from text and lang of rows that are not held out. A text that is null or has no letter is of language
    ``und`` with score 0, as is every text when no row has a language. Words are runs of letters, lower-cased, of any length; each word's probability in a language
    sums over all ways to cut it into vocabulary pieces and bytes. Repeated rows are predicted alike; an empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.withColumns({"held_out": held_out(F.col("doc_id"), modulus, remainder)})
    model = fit_languages(rows.filter(~F.col("held_out")), model_file, **options)
    known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces x languages
    out = rows.select("doc_id", "held_out", known.alias("known"), lettered(F.col("text")).alias("text")).mapInArrow(_predicted(shared), "doc_id long, held_out boolean, known boolean, lang_pred string, score double")
    return out.select("doc_id", "held_out", F.when(F.col("known"), F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("known"), F.col("score")).otherwise(0.0).alias("score"))
