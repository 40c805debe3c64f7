"""Language identification by segmentation-marginalised unigram models over a fixed public vocabulary.

A text is cut at white space; every word, with a space before it, is a byte string that the vocabulary's
pieces (and all single bytes) can spell in many ways. Each language has a probability for every piece.
A forward algorithm sums the probability of all segmentations of a word; a text's score in a language
is the sum of its words' log probabilities, and the answer is the language of highest posterior.

Training counts every distinct word of each language (all training texts, whole) as a table on Spark. Piece
probabilities start from how often a piece occurs anywhere in those words; ROUNDS rounds of expectation-maximisation
then weigh each occurrence by the share of the word's segmentations that use it (forward times backward),
with add-one smoothing. Each round brings one row for each piece and language of a block of LANGS
languages to the driver, so what it collects and broadcasts is bounded by vocabulary times LANGS; more
languages take more blocks, and more passes over the texts.

A worker remembers the scores of words it has met lately, in a bounded number of bytes. Words of more than
SHORT bytes are summed whole too, step by step with rescaling; for training alone they count as stretches of SHORT bytes.
Defined results: null texts and texts without a letter are `und` with score 0; without any labelled
training text everything is `und`; ties go to the language that sorts first.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import BYTE_CODES, NOT_SPACE, U64, buffers, fresh, kept_in_worker, mix, powers, release, row_chunks, rows_of, slice_hashes, small_batches, table, words, written
from engram.llm.pretokens import Memo

CHUNK_BYTES = 1 << 20
#: Bytes of a word that is handled in a matrix of words of its length (a product of so many probabilities stays a float64).
SHORT = 31
#: Languages in one pass.
LANGS = 64
ROUNDS = 1
#: No piece is rarer than this in a model.
FLOOR = 1e-8
#: Bytes of what a worker remembers of words.
MEMO_BYTES = 32 << 20
#: Words whose pieces are summed at once.
GROUP_WORDS = 25_000
#: Distinct words that a training task holds before it hands their counts on.
HELD_WORDS = 150_000


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a public sentencepiece model as byte strings, word starts as spaces, and all bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    texts = {model.id_to_piece(i).replace("▁", " ").encode() for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
    return sorted({t for t in texts if 1 < len(t) <= SHORT + 1} | {bytes([b]) for b in range(256)})


class Pieces:
    """Finds the vocabulary's pieces in many words at once."""

    def __init__(self, pieces: list[bytes]):
        self.n = len(pieces)
        ends = np.cumsum([len(p) for p in pieces])
        h = slice_hashes(np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], ends[:-1]]), ends)
        order = np.argsort(h)
        self.hashes, self.ids = h[order], order.astype(np.int32)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[h >> U64(42)] = True
        self.longest = max(map(len, pieces))

    def _among(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of h that are pieces, their ids)."""
        rows = np.flatnonzero(self.maybe[h >> U64(42)])
        h = h[rows]
        place = np.searchsorted(self.hashes, h)
        place[place == self.n] = 0
        good = self.hashes[place] == h
        return rows[good], self.ids[place[good]]

    def find(self, matrix: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(end, length, rows, piece ids) for each end and length, over words that are the rows of a byte matrix."""
        n, length = matrix.shape
        up, down = powers(length)
        total = np.zeros((length + 1, n), U64)
        np.cumsum(BYTE_CODES[matrix.T] * up[:length, None], axis=0, dtype=U64, out=total[1:])
        for end in range(1, length + 1):
            for m in range(1, min(end, self.longest) + 1):
                rows, ids = self._among(mix((total[end] - total[end - m]) * down[end - m]))
                if len(rows):
                    yield end, m, rows, ids

    def find_in(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ends, lengths, piece ids) in one long word, by end."""
        found = []
        for m in range(1, self.longest + 1):
            starts = np.arange(len(word) - m + 1)
            rows, ids = self._among(slice_hashes(word, starts, starts + m))
            found.append((rows + m, np.full(len(rows), m), ids))
        ends, lengths, ids = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(ends, kind="stable")
        return ends[order], lengths[order], ids[order]


def _pieces(path: str) -> Pieces:
    return Pieces(vocabulary(path))


def forward(matrix: np.ndarray, pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    """Log probability of each word (a row of the matrix) in each language: the sum over all segmentations."""
    n, length = matrix.shape
    sums = np.zeros((length + 1, n, probs.shape[1]))
    sums[0] = 1
    for end, m, rows, ids in pieces.find(matrix):
        sums[end, rows] += sums[end - m, rows] * probs[ids]
    return np.log(sums[length])


def forward_long(word: np.ndarray, pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    """The same for one long word; the sums of the last few places are rescaled at every step."""
    ends, lengths, ids = pieces.find_in(word)
    at = np.searchsorted(ends, np.arange(1, len(word) + 2)).tolist()
    ring = np.zeros((pieces.longest, probs.shape[1]))  # row k: the sum at the place k + 1 before this one, scaled
    ring[0] = 1
    log = np.zeros(probs.shape[1])
    for a, b in zip(at[:-1], at[1:]):
        now = (ring[lengths[a:b] - 1] * probs[ids[a:b]]).sum(axis=0)
        log += np.log(now)
        ring[1:] = ring[:-1] / now
        ring[0] = 1
    return log


def matrices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lead: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(byte matrix of words of one length, their numbers); lead: with a space before each."""
    sizes = ends - starts
    for m in np.unique(sizes).tolist():
        which = np.flatnonzero(sizes == m)
        matrix = np.full((len(which), m + lead), 0x20, np.uint8)
        matrix[:, int(lead) :] = data[starts[which][:, None] + np.arange(m)]
        yield matrix, which


class Scorer:
    """Log probabilities of words in the languages of a model, remembered in a bounded number of bytes."""

    def __init__(self, path: str, model: Callable[[], np.ndarray]):
        self.pieces, self.probs = Pieces(vocabulary(path)), model()
        self.memo = Memo([np.float64], MEMO_BYTES)

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(rows, languages): the sum of each text's words."""
        langs, rows = self.probs.shape[1], len(offsets) - 1
        starts, ends, bounds = words(data, offsets, NOT_SPACE)
        if not len(starts):
            return np.zeros((rows, langs))

        def make(first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
            a, b = starts[first], ends[first]
            out = np.empty((len(first), langs))
            short = np.flatnonzero(b - a <= SHORT)
            for matrix, which in matrices(data, a[short], b[short]):
                out[short[which]] = forward(matrix, self.pieces, self.probs)
            for i in np.flatnonzero(b - a > SHORT).tolist():
                out[i] = forward_long(np.concatenate([np.full(1, 0x20, np.uint8), data[a[i] : b[i]]]), self.pieces, self.probs)
            return [(out.ravel(), np.full(len(first), langs))]

        numbers = self.memo.numbers(slice_hashes(data, starts, ends), make)
        scores = self.memo.flat[0][: self.memo.size * langs].reshape(-1, langs)
        of = rows_of(bounds)
        return np.stack([np.bincount(of, weights=scores[numbers, k], minlength=rows) for k in range(langs)], axis=1)


def labels_of(train: DataFrame, lang_col: str) -> list[str]:
    """All labels, in order (names only)."""
    return sorted(r[0] for r in train.select(lang_col).where(F.col(lang_col).isNotNull()).distinct().collect())


def _word_counter(langs: list[str]) -> Callable:
    """Counts the distinct words of each language: (lang, word, n); a word holds its leading space."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: i for i, x in enumerate(langs)}
        memo, counts = Memo([np.uint8], 1 << 40), np.zeros((1024, len(langs)), np.int64)

        def flush() -> pa.RecordBatch:
            word, lang = np.nonzero(counts[: memo.size])
            text, sizes = memo.rows(0, word)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            made = [pa.array(lang, pa.int32()), pa.Array.from_buffers(pa.binary(), len(word), [None, pa.py_buffer(offsets), pa.py_buffer(text)]), pa.array(counts[word, lang])]
            return pa.RecordBatch.from_arrays(made, names=["lang", "word", "n"])

        for batch in batches:
            lang = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for first, end, data, offsets in row_chunks(*buffers(batch.column(0)), CHUNK_BYTES):
                starts, ends, bounds = words(data, offsets, NOT_SPACE)
                if not len(starts):
                    continue
                of = lang[first:end][rows_of(bounds)]
                times = np.maximum(1, -(-(ends - starts) // SHORT))
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                begin = np.repeat(starts, times) + part * SHORT
                stop = np.minimum(begin + SHORT, np.repeat(ends, times))
                h = slice_hashes(data, begin, stop) ^ (part > 0).astype(U64)

                def make(where: np.ndarray, data=data, begin=begin, stop=stop, part=part) -> list[tuple[np.ndarray, np.ndarray]]:
                    own = [(b" " if k == 0 else b"") + data[a:b].tobytes() for a, b, k in zip(begin[where].tolist(), stop[where].tolist(), part[where].tolist())]
                    return [(np.frombuffer(b"".join(own), np.uint8), np.array([len(w) for w in own]))]

                word = memo.numbers(h, make)
                if memo.size > len(counts):
                    counts = np.concatenate([counts, np.zeros((memo.size - len(counts) // 2, len(langs)), np.int64)])
                key, n = np.unique(word.astype(np.int64) * len(langs) + np.repeat(of, times), return_counts=True)
                counts.reshape(-1)[key] += n
                if memo.size > HELD_WORDS:
                    yield flush()
                    memo.clear()
                    counts[:] = 0
        if memo.size:
            yield flush()
        del memo, counts
        release()

    return count


def _groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches joined to tables of at least so many rows, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _expect(path: str, model: Callable[[], np.ndarray] | None, langs: int) -> Callable:
    """Sums over words how often each piece is used: in any place without a model, else by the share of segmentations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = kept_in_worker(_pieces, path)
        probs = model() if model else None
        sums = np.zeros(langs * pieces.n)
        for group in _groups(batches, GROUP_WORDS):
            lang, n = (np.asarray(group.column(i)).astype(np.int64) for i in (0, 2))
            data, offsets = buffers(group.column(1))
            for matrix, which in matrices(data, offsets[:-1], offsets[1:], lead=False):
                of, times = lang[which], n[which].astype(float)
                found = list(pieces.find(matrix))
                keys = np.concatenate([of[rows] * pieces.n + ids for _, _, rows, ids in found])
                if probs is None:
                    sums += np.bincount(keys, weights=np.concatenate([times[rows] for _, _, rows, _ in found]), minlength=len(sums))
                    continue
                length = matrix.shape[1]
                ahead, back = np.zeros((2, length + 1, len(which)))
                ahead[0] = back[length] = 1
                used = [probs[ids, of[rows]] for _, _, rows, ids in found]
                for (end, m, rows, _), p in zip(found, used):
                    ahead[end, rows] += ahead[end - m, rows] * p
                weight = times / ahead[length]
                for (end, m, rows, ids), p in zip(reversed(found), reversed(used)):
                    back[end - m, rows] += p * back[end, rows]
                share = np.concatenate([ahead[end - m, rows] * p * back[end, rows] * weight[rows] for (end, m, rows, _), p in zip(found, used)])
                sums += np.bincount(keys, weights=share, minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at // pieces.n, pa.int32()), pa.array(at % pieces.n, pa.int32()), pa.array(sums[at])], names=["lang", "piece", "n"])
        release(kept=True)

    return run


Model = list[tuple[list[str], np.ndarray]]


def fit(train: DataFrame, path: str, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Blocks of (languages, probability of each piece in each of them), from all rows of train with a text and a language.

    Runs jobs on the cluster while it is called.
    """
    spark = train.sparkSession
    small_batches(spark)
    names = labels_of(train, lang_col)
    n_pieces = len(vocabulary(path))
    out: Model = []
    for k in range(0, len(names), LANGS):
        langs = names[k : k + LANGS]
        rows = train.where(F.col(text_col).isNotNull() & F.col(lang_col).isin(langs)).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
        counted = written(rows.mapInArrow(_word_counter(langs), "lang int, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
        probs, model = None, None
        for _ in range(ROUNDS + 1):
            sums = counted.mapInArrow(_expect(path, model, len(langs)), "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
            counts = np.ones((n_pieces, len(langs)))
            counts[sums["piece"].to_numpy(), sums["lang"].to_numpy()] += sums["n"].to_numpy()
            probs = np.maximum(counts / counts.sum(axis=0), FLOOR)
            probs /= probs.sum(axis=0)
            shared = spark.sparkContext.broadcast(probs)
            model = lambda shared=shared: shared.value
        out.append((langs, probs))
    return out


def predict(docs: DataFrame, model: Model, path: str, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language and the score (its posterior) in the named columns, which replace others of these names; only the text is looked at."""
    spark = docs.sparkSession
    small_batches(spark)
    taken = {n.lower() for n in names}
    rest = [c for c in docs.columns if c.lower() not in taken]
    letter, best, top, mass = (fresh(n, docs.columns) for n in ("letter", "best", "top", "mass"))
    out = docs.select(*rest, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias(letter), F.lit(None).cast("string").alias(best), F.lit(float("-inf")).alias(top), F.lit(float("-inf")).alias(mass))
    for langs, probs in model:
        out = out.mapInArrow(_predictor(path, langs, spark.sparkContext.broadcast(probs), uuid.uuid4().hex, rest.index(text_col)), out.schema)
    known = F.col(letter) & F.col(best).isNotNull()
    return out.select(*rest, F.when(known, F.col(best)).otherwise("und").alias(names[0]), F.when(known, F.exp(F.col(top) - F.col(mass))).otherwise(0.0).alias(names[1]))


def _predictor(path: str, langs: list[str], shared, name: str, text: int) -> Callable:
    """Carries the best language so far, its log probability and that of all languages, over one more block of languages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept_in_worker(Scorer, path, lambda: shared.value, key=name)
        for batch in batches:
            total = [scorer.texts(data, offsets) for _, _, data, offsets in row_chunks(*buffers(batch.column(text)), CHUNK_BYTES)]
            total = np.concatenate(total) if total else np.zeros((0, len(langs)))
            at = batch.num_columns - 3
            old = batch.column(at).to_pylist()
            top, mass = (np.asarray(batch.column(at + i)) for i in (1, 2))
            own = total.argmax(axis=1)
            high = total[np.arange(len(own)), own]
            better = high > top
            best = [langs[k] if b else o for k, b, o in zip(own.tolist(), better.tolist(), old)]
            mass = np.logaddexp(mass, np.logaddexp.reduce(total, axis=1))
            made = [pa.array(best, pa.string()), pa.array(np.maximum(top, high)), pa.array(mass)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *made], schema=batch.schema)
        release(kept=True)

    return run


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fit_documents(docs: DataFrame) -> Model:
    """The model of all labelled documents that aren't held out."""
    return fit(docs.where(~held_out()).select("text", "lang"), piece_path())


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model of the four folds that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), fit_documents(docs), piece_path())
    return out.select("doc_id", "held_out", "lang_pred", "score")
