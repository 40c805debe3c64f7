"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside Spark's partitions.

The distinct pre-tokens of a chunk of text that the worker hasn't met lately become rows of token positions in
an in-memory DuckDB. A recursive query joins each word's neighbouring positions with the merge table and
contracts its leftmost pair of least rank, until no pair of the word is left; words that are done leave
the recursion. An ordered aggregation collects the ids, and another one joins them with the vocabulary and
decodes. A text's ids are those of its pre-tokens in order.

A word of more than LONG bytes is cut into stretches, which are encoded like words. A sequence of tokens is
the encoding of its bytes exactly if each two neighbours are that of theirs, so only the seams are open: the
tokens around a seam are encoded again together, over a wider stretch until its outer tokens are the old ones.

Texts never leave their partition. What a worker remembers is bounded in bytes.
Defined results: null and empty texts have no ids and decode to no bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import buffers, fresh, kept_in_worker, release, row_chunks, small_batches, table
from engram.llm.pretokens import Memo, by_row, numbers_of, pretokens, ragged

#: Bytes of text whose new words are encoded together.
CHUNK_BYTES = 2 << 20
#: Words in one recursive query.
WORDS = 25_000
#: Bytes of what a worker remembers of pieces.
MEMO_BYTES = 48 << 20
#: A longer word (in bytes) is encoded in stretches of so many.
LONG = 64
#: A longer window around a seam is contracted by a query for each pair instead of a recursive one.
WINDOW = 1024

_ENCODE = """
WITH RECURSIVE steps(w, toks) AS (
    SELECT w, toks FROM start
    UNION ALL
    (WITH pairs AS (SELECT w, CAST(unnest(toks[:-2]) AS BIGINT) * 1048576 + unnest(toks[2:]) AS lr, generate_subscripts(toks[2:], 1) AS pos FROM steps),
     best AS (SELECT w, min((CAST(m.id AS BIGINT) << 16) | pos) AS k FROM pairs JOIN merges m USING (lr) GROUP BY w)
     SELECT w, toks[:(k & 65535) - 1] || [CAST(k >> 16 AS INTEGER)] || toks[(k & 65535) + 2:] FROM steps JOIN best USING (w))
)
SELECT w, arg_min(toks, len(toks)) AS toks FROM steps GROUP BY w
"""
_DECODE = """
WITH places AS (SELECT w, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM coded),
     text AS (SELECT w, unhex(string_agg(hex, '' ORDER BY pos)) AS decoded FROM places JOIN vocabulary ON id = tok GROUP BY w)
SELECT toks, decoded FROM coded JOIN text USING (w) ORDER BY w
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class DuckBpe:
    """Encodes and decodes batches of words."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})
        tokens, ids = list(self.ranks), list(self.ranks.values())
        self.db.register("tokens", pa.table({"token": pa.array(tokens, pa.binary()), "id": pa.array(ids, pa.int32())}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT id, hex(token) AS hex, octet_length(token) AS size FROM tokens")
        self.db.execute("""CREATE TABLE merges AS SELECT CAST(x.id AS BIGINT) * 1048576 + y.id AS lr, z.id FROM (SELECT id, hex, unnest(range(1, size)) AS k FROM vocabulary) z
                           JOIN vocabulary x ON x.hex = z.hex[:2 * k] JOIN vocabulary y ON y.hex = z.hex[2 * k + 1:]""")
        self.db.unregister("tokens")
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.token = {i: t for t, i in self.ranks.items()}

    def short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids of each, decoded bytes, bytes of each) of words by the recursive query, which keeps every step of theirs."""
        made = []
        for k in range(0, len(words), WORDS):
            part = words[k : k + WORDS]
            whole = [self.ranks.get(w, -1) for w in part]  # a word of the vocabulary is its own fixpoint
            offsets = np.zeros(len(part) + 1, np.int32)
            np.cumsum([len(w) if r < 0 else 1 for w, r in zip(part, whole)], out=offsets[1:])
            tok = self.byte[np.frombuffer(b"".join([w if r < 0 else b"\0" for w, r in zip(part, whole)]), np.uint8)]
            known = np.array(whole, np.int32)
            tok[offsets[:-1][known >= 0]] = known[known >= 0]
            self.db.register("start", pa.table({"w": np.arange(len(part), dtype=np.int32), "toks": pa.ListArray.from_arrays(pa.array(offsets), pa.array(tok))}))
            self.db.execute("CREATE OR REPLACE TEMP TABLE coded AS " + _ENCODE)
            self.db.unregister("start")
            found = self.db.sql(_DECODE).to_arrow_table()
            ids, (text, at) = found["toks"].combine_chunks(), buffers(found["decoded"])
            made.append((np.asarray(ids.flatten()), np.diff(np.asarray(ids.offsets)), text, np.diff(at)))
        self.db.execute("DROP TABLE IF EXISTS coded")
        return tuple(np.concatenate(x) for x in zip(*made)) if made else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int64))

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same for words of any length."""
        long = [w for w in words if len(w) > LONG]
        if not long:
            return self.short(words)
        cut = [[w[i : i + LONG] for i in range(0, len(w), LONG)] for w in long]
        coded = self._distinct([x for parts in cut for x in parts])
        joined = iter(self._seams([[coded[x] for x in parts] for parts in cut]))
        short = self._distinct([w for w in words if len(w) <= LONG])
        ids = [short[w] if len(w) <= LONG else next(joined) for w in words]
        text = [b"".join(map(self.token.__getitem__, x)) for x in ids]
        return np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids]), np.frombuffer(b"".join(text), np.uint8), np.array([len(t) for t in text])

    def _distinct(self, words: list[bytes]) -> dict[bytes, list[int]]:
        own = sorted(set(words))
        ids, sizes, _, _ = self.short(own)
        ends = np.cumsum(sizes).tolist()
        return {w: x for w, x in zip(own, (ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)))}

    def _seams(self, words: list[list[list[int]]]) -> list[list[int]]:
        """The ids of each word from those of its stretches; halves of all words are joined at once."""
        while any(len(parts) > 1 for parts in words):
            seams = [(k, i, 2) for k, parts in enumerate(words) for i in range(0, len(parts) - 1, 2)]
            done: dict[tuple[int, int], list[int]] = {}
            while seams:
                around = [(words[k][i][-n:], words[k][i + 1][:n]) for k, i, n in seams]
                spell = [b"".join(map(self.token.__getitem__, x + y)) for x, y in around]
                coded = self._distinct([t for t in spell if len(t) <= WINDOW]) | {t: self._contract(t) for t in set(spell) if len(t) > WINDOW}
                wider = []
                for (k, i, n), (x, y), t in zip(seams, around, spell):
                    a, b, ids = words[k][i], words[k][i + 1], coded[t]
                    if (ids[0] == x[0] or n >= len(a)) and (ids[-1] == y[-1] or n >= len(b)):
                        done[k, i] = a[: max(0, len(a) - n)] + ids + b[n:]
                    else:
                        wider.append((k, i, 2 * n))
                seams = wider
            words = [[done[k, i] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)] for k, parts in enumerate(words)]
        return [parts[0] if parts else [] for parts in words]

    def _contract(self, word: bytes) -> list[int]:
        """The ids of one word; each query finds the least pair, and all its places contract from the left."""
        toks = self.byte[np.frombuffer(word, np.uint8)].tolist()
        while True:
            self.db.register("line", pa.table({"pos": np.arange(len(toks), dtype=np.int64), "tok": np.array(toks, np.int32)}))
            best = self.db.execute("SELECT m.id, l, r FROM (SELECT tok AS l, lead(tok) OVER (ORDER BY pos) AS r FROM line) JOIN merges m ON m.lr = CAST(l AS BIGINT) * 1048576 + r ORDER BY m.id LIMIT 1").fetchall()
            self.db.unregister("line")
            if not best:
                return toks
            made, i = [], 0
            while i < len(toks):
                hit = tuple(toks[i : i + 2]) == best[0][1:]
                made.append(best[0][0] if hit else toks[i])
                i += 1 + hit
            toks = made


def decimals(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the numbers as decimal digits with a space before each, bytes of each)."""
    scale = 10 ** np.arange(6, -1, -1)
    chars = np.concatenate([np.full((len(ids), 1), 0x20), ids[:, None] // scale % 10 + 0x30], axis=1).astype(np.uint8)
    size = np.searchsorted(10 ** np.arange(1, 7), ids, side="right") + 1
    keep = np.arange(8) >= 8 - size[:, None]
    keep[:, 0] = True
    return chars[keep], size + 1


class PieceCoder:
    """What is remembered of pieces of text: ids, ids as text with a space before each, decoded bytes."""

    def __init__(self, path: str, pattern: str):
        self.bpe, self.pattern = DuckBpe(path), regex.compile(pattern)
        self.memo = Memo([np.int32, np.uint8, np.uint8], MEMO_BYTES)

    def encode(self, pieces: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        own: dict[bytes, int] = {}
        counts, which = [], []
        for p in pieces:
            tokens = pretokens(p, self.pattern)
            counts.append(len(tokens))
            which += [own.setdefault(t, len(own)) for t in tokens]
        ids, n_ids, text, n_text = self.bpe.words(list(own))
        number, first = np.array(which), np.cumsum(counts) - counts
        add = lambda sizes: np.add.reduceat(sizes[number], first)
        digits, n_digits = decimals(ids)
        n_digits = np.diff(np.concatenate([[0], np.cumsum(n_digits)])[np.concatenate([[0], np.cumsum(n_ids)])])
        return [(ragged(values, np.cumsum(sizes), sizes, number), add(sizes)) for values, sizes in ((ids, n_ids), (digits, n_digits), (text, n_text))]

    def rows(self, texts: pa.Array, want: list[int]) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
        """For chunks of texts: (number of ids of each, (values, offsets of the texts) of each wanted array)."""
        for _, _, data, offsets in row_chunks(*buffers(texts), CHUNK_BYTES):
            numbers, bounds = numbers_of(self.memo, data, offsets, self.encode)
            made = []
            for k in want:
                values, sizes = self.memo.rows(k, numbers)
                made.append((values, by_row(sizes, bounds)))
            yield np.diff(by_row(self.memo.sizes(0, numbers), bounds)), made


def _over_texts(docs: DataFrame, text_col: str, keep: list[str], added: list[tuple[str, str]], chunks: Callable) -> DataFrame:
    """docs' columns `keep` and the columns that chunks(texts) makes (one record batch for each run of rows)."""
    small_batches(docs.sparkSession)
    text = fresh("text", docs.columns)
    schema = docs.select(*keep, *[F.lit(None).cast(kind).alias(n) for n, kind in added]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for made in chunks(batch.column(len(keep))):
                rows = len(made[0])
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(at, rows) for i in range(len(keep))] + made, names=[*keep, *[n for n, _ in added]])
                at += rows
        release(kept=True)

    return docs.select(*keep, F.col(text_col).alias(text)).mapInArrow(run, schema)


def encode_and_decode(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs' other columns with `ids` (array of int) and `decoded` (binary) in place of the text."""

    def chunks(texts: pa.Array) -> Iterator[list[pa.Array]]:
        for _, ((ids, at), (decoded, end)) in kept_in_worker(PieceCoder, path, pattern).rows(texts, [0, 2]):
            data = pa.py_buffer(decoded)
            yield [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), pa.Array.from_buffers(pa.binary(), len(end) - 1, [None, pa.py_buffer(end.astype(np.int32)), data])]

    return _over_texts(docs, text_col, [c for c in docs.columns if c not in (text_col, "ids", "decoded")], [("ids", "array<int>"), ("decoded", "binary")], chunks)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each text: n_tokens, ids_sha256 and decoded_sha256, from its ids and their decoding."""

    def sha(values: np.ndarray, offsets: np.ndarray, skip: int) -> pa.Array:
        view = memoryview(values)
        return pa.array([hashlib.sha256(view[min(a + skip, b) : b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.string())

    def chunks(texts: pa.Array) -> Iterator[list[pa.Array]]:
        for n, ((ids, at), (decoded, end)) in kept_in_worker(PieceCoder, path, pattern).rows(texts, [1, 2]):
            yield [pa.array(n.astype(np.int64)), sha(ids, at, 1), sha(decoded, end, 0)]

    return _over_texts(docs, text_col, [id_col], [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")], chunks)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the public ranks and decoded again."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
