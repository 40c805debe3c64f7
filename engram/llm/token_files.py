"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

Texts are dealt by ranges of doc_id (rows that share an id may be dealt over several ranges), sorted, encoded
by the public tokenizers library (each distinct pre-token once in a while) and written as ORC: file k holds
the k-th range, so files, stripes and row groups have narrow id ranges and readers skip what a filter excludes
from the metadata alone. Stripes are read in parallel; nothing depends on a whole file being in one task.

Reading back, the id where a document starts is the ids of all files before its own (a table of one row
for each file) plus a running sum in its own file, in the order in which its rows were written.

The tokenizer's added tokens (<|endoftext|> and the like) in a text become their own ids as in the library's
default setting (the library encodes texts that hold one), or, with added_tokens=False, are plain text.

Defined results: null and empty texts hold the end id alone; null doc_ids sort first; rows with the same
doc_id follow each other, shorter texts first; an empty table writes no ids.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.llm.common import buffers, group_count, kept_in_worker, release, row_chunks, small_batches, table, text_bytes, with_checkpoints
from engram.llm.pretokens import Memo, by_row, numbers_of, pretokens

#: UTF-8 bytes of text in one file.
FILE_BYTES = 24 << 20
#: Bytes of text whose new pieces are encoded together, and bytes of what a worker remembers of pieces.
CHUNK_BYTES = 1 << 20
MEMO_BYTES = 64 << 20
#: ORC: a row group's rows, small stripes of many documents, Bloom filters on the ids of documents.
ORC = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "orc.create.index": "true", "orc.stripe.size": str(16 << 20), "compression": "lz4"}


def byte_alphabet() -> dict[int, str]:
    """The published byte alphabet of byte-level BPE: printable bytes stand for themselves, the others for the characters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


class TextEncoder:
    """Ids of texts: the library's model encodes each distinct pre-token once in a while, the library itself whole texts that hold an added token."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.pattern = regex.compile(pattern)
        alphabet = byte_alphabet()
        self.letters = {chr(b): alphabet[b] for b in range(256)}
        self.plain = str.maketrans(self.letters)
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.memo = Memo([np.int32], MEMO_BYTES)

    def encode(self, pieces: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        tokenize, plain = self.model.tokenize, self.plain
        ids, sizes = [], []
        for p in pieces:
            before = len(ids)
            for w in pretokens(p, self.pattern):
                ids += [t.id for t in tokenize(w.decode("latin-1").translate(plain))]
            sizes.append(len(ids) - before)
        return [(np.array(ids, np.int32), np.array(sizes))]

    def rows(self, texts: pa.Array, added_tokens: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of some texts in a row, offsets of the texts)."""
        for first, end, data, offsets in row_chunks(*buffers(texts), CHUNK_BYTES):
            numbers, bounds = numbers_of(self.memo, data, offsets, self.encode)
            ids, sizes = self.memo.rows(0, numbers)
            at = by_row(sizes, bounds)
            raw = data.tobytes() if added_tokens else b""
            if any(t in raw for t in self.added):
                own = []
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    held = any(t in raw[a:b] for t in self.added)
                    own.append(np.array(self.library.encode(raw[a:b].decode(), add_special_tokens=False).ids, np.int32) if held else ids[at[i] : at[i + 1]])
                ids, at = np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])
            yield ids, at


def with_end(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each text."""
    ends = at + np.arange(len(at))
    out = np.empty(ends[-1], np.int32)
    inside = np.ones(len(out), bool)
    inside[ends[1:] - 1] = False
    out[inside] = ids
    out[~inside] = end_id
    return out, ends


def _encoder(path: str, pattern: str, end_id: int, added_tokens: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, file, row = kept_in_worker(TextEncoder, path, pattern), TaskContext.get().partitionId(), 0
        for batch in batches:
            at = 0
            for ids, offsets in coder.rows(batch.column(1), added_tokens):
                values, ends = with_end(ids, offsets, end_id)
                rows = len(ends) - 1
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))
                made = [batch.column(0).slice(at, rows), pa.array(np.full(rows, file, np.int32)), pa.array(np.arange(row, row + rows)), pa.array(np.diff(ends)), lists]
                yield pa.RecordBatch.from_arrays(made, names=["doc_id", "file", "row", "n_tokens", "ids"])
                at, row = at + rows, row + rows
        release(kept=True)

    return run


def write_token_ids(docs: DataFrame, out: str, tokenizer_path: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = True) -> str:
    """Write docs' ids to the folder `out`, in ascending order of id_col; returns the folder. pattern: that of the tokenizer's pre-tokens."""
    small_batches(docs.sparkSession)
    files = group_count(text_bytes(docs, text_col), FILE_BYTES)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.octet_length("text").asc_nulls_first(), F.xxhash64("text")]
    dealt = narrow.repartitionByRange(files, *order).sortWithinPartitions(*order)
    schema = narrow.select("doc_id", F.lit(0).alias("file"), F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("n_tokens"), F.array().cast("array<int>").alias("ids")).schema
    dealt.mapInArrow(_encoder(tokenizer_path, pattern, end_id, added_tokens), schema).write.mode("overwrite").options(**ORC).orc(out)
    return out


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, file, row (in the file), n_tokens and ids; filters on doc_id reach the files' indexes and Bloom filters."""
    return spark.read.orc(path)


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch["ids"]
        values, offsets = np.asarray(ids.values).astype("<u4", copy=False), np.asarray(ids.offsets)
        crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        made = [*(batch[n] for n in ("doc_id", "file", "row")), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(made, names=["doc_id", "file", "row", "n_tokens", "ids_crc32"])


def token_index(files: DataFrame) -> DataFrame:
    """For each document of the files: doc_id, start, n_tokens (counted from the ids) and ids_crc32."""
    rows = files.select("doc_id", "file", "row", "ids")
    rows = rows.mapInArrow(_crc, rows.select("doc_id", "file", "row", F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("ids_crc32")).schema)
    totals = files.groupBy("file").agg(F.sum("n_tokens").alias("n"))  # one row for each file
    before = totals.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    order = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0))
    return rows.join(F.broadcast(before), "file").select("doc_id", start.cast("long").alias("start"), "n_tokens", "ids_crc32")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as ORC token files in the shared folder, then indexed from them."""
    import public_tokenizers

    with_checkpoints(spark)
    out = f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_index(read_token_ids(spark, write_token_ids(docs, out, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 2)))
