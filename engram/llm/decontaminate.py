"""Benchmark decontamination by a generalised suffix automaton of normalised test items.

Items and texts are lower-cased (A-Z) and cut into words of digits, ASCII letters and non-ASCII
bytes. One automaton over word numbers holds all items; each text's words run through it and the
length of the longest match ending at every word is tracked. Where it reaches a window's length
(13 words, or a whole item if that is shorter) the window's words are hit.

Texts are never shuffled. Only stretches of words that all occur in some item reach the automaton,
so most text costs a few numpy passes. The items are broadcast in blocks of a bounded size (a worker builds a
block's automaton once); a larger benchmark takes more passes, each written to the shared folder before the next.

Defined results: null texts have no words; items that are null, have no word or no id take no part;
an item given twice counts once; rows of documents are judged one by one, so repeated rows repeat
their result; an empty benchmark hits nothing.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import ALNUM, LOWER, buffers, kept_in_worker, release, row_chunks, slice_hashes, small_batches, table, words, written

WINDOW = 13
#: Bytes of item text in one automaton.
BLOCK_BYTES = 2 << 20


class ItemAutomaton:
    """A suffix automaton of several word sequences; says which windows end at a word."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        seqs = []
        for item, text in items:
            data = LOWER[np.frombuffer(text, np.uint8)]
            starts, ends, _ = words(data, np.array([0, len(data)]), ALNUM)
            raw = data.tobytes()
            if seq := [self.number.setdefault(raw[s:e], len(self.number)) for s, e in zip(starts.tolist(), ends.tolist())]:
                seqs.append((item, seq))
                self._add(seq)
        self.least = min([window, *(len(s) for _, s in seqs)]) if seqs else 0
        self.items: dict[int, set[str]] = defaultdict(set)  # state: items that hold its strings
        whole: dict[int, list[tuple[int, str]]] = defaultdict(list)  # state: short items that are one of its strings
        for item, seq in seqs:
            v = 0
            for w in seq:
                v = u = self.next[v][w]
                while u > 0 and item not in self.items[u]:
                    self.items[u].add(item)
                    u = self.link[u]
            if len(seq) < window:
                whole[v].append((len(seq), item))
        self.short: dict[int, list[tuple[int, str]]] = {}
        if whole:
            for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
                if found := whole.get(v, []) + self.short.get(self.link[v], []):
                    self.short[v] = found
        vocabulary = list(self.number)
        ends = np.cumsum([len(w) for w in vocabulary], dtype=np.int64)
        data = np.frombuffer(b"".join(vocabulary), np.uint8)
        self.hashes = np.sort(slice_hashes(data, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)) if vocabulary else np.zeros(0, np.uint64)

    def _add(self, seq: list[int]) -> None:
        last = 0
        for w in seq:
            if w in self.next[last]:
                q = self.next[last][w]
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, q, w)
                continue
            new = self._state(self.length[last] + 1, {})
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            else:
                q = self.next[p][w]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
            last = new

    def _state(self, length: int, go: dict[int, int]) -> int:
        self.next.append(go)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, q: int, w: int) -> int:
        c = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[c] = self.link[q]
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def windows(self, seq: list[int]) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, word after the last, items) of each window that occurs in seq; -1 is in no item."""
        go, link, length, window = self.next, self.link, self.length, self.window
        v = n = 0
        for i, w in enumerate(seq, 1):
            while v and w not in go[v]:
                v = link[v]
                n = length[v]
            if w in go[v]:
                v, n = go[v][w], n + 1
            for m, item in self.short.get(v, ()):
                if m <= n:
                    yield i - m, i, {item}
            if n >= window:
                u = v
                while length[link[u]] >= window:
                    u = link[u]
                yield i - window, i, self.items[u]


def scan_texts(data: np.ndarray, offsets: np.ndarray, automaton: ItemAutomaton) -> Iterator[tuple[int, int, list, set[str]]]:
    """(row, its words, word spans hit, items) of each row."""
    for first, end, part, at in row_chunks(data, offsets):
        low = LOWER[part]
        starts, ends, bounds = words(low, at, ALNUM)
        n_words = np.diff(bounds)
        found: dict[int, tuple[list, set[str]]] = {}
        if len(starts) and len(automaton.hashes):
            h = slice_hashes(low, starts, ends)
            place = np.searchsorted(automaton.hashes, h)
            place[place == len(automaton.hashes)] = 0
            known = automaton.hashes[place] == h
            cut = np.zeros(len(h) + 1, np.int8)
            cut[1:-1] = known[1:] != known[:-1]
            cut[bounds] = 1
            cut[0] = cut[-1] = 1
            edges = np.flatnonzero(cut)
            keep = known[edges[:-1]] & (np.diff(edges) >= automaton.least)
            rows = np.searchsorted(bounds, edges[:-1][keep], side="right") - 1
            raw = low.tobytes()
            for s, e, row in zip(edges[:-1][keep].tolist(), edges[1:][keep].tolist(), rows.tolist()):
                seq = [automaton.number.get(raw[a:b], -1) for a, b in zip(starts[s:e].tolist(), ends[s:e].tolist())]
                base = s - int(bounds[row])
                for a, b, items in automaton.windows(seq):
                    spans, names = found.setdefault(row, ([], set()))
                    if spans and a + base <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b + base)
                        spans[-1][0] = min(spans[-1][0], a + base)
                    else:
                        spans.append([a + base, b + base])
                    names |= items
        for row in range(end - first):
            spans, names = found.get(row, ([], set()))
            yield first + row, int(n_words[row]), spans, names


def union(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of about BLOCK_BYTES."""
    known = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t"))
    total = known.agg(F.coalesce(F.sum(F.octet_length("t").cast("long")), F.lit(0)).alias("b")).first()["b"]
    n = 1 + int(total) // BLOCK_BYTES
    for k in range(n):
        block = known.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k) if n > 1 else known
        yield sorted((r["i"], bytes(r["t"])) for r in block.collect())


def find_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with `n_words`, `hit_spans` (word positions, end exclusive) and `hit_items`."""
    spark = docs.sparkSession
    small_batches(spark)
    rest = [c for c in docs.columns if c not in ("n_words", "hit_spans", "hit_items")]
    out = docs.select(*rest, F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<first:int,last:int>>").alias("hit_spans"), F.array().cast("array<string>").alias("hit_items"))
    kept = list(out.schema)
    for k, block in enumerate(_blocks(items, item_id, item_text)):
        out = written(out, "hits") if k else out
        out = out.mapInArrow(_scanner(spark.sparkContext.broadcast(block), uuid.uuid4().hex, rest, text_col), schema=type(out.schema)(kept))
    return out


def _automaton(block) -> ItemAutomaton:
    return ItemAutomaton(block.value)


def _scanner(block, name: str, rest: list[str], text_col: str) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = kept_in_worker(_automaton, block, key=name)
        for batch in batches:
            n_words, spans, names = [], [], []
            old_spans, old_names = batch["hit_spans"].to_pylist(), batch["hit_items"].to_pylist()
            for row, n, hit, items in scan_texts(*buffers(batch[text_col]), automaton):
                n_words.append(n)
                merged = union([[x["first"], x["last"]] for x in old_spans[row]] + hit)
                spans.append([{"first": a, "last": b} for a, b in merged])
                names.append(sorted(items.union(old_names[row])))
            kind = batch.schema
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in rest], pa.array(n_words, pa.int64()), pa.array(spans, kind.field("hit_spans").type), pa.array(names, kind.field("hit_items").type)], schema=kind)
        release(kept=True)

    return scan


def judge(found: DataFrame, least_share: int = 20) -> DataFrame:
    """found with n_hit, n_items, items_sha256 and contaminated (a hit, and at least one word in least_share hit)."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + (s["last"] - s["first"]))
    out = found.withColumns({"n_hit": n_hit, "n_items": F.size("hit_items").cast("long"), "items_sha256": F.sha2(F.array_join("hit_items", ","), 256)})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * least_share >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without those that the coverage limit calls contaminated; all other rows stay as they are."""
    own = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    found = judge(find_items(own, items, f"c{docs.columns.index(text_col)}")).where("not contaminated")
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def remove_spans(docs: DataFrame, items: DataFrame, text_col: str = "text", least_words: int = 1, least_share: int = 20) -> DataFrame:
    """docs without contaminated ones (see judge), and with hit spans of `least_words` words or more cut out of the other texts.

    A span is cut from the start of its first word to the end of its last; what stands around it stays. Texts without such a span, null and
    empty ones stay as they are; columns, whatever their names, are kept.
    """
    own = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    text = docs.columns.index(text_col)
    found = judge(find_items(own, items, f"c{text}"), least_share).where("not contaminated").select(*own.columns, "hit_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = batch.column(text).to_pylist()
            hit = [[(x["first"], x["last"]) for x in spans if x["last"] - x["first"] >= least_words] for spans in batch["hit_spans"].to_pylist()]
            for first, _, data, offsets in row_chunks(*buffers(batch.column(text))):
                starts, ends, bounds = words(LOWER[data], offsets, ALNUM)
                raw = data.tobytes()
                for i in range(len(offsets) - 1):
                    if hit[first + i]:
                        kept, at = [], int(offsets[i])
                        for a, b in hit[first + i]:
                            kept.append(raw[at : starts[bounds[i] + a]])
                            at = int(ends[bounds[i] + b - 1])
                        out[first + i] = b"".join([*kept, raw[at : offsets[i + 1]]]).decode()
            columns = list(batch.columns[:-1])
            columns[text] = pa.array(out, batch.column(text).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])
        release(kept=True)

    cut = found.mapInArrow(run, own.schema)
    return cut.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold windows of benchmark items, and how many of their words."""
    found = judge(find_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM (SELECT item_id, w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
hit AS (SELECT doc_id, i, dw.m, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
