"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

1. Every document's set of five-word shingles (lower-cased words; a text of fewer words is one shingle)
   gets minima of its own for each of TREES prefix tries: no two tries share a hash function, so their
   misses are independent. Documents of equal word sequence are one class, so copies are never expanded.
2. Spark sorts the tries: (label sequence, class) is range-partitioned and sorted, so classes that share a
   prefix are neighbours. Each task reads off, for every prefix length, the least class of each run of equal
   prefixes; runs that go on in the next partition are joined by their prefix. A frequent prefix is cut
   between partitions like any other range.
3. Matched prefixes are shortened adaptively. The longest come first: components of classes that share one
   are cut into blocks of about BLOCK classes and BLOCK_BYTES of text, and every pair of blocks is compared
   exactly, as products of shingle incidence matrices. Each link found says how likely its similarity was to
   be met at each length, so the links found measure the recall. While it is short of the target, prefixes
   are shortened to the longest length that promises it, and components that grew are compared again.
   `depth_for` is the length at which even a pair right at the threshold is met with the target recall; no
   prefix is shortened beyond it.
4. Components of the verified roots are the groups.

Defined results: texts without words are alone with no links; rows that share an id are one document, whose
text is the least of theirs; groups are named by
their least doc_id; null ids take no part in groups and are returned with a null class and no links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import ALNUM, LOWER, U64, buffers, fresh, gram_hashes, group_count, mix, part_of, release, row_chunks, slice_hashes, table, words, written
from engram.llm.components import components

SHINGLE = 5
TREES = 64
DEEPEST = 16
#: Labels beyond the shortest prefix, in steps of two: prefixes have three lengths.
DEEPER, STEP = 4, 2
LEVELS = DEEPER // STEP + 1
BLOCK = 256
BLOCK_BYTES = 2 << 20
RECALL = 0.99999
BUCKET_BYTES = 4 << 20
RANGE_BYTES = 8 << 20

_RNG = np.random.default_rng(8)
#: The hash functions of each trie's labels, in its order.
_XOR = _RNG.integers(1, 1 << 63, (TREES, DEEPEST), dtype=np.uint64)
_ODD = _RNG.integers(1, 1 << 62, (TREES, DEEPEST), dtype=np.uint64) * U64(2) + U64(1)


def depth_for(threshold: float, recall: float = RECALL) -> int:
    """The longest prefix at which a pair of that similarity shares one in some trie often enough."""
    depth = DEEPEST - DEEPER
    while depth > 1 and met(threshold, depth) < recall:
        depth -= 1
    return depth


def met(similarity: np.ndarray | float, depth: int) -> np.ndarray | float:
    """How likely a pair of that similarity shares a prefix of that length in some trie."""
    return 1 - (1 - similarity**depth) ** TREES


def next_level(found: float, missed: list[float], depth: int, threshold: float, recall: float, level: int) -> int | None:
    """The level to shorten prefixes to, after links were found at `level` (level 0 has prefixes of `depth` labels); None where the recall is reached.

    missed: for each level, the sum over found links of the pairs that are expected to be missed for each that is met;
    one unseen pair at the threshold is added, so a handful of links can't prove a recall.
    """

    def reached(at: int) -> bool:
        p = met(threshold, depth + STEP * at)
        return at == 0 or found >= recall * (found + missed[at] + 2 * (1 - p) / p)

    return None if reached(level) else next(at for at in range(level - 1, -1, -1) if reached(at))


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, first shingle of each row, word hashes, first word of each row) of some texts."""
    low = LOWER[data]
    starts, ends, bounds = words(low, offsets, ALNUM)
    codes = slice_hashes(low, starts, ends)
    n = np.diff(bounds)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(first[-1], U64)
    grams = gram_hashes(codes, SHINGLE)
    full = np.repeat(n >= SHINGLE, count)
    place = np.arange(len(out)) + np.repeat(bounds[:-1] - first[:-1], count)
    out[full] = grams[place[full]]
    for r in np.flatnonzero((n > 0) & (n < SHINGLE)).tolist():
        out[first[r]] = gram_hashes(codes[bounds[r] : bounds[r + 1]], int(n[r]))[0]
    return out, first, codes, bounds


def _signer(depth: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in row_chunks(*buffers(batch["text"])):
                sh, first, codes, bounds = shingles(data, offsets)
                rows = np.flatnonzero(np.diff(first))
                keys, deeper, hashed = np.zeros((len(rows), TREES), U64), np.zeros((len(rows), TREES), np.uint16), np.empty_like(sh)
                for t in range(TREES if len(rows) else 0):
                    key = np.full(len(rows), t + 1, U64)
                    for k in range(depth + DEEPER):
                        np.multiply(np.bitwise_xor(sh, _XOR[t, k], out=hashed), _ODD[t, k], out=hashed)
                        key = mix(key * U64(0x9E3779B97F4A7C15) ^ np.minimum.reduceat(hashed, first[rows]))
                        if k == depth - 1:
                            keys[:, t] = key
                        elif k >= depth and (k - depth) % STEP == STEP - 1:
                            deeper[:, t] = deeper[:, t] << 8 | (key >> U64(56)).astype(np.uint16)
                digest = [hashlib.blake2b(codes[bounds[r] : bounds[r + 1]].tobytes(), digest_size=16).digest() for r in rows.tolist()]
                ends = pa.array(np.arange(0, len(rows) * TREES + 1, TREES, dtype=np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (keys.view(np.int64), deeper.view(np.int16))]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a).take(pa.array(rows)), pa.array(np.diff(offsets)[rows]), pa.array(digest, pa.binary()), *lists], names=["doc_id", "size", "digest", "keys", "deeper"])
        release()

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v, level) from each row of a sorted range (key, deeper, rep) to the least row of its run of equal prefixes, at the
    longest prefix (highest level) that leads there; and, with v null, prefix and least row of the runs at both ends of the range.

    key stands for the labels of the shortest prefix (they are never told apart), each byte of deeper for the next STEP labels.
    """
    rows = [batch for batch in batches if batch.num_rows]
    if not rows:
        return
    rows = pa.Table.from_batches(rows)
    key, deeper, rep = (rows[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("key", "deeper", "rep"))
    deeper = deeper.view(np.uint16)
    out: dict[str, list[np.ndarray]] = {c: [] for c in ("u", "v", "level", "key", "deeper")}
    before = rep
    for level in range(LEVELS - 1, -1, -1):
        code = deeper >> np.uint16(8 * (LEVELS - 1 - level)) if level else np.zeros_like(deeper)
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (code[1:] != code[:-1])]))
        least = np.repeat(np.minimum.reduceat(rep, starts), np.diff(np.append(starts, len(rep))))
        own = np.flatnonzero(least != before)
        own = own[least[own] != rep[own]]
        ends = np.array([0, len(rep) - 1])
        n = len(own) + 2
        out["u"].append(np.concatenate([rep[own], least[ends]]))
        out["v"].append(np.ma.array(np.concatenate([least[own], [0, 0]]), mask=np.arange(n) >= len(own)))
        out["level"].append(np.full(n, level, np.int32))
        out["key"].append(np.concatenate([np.zeros(len(own), np.int64), key[ends]]))
        out["deeper"].append(np.concatenate([np.zeros(len(own), np.int32), code[ends].astype(np.int32)]))
        before = least
    v = np.ma.concatenate(out.pop("v"))
    made = {c: pa.array(np.concatenate(x)) for c, x in out.items()}
    yield pa.RecordBatch.from_arrays([made["u"], pa.array(v.data, mask=v.mask), made["level"], made["key"], made["deeper"]], names=["u", "v", "level", "key", "deeper"])


def forest(classes: DataFrame) -> DataFrame:
    """Edges (u, v, level) of classes (rep, keys, deeper): those of a level and above join exactly the classes that share a prefix of that level in some trie."""
    posted = classes.select("rep", "deeper", F.posexplode("keys").alias("trie", "key")).select("key", F.col("deeper")[F.col("trie")].alias("deeper"), "rep")
    ranges = group_count(classes.count() * TREES * 24, RANGE_BYTES)
    tries = posted.repartitionByRange(ranges, "key", "deeper", "rep").sortWithinPartitions("key", "deeper", "rep")
    runs = written(tries.mapInArrow(_runs, "u long, v long, level int, key long, deeper int"), "runs")
    border = runs.where("v is null").select("level", "key", "deeper", "u")
    least = border.groupBy("level", "key", "deeper").agg(F.min("u").alias("v"))
    across = border.join(least, ["level", "key", "deeper"]).where("u <> v").select("u", "v", "level")
    return written(runs.where("v is not null").select("u", "v", "level").union(across).groupBy("u", "v").agg(F.max("level").alias("level")), "forest")


def _verify(threshold_num: int, threshold_den: int, depth: int) -> Callable:
    def links(sets: list[np.ndarray], side: np.ndarray, same: bool) -> tuple[np.ndarray, list[np.ndarray]]:
        sizes = np.array([len(s) for s in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        _, column = np.unique(flat, return_inverse=True)
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        common = np.zeros((len(sets), len(sets)), np.float32)
        width = 8192
        cuts = np.searchsorted(column, np.arange(0, int(column[-1]) + width + 1, width)) if len(column) else [0]
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            m = np.zeros((len(sets), width), np.float32)
            m[owner[a:b], column[a:b] - i * width] = 1
            common += m @ m.T
        common = common.astype(np.int64)
        close = common * (threshold_den + threshold_num) >= threshold_num * (sizes[:, None] + sizes[None, :])
        close &= np.triu(np.ones_like(close), 1) if same else (side[:, None] < side[None, :])
        close |= close.T
        i, j = np.nonzero(close)
        similar = common[i, j] / (sizes[i] + sizes[j] - common[i, j])
        missed = [np.bincount(i, (1 - p) / p, len(sets)).astype(np.float64) for p in (met(similar, depth + STEP * level) for level in range(LEVELS))]
        return close, missed

    def run(rows: pa.Table) -> pa.Table:
        data, offsets = buffers(rows["text"])
        sets = []
        for a, b, part, at in row_chunks(data, offsets):
            sh, first, _, _ = shingles(part, at)
            sets += [np.unique(sh[first[i] : first[i + 1]]) for i in range(b - a)]
        rep, copies = (np.asarray(rows[c].combine_chunks()) for c in ("rep", "copies"))
        groups: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(rows["cluster"].to_pylist(), rows["bi"].to_pylist(), rows["bj"].to_pylist())):
            groups.setdefault(key, []).append(i)
        block = np.asarray(rows["block"].combine_chunks())
        out_rep, out_root, out_links, out_found, out_missed = [], [], [], [], []
        for (_, bi, bj), members in groups.items():
            members = sorted(members, key=lambda i: rep[i])
            own = np.array(members)
            close, missed = links([sets[i] for i in members], (block[own] == bj).astype(int), bi == bj)
            count = close @ copies[own]
            root = np.arange(len(own))
            while True:  # members are sorted by id, so the least index is the least id
                low = np.minimum(root, np.where(close, root[None, :], len(own)).min(axis=1))
                low = low[low]
                if (low == root).all():
                    break
                root = low
            out_rep.append(rep[own])
            out_root.append(rep[own[root]])
            out_links.append(count)
            out_found.append(close.sum(axis=1))
            out_missed.append(np.stack(missed, 1))
        made = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_rep, out_root, out_links, out_found)]
        missed = np.concatenate(out_missed) if out_missed else np.zeros((0, LEVELS))
        release()
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("rep", "root", "links", "found"), made)} | {f"missed{k}": pa.array(missed[:, k]) for k in range(LEVELS)})

    return run


def near_duplicates(docs: DataFrame, threshold: tuple[int, int] = (4, 5), id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """For each document: doc_id, class_id (the least doc_id of its group) and n_links (other documents as similar as the threshold, copies included)."""
    num, den = threshold
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    usable = narrow.where("doc_id is not null and text is not null")
    if usable.groupBy("doc_id").count().where("count > 1").limit(1).count():
        usable = usable.groupBy("doc_id").agg(F.min("text").alias("text"))
    depth = depth_for(num / den, recall)
    signed = written(usable.mapInArrow(_signer(depth), "doc_id long, size long, digest binary, keys array<long>, deeper array<short>"), "signatures")
    classes = written(signed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("copies"), F.max("size").alias("size"), F.first("keys").alias("keys"), F.first("deeper").alias("deeper")), "classes")
    edges = forest(classes)
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_BYTES)).cast("int")
    result = "rep long, root long, links long, found long, " + ", ".join(f"missed{k} double" for k in range(LEVELS))
    checked = seen = None
    level: int | None = LEVELS - 1
    while level is not None:
        cluster = components(edges.where(F.col("level") >= level)).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
        members = cluster.join(classes.select("rep", "copies", "size"), "rep")
        sizes = written(members.groupBy("cluster").agg(blocks.alias("blocks"), F.sum("size").alias("bytes"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("mark")), "sizes")
        grown = sizes if seen is None else sizes.join(seen.select("cluster", "n", "mark"), ["cluster", "n", "mark"], "left_anti")
        sent = grown.agg(F.coalesce(F.sum(F.col("bytes") * F.col("blocks")), F.lit(0)).alias("b")).first()["b"]  # every text travels once for each block
        members = members.join(grown.select("cluster", "blocks"), "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
        tasks = members.join(usable.withColumnRenamed("doc_id", "rep"), "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        tasks = tasks.select("cluster", "rep", "copies", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "text")
        tasks = tasks.withColumn("bucket", part_of(group_count(int(sent), BUCKET_BYTES), "cluster", "bi", "bj"))
        now = written(tasks.groupBy("bucket").applyInArrow(_verify(num, den, depth), result), "links")
        checked = now if checked is None else written(checked.join(members.select("rep"), "rep", "left_anti").unionByName(now), "links")
        seen = sizes
        told = checked.agg(*[F.coalesce(F.sum(c).cast("double"), F.lit(0.0)) for c in ("found", *(f"missed{k}" for k in range(LEVELS)))]).first()
        level = next_level(told[0], list(told[1:]), depth, num / den, recall, level)
    links = checked.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(checked.select(F.col("rep").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("rep"), "component")
    named = classes.select("digest", "rep", "copies").join(links, "rep", "left").join(groups, "rep", "left")
    named = named.select("digest", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    found = signed.select("doc_id", "digest").join(named, "digest").select("doc_id", "class_id", "n_links")
    return narrow.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without those whose group has a document of smaller doc_id.

    Rows with null ids, null texts or texts without words stay; rows that share an id stay or go together. Columns may have any names.
    """
    gone = near_duplicates(docs).where("doc_id <> class_id").select(F.col("doc_id").alias(fresh("gone", docs.columns))).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone[gone.columns[0]], "left_anti")


def op8_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group and the number of links of every document, at five words and a similarity of 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9 * c >= 4 * (x.n + y.n)),
r(doc_id, root) AS (SELECT a, a FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT d.doc_id, coalesce(c.root, d.doc_id) AS class_id, coalesce(k.n, 0) AS n_links FROM d
LEFT JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) c USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM l GROUP BY a) k USING (doc_id)
"""
