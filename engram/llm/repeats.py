"""Windows of units (words or bytes) that also start earlier: the exact job behind both repeat removers.

The corpus is dealt into parts of about PART_BYTES of text by document id, once; all passes read that
one shuffle. A window of `width` units has exactly one minimiser, its least-hashed gram of `gram` units
(the leftmost of equals), so windows of equal content share it, wherever they are.

1. rank     Each part sends the distinct hashes of its minimisers, with counts, to hash buckets. A bucket
            ranks them and tells each part which of its hashes occur more than once in the corpus.
            Unique ones end here.
2. travel   Consecutive windows that share a surviving minimiser travel to its bucket as one packed
            string. Equal strings of a part travel once, the later ones are already known to repeat.
            Where a minimiser occurs HOT times or more, windows travel one by one to the bucket of their
            own hash instead, again once for each part, so no bucket collects what a frequent passage's
            neighbourhoods have in common.
3. judge    A bucket names its windows by doubling (names of 2k units from pairs of names of k units),
            sorts the names and compares each window with the first of its name byte by byte. All but the
            first in (document, position) order repeat; runs of them go back to the documents' parts.
4. finish   Each part merges its documents' runs into spans and hands texts and spans to `finish`.

Rows that share a document id and text are one document; other rows that share an id are ordered by a
64-bit hash of the text, and dealt by it too, so that one id (or null) may have any share of the rows. A null
id is the smallest. Null texts are empty. Columns of the input may have any names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import BYTE_CODES, CHUNK, NOT_SPACE, U64, buffers, gram_hashes, group_count, part_of, release, row_chunks, slice_hashes, text_bytes, words

PART_BYTES = 8 << 20
#: Text bytes whose windows meet in one bucket, as packed strings if they survive the ranking.
BUCKET_BYTES = 4 << 20
#: Occurrences from which a minimiser's windows travel one by one.
HOT = 400
#: Windows of frequent minimisers that are told apart at once.
AT_ONCE = 1 << 18


@dataclass(frozen=True)
class Units:
    """What windows are made of: `words` (else bytes), a window's units, a gram's units."""

    words: bool
    width: int
    gram: int


class Chunk:
    """Some documents' units: hash codes, the first unit of each row, and a text in which unit i starts at `at[i]`."""

    def __init__(self, units: Units, data: np.ndarray, offsets: np.ndarray, text: bool):
        self.units = units
        if units.words:
            starts, ends, self.bounds = words(data, offsets, NOT_SPACE)
            self.codes = slice_hashes(data, starts, ends)
            if text:  # words followed by one space each
                sizes = ends - starts + 1
                self.at = np.concatenate([[0], np.cumsum(sizes)])
                shift = np.repeat(starts - self.at[:-1], sizes)
                shift += np.arange(len(shift))
                shift[self.at[1:] - 1] = 0
                self.text = data[shift] if len(data) else data
                self.text[self.at[1:] - 1] = 0x20
        else:
            self.bounds, self.codes, self.text, self.at = offsets, BYTE_CODES[data], data, None

    def packed(self, first: int, n: int) -> bytes:
        """The text of n consecutive windows from unit `first`."""
        last = first + n + self.units.width - 1
        return (self.text[self.at[first] : self.at[last] - 1] if self.units.words else self.text[first:last]).tobytes()

    def segments(self) -> tuple[np.ndarray, ...]:
        """(row, first window, windows, hash) of each run of windows with one minimiser."""
        width, n = self.units.width, len(self.codes)
        none = np.zeros(0, np.int64)
        if n < width:
            return none, none, none, np.zeros(0, U64)
        grams = gram_hashes(self.codes, self.units.gram)
        low = sliding_min((grams & ~U64(0xFFFFFFFF)) | np.arange(len(grams), dtype=U64), width - self.units.gram + 1)
        sizes = np.diff(self.bounds)
        rows = np.flatnonzero(sizes >= width)
        edge = np.zeros(n - width + 2, np.int8)
        edge[self.bounds[rows]] += 1
        edge[self.bounds[rows + 1] - width + 1] -= 1
        window = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8))
        if not len(window):
            return none, none, none, np.zeros(0, U64)
        place = (low[window] & U64(0xFFFFFFFF)).astype(np.int64)
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)])
        head = np.flatnonzero(new)
        first = window[head]
        return np.searchsorted(self.bounds, first, side="right") - 1, first, np.diff(np.append(head, len(window))), grams[place[head]]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h & U64(0xFFFFFFFF)) * U64(n) >> U64(32)).astype(np.int32)


class Part:
    """A part's documents: `data`, and of each row its id and its number (the hash of its text)."""

    def __init__(self, rows: pa.Table):
        self.data, self.offsets = buffers(rows["text"])
        self.ids = np.asarray(rows["id"].combine_chunks().cast(pa.int64()).fill_null(np.iinfo(np.int64).min))
        self.number = np.asarray(rows["number"].combine_chunks())
        order = np.lexsort((self.number, self.ids))
        same = np.concatenate([[False], (np.diff(self.ids[order]) == 0) & (np.diff(self.number[order]) == 0)]) if len(order) else np.zeros(0, bool)
        first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        self.same_as = dict(zip(order[same].tolist(), first[same].tolist()))

    def chunks(self, units: Units, text: bool = True):
        """(row of the part of the chunk's first row, unit of that row at which it starts, Chunk). A row much longer than a chunk comes in pieces that
        overlap by a window less one unit, so that every window is in one piece."""
        for first, end, data, offsets in row_chunks(self.data, self.offsets):
            if end - first > 1 or len(data) <= 2 * CHUNK:
                yield first, 0, Chunk(units, data, offsets, text)
                continue
            starts, ends = words(data, offsets, NOT_SPACE)[:2] if units.words else (None, None)
            total = len(starts) if units.words else len(data)
            step = max(1, total * CHUNK // len(data))
            for i in range(0, max(1, total), step):
                j = min(total, i + step + units.width - 1)
                piece = data[starts[i] : ends[j - 1]] if units.words and j > i else data[i:j]
                yield first, i, Chunk(units, piece, np.array([0, len(piece)]), text)

    def segments(self, units: Units, text: bool):
        """(chunk, row in the part, first unit in the row, first window in the chunk, windows, hash); repeated rows hold no units."""
        for base, start, chunk in self.chunks(units, text):
            row, first, n, h = chunk.segments()
            if self.same_as:
                own = np.array([int(r) not in self.same_as for r in row + base], bool)
                row, first, n, h = row[own], first[own], n[own], h[own]
            yield chunk, row + base, first - chunk.bounds[row] + start, first, n, h


def _rank_part(units: Units, buckets: int) -> Callable:
    def run(rows: pa.Table) -> pa.Table:
        part = rows["_part"][0].as_py()
        found = [h for *_, h in Part(rows).segments(units, False)]
        h, n = np.unique(np.concatenate(found) if found else np.zeros(0, U64), return_counts=True)
        to = bucket(h, buckets)
        order = np.argsort(to, kind="stable")
        h, n, to = h[order], np.minimum(n[order], 1 << 30).astype("<u4"), to[order]
        cuts = np.flatnonzero(np.diff(to)) + 1
        names = to[np.concatenate([[0], cuts]).astype(int)] if len(to) else to
        hs, ns = (np.split(x, cuts) if len(to) else [] for x in (h, n))
        release()
        return pa.table({"bucket": pa.array(names, pa.int32()), "_part": pa.array([part] * len(hs), pa.int32()), "hashes": pa.array([x.tobytes() for x in hs], pa.binary()), "counts": pa.array([x.tobytes() for x in ns], pa.binary())})

    return run


def _rank_bucket(hot: int) -> Callable:
    def run(rows: pa.Table) -> pa.Table:
        parts = rows["_part"].to_pylist()
        hs = [np.frombuffer(x, "<u8") for x in rows["hashes"].to_pylist()]
        _, name = np.unique(np.concatenate(hs), return_inverse=True)
        total = np.bincount(name, weights=np.concatenate([np.frombuffer(x, "<u4") for x in rows["counts"].to_pylist()]))[name]
        out: dict[str, list] = {"_part": [], "hashes": [], "hot": []}
        at = 0
        for part, h in zip(parts, hs):
            n = total[at : at + len(h)]
            at += len(h)
            if (keep := n >= 2).any():
                out["_part"].append(part)
                out["hashes"].append(h[keep].tobytes())
                out["hot"].append((n[keep] >= hot).tobytes())
        return pa.table({"_part": pa.array(out["_part"], pa.int32()), "hashes": pa.array(out["hashes"], pa.binary()), "hot": pa.array(out["hot"], pa.binary())})

    return run


#: What a packed string carries besides its text: document id, number, first unit, windows, length.
_HEAD = np.dtype([("id", "<i8"), ("number", "<i8"), ("first", "<i4"), ("n", "<i4"), ("size", "<i4")])
_TRAVEL = "bucket int, _part int, head binary, text binary"


def first_windows(units: Units, chunk: Chunk, hashes: np.ndarray, rank: np.ndarray, unit: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Some windows of a chunk (hashes: of all its windows; their rows' ranks, first units in their rows and in the chunk) in document order: (places of those that come first of their content, first
    places and lengths of runs of consecutive others). Contents are told apart by hash and compared run by run; what only shares a hash counts as first."""
    order = np.lexsort((unit, rank))
    _, lead, inverse = np.unique(hashes[window[order]], return_index=True, return_inverse=True)
    lead = lead[inverse]
    later = np.flatnonzero(lead != np.arange(len(lead)))
    none = np.zeros(0, np.int64)
    if not len(later):
        return order, none, none
    after = lambda places: (np.diff(rank[order[places]]) == 0) & (np.diff(unit[order[places]]) == 1)
    begin = np.flatnonzero(np.concatenate([[True], ~(after(later) & after(lead[later]))]))
    size = np.diff(np.append(begin, len(later)))
    a, b = window[order[later[begin]]], window[order[lead[later[begin]]]]
    last_a, last_b = a + size + units.width - 1, b + size + units.width - 1
    if units.words:
        a, b, last_a, last_b = chunk.at[a], chunk.at[b], chunk.at[last_a] - 1, chunk.at[last_b] - 1
    raw = memoryview(np.ascontiguousarray(chunk.text))
    equal = np.array([raw[w:x] == raw[y:z] for w, x, y, z in zip(a.tolist(), last_a.tolist(), b.tolist(), last_b.tolist())], bool)
    known = np.zeros(len(lead), bool)
    known[later] = np.repeat(equal, size)
    return order[~known], order[later[begin[equal]]], size[equal]


def _travel(units: Units, buckets: int) -> Callable:
    def run(rows: pa.Table, ranks: pa.Table) -> pa.Table:
        out: dict[int, tuple[list, list]] = {}
        known: list[tuple] = []  # repeats that are clear inside the part
        clear: list[np.ndarray] = []  # runs of repeats that are clear inside a chunk
        if rows.num_rows and ranks.num_rows:
            h = np.concatenate([np.frombuffer(x, "<u8") for x in ranks["hashes"].to_pylist()])
            hot = np.concatenate([np.frombuffer(x, bool) for x in ranks["hot"].to_pylist()])
            order = np.argsort(h)
            h, hot = h[order], hot[order]
            part = Part(rows)
            rank = np.empty(len(part.ids), np.int64)
            rank[np.lexsort((part.number, part.ids))] = np.arange(len(rank))
            seen: dict[bytes, tuple] = {}
            pending: list[tuple[tuple, int, bytes]] = []
            for chunk, row, unit, first, n, own in part.segments(units, True):
                place = np.searchsorted(h, own)
                place[place == len(h)] = 0
                good = np.flatnonzero(h[place] == own)
                is_hot = hot[place[good]]
                cool = good[~is_hot]
                ids, numbers = part.ids[row[cool]].tolist(), part.number[row[cool]].tolist()
                for i, number, u, f, m, b in zip(ids, numbers, unit[cool].tolist(), first[cool].tolist(), n[cool].tolist(), bucket(own[cool], buckets).tolist()):
                    pending.append(((i, number, u, m), b, chunk.packed(f, m)))
                hot_ones = good[is_hot]
                if len(hot_ones):
                    hashes = gram_hashes(chunk.codes, units.width)
                for each in np.split(hot_ones, np.flatnonzero(np.diff(np.cumsum(n[hot_ones]) // AT_ONCE)) + 1) if len(hot_ones) else ():
                    # windows by themselves; those that repeat among these never travel
                    within = np.arange(int(n[each].sum())) - np.repeat(np.cumsum(n[each]) - n[each], n[each])
                    wide = [np.repeat(x[each], n[each]) for x in (row, unit, first)]
                    row_, unit_, window = wide[0], wide[1] + within, wide[2] + within
                    new, begin, size = first_windows(units, chunk, hashes, rank[row_], unit_, window)
                    bs = bucket(hashes[window[new]], buckets).tolist()
                    heads = zip(part.ids[row_[new]].tolist(), part.number[row_[new]].tolist(), unit_[new].tolist())
                    pending += [((*head, 1), b, chunk.packed(f, 1)) for head, b, f in zip(heads, bs, window[new].tolist())]
                    runs = np.zeros(len(begin), _HEAD)
                    runs["id"], runs["number"], runs["first"], runs["n"] = part.ids[row_[begin]], part.number[row_[begin]], unit_[begin], size
                    clear.append(runs)
            pending.sort(key=lambda x: x[0])
            for head, b, text in pending:
                if text in seen:
                    known.append(head)
                else:
                    seen[text] = head
                    heads, texts = out.setdefault(b, ([], []))
                    heads.append((*head, len(text)))
                    texts.append(text)
        name = rows["_part"][0].as_py() if rows.num_rows else ranks["_part"][0].as_py()
        pack = zstandard.ZstdCompressor(level=1).compress
        pending = seen = None
        made = [(b, name, np.array(heads, _HEAD).tobytes(), pack(b"".join(texts))) for b, (heads, texts) in out.items()]
        if known:
            clear.append(np.array([(*x, 0) for x in known], _HEAD))
        if clear := [x for x in clear if len(x)]:
            made.append((name % buckets, name, np.concatenate(clear).tobytes(), None))
        cols = list(zip(*made)) or [(), (), (), ()]
        out = made = None
        release()
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("bucket", "_part", "head", "text"), cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))})

    return run


def _judge(units: Units) -> Callable:
    def run(rows: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        runs: list[tuple[np.ndarray, np.ndarray]] = []
        heads, texts, parts = [], [], []
        for part, head, text in zip(rows["_part"].to_pylist(), rows["head"].to_pylist(), rows["text"].to_pylist()):
            head = np.frombuffer(head, _HEAD)
            if text is None:
                runs.append((np.full(len(head), part, np.int32), head))
            else:
                heads.append(head)
                parts.append(np.full(len(head), part, np.int32))
                texts.append(unpack(text))
        if heads:
            runs.append(_repeats(units, np.concatenate(heads), np.concatenate(parts), np.frombuffer(b"".join(texts), np.uint8)))
        heads = texts = None
        release()
        part = np.concatenate([p for p, _ in runs])
        head = np.concatenate([x for _, x in runs])
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        groups = np.split(order, cuts) if len(order) else []
        return pa.table({"_part": pa.array([int(part[g[0]]) for g in groups], pa.int32()), "head": pa.array([head[g].tobytes() for g in groups], pa.binary())})

    return run


def _repeats(units: Units, head: np.ndarray, part: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(part, head) of the runs of windows that aren't the first of their content."""
    offsets = np.concatenate([[0], np.cumsum(head["size"], dtype=np.int64)])
    order = np.lexsort((head["first"], head["number"], head["id"]))
    if units.words:
        starts, ends, bounds = words(text, offsets, NOT_SPACE)
        at, stop = starts, ends
    else:
        bounds, at, stop = offsets, None, None
    n = head["n"][order].astype(np.int64)
    seg = np.repeat(order, n)
    within = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
    place = bounds[seg] + within  # the first unit of each window, in document order
    name = np.empty(len(seg), U64)
    for i, j, codes, base in _codes(units, text, offsets, bounds, at, stop):
        mine = np.flatnonzero((seg >= i) & (seg < j))
        name[mine] = gram_hashes(codes, units.width)[place[mine] - base]
    _, inverse = np.unique(name, return_inverse=True)
    first = np.empty(int(inverse.max()) + 1, np.int64)
    first[inverse[::-1]] = np.arange(len(seg))[::-1]
    lead = first[inverse]
    later = np.flatnonzero(lead != np.arange(len(seg)))
    if not len(later):
        return part[:0], head[:0]
    new = np.concatenate([[True], (np.diff(later) != 1) | (seg[later[1:]] != seg[later[:-1]]) | (np.diff(lead[later]) != 1) | (seg[lead[later[1:]]] != seg[lead[later[:-1]]])])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(later)))
    a, b = place[later[begin]], place[lead[later[begin]]]
    last_a, last_b = a + size + units.width - 2, b + size + units.width - 2
    if units.words:
        spans = zip(at[a].tolist(), stop[last_a].tolist(), at[b].tolist(), stop[last_b].tolist())
    else:
        spans = zip(a.tolist(), (last_a + 1).tolist(), b.tolist(), (last_b + 1).tolist())
    raw = memoryview(text)
    if not all(raw[w:x] == raw[y:z] for w, x, y, z in spans):
        return _repeats_by_text(units, head, part, place, seg, within, raw, at, stop)
    out = np.zeros(len(begin), _HEAD)
    origin = head[seg[later[begin]]]
    out["id"], out["number"], out["n"] = origin["id"], origin["number"], size
    out["first"] = origin["first"] + within[later[begin]]
    return part[seg[later[begin]]], out


def _repeats_by_text(units, head, part, place, seg, within, raw, at, stop) -> tuple[np.ndarray, np.ndarray]:
    """The same, for the case that two contents have one name: windows are told apart by their text."""
    seen: set[bytes] = set()
    later = []
    for i, p in enumerate(place.tolist()):
        t = bytes(raw[at[p] : stop[p + units.width - 1]] if units.words else raw[p : p + units.width])
        if t in seen:
            later.append(i)
        seen.add(t)
    out = np.zeros(len(later), _HEAD)
    origin = head[seg[later]]
    out["id"], out["number"], out["n"] = origin["id"], origin["number"], 1
    out["first"] = origin["first"] + within[later]
    return part[seg[later]], out


def _codes(units: Units, text: np.ndarray, offsets: np.ndarray, bounds: np.ndarray, starts: np.ndarray | None, ends: np.ndarray | None):
    """(first string, end string, unit codes, first unit) of some packed strings at a time."""
    for i, j, piece, _ in row_chunks(text, offsets):
        a, b = int(bounds[i]), int(bounds[j])
        yield i, j, slice_hashes(piece, starts[a:b] - offsets[i], ends[a:b] - offsets[i]) if units.words else BYTE_CODES[piece], a


def union(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Maximal spans of a union of spans."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.concatenate([[True], first[1:] > last[:-1]])
    begin = np.flatnonzero(new)
    return list(zip(first[begin].tolist(), last[np.append(begin[1:], len(first)) - 1].tolist()))


Finish = Callable[[bytes, list[tuple[int, int]]], list]


def _finish(units: Units, finish: Finish, kinds: list[pa.DataType]) -> Callable:
    def run(rows: pa.Table, runs: pa.Table) -> pa.Table:
        part = Part(rows)
        spans: dict[int, list[tuple[int, int]]] = {}
        if runs.num_rows and rows.num_rows:
            head = np.concatenate([np.frombuffer(x, _HEAD) for x in runs["head"].to_pylist()])
            head = head[np.lexsort((head["number"], head["id"]))]
            new = np.concatenate([[True], (head["id"][1:] != head["id"][:-1]) | (head["number"][1:] != head["number"][:-1])])
            begin = np.flatnonzero(new).tolist()
            by = {(int(head["id"][i]), int(head["number"][i])): (i, j) for i, j in zip(begin, [*begin[1:], len(head)])}
            for r, key in enumerate(zip(part.ids.tolist(), part.number.tolist())):
                if (x := by.get(key)) and r not in part.same_as:
                    own = head[x[0] : x[1]]
                    spans[r] = union(own["first"].astype(np.int64), own["first"].astype(np.int64) + own["n"] + units.width - 1)
            for r, other in part.same_as.items():
                spans[r] = spans.get(other, [])
        raw = part.data.tobytes()
        made = [finish(raw[a:b], spans.get(r, [])) for r, (a, b) in enumerate(zip(part.offsets[:-1].tolist(), part.offsets[1:].tolist()))]
        cols = list(zip(*made)) or [()] * len(kinds)
        kept = {n: rows[n] for n in rows.column_names if n[0] == "c"}
        return pa.table(kept | {f"m{i}": pa.array(c, t) for i, (c, t) in enumerate(zip(cols, kinds))})

    return run


def remove_repeats(docs: DataFrame, units: Units, finish: Finish, columns: list[tuple[str, str, pa.DataType]], id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """docs without the text column, with what `finish(text, spans of repeated units)` returns as `columns` (name, Spark type, Arrow type)."""
    total = text_bytes(docs, text_col)
    parts, buckets = group_count(total, PART_BYTES), group_count(total, BUCKET_BYTES)
    names = [c[0] for c in columns]
    rest = [c for c in docs.columns if c not in (text_col, *names)]
    own = [F.col(c).alias(f"c{i}") for i, c in enumerate(rest)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*own, F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("number"), text.alias("text"))
    by_part = rows.withColumn("_part", part_of(parts, "id", "number")).repartition(parts, "_part").groupBy("_part")
    ranked = by_part.applyInArrow(_rank_part(units, buckets), "bucket int, _part int, hashes binary, counts binary")
    survivors = ranked.groupBy("bucket").applyInArrow(_rank_bucket(hot), "_part int, hashes binary, hot binary")
    packed = by_part.cogroup(survivors.groupBy("_part")).applyInArrow(_travel(units, buckets), _TRAVEL)
    runs = packed.groupBy("bucket").applyInArrow(_judge(units), "_part int, head binary")
    schema = docs.select(*own, *[F.lit(None).cast(kind).alias(f"m{i}") for i, (_, kind, _) in enumerate(columns)]).schema
    out = by_part.cogroup(runs.groupBy("_part")).applyInArrow(_finish(units, finish, [c[2] for c in columns]), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], *[F.col(f"m{i}").alias(n) for i, n in enumerate(names)])
