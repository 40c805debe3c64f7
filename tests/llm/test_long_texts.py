"""Texts much longer than a chunk, which are cut into overlapping pieces, and frequent windows: results equal brute force."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from engram.llm import repeats, substring_dedup, suffix_dedup
from engram.llm.common import with_checkpoints


def long_rows():
    rng = random.Random(8)
    line = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n)) + "\n"
    repeated = "".join(line(150) for _ in range(7))
    fresh = "".join(line(90) for _ in range(300))
    long = repeated * 2000 + fresh + repeated[200:900] + fresh[5000:9000]
    return [(1, fresh[:3000]), (2, long), (3, line(60) + repeated[:400] + line(60)), (4, long[:1500]), (None, line(200)), (5, None)]


def brute(rows, split, width):
    """Units of each id that no window covers which also starts earlier."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        units, until, kept = split(text or ""), 0, []
        covered = bytearray(len(units))
        for a in range(len(units) - width + 1):
            w = hash(b"\0".join(units[a : a + width])) if isinstance(units, list) else units[a : a + width]
            if w in seen:
                covered[max(a, until) : a + width] = b"\1" * (a + width - max(a, until))
                until = a + width
            seen.add(w)
        kept = [j for j, c in enumerate(covered) if not c]
        out[i] = b" ".join(units[j] for j in kept) if isinstance(units, list) else bytes(np.frombuffer(units, np.uint8)[kept])
    return out


def test_long_text_of_repeated_lines(spark):
    rows = long_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = repeats.remove_repeats(df, suffix_dedup.BYTES, lambda t, s: [suffix_dedup.kept_bytes(t, s)], [("kept", "binary", pa.binary())], hot=5)
    assert {r["doc_id"]: bytes(r["kept"]) for r in got.collect()} == brute(rows, lambda t: t.encode(), 100)
    got = repeats.remove_repeats(df, substring_dedup.WORDS, lambda t, s: [b" ".join(substring_dedup.kept_words(t, s)[0])], [("kept", "binary", pa.binary())], hot=5)
    assert {r["doc_id"]: bytes(r["kept"]) for r in got.collect()} == brute(rows, lambda t: t.encode().split(), 20)


@pytest.mark.parametrize("units", [suffix_dedup.BYTES, substring_dedup.WORDS])
def test_pieces_hold_every_window_once(monkeypatch, units):
    rows = pa.table({"id": pa.array([1], pa.int64()), "number": pa.array([7], pa.int64()), "text": pa.array([long_rows()[1][1][-60_000:]], pa.large_string())})

    def windows():
        out = {}
        for _, row, unit, _, n, h in repeats.Part(rows).segments(units, True):
            for r, u, m, x in zip(row.tolist(), unit.tolist(), n.tolist(), h.tolist()):
                for j in range(m):
                    assert (r, u + j) not in out
                    out[r, u + j] = x
        return out

    whole = windows()
    monkeypatch.setattr(repeats, "CHUNK", 4000)
    assert windows() == whole


@pytest.mark.parametrize("at_once", [50, 1 << 18])
def test_frequent_windows_travel_once(monkeypatch, at_once):
    """One part in this process: what travels and what is known to repeat make up all windows, each once, and no text travels twice."""
    monkeypatch.setattr(repeats, "AT_ONCE", at_once)
    units = repeats.Units(words=False, width=30, gram=10)
    text = long_rows()[1][1][:9000]
    rows = pa.table({"_part": pa.array([0], pa.int32()), "id": pa.array([5], pa.int64()), "number": pa.array([77], pa.int64()), "text": pa.array([text], pa.large_string())})
    ranks = repeats._rank_bucket(2)(repeats._rank_part(units, 1)(rows))
    covered, texts = [], 0
    for head, packed in zip(*[repeats._travel(units, 1)(rows, ranks)[c].to_pylist() for c in ("head", "text")]):
        heads = np.frombuffer(head, repeats._HEAD)
        covered += [int(f) + j for f, n in zip(heads["first"], heads["n"]) for j in range(int(n))]
        texts += len(heads) if packed is not None else 0
    raw = text.encode()
    assert len(covered) == len(set(covered)) <= len(raw) - 29
    assert texts <= len({raw[i : i + 30] for i in range(len(raw) - 29)})


@pytest.mark.parametrize(("master", "named", "ok"), [("local[8]", None, True), ("local-cluster[3,2,3000]", None, False), ("spark://host:7077", "/shared/cut", True), ("yarn", None, False)])
def test_checkpoints_on_a_cluster(master, named, ok):
    """A machine's own folder serves a local session alone."""
    state = {"dir": None}
    sc = SimpleNamespace(master=master, getCheckpointDir=lambda: state["dir"], setCheckpointDir=lambda d: state.update(dir=d))
    session = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda key, default: named))
    if ok:
        with_checkpoints(session)
        assert state["dir"] and (named is None or state["dir"] == named)
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            with_checkpoints(session)
