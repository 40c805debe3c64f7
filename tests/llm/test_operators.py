"""Small tables with every hard case (nulls, empty and long texts, repeats, clashing columns) against brute force, and empty tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.llm import ann, bpe, decontaminate, langid, lm_score, near_dups, sharding, substring_dedup, suffix_dedup, token_files
from engram.llm.components import components
from engram.llm.repeats import Units, remove_repeats

#: Names that the operators' own temporary columns might have.
CLASH = "_part int, _bucket int, _rank int, _n int, _start int, _letter int, _text string, letter int, absent int, id string, c0 string, m0 string, size int, row int, best string, top double"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, rows string, number int, shard string, keys string, file string, bucket int, " + CLASH


EXTRA = (1, 2, 3, 4, 5, 6, "t", 7, 8, "i", "c", "m", 9, 10, "b", 1.5)


def words(rng, n, vocab=40):
    return " ".join(f"w{rng.randrange(vocab)}é" if rng.random() < 0.2 else f"w{rng.randrange(vocab)}" for _ in range(n))


def texts():
    rng = random.Random(3)
    shared = words(rng, 60, 5000)
    out = {i: words(rng, rng.randrange(1, 90), 4000) for i in range(24)}
    out[2] = out[1]
    out[3] = out[1] + " tail one two"
    out[5] = words(rng, 30, 4000) + "\n" + shared + "  \t " + words(rng, 20, 4000)
    out[6] = shared.upper()
    out[7] = "head " + shared + " " + shared
    out[8] = ""
    out[9] = None
    out[10] = "one"
    out[11] = "a b " * 800
    out[12] = "ééé " * 300 + shared
    out[13] = " \n\t "
    out[14] = "!!! ... ???"
    out[15] = words(rng, 6000, 3000)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], "s", 7, 1, "r", 2, "x", "k", "f", 9, *EXTRA) for i, t in texts().items()]
    rows += [rows[1], (None, "null id text", *[None] * 26), (4, "another text with the id of four", "en", "s", 1, 1, "r", 2, "x", "k", "f", 9, *EXTRA)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def text_hash(text):
    """What Spark's xxhash64 gives for a string."""
    import xxhash

    h = xxhash.xxh64((text or "").encode(), seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


def order_key(row):
    return (-(1 << 63) if row["doc_id"] is None else row["doc_id"], text_hash(row["text"]))


def brute_repeats(rows, split, width):
    """Spans of repeated units of each distinct (id, text), by trying every window in order."""
    seen, out = set(), {}
    for r in sorted({(order_key(r)): r for r in rows}.values(), key=order_key):
        units = split(r["text"] or "")
        gone = [False] * len(units)
        for i in range(len(units) - width + 1):
            w = tuple(units[i : i + width])
            if w in seen:
                gone[i : i + width] = [True] * width
            seen.add(w)
        out[order_key(r)] = [u for u, g in zip(units, gone) if not g]
    return out


@pytest.mark.parametrize("hot", [2, 400])
def test_repeated_words(docs, hot):
    units = Units(words=True, width=8, gram=3)
    kept = lambda t, s: [b" ".join(substring_dedup.kept_words(t, s)[0]).decode()]
    import pyarrow as pa

    got = remove_repeats(docs.withColumn("own", F.col("text")), units, kept, [("kept", "string", pa.string())], hot=hot)
    rows = docs.collect()
    want = brute_repeats(rows, lambda t: t.encode().split(), 8)
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["kept"].encode() == b" ".join(want[order_key({"doc_id": r["doc_id"], "text": r["own"]})])


def test_repeated_bytes(docs):
    import pyarrow as pa

    units = Units(words=False, width=30, gram=10)
    kept = lambda t, s: [suffix_dedup.kept_bytes(t, s)]
    got = remove_repeats(docs.withColumn("own", F.col("text")), units, kept, [("kept", "binary", pa.binary())], hot=3).collect()
    want = brute_repeats(docs.collect(), lambda t: list(t.encode()), 30)
    for r in got:
        assert bytes(r["kept"]) == bytes(want[order_key({"doc_id": r["doc_id"], "text": r["own"]})])


def test_dedup_keeps_columns_and_characters(docs):
    out = suffix_dedup.dedup_bytes(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert substring_dedup.dedup_words(docs).columns == docs.columns


def test_whole_characters():
    text = "aé€b".encode()
    assert suffix_dedup.whole_characters(text, [(2, 4)]) == []
    assert suffix_dedup.kept_bytes(text, suffix_dedup.whole_characters(text, [(1, 7)])).decode() == "a"
    assert suffix_dedup.kept_bytes(text, suffix_dedup.whole_characters(text, [(0, 2)])).decode() == "é€b"


@pytest.mark.parametrize("shards,rows", [(1, 7), (3, 50), (40, 2000), (5, 1)])
def test_sharding_is_a_permutation(spark, shards, rows):
    df = spark.range(rows).withColumnRenamed("id", "doc_id").withColumn("shard", F.lit("old"))
    out = sharding.assign_shards(df, shards).collect()
    assert sorted(r["slot"] * shards + r["shard"] for r in out) == list(range(rows))
    assert sorted(r["doc_id"] for r in out) == list(range(rows))
    again = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(df.repartition(3), shards).collect()}
    assert again == {r["doc_id"]: r["shard"] for r in out}


def test_sharding_hard_rows(docs, empty, tmp_path):
    out = sharding.assign_shards(docs, 4)
    assert out.count() == docs.count()
    sharding.write_shards(out, str(tmp_path / "s"))
    assert docs.sparkSession.read.parquet(str(tmp_path / "s")).count() == docs.count()
    assert sharding.assign_shards(empty, 4).count() == 0


def brute_shingles(text):
    import re

    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


def test_near_duplicates(spark, docs, empty):
    rng = random.Random(5)
    base = [f"t{rng.randrange(9999)}" for _ in range(120)]
    rows = [(1000 + k, " ".join(base[:j] + ["X"] + base[j + 1 :])) for k, j in enumerate(rng.sample(range(120), 60))]
    all_docs = docs.where("doc_id IS NULL OR doc_id <> 4").select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_dups.near_duplicates(all_docs).collect()}
    sets = {r["doc_id"]: brute_shingles(r["text"]) for r in all_docs.collect() if r["doc_id"] is not None}
    ids = sorted(sets)
    near = {i: {j for j in ids if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} for i in ids}
    for i in ids:
        group, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - group:
                group.add(j)
                todo.append(j)
        assert got[i] == (min(group), len(near[i])), i
    assert got[None] == (None, 0)
    assert near_dups.near_duplicates(empty).count() == 0
    assert near_dups.keep_one(docs).columns == docs.columns


def test_forest_depth():
    assert near_dups.depth_for(0.8) == 8
    assert near_dups.depth_for(0.5) < near_dups.depth_for(0.9)


def test_isolated_pairs_meet():
    """Of many pairs without other members, no more miss each other than the target recall allows."""
    import pyarrow as pa

    rng = random.Random(11)
    texts = []
    for i in range(30000):
        a = [f"w{rng.randrange(10**9)}" for _ in range(24)]  # 20 shingles; 20 / 25 to 20 / 24 are shared
        texts += [" ".join(a), " ".join(a + [f"w{rng.randrange(10**9)}" for _ in range(5 - i % 2)])]
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    keys = []
    for out in near_dups._signer(near_dups.depth_for(0.8))([batch]):
        keys.append(np.asarray(out["keys"].values).reshape(out.num_rows, -1))
    keys = np.concatenate(keys)
    missed = int((keys[::2] != keys[1::2]).all(axis=1).sum())
    assert missed <= 3  # 0.15 expected at independent tries


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (3, 9), (7, 7), (9, 1)], "u long, v long")
    got = {r["node"]: r["component"] for r in components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4}
    path = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert components(path).select("component").distinct().collect()[0]["component"] == 0


def brute_contamination(text, items, window=13):
    import re

    cut = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    w, hit, names = cut(text), set(), set()
    for name, t in items:
        it = cut(t)
        m = min(window, len(it))
        wins = {tuple(it[i : i + m]) for i in range(len(it) - m + 1)} if m else set()
        for i in range(len(w) - m + 1):
            if m and tuple(w[i : i + m]) in wins:
                hit |= set(range(i, i + m))
                names.add(name)
    return len(w), len(hit), sorted(names)


def test_contamination(spark, docs, empty):
    t = texts()
    rng = random.Random(9)
    items = [(1, " ".join(t[5].split()[5:40])), (2, t[15][:400]), (3, "one"), (4, "a b a b a"), (5, None), (6, "..."), (7, " ".join(t[5].split()[10:24])), (8, words(rng, 20, 9)), (2, t[15][900:1200])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.judge(decontaminate.find_items(docs, bench)).collect()
    assert len(got) == docs.count()
    for r in got:
        n, hit, names = brute_contamination(r["text"], [(str(i), x) for i, x in items if x])
        assert (r["n_words"], r["n_hit"], r["hit_items"]) == (n, hit, names), r["doc_id"]
        assert r["items_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not r["contaminated"] for r in got)
    assert decontaminate.find_items(empty, bench).count() == 0
    assert {r["hit_items"] == [] for r in decontaminate.find_items(docs, bench.where("false")).collect()} == {True}


def test_spans_are_removed(spark):
    item = " ".join(f"i{k}" for k in range(15))
    plain = " ".join(f"w{k}" for k in range(400))
    rows = [(1, f"{plain}, {item}! {plain}", "x"), (2, item, "x"), (3, plain, "x"), (4, None, "x"), (5, "", "x"), (6, f"é {plain} tail {item.upper()}", "x"), (6, f"é {plain} tail {item.upper()}", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, hit_spans string")
    bench = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    got = sorted((r["doc_id"], r["text"], r["hit_spans"]) for r in decontaminate.remove_spans(df, bench).collect())
    assert [x[:2] for x in got] == [(1, f"{plain}, ! {plain}"), (3, plain), (4, None), (5, ""), (6, f"é {plain} tail "), (6, f"é {plain} tail ")] and {x[2] for x in got} == {"x"}
    assert {r["text"] for r in decontaminate.remove_spans(df.where("doc_id = 1"), bench, least_words=16).collect()} == {rows[0][1]}


def test_bpe_round_trip(docs, empty):
    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    odd = docs.sparkSession.createDataFrame([(100, "  a  b\n c  "), (101, "x  　y z\t w"), (102, "it's  we'll 's 12 34!! <|endoftext|> 😀"), (103, " ")], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(odd).withColumn("own", F.col("text"))
    for r in bpe.encode_and_decode(both, path, P.PATTERN).collect():
        assert r["ids"] == library.encode_ordinary(r["own"] or "") and bytes(r["decoded"]).decode() == (r["own"] or "")
    for r in bpe.digests(both, path, P.PATTERN, id_col="own").collect():
        ids = library.encode_ordinary(r["own"] or "")
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r["n_tokens"] == len(ids)
    assert bpe.encode_and_decode(docs, path, P.PATTERN).count() == docs.count()
    assert bpe.digests(empty, path, P.PATTERN).count() == 0


def test_long_words(spark):
    """Words beyond a recursive query's stretch, with open seams too, as the library encodes them."""
    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(6)
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    texts = ["-" * 5000, " " * 3001, "a" * 65, "abc" * 777, pick("abcdefghijklmnopqrstuvwxyz", 100_000), pick("ab", 9000), pick("éü漢字かな", 700), pick(["ing", "tion", "the"], 900)]
    rows = bpe.encode_and_decode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, P.PATTERN).collect()
    assert {r["doc_id"]: (r["ids"], bytes(r["decoded"]).decode()) for r in rows} == {i: (library.encode_ordinary(t), t) for i, t in enumerate(texts)}


def test_wide_seams(monkeypatch):
    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(bpe, "WINDOW", 12)
    path = P.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    words = ["ab" * 300, "-" * 700, "the" * 200]
    ids, sizes, _, _ = bpe.DuckBpe(path).words([w.encode() for w in words])
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [library.encode_ordinary(w) for w in words]


def test_pieces_are_pretokens():
    """Pieces of random texts, cut in a batch, are the public pattern's matches."""
    P = pytest.importorskip("public_tokenizers")
    import regex

    from engram.llm.pretokens import cut, pretokens

    pattern, rng = regex.compile(P.PATTERN), random.Random(1)
    alphabet = [" ", " ", "\n", "\t", "a", "b", "é", "'", "s", "!", "5", "\xa0", "\u2003", "\u3000", "漢", "\x1c", "\x85", "\r", "²", "\u0301", "😀", ".", "ll", "'re"]
    for _ in range(300):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(14))) for _ in range(20)]
        raw = [t.encode() for t in texts]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        starts, ends, bounds = cut(data, offsets)
        for i, t in enumerate(texts):
            got = [w.decode() for k in range(bounds[i], bounds[i + 1]) for w in pretokens(data[starts[k] : ends[k]].tobytes(), pattern)]
            assert got == pattern.findall(t), t


def test_memo_forgets_and_finds():
    from engram.llm.pretokens import Memo

    memo, rng = Memo([np.int64], limit=20_000, slots=4), np.random.default_rng(0)
    for _ in range(50):
        h = rng.integers(0, 500, 200, dtype=np.uint64) << np.uint64(54)
        numbers = memo.numbers(h, lambda first: [(np.repeat(h[first].astype(np.int64) >> 54, 2), np.full(len(first), 2))])
        values, sizes = memo.rows(0, numbers)
        assert (sizes == 2).all() and (values == np.repeat(h.astype(np.int64) >> 54, 2)).all()


def test_token_files(docs, empty, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    odd = spark.createDataFrame([(100, "  a  b\n c  "), (101, "x  　y z\t w\x00q"), (102, "it's\n\n12 34!! <|endoftext|> 😀\nend")], "doc_id long, text string")
    both = docs.where("doc_id IS NULL OR doc_id <> 4").select("doc_id", "text").distinct().union(odd)
    out = token_files.write_token_ids(both, str(tmp_path / "t"), path, P.PATTERN, 2)
    got = {r["doc_id"]: r for r in token_files.token_index(token_files.read_token_ids(spark, out)).collect()}
    at = 0
    for r in sorted(both.collect(), key=lambda r: -1 if r["doc_id"] is None else r["doc_id"]):
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        assert (got[r["doc_id"]]["start"], got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.read_token_ids(spark, out).where("doc_id = 101").count() == 1
    token_files.write_token_ids(empty, str(tmp_path / "e"), path, P.PATTERN, 2)


def test_token_files_of_added_tokens(spark, tmp_path):
    """op4's result on texts that hold the tokenizer's added token equals the library's in its default setting."""
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "plain words", "<|endoftext|><|endoftext|>", "x  <|endoftext|>\n y", None, "", "<|endoftext|", "end <|endoftext|>"]
    assert library.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in token_files.op4_token_files(spark, str(tmp_path)).collect()}
    at = 0
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        at += len(ids)


def test_language(spark, docs, empty):
    path = langid.piece_path()
    en, de = "the house and the river were under the old tree", "das haus und der fluss waren unter dem alten baum"
    train = spark.createDataFrame([(en, "en"), (de, "de"), (None, "en"), ("text", None)], "text string, lang string")
    model = langid.fit(train, path)
    [(langs, probs)] = model
    assert langs == ["de", "en"] and np.allclose(probs.sum(axis=0), 1)
    rows = spark.createDataFrame([(1, "the old river"), (2, "der alte fluss und das haus"), (3, None), (4, ""), (5, "123 !!!"), (6, "x" * 5000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.predict(rows, model, path).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5)] == ["en", "de", "und", "und", "und"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[6]["lang_pred"] in ("de", "en")
    assert langid.predict(docs, model, path).count() == docs.count() and langid.predict(empty, model, path).count() == 0
    none = langid.fit(train.where("false"), path)
    assert {r["lang_pred"] for r in langid.predict(rows, none, path).collect()} == {"und"}


def all_segmentations(word, probs):
    """The sum over all segmentations, by recursion."""
    return 1.0 if not word else sum(p * all_segmentations(word[len(t) :], probs) for t, p in probs.items() if word.startswith(t))


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(2)
    texts = [b" a", b"ab", b" ab", b"ba", b"aba", b"bab a"[:3], *[bytes([b]) for b in range(256)]]
    texts = sorted(set(texts))
    pieces, probs = langid.Pieces(texts), rng.random((len(texts), 2)) * 0.1
    words = [" abab", " babb", " aaaa", " bbab"]
    matrix = np.array([list(w.encode()) for w in words], np.uint8)
    want = [[all_segmentations(w.encode(), dict(zip(texts, probs[:, k]))) for k in range(2)] for w in words]
    assert np.exp(langid.forward(matrix, pieces, probs)) == pytest.approx(np.array(want))
    for row, w in zip(matrix, want):
        assert np.exp(langid.forward_long(row, pieces, probs)) == pytest.approx(np.array(w))
    long = np.frombuffer(b" " + b"ab" * 20000, np.uint8)
    assert np.isfinite(langid.forward_long(long, pieces, probs)).all()


def test_expected_counts_share_segmentations(monkeypatch):
    """Expected counts equal those of an enumeration of all segmentations."""
    import pyarrow as pa

    texts = sorted({b" a", b"ab", b" ab", *[bytes([b]) for b in range(256)]})
    monkeypatch.setattr(langid, "vocabulary", lambda path: texts)
    probs = np.random.default_rng(3).random((len(texts), 1)) * 0.1

    def spell(word):
        return [[]] if not word else [[t, *rest] for t in texts if word.startswith(t) for rest in spell(word[len(t) :])]

    p = dict(zip(texts, probs[:, 0]))
    want = {}
    for word, n in ((b" ab", 3), (b" aab", 2)):
        ways = [(w, np.prod([p[t] for t in w])) for w in spell(word)]
        for w, weight in ways:
            for t in w:
                want[t] = want.get(t, 0) + n * weight / sum(x for _, x in ways)
    batch = pa.record_batch({"lang": pa.array([0, 0], pa.int32()), "word": pa.array([b" ab", b" aab"]), "n": pa.array([3, 2], pa.int64())})
    [out] = list(langid._expect("own", lambda: probs, 1)(iter([batch])))
    got = {texts[i]: x for i, x in zip(out["piece"].to_pylist(), out["n"].to_pylist())}
    assert got.keys() == want.keys() and all(got[t] == pytest.approx(want[t]) for t in want)


def test_many_languages_take_blocks(spark, monkeypatch):
    path = langid.piece_path()
    train = spark.createDataFrame([("the old house by the river", "en"), ("das alte haus am fluss", "de"), ("la vieille maison du fleuve", "fr")], "text string, lang string")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["the river", "das haus", "la maison", "x" * 300])], "doc_id long, text string")
    one = {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in langid.predict(rows, langid.fit(train, path), path).collect()}
    monkeypatch.setattr(langid, "LANGS", 1)
    model = langid.fit(train, path)
    assert len(model) == 3 and {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in langid.predict(rows, model, path).collect()} == one


def brute_scores(rows):
    import math
    from collections import Counter

    import re

    cut = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    docs = [cut(r["text"]) for r in rows]
    gram = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    total = Counter(g for w in docs for n in (1, 2, 3) for g in gram(w, n))
    size = sum(map(len, docs))
    out = []
    for w in docs:
        own = Counter(g for n in (1, 2, 3) for g in gram(w, n))
        c = lambda g: total[g] - own[g]
        s = 0.0
        for i in range(len(w)):
            g3, g2, g1 = tuple(w[i - 2 : i + 1]), tuple(w[i - 1 : i + 1]), (w[i],)
            if i >= 2 and c(g3) > 0:
                s += math.log(c(g3) / c(g3[:2]))
            elif i >= 1 and c(g2) > 0:
                s += math.log(c(g2) / c(g2[:1]) * 0.4 ** (min(i, 2) - 1))
            else:
                s += math.log(max(c(g1), 1) / size * 0.4 ** min(i, 2))
        out.append(s / len(w) if w else None)
    return out


def test_backoff_scores(docs, empty):
    rows = docs.collect()
    got = lm_score.score_documents(docs.withColumn("own", F.col("text"))).collect()
    want = {}
    for r, s in zip(rows, brute_scores(rows)):
        want.setdefault((r["doc_id"], r["text"]), s)
    assert len(got) == len(rows)
    for r in got:
        s = want[r["doc_id"], r["own"]]
        assert r["score"] is None if s is None else r["score"] == pytest.approx(s)
    assert lm_score.score_documents(empty).count() == 0


def test_packed_hashes():
    h = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64))
    assert (lm_score.unpack(lm_score.pack(h)) == h).all() and len(lm_score.unpack(lm_score.pack(h[:0]))) == 0


def test_counts_beyond_32_bits():
    import pyarrow as pa

    h = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 3, dtype=np.uint64))
    asked = [(0, part, 1, lm_score.pack(h), lm_score.pack_counts(np.array([1, 3_000_000_000, 7]))) for part in (0, 1)]
    answer = lm_score._answer(pa.table(dict(zip(("bucket", "part", "n", "grams", "counts"), map(list, zip(*asked))))))
    for raw in answer["totals"].to_pylist():
        assert lm_score.unpack_counts(raw).tolist() == [2, 6_000_000_000, 14]
    assert len(lm_score.unpack_counts(lm_score.pack_counts(np.zeros(0, np.int64)))) == 0


def vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist(), 0) for i in range(300)]
    rows += [(300 + i, rows[20][1], 0) for i in range(30)] + [(400, None, 0), (401, [0.0] * 8, 0), (402, [1.0, None] + [0.0] * 6, 0), (403, [float("nan")] * 8, 0), (404, [1.0, 2.0], 0), (None, rows[0][1], 0), rows[40]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, file int")


def brute_nearest(df, k):
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect() if r["vec_id"] is not None and r["vec_id"] < 400}
    return {q: sorted(((-float(v @ rows[q]), i) for i, v in rows.items() if i != q))[:k] for q in rows if q % 20 == 0}


def test_nearest_of_all_files_is_exact(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAST_VISITS", 10**6)
    df = vectors(spark)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute_nearest(df, 5)
    assert got.keys() == want.keys()
    for q, hits in want.items():
        assert [s for _, s in got[q]] == pytest.approx([-s for s, _ in hits])
    assert ann.nearest(df.where("false"), df.where("false"), 5).count() == 0
    assert ann.nearest(df.where("vec_id < 3"), df.where("vec_id = 0"), 5).count() == 2


def test_nearest_prunes(spark, monkeypatch):
    """A file dealt over several parts and sides, and few visits: what is found is exact in score, and recall holds."""
    monkeypatch.setattr(ann, "FILE_ROWS", 40)
    monkeypatch.setattr(ann, "FILE_QUERIES", 3)
    monkeypatch.setattr(ann, "LEAST_VISITS", 24)
    df = vectors(spark)
    found = ann.nearest(df, df.where("vec_id % 20 = 0"), 5).collect()
    want = {q: {i for _, i in hits} for q, hits in brute_nearest(df, 5).items()}
    assert sum(r["vec_id"] in want[r["query_id"]] for r in found) >= 0.9 * 5 * len(want)


def test_nearest_query_recall(spark):
    """op9's own query on a driver table: ranks, order, exact scores and recall at 20 against brute force."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    place, got = {int(v): i for i, v in enumerate(ids)}, {}
    for r in ann.op9_ann(spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
        assert r["score"] == pytest.approx(score[place[r["query_id"]], place[r["vec_id"]]], abs=1e-12)
    assert set(got) == {int(v) for v in ids if v % 20 == 0} and all(sorted(g) == list(range(1, 21)) for g in got.values())
    best = {q: set(ids[np.lexsort((ids, -score[place[q]]))[:20]].tolist()) for q in got}
    assert sum(len(best[q] & set(g.values())) for q, g in got.items()) >= 0.9 * 20 * len(got)


def test_sharding_query(spark):
    """op1's contract on a driver table: sizes, checksums, law, gapless slots and counts at most one apart."""
    sf = "/root/testdata/sf0.001"
    want = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sharding.op1_sharding(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(want)
    slots = {}
    for r in rows:
        raw = (want[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) <= set(range(40)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    counts = [len(slots.get(i, [])) for i in range(40)]
    assert max(counts) - min(counts) <= 1


def test_language_query_accuracy(spark):
    """op5 on a driver table: folds as the contract states them, scores in range, held-out accuracy."""
    sf = "/root/testdata/sf0.01"
    want = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = langid.op5_langid(spark, sf).collect()
    assert len(rows) == len(want) and all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    tested = [r for r in rows if r["held_out"] and want[r["doc_id"]] is not None]
    assert sum(r["lang_pred"] == want[r["doc_id"]] for r in tested) >= 0.99 * len(tested)


def test_bpe_query(spark):
    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    sf = "/root/testdata/sf0.001"
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r["doc_id"]: r for r in bpe.op6_bpe(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode_ordinary(r["text"] or "")
        found = got[r["doc_id"]]
        assert (found["n_tokens"], found["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert found["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_columns_of_clashing_names_survive(docs):
    """Operators that keep the input's columns keep all of them as they are, whatever their names."""
    path = langid.piece_path()
    own = {(r["doc_id"], r["text"]): tuple(r)[2:] for r in docs.collect()}
    for out in (near_dups.keep_one(docs), decontaminate.drop_contaminated(docs, docs.where("false").select(F.col("doc_id").alias("item_id"), "text")), langid.predict(docs, langid.fit(docs, path), path).drop("lang_pred", "score")):
        assert out.columns == docs.columns
        for r in out.collect():
            assert tuple(r)[2:] == own[r["doc_id"], r["text"]]
    scored = lm_score.score_documents(docs).collect()
    assert len(scored) == docs.count() and {r["_text"] for r in scored} == {"t", None}
    sharded = sharding.assign_shards(docs, 3).collect()
    assert {r["_start"] for r in sharded} == {5, None} and len(sharded) == docs.count()
    kept = {(r["doc_id"], r["c0"], r["m0"], r["_part"]) for r in suffix_dedup.dedup_bytes(docs).collect()}
    assert {x[1:] for x in kept if x[0] is not None} == {("c", "m", 1)}
    assert {r["text"] is None for r in suffix_dedup.dedup_bytes(docs.where("text IS NULL")).collect()} == {True}


def test_sorted_runs():
    """Edges of a level and above join the rows of equal prefixes, wherever the sorted rows are cut into ranges."""
    import pyarrow as pa

    rng = random.Random(3)
    rows = sorted((rng.randrange(6), rng.randrange(3) << 8 | rng.randrange(3), i) for i in range(400))
    for cut in (400, 150, 7):
        edges, border = [], {}
        for a in range(0, 400, cut):
            part = rows[a : a + cut]
            batch = pa.record_batch({"key": pa.array([r[0] for r in part], pa.int64()), "deeper": pa.array([r[1] for r in part], pa.int16()), "rep": pa.array([r[2] for r in part], pa.int64())})
            for out in near_dups._runs(iter([batch.slice(0, 3), batch.slice(3)])):
                for r in out.to_pylist():
                    if r["v"] is None:
                        border.setdefault((r["level"], r["key"], r["deeper"]), set()).add(r["u"])
                    else:
                        edges.append((r["u"], r["v"], r["level"]))
        edges += [(u, min(us), k[0]) for k, us in border.items() for u in us if u != min(us)]
        for level in range(near_dups.LEVELS):
            root = {r[2]: r[2] for r in rows}
            for _ in range(400):
                low = dict(root)
                for u, v, at in edges:
                    if at >= level:
                        low[u] = low[v] = min(low[u], low[v])
                if low == root:
                    break
                root = low
            shift = 8 * (near_dups.LEVELS - 1 - level)
            runs = {}
            for key, deeper, i in rows:
                runs.setdefault((key, deeper >> shift if level else 0), []).append(i)
            assert all(root[i] == min(run) for run in runs.values() for i in run), (cut, level)


def test_prefixes_are_shortened_until_the_recall_is_reached():
    assert near_dups.next_level(0, [0.0] * 3, 8, 0.8, 0.99999, 2) == 0  # nothing found proves nothing
    assert near_dups.next_level(10**6, [0.0, 0.1, 0.5], 8, 0.8, 0.99999, 2) is None
    assert near_dups.next_level(10**6, [0.0, 1.0, 900.0], 8, 0.8, 0.99999, 2) == 1
    assert near_dups.next_level(10**6, [0.0, 900.0, 9000.0], 8, 0.8, 0.99999, 2) == 0
    assert near_dups.next_level(10**6, [900.0, 900.0, 9000.0], 8, 0.8, 0.99999, 0) is None


def test_pairs_at_the_threshold_are_found_end_to_end(spark):
    rng = random.Random(12)
    rows = []
    for i in range(1500):
        a = [f"w{rng.randrange(10**9)}" for _ in range(24)]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(a + [f"w{rng.randrange(10**9)}" for _ in range(5 - i % 2)]))]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("class_id = doc_id - doc_id % 2 and n_links = 1").count() == 3000


def test_candidates_without_a_link():
    import pyarrow as pa

    texts = ["a b c d e f g h", "a b c d e x y z"]
    rows = pa.table({"cluster": pa.array([1, 1], pa.int64()), "rep": pa.array([1, 2], pa.int64()), "copies": pa.array([1, 1], pa.int64()), "block": pa.array([0, 0], pa.int32()), "bi": pa.array([0, 0], pa.int32()), "bj": pa.array([0, 0], pa.int32()), "text": texts})
    out = near_dups._verify(4, 5, 8)(rows)
    assert out["found"].to_pylist() == [0, 0] and all(out.schema.field(f"missed{k}").type == pa.float64() for k in range(near_dups.LEVELS))
