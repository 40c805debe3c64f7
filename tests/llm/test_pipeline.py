"""Each stage of the pipeline against a brute-force version, with nulls, empty texts, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re

import pytest

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, Number string, _part string, hit_items string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(["the", "old", "house", "river", "under", "tree", "walks"]) + str(rng.randrange(900)) for _ in range(n))
    texts = {i: say(rng.randrange(30, 80)) for i in range(20)}
    texts[3] = texts[1]
    texts[4] = texts[1] + " end"
    texts[6] = "head " + texts[5][:200] + " tail"
    texts[7] = None
    texts[8] = ""
    texts[9] = "12345 !!!"
    texts[11] = texts[12] + " " + say(40)
    rows = [(i, t, ["en", "fr"][i % 2], "s", len(t) if t is not None else None, i / 2, "own", f"n{i}", "p", "h") for i, t in texts.items()]
    rows += [rows[13], (None, say(30), "en", None, 1, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def sf_dir(spark, docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [(1, " ".join(texts[14].split()[3:20])), (2, None), (3, "..."), (4, texts[15])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    docs.write.parquet(str(path / "documents.parquet"))
    return str(path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def test_language(spark, docs, sf_dir):
    out = pipeline.language(spark, docs, sf_dir)
    assert out.columns == docs.columns
    assert rows(out) == sorted((tuple(r) for r in docs.collect() if re.search(r"[^\W\d_]", r["text"] or "")), key=repr)


def test_near_duplicates(spark, docs, sf_dir):
    own = [r for r in docs.collect() if r["doc_id"] is not None]
    shingles = {r["doc_id"]: {tuple(w[i : i + 5]) for w in [words(r["text"])] for i in range(max(len(w) - 4, min(len(w), 1)))} for r in own}
    near = lambda a, b: shingles[a] and shingles[b] and 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b])
    group = {i: i for i in shingles}
    for _ in shingles:
        for a in shingles:
            group[a] = min([group[b] for b in shingles if a == b or near(a, b)])
    out = pipeline.near_duplicates(spark, docs, sf_dir)
    assert out.columns == docs.columns and any(group[i] != i for i in group)
    assert rows(out) == sorted((tuple(r) for r in docs.collect() if r["doc_id"] is None or group[r["doc_id"]] == r["doc_id"]), key=repr)


def test_repeated_strings(spark, docs, sf_dir):
    got = {(r["doc_id"], r["Number"]): r for r in pipeline.repeated_strings(spark, docs, sf_dir).collect()}
    assert pipeline.repeated_strings(spark, docs, sf_dir).count() == docs.count()
    seen = set()
    for r in sorted({(r["doc_id"], r["text"]): r for r in docs.collect()}.values(), key=lambda r: -1 if r["doc_id"] is None else r["doc_id"]):
        text, gone = r["text"] or "", set()
        for i in range(len(text) - 99):
            if text[i : i + 100] in seen:
                gone |= set(range(i, i + 100))
            seen.add(text[i : i + 100])
        want = None if r["text"] is None else "".join(c for i, c in enumerate(text) if i not in gone)
        found = got[r["doc_id"], r["Number"]]
        assert found["text"] == want and found["n_chars"] == (r["n_chars"] if want is None else len(want))
        assert (found["score"], found["_part"], found["hit_items"]) == (r["score"], r["_part"], r["hit_items"])


def test_benchmark_items(spark, docs, sf_dir):
    items = [words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    def contaminated(text):
        w, hit = words(text), set()
        for it in items:
            m = min(13, len(it))
            for i in range(len(w) - m + 1 if m else 0):
                if any(w[i : i + m] == it[j : j + m] for j in range(len(it) - m + 1)):
                    hit |= set(range(i, i + m))
        return bool(hit) and 20 * len(hit) >= len(w)

    out = pipeline.benchmark_items(spark, docs, sf_dir)
    kept = [r for r in docs.collect() if not contaminated(r["text"])]
    assert out.columns == docs.columns and len(kept) < docs.count()
    assert rows(out) == sorted((tuple(r) for r in kept), key=repr)


def test_token_ids(spark, docs, sf_dir):
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    from engram.llm.bpe import read_ranks

    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=read_ranks(tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = []
    for r in docs.collect():
        ids = library.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert rows(pipeline.token_ids(spark, docs, sf_dir)) == sorted(want, key=repr)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_empty_table(spark, docs, sf_dir, name):
    assert dict(pipeline.STAGES)[name](spark, docs.where("false"), sf_dir).count() == 0


def test_run_is_the_stages_one_after_the_other(spark, docs, sf_dir):
    want = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(pipeline.STAGES):
        want = stage(spark, want, sf_dir)
        want = spark.createDataFrame(want.collect(), want.schema)
    assert rows(pipeline.run(spark, sf_dir)) == rows(want)
    assert set(want.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
