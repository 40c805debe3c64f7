"""Joins, clusters, searches, folds and counts against brute force on small tables with hot keys, nulls and ties."""

import random
import re
from datetime import datetime, timedelta
from itertools import combinations
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.operators import evaluation as ev
from engram.operators import folds, joins, lexical, logs, scenarios, vector
from engram.operators import lifecycle as lc
from engram.plans import governance
from engram.plans.streams import folder

T0 = datetime(2024, 1, 1)


def sessions(rng, n, common):
    return [(i, T0 + timedelta(hours=rng.randrange(0, 900) if i % 5 else 100), [f"hot{k}" for k in range(common)] + [f"w{rng.randrange(60 if common else 20)}" for _ in range(rng.randrange(0, 12))]) for i in range(n)]


@pytest.mark.parametrize("common", [0, 4])
def test_session_links_with_hot_words(spark, common):
    rows = sessions(random.Random(1), 60, common)
    want = set()
    for (i, a, v), (j, b, w) in combinations(rows, 2):
        later, earlier = (i, j) if (a, i) > (b, j) else (j, i)
        if abs(a - b) <= timedelta(hours=168) and len(set(v) & set(w)) >= 5:
            want.add((later, earlier, len(set(v) & set(w)), round(abs((a - b).total_seconds()) / 3600, 3)))
    df = spark.createDataFrame([*rows, (99, T0, None), (98, T0, [])], "id long, ts timestamp, vocabulary array<string>")
    got = {tuple(r)[:4] for r in joins.link_sessions(df).collect()}
    assert got == want and want


def test_words_of_every_session_make_no_pairs(spark):
    """Sessions that share just the four most frequent words never meet: nothing leaves the join."""
    rows = [(i, T0, ["a", "b", "c", "d", f"own{i}", f"other{i}"]) for i in range(300)]
    df = joins.link_sessions(spark.createDataFrame(rows, "id long, ts timestamp, vocabulary array<string>"))
    assert df.count() == 0
    assert "CartesianProduct" not in df._jdf.queryExecution().toString()


@pytest.mark.parametrize("block", [4, 512])
def test_session_links_of_crowded_cells(spark, monkeypatch, block):
    """Crowded cells are cut into blocks; sessions of one time, before 1970 and exactly at the reach are linked as pair by pair. No words travel for a pair."""
    monkeypatch.setattr(joins, "BLOCK", block)
    rng = random.Random(5)
    hot = [(i, T0 + timedelta(hours=rng.randrange(0, 200)), [f"w{rng.randrange(30)}" for _ in range(12)] + ["a", "b", "c"]) for i in range(50)]
    thin = [(100 + i, datetime(1969, 12, 1) + timedelta(hours=84 * i), [f"w{k}" for k in range(i % 3, 8)]) for i in range(20)]
    long = [(200 + i, T0 + timedelta(hours=1000), [f"long{k}" for k in range(6000)]) for i in range(2)]
    rows, want = [*hot, *thin, *long], set()
    for (i, a, v), (j, b, w) in combinations(rows, 2):
        later, earlier = (i, j) if (a, i) > (b, j) else (j, i)
        if abs(a - b) <= timedelta(hours=168) and len(set(v) & set(w)) >= 5:
            want.add((later, earlier, len(set(v) & set(w)), round(abs((a - b).total_seconds()) / 3600, 3)))
    df = joins.link_sessions(spark.createDataFrame(rows, "id long, ts timestamp, vocabulary array<string>"))
    got = [tuple(r)[:4] for r in df.collect()]
    assert sorted(got) == sorted(want) and (201, 200, 6000, 0.0) in want and any(s < 120 and h == 168.0 for s, _, _, h in want)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and ("source_id" in x or "target_id" in x)]


def test_sessions_and_links_are_made_once_to_be_stored(spark, sf, monkeypatch):
    """Each of gr11's three calls reads stored sessions and links and makes neither of them again."""
    seen, real = [], governance.gr.link_and_store
    monkeypatch.setattr(governance.gr, "link_and_store", lambda s, e, *a, **b: seen.extend([s, e]) or real(s, e, *a, **b))
    governance.gr11(spark, sf)
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in seen]
    assert len(plans) == 6 and all("Relation" in x and "Aggregate" not in x and "Join" not in x and "CoGroup" not in x for x in plans)


def test_co_work_equals_pairs_of_sessions(spark):
    rng = random.Random(2)
    rows = [(i, T0 + timedelta(minutes=rng.randrange(0, 60 * 400)), rng.randrange(8)) for i in range(25)] + [(50, T0, 20), (51, T0 + timedelta(hours=900), 21)]
    links = [(i, e) for i, _, e in rows] + [(i, e + 9) for i, _, e in rows if i % 3 == 0]
    at = {i: t for i, t, _ in rows}
    want = {(min(a, b), max(a, b)) for (i, a) in links for (j, b) in links if i != j and a != b and abs(at[i] - at[j]) <= timedelta(hours=48)}
    s = spark.createDataFrame([(i, t) for i, t, _ in rows], "id long, ts timestamp")
    got = joins.co_work(s, spark.createDataFrame([*links, (1, None)], "id long, entity long"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    one = spark.createDataFrame([(1, 5), (1, 6)], "id long, entity long")  # two entities of one session only
    assert joins.co_work(s, one).count() == 0


def memories():
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(20)) for _ in range(6)]
    rows = [(i, "ab"[i % 2], T0 + timedelta(hours=rng.randrange(0, 120)), base[rng.randrange(6)] + f" extra{i % 3}") for i in range(60)]
    return rows + [(100, "a", T0, ""), (101, "a", T0, None), (102, None, T0, base[0]), (103, "a", None, base[0]), (104, "a", T0 + timedelta(hours=3), "line\nbreak " + "x" * 300)]


def test_memory_clusters_equal_brute_force(spark):
    rows = memories()
    kept = {i: (p, t, c or "") for i, p, t, c in rows if p is not None and t is not None}
    root = {i: i for i in kept}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(sorted(kept), 2):
        (p, t, c), (q, u, d) = kept[i], kept[j]
        a, b = set(c.lower().split()), set(d.lower().split())
        if p == q and abs(t - u) <= timedelta(hours=24) and a and b and len(a & b) / len(a | b) >= 0.75:
            root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in kept:
        groups.setdefault(find(i), []).append(i)
    df = spark.createDataFrame(rows, "id long, project string, ts timestamp, content string")
    got = {r["cluster"]: r for r in scenarios.memory_clusters(df).collect()}
    assert set(got) == set(groups)
    for k, own in groups.items():
        newest = sorted(own, key=lambda i: (-kept[i][1].timestamp(), i))
        r = got[k]
        assert (r["size"], r["snippets"]) == (len(own), [None if kept[i][2] == "" and i == 101 else kept[i][2][:200].replace("\n", " ") for i in newest[:3] if i != 101 or True][:3])
        assert r["name"] == "Scene " + min(kept[i][1] for i in own).strftime("%Y-%m-%d %H:%M UTC") and r["latest"] == kept[newest[0]][1].strftime("%Y-%m-%d %H:%M UTC")
    for p in "ab":
        places = sorted((r for r in got.values() if r["project"] == p), key=lambda r: r["place"])
        assert [r["place"] for r in places] == list(range(len(places))) and [r["latest"] for r in places] == sorted((r["latest"] for r in places), reverse=True)
    assert scenarios.memory_clusters(df.where("false")).count() == 0


@pytest.mark.parametrize("many", [0, 1 << 20])
def test_near_duplicate_clusters_equal_brute_force(spark, monkeypatch, many):
    """Sets of 1 to 3000 words at and beside the threshold, copies, chains, several blocks and rounds."""
    monkeypatch.setattr(joins, "MANY", many)
    monkeypatch.setattr(joins, "LEAST_ROWS", 8)
    rng, rows = random.Random(8), []
    for base in (1, 4, 20, 63, 64, 100, 130, 300, 1000, 3000):
        words = [f"b{base}x{k}" for k in range(base)]
        for c in range(12):
            gone = rng.randrange(0, base // 3 + 1)
            rows.append((len(rows), "pq"[c % 2], 0.5, " ".join(rng.sample(words, base - gone) + [f"o{len(rows)}x{k}" for k in range(rng.choice([0, gone, base // 8]))])))
    rows += [(len(rows) + k, "p", 0.5, " ".join(f"c{j}" for j in range(4 * k, 4 * k + 30))) for k in range(20)]  # a chain: neighbours share 26 of 30
    rows += [(len(rows) + 50 + k, rows[k][1], 0.1, rows[k][3].upper()) for k in range(0, 60, 7)] + [(900, "p", 0.1, " "), (901, "p", 0.1, None)]
    sets = {i: (p, set(t.lower().split())) for i, p, _, t in rows if t and t.strip()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(sorted(sets), 2):
        (p, a), (q, b) = sets[i], sets[j]
        if p == q and len(a & b) / max(len(a), len(b)) >= 0.75:
            root[max(find(i), find(j))] = min(find(i), find(j))
    df = spark.createDataFrame(rows, "id long, project string, confidence double, text string")
    got = {r["id"]: r["cluster"] for r in joins.near_duplicate_clusters(df, 0.75).collect()}
    assert got == {i: find(i) for i in sets} and 20 < len(set(got.values())) < len(got) - 40


def test_clusters_don_t_compare_all_pairs_of_a_group(spark, sf, monkeypatch):
    """Words travel for about a pair a member of a large group of near copies, not for all its pairs; ag23 makes no such pairs."""
    rows = [(i, "p", 0.5, " ".join([f"w{k}" for k in range(40)] + [f"own{i}"])) for i in range(120)]
    seen, real = [], joins._verified
    monkeypatch.setattr(joins, "_verified", lambda pairs, *a: seen.append(pairs.count()) or real(pairs, *a))
    monkeypatch.setattr(joins, "MANY", 200)
    got = joins.near_duplicate_clusters(spark.createDataFrame(rows, "id long, project string, confidence double, text string"), 0.75).collect()
    assert {r["cluster"] for r in got} == {0} and len(got) == 120 and sum(seen) <= 240
    monkeypatch.setattr(joins, "near_duplicate_classes", None)
    governance.ag23(spark, sf)
    assert len(seen) > 1


def test_block_summaries(spark):
    blocks = spark.createDataFrame([("p", 0, "First one\n\nalpha beta\nc\nd\ne\nf"), ("p", 1, "Second\nALPHAbet gamma"), ("p", 2, "Third gamma alpha"), ("q", 0, " \n "), ("p", None, "x"), ("p", 3, None)], "project string, position long, content string")
    queries = spark.createDataFrame([(1, "p", "gamma alphab"), (2, "p", ""), (3, "p", None), (4, "p", "zeta"), (5, "none", "alpha"), (6, "q", "alpha"), (7, "p", "GAMMA alpha alpha")], "query_id long, project string, text string")
    got = {r["query_id"]: (r["position"], r["score"], r["summary"]) for r in scenarios.block_summaries(blocks, queries).collect()}
    first = (0, 0, "## First one\nalpha beta\nc\nd")
    assert got == {1: (1, 2, "## Second\nALPHAbet gamma"), 2: first, 3: first, 4: first, 6: (0, 0, "## Scenario\n"), 7: (1, 2, "## Second\nALPHAbet gamma")}
    with_text = {r["query_id"]: r["summary"] for r in scenarios.block_summaries(blocks, queries, spark.createDataFrame([("none", "Persona"), ("q", "Other")], "project string, text string")).collect()}
    assert with_text[5] == "Persona" and with_text[6] == "Other\n\n## Scenario\n" and with_text[1] == got[1][2]
    assert scenarios.best_blocks(blocks, queries.where("false")).count() == 0
    plan = scenarios.block_summaries(blocks, queries)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def vectors(n=400):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).tolist(), None if i % 11 == 0 else [] if i % 13 == 0 else [f"g{i % 3}"]) for i in range(n)]
    rows += [(n + i, rows[7][1], ["g1"]) for i in range(n // 2)]  # a third are copies
    return rows + [(900, None, ["g0"]), (901, [0.0] * 16, ["g0"]), (902, [1.0], ["g0"]), (None, rows[0][1], ["g0"])]


def nearest(rows, q, k, who=None):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    own = {i: (unit(v), a) for i, v, a in rows if i is not None and i < 900}
    seen = [(-round(float(v @ own[q][0]), 9), i) for i, (v, a) in own.items() if i != q and (who is None or (a and set(a) & set(who)))]
    return [i for _, i in sorted(seen)[:k]]


@pytest.mark.parametrize("who", [None, ["g1", "g2"], []])
def test_exact_searches_equal_brute_force(spark, who):
    rows = vectors()
    df = spark.createDataFrame(rows, "id long, embedding array<double>, acl array<string>")
    q = df.where("id % 40 = 0 AND id < 900").select(F.col("id").alias("query_id"), "embedding")
    found = {}
    if who is None:
        answers = [vector.cluster_search(df, q, 10), vector.cluster_search(df, q, 10, clusters=1), vector.lsh_search(df.drop("acl"), q, 10, exact=True)]
    else:
        answers = [vector.lsh_search(df, q.withColumn("principals", F.array(*[F.lit(w) for w in who]).cast("array<string>")), 10, exact=True)]
    for answer in answers:
        found = {}
        for r in answer.orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append(r["id"])
        for i in range(0, 600, 40):
            assert found.get(i, []) == nearest(rows, i, 10, who)
    assert vector.lsh_search(df.where("false"), q, 10).count() == 0 and vector.cluster_search(df.where("false"), q, 10).count() == 0


def test_index_search_recall_and_work(spark):
    """At sf0.1 a query scores under a tenth of the vectors and finds 95 of 100 neighbours."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    rows = e.collect()
    ids, x = np.array([r["id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    place = {int(i): p for p, i in enumerate(ids)}
    got = vector.lsh_search(e, e.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding"), 10, counted=True).collect()
    hits, met = 0, {}
    for q in {r["query_id"] for r in got}:
        score = x @ x[place[q]]
        score[place[q]] = -2
        best = set(ids[np.argsort(-score, kind="stable")[:10]].tolist())
        own = [r for r in got if r["query_id"] == q]
        hits += len(best & {r["id"] for r in own})
        met[q] = own[0]["met"]
    assert len(met) == sum(ids % 20 == 0) and hits >= 0.95 * 10 * len(met) and np.mean(list(met.values())) <= 0.1 * len(ids)


def test_chunk_boundaries_are_bounded(spark):
    rows = [("s", i, [1.0, 0.0] if i < 3 else [0.0, 1.0], [f"E{i}", f" e{i} ", "", None, f"x{i % 2}"], i / 10) for i in range(8)] + [("t", 0, None, None, 0.5), ("t", 1, [1.0], ["A"], None)]
    df = spark.createDataFrame(rows, "stream string, pos long, embedding array<double>, entities array<string>, score double")
    got = {(r["stream"], r["pos"]): r for r in folds.chunk_boundaries(df, "stream", "pos", most=3).collect()}
    assert got["s", 7]["entities_kept"] == ["E7", "x1", "E6"] and got["s", 0]["entities_kept"] == ["E0", "x0"]
    assert [got["s", i]["drift"] for i in range(8)] == [False, False, False, True, False, False, False, False][:3] + [got["s", i]["drift"] for i in range(3, 8)] and got["s", 3]["drift"]
    assert got["s", 7]["decay"] == pytest.approx(0.95**8) and got["s", 7]["score_max"] == 0.7 and got["t", 0]["topic"] is None and ("t", 1) not in got


def test_bootstrap_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(5)
    rows = [("g", i, float(x)) for i, x in enumerate(rng.normal(3, 1, 300))] + [("one", 0, 2.0), (None, 0, 1.0), ("g", 1000, None)]
    df = spark.createDataFrame(rows, "grp string, key long, x double")
    a, b = ({r["grp"]: (r["n"], round(r["mean"], 9), round(r["low"], 9), round(r["high"], 9)) for r in ev.bootstrap_sums(df.repartition(n), resamples=2000).collect()} for n in (1, 40))
    assert a == b and a["one"] == (1, 2.0, 2.0, 2.0) and a[None] == (1, 1.0, 1.0, 1.0)
    n, mean, low, high = a["g"]
    assert n == 300 and low < mean < high and high - low == pytest.approx(2 * 1.96 / np.sqrt(300), rel=0.2)
    w = ev.draws(np.arange(-500, 500), 7, 200)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03


def test_backfill_of_lines_is_idempotent(spark):
    lines = ['{"a":1}', "{}", "not json", "", "[1]", '{"acl_allow":["x"],"classification":"public"}', '{"acl_allow":["x"]}', '{"classification":null,"b":"acl_allow"}', "12", '{"a":{"acl_allow":1}}']
    once = {r["value"]: (r["line"], r["outcome"]) for r in lc.backfill_lines(spark.createDataFrame([(x,) for x in lines], "value string"), ["team"], "internal").collect()}
    assert {x: o for x, (_, o) in once.items()} == dict(zip(lines, ["filled", "filled", "malformed", "malformed", "malformed", "kept", "filled", "filled", "malformed", "filled"]))
    assert all(line == x for x, (line, o) in once.items() if o != "filled")
    again = lc.backfill_lines(spark.createDataFrame([(line,) for line, o in once.values() if o == "filled"], "value string"), ["team"], "internal").collect()
    assert {r["outcome"] for r in again} == {"kept"}
    assert once['{"acl_allow":["x"]}'][0] == '{"acl_allow":["x"],"classification":"internal"}'


def test_counts_of_what_is_dropped(spark):
    pool = spark.createDataFrame([(1, 1, 0.9, 5), (1, 2, 0.2, 5), (2, 3, 0.9, 1), (2, 4, None, 9)], "query_id long, id long, score double, lex long")
    rows, counts = logs.gated(pool, {"near": F.col("score") >= 0.5, "lexical": F.col("lex") >= 3}, folder(spark))
    assert counts == {"entered": 4, "near": 2, "lexical": 1, "returned": 3, "fallback": 2} and sorted(r["id"] for r in rows.collect()) == [1, 3, 4]
    acl = spark.createDataFrame([(1, ["bob"]), (2, None), (3, []), (4, ["eve"])], "id long, acl array<string>")
    kept, leaks, counts = logs.verified(acl, "acl", ["bob"], folder(spark))
    assert sorted(r["id"] for r in kept.collect()) == [1, 2] and sorted(r["id"] for r in leaks.collect()) == [3, 4] and counts == {"checked": 4, "open": 1, "leaked": 2}
    said = spark.createDataFrame([(1, 0, "user", "please do this long thing"), (1, 1, "user", " Please do this  long thing"), (1, 2, "assistant", "x" * 50), (1, 3, "user", "no"), (1, 4, None, None)], "conv_id long, turn long, role string, text string")
    prompts, counts = logs.mined(said, 10, folder(spark))
    assert prompts.count() == 1 and counts == {"messages": 5, "other_role": 2, "too_short": 1, "wrapper": 0, "candidates": 2, "kept": 1, "duplicates": 1}


@pytest.mark.parametrize("terms", [500_000, 3])
def test_session_relevance(spark, monkeypatch, terms):
    """One tag and one word stand in every block and task; with few broadcast rows and with salts."""
    monkeypatch.setattr(lexical, "QUERY_TERMS", terms)
    rng = random.Random(29)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "Omega"])
    blocks = [(i, ["Hot", *{word() for _ in range(i % 3)}], f"common {word()} {word()}") for i in range(120)] + [(120, None, None), (121, [], ""), (122, ["hot", "HOT"], None), (123, None, "common beta beta")]
    tasks = [(i, f"common hot {word()} {word()}") for i in range(12)] + [(12, None), (13, ""), (14, "nothing")]
    got = lexical.session_relevance(spark.createDataFrame(blocks, "id long, tags array<string>, content string"), spark.createDataFrame(tasks, "task_id long, task string"))
    assert "Cartesian" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan
    want = {}
    for t, task in tasks:
        asked = set((task or "").lower().split())
        for b, tags, content in blocks:
            own, held = {x.lower() for x in tags or []}, set((content or "").lower().split())
            if own & asked or held & asked:
                want[t, b] = round(0.6 * (len(own & asked) / len(own) if own else 0) + 0.4 * (len(held & asked) / len(asked) if asked else 0), 6)
    assert {(r["task_id"], r["id"]): r["score"] for r in got.collect()} == pytest.approx(want)


@pytest.mark.parametrize(("master", "named", "ok"), [("local[4]", None, True), ("local", None, True), ("local-cluster[2,1,1024]", None, False), ("spark://host:7077", None, False), ("yarn", "/shared/cut", True)])
def test_shared_folder_on_a_cluster(master, named, ok):
    """A machine's own folder serves a local session alone."""
    state = {"dir": None}
    sc = SimpleNamespace(master=master, getCheckpointDir=lambda: state["dir"], setCheckpointDir=lambda d: state.update(dir=d))
    session = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda key, default: named))
    if ok:
        assert joins.shared_folder(session, "x").startswith(f"{named or state['dir']}/x-")
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            joins.shared_folder(session, "x")


def test_near_duplicates_meet_by_class_and_none_is_lost(spark):
    import random

    from engram.operators import joins as jn

    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    sets = [rng.sample(words, rng.randint(1, 40)) for _ in range(40)]
    for s in sets[:25]:  # near ones of all sizes
        t = list(s)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice(words)
        sets += [t, s[::-1]]
    rows = [(i, rng.choice("ab"), rng.choice([0.1, 0.5, None]), " ".join(s)) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "id long, project string, confidence double, text string")
    for threshold in (0.4, 0.75, 0.92):
        want, lost = {}, set()
        for i, p, c, t in rows:
            for j, q, d, u in rows:
                a, b = set(t.split()), set(u.split())
                if i < j and p == q and len(a & b) / max(len(a), len(b)) >= threshold:
                    won = j if c is not None and d is not None and d > c else i
                    want[i, j] = (round(len(a & b) / max(len(a), len(b)), 9), won)
                    lost.add(i + j - won)
        got = {(r["id"], r["id2"]): (round(r["similarity"], 9), r["winner"]) for r in jn.near_duplicate_pairs(df, threshold).collect()}
        assert got == want
        assert {r["id"] for r in jn.near_duplicate_losers(df, threshold).collect()} == lost


def test_copies_make_no_candidates_and_a_common_rare_word_none_either(spark):
    from engram.operators import joins as jn

    text = " ".join(f"a{i}" for i in range(64))
    rows = [(i, "p", 0.5, text) for i in range(50)] + [(100 + i, "p", 0.5, " ".join(["rare"] + [f"b{i}x{j}" for j in range(63)])) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, project string, confidence double, text string")
    members, links = jn.near_duplicate_classes(df, 0.75)
    assert members.where("class = 0").count() == 50 and links.count() == 0
    assert jn._prefix_pairs(df.selectExpr("id", "project", "split(text, ' ') AS w").where("id >= 100"), 0.75).count() == 0  # one common word of 64 is too few


def test_scores_are_summed_in_parts_that_grow_with_the_pairs(spark, monkeypatch):
    from engram.operators import lexical as lx

    docs = spark.createDataFrame([(i, f"common word{i % 7}") for i in range(300)], "id long, text string")
    terms = lx.query_terms(spark.createDataFrame([(q, f"common word{q}") for q in range(5)], "query_id long, text string"), "query_id", "text")
    tok = lx.tokens(docs, "id", "text")
    want = sorted(map(tuple, lx.bm25(tok, terms).collect()))
    monkeypatch.setattr(lx, "TASK_PAIRS", 100)
    out = lx.bm25(tok, terms)
    assert out.rdd.getNumPartitions() == 16 and [r[:2] for r in sorted(map(tuple, out.collect()))] == [r[:2] for r in want]  # 1 + 300 x 5 pairs / 100


@pytest.mark.parametrize("name", ["rk15_reciprocal_rank_fusion", "rk16_two_list_fusion", "rk17_linear_blend", "rk18_layer_blend", "rk28_cached_hybrid"])
def test_fused_lists_are_scored_in_parts_that_grow_with_the_pairs(spark, sf, monkeypatch, name):
    """Both lists of a fusion deal the documents into a part for each TASK_PAIRS pairs, and a part sends on no more than a query's best 20."""
    from engram.operators import lexical as lx
    from engram.plans import catalog
    from engram.plans.registry import table

    pairs = table(spark, sf, "documents").count() * table(spark, sf, "benchmark").count()
    monkeypatch.setattr(lx, "TASK_PAIRS", pairs // 40)
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "REPARTITION_BY_NUM" in x]
    assert len(dealt) >= 2 and all(re.search(r"hashpartitioning\(id#\d+L, 4[0-2]\)", x) for x in dealt)
    limits = [x for x in plan.splitlines() if "WindowGroupLimit" in x and "Partial" in x]
    assert len([x for x in limits if " 20, Partial" in x]) >= 2


def test_vector_searches_hold_a_few_queries_scores_at_once(spark, monkeypatch):
    import numpy as np

    from engram.operators import vector as ve

    x = np.random.default_rng(5).normal(size=(400, 8))
    e = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<double>")
    q = e.withColumnRenamed("id", "query_id")
    monkeypatch.setattr(ve, "CHUNK", 7)
    monkeypatch.setattr(ve, "ASKED", 50)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -9)
    want = {(i, int(j)) for i in range(400) for j in np.argsort(-s[i])[:3]}
    for found in (ve.vector_topk(e, q, 3), ve.cluster_search(e, q, 3)):
        assert {(r["query_id"], r["id"]) for r in found.collect()} == want


def test_patterns_are_tried_only_where_a_match_can_be(spark):
    import re
    import time

    from engram.operators import extraction as ex

    assert all(p in ex.NEEDED for p in (*ex.PROSE, *ex.NEGATIVE) if p.startswith("(?i)(.{"))
    said = ["The old cache failed due to memory", "This setup of ours DIDN'T WORK BECAUSE it was slow", "The parser doesn't support comments", "This thing is incompatible with version two", "The retry loop causes a timeout error", "Every import hits the rate limit.",
            "The whole build stopped working because of it.", "The upgrade of it led to a new crash.", "The nightly run breaks when it rains."]
    rows = [(i, t) for i, t in enumerate(said)] + [(100, None), (101, "")]
    got = {(r["d"], r["what"]) for r in ex.negatives(spark.createDataFrame(rows, "d long, t string"), "d", "t").collect()}
    want = {(i, m[1].strip()) for i, t in enumerate(said) for p in ex.NEGATIVE for m in re.finditer(p.replace("[Tt]", "t"), t)}
    assert got == want and {i for i, _ in got} == set(range(9))
    long = spark.createDataFrame([(0, "lorem ipsum " * 60_000)], "d long, t string")
    start = time.time()
    assert ex.negatives(long, "d", "t").count() == 0
    assert time.time() - start < 10


def test_named_projects_lower_a_text_once(spark):
    from pyspark.sql import functions as F

    from engram.functions import text as tx

    df = spark.createDataFrame([("We use ENGRAM and Café-x",), (None,)], "t string")
    slugs = F.array(F.lit("engram"), F.lit("Café-X"), F.lit("use"), F.lit("other"))
    out = df.select(tx.projects_named(F.col("t"), slugs).alias("p"))
    assert [r["p"] for r in out.collect()] == [["engram", "Café-X"], []]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "contains(lower(t" not in plan


def test_compaction_moves_places_and_not_texts(spark):
    from engram.operators.compaction import compact

    s = spark.createDataFrame([(1, "alpha one\n\nbeta two\nmore\n\nalpha beta three\n\nnone here"), (2, "  "), (3, None)], "session long, content string")
    t = spark.createDataFrame([(7, "alpha beta"), (8, "zulu")], "task_id long, task string")
    got = lambda p: {(r["task_id"], r["session"]): r["text"] for r in compact(s, t, p).collect()}
    assert got(1) == {(k, 1): "alpha one\n\nbeta two\nmore\n\nalpha beta three\n\nnone here" for k in (7, 8)}
    assert got(0.5) == {(7, 1): "alpha one\n\nbeta two\nmore\n\nalpha beta three"}
    assert got(0) == {(7, 1): "[summary] alpha one\n\n[summary] beta two\n\n[summary] alpha beta three"}
    plan = compact(s, t, 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(i, i" in plan and "whole" in plan.split("collect_list(")[1].split(")")[0]


@pytest.mark.parametrize("terms", [3, 500_000])
def test_compaction_deals_sections_once(spark, monkeypatch, terms):
    """Whatever the tasks, the sections are all that is shuffled, once; tasks of more words than a broadcast holds come in groups. Against brute force, with ties and repeated sections."""
    from engram.operators import compaction

    monkeypatch.setattr(compaction, "QUERY_TERMS", terms)
    rng, names = random.Random(4), [f"word{k}" for k in range(12)]
    sections = {i: [" ".join(rng.choices(names, k=rng.randrange(1, 5))) if rng.random() < 0.7 else f"none of {i}" for _ in range(rng.randrange(1, 14))] for i in range(25)}
    tasks = {k: " ".join(rng.choices(names, k=4)) for k in range(9)}
    want = {}
    for (i, own), (k, t) in ((x, y) for x in sections.items() for y in tasks.items()):
        asked = set(t.split())
        score = [len(asked & set(s.split())) / len(asked) for s in own]
        high, mid = (sorted(score)[int(len(own) * p)] for p in (0.5, 0.3))
        kept = [s if x >= high else f"[summary] {s}" for s, x in zip(own, score) if x > 0 and x >= mid]
        if kept:
            want[k, i] = "\n\n".join(kept)
    df = compaction.compact(spark.createDataFrame([(i, "\n\n".join(own)) for i, own in sections.items()] + [(None, "word1")], "session long, content string"), spark.createDataFrame(list(tasks.items()), "task_id long, task string"), 0.5)
    assert {(r["task_id"], r["session"]): r["text"] for r in df.collect()} == want
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    dealt = set(re.findall(r"Exchange (\w+\(\w+).*plan_id=(\d+)", final.replace("BroadcastExchange", "")))
    assert [x for x, _ in dealt] == ["hashpartitioning(session"]


def test_a_greedy_fit_reads_no_other_columns(spark):
    from engram.operators import folds

    rows = spark.createDataFrame([("g", i, 4, "text" * 50) for i in range(5)], "g string, id long, size long, text string")
    out = folds.greedy_fit(rows, "g", "size", 9, [], "id")
    assert sorted(r["id"] for r in out.collect()) == [0, 1]
    assert all("LogicalRDD" in line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "text" in line)


def test_a_window_of_exports_is_not_read_again_for_each_row(monkeypatch):
    import json
    import time

    from engram.streaming import stateful as st

    class Kept:
        def where(self, _):
            return self

    steps = []
    monkeypatch.setattr(st, "ordered_fold", lambda events, key, read, start, step, *rest: steps.append(step) or Kept())
    st.export_alerts(None, "k", 100, 2, 3)
    state, seen = [], []
    for i, second in enumerate([0, 0, 3, 50, 100, 101, 151, 400, 401]):
        p = None if i == 3 else f"p{i % 3}"
        seen.append((second, p))
        state, out = steps[0](json.loads(json.dumps(state)), [[second * 1_000_000, i, p]])
        near = [x for x in seen if second - x[0] <= 100]
        n, projects = len(near), len({x for _, x in near if x is not None})
        assert out == [(n, projects, n > 2, projects >= 3)]
    st.export_alerts(None, "k", 1_000_000, 2, 3)
    state, start = [], time.time()
    for i in range(20_000):
        state, _ = steps[1](state, [[i * 1_000_000, i, "p"]])
    assert time.time() - start < 3
