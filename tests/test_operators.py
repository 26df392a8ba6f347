"""Operators on small tables, with the properties that should hold for any."""

import random
from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import block, evaluate, feedback, fuse, ledger, survive, taste, triage
from tessera.operators.triage import fold_run, judge_by_words


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_rrf_order_and_permutation(spark):
    data = [("a", 0, 0), ("b", 1, 0), ("c", 2, 0), ("b", 0, 1), ("a", 1, 1), ("b", 0, 2)]
    results = []
    for seed in range(3):
        shuffled = random.Random(seed).sample(data, len(data))
        df = spark.createDataFrame([(u, r, i, r) for u, r, i in shuffled], "url string, rank int, list_idx int, pos int").repartition(3)
        fused = fuse.fused_order(fuse.rrf(df, ["url"]), [])
        results.append([(r["url"], round(r["score"], 12)) for r in fused.orderBy("place").collect()])
    assert [u for u, _ in results[0]] == ["b", "a", "c"] and results[0] == results[1] == results[2]


def test_block_join_equals_predicate(spark):
    rng = random.Random(3)
    make = lambda n: [(i, rng.choice(["x", "y", None]), rng.choice([None, rng.randrange(5 * 86400)])) for i in range(n)]
    left, right = make(60), make(80)
    want = sorted((a[0], b[0]) for a in left for b in right if (a[1] is None or b[1] is None or a[1] == b[1]) and (a[2] is None or b[2] is None or abs(a[2] - b[2]) <= 86400))
    schema = "id int, city string, at bigint"
    got = block.block_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema))
    assert rows(got, "l_id", "r_id") == want


@pytest.mark.parametrize("days", [0, 1, 2])
def test_block_sizes_are_those_of_the_join(spark, days):
    rng = random.Random(days)
    make = lambda n: [(i, rng.choice(["x", "y", "", None]), rng.choice([None, *(rng.randrange(-3, 7) * 43200 + rng.randrange(2) for _ in range(4))])) for i in range(n)]
    left, right = make(120), make(200)
    schema = "id int, city string, at bigint"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    want = {}
    for x in left:
        n = sum((x[1] is None or y[1] is None or x[1] == y[1]) and (x[2] is None or y[2] is None or abs(x[2] - y[2]) <= days * 86400) for y in right)
        want[x[1:]] = want.get(x[1:], 0) + n
    got = block.block_sizes(a, b, days)
    assert {(r["city"], r["at"]): r["pairs"] for r in got.collect()} == want
    # A million rows on either side make 10 ** 12 pairs, which are counted and not made.
    many = spark.range(1_000_000).selectExpr("id", "cast(null as string) AS city", "id % 7 AS at")
    assert block.block_sizes(many, many, days).agg(F.sum("pairs")).first()[0] == (10**12 if days else sum(len(range(r, 10**6, 7)) ** 2 for r in range(7)))


def test_block_edges(spark):
    schema = "id int, city string, at bigint"
    a = spark.createDataFrame([(1, "x", 86400)], schema)
    b = spark.createDataFrame([(i, "x", t) for i, t in enumerate((0, 2 * 86400, 2 * 86400 + 1))], schema)
    assert rows(block.block_join(a, b), "r_id") == [(0,), (1,)]


def test_knn(spark):
    vectors = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.8, 0.6]), (4, None), (5, [0.0, 0.0])]
    df = spark.createDataFrame(vectors, "vec_id bigint, v array<double>")
    got = block.knn(df.filter("vec_id = 0"), df, "vec_id", "v", 3)
    assert [(r["id"], r["similarity"]) for r in got.orderBy("knn_pos").collect()] == [(1, 1.0), (3, 0.8), (2, 0.0)]


def _c(i, vec, url=None, city=None, start=None, venue=None, title="t"):
    return {"id": i, "url": url or f"http://x/{i}", "title": title, "description": "", "city": city, "venue": venue, "starts_at": start, "price": None, "embedding": vec}


T0, T1 = datetime(2026, 7, 1, 20), datetime(2026, 7, 1, 21)
CASES = [
    ([_c("1", [1, 0], "u"), _c("2", [0, 1], "u")], True, "auto_merge", 1.0),
    ([_c("1", [1, 0], title="a"), _c("2", [1, 0], title="b")], True, "auto_merge", 1.0),
    ([_c("1", [1, 0], venue="Hall", start=T0, title="a"), _c("2", [0, 1], venue=" hall", start=T0, title="b")], True, "tiebreak", 0.0),
    ([_c("1", [1, 0], venue="Hall", start=T0, title="a"), _c("2", [0, 1], venue="Hall", start=T1, title="b")], True, "insert_new", 0.0),
    ([_c("1", [1, 0], title="a"), _c("2", [0.8, 0.6], title="b")], False, "tiebreak", 0.8),
    ([_c("1", [1, 0], title="a"), _c("2", [0, 1], title="b")], True, "insert_new", 0.0),
    ([_c("1", [1, 0], city="Berlin"), _c("2", [1, 0], city="Paris")], True, "insert_new", None),
]


@pytest.mark.parametrize("candidates,verdict,decision,similarity", CASES)
def test_fold(candidates, verdict, decision, similarity):
    last = outcomes(fold_run(candidates, [], lambda pairs: [verdict] * len(pairs)))[-1]
    assert last["decision"] == decision and last["similarity"] == (pytest.approx(similarity) if similarity is not None else None)
    merged = decision == "auto_merge" or (decision == "tiebreak" and verdict)
    assert (last["canonical_id"] == "1") == merged


def test_held_back_do_not_see_each_other():
    known = [_c("0", [1, 0], title="a")]
    twins = [_c("1", [0.8, 0.6], title="b"), _c("2", [0.8, 0.6], title="c")]
    out = outcomes(fold_run(twins, known, lambda pairs: [False] * len(pairs)))
    assert [o["decision"] for o in out] == ["tiebreak", "tiebreak"] and {o["canonical_id"] for o in out} == {"1", "2"}


def test_sequential_matches_plain_fold(spark):
    rng = random.Random(8)
    data = []
    for run in range(4):
        for p in range(15):
            v = [rng.random(), rng.random()]
            data.append((run, p, f"{run}-{p:02d}", f"http://x/{rng.randrange(12)}", rng.choice(["red cat", "blue dog", "red dog"]), "", rng.choice(["a", "b", None]), None, None, None, v))
    schema = "run int, pos int, id string, url string, title string, description string, city string, venue string, starts_at timestamp, price string, embedding array<double>"
    df = spark.createDataFrame(data, schema)
    got = rows(triage.reconcile(df, df.filter("false"), "run", judge_by_words(0.5)).outcomes, "run", "candidate_id", "decision", "canonical_id")
    want = []
    for run in range(4):
        cands = [dict(zip(("run", "pos", "id", "url", "title", "description", "city", "venue", "starts_at", "price", "embedding"), r, strict=True)) for r in data if r[0] == run]
        want += [(run, c, decision, triage.fresh_id(run, known)) for c, decision, known in plain_fold(cands, 0.5)]
    assert got == sorted(want)


def plain_fold(cands, least):
    """The exact mode written down once more, over lists, with NumPy's cosine."""
    words = lambda c: {tuple(c["title"].split()[i : i + 2]) for i in range(max(1, len(c["title"].split()) - 1))}
    lexical = lambda a, b: len(words(a) & words(b)) / len(words(a) | words(b))
    known, urls, out, held = [], {}, {}, []
    for pos, c in enumerate(cands):
        if c["url"] in urls:
            out[pos] = (c["id"], "auto_merge", urls[c["url"]])
            first = next(k for k in known if k["id"] == urls[c["url"]])
            first["city"] = first["city"] or c["city"]
            continue
        block = [k for k in known if not (c["city"] and k["city"] and c["city"] != k["city"])]
        cos = [float(np.dot(c["embedding"], k["embedding"]) / np.linalg.norm(c["embedding"]) / np.linalg.norm(k["embedding"])) for k in block]
        near = sorted(range(len(block)), key=lambda i: (-cos[i], block[i]["id"]))[:10]
        ranked = [(max(cos[i], lexical(c, block[i])), -n, block[i]) for n, i in enumerate(near)]
        s, _, best = max(ranked, key=lambda x: (x[0] >= 0.88, x[0] >= 0.75, x[0], x[1])) if ranked else (0.0, 0, None)
        if best is not None and s >= 0.88:
            out[pos] = (c["id"], "auto_merge", best["id"])
            urls[c["url"]] = best["id"]
            urls[best["url"]] = best["id"]
            best["city"] = best["city"] or c["city"]
        elif best is not None and s >= 0.75:
            held.append((pos, c, best))
        else:
            known.append(dict(c))
            urls[c["url"]] = c["id"]
            out[pos] = (c["id"], "insert_new", c["id"])
    same = [lexical(c, best) >= least for _, c, best in held]
    for (pos, c, best), yes in zip(held, same, strict=True):
        out[pos] = (c["id"], "tiebreak", best["id"] if yes else c["id"])
    return [out[k] for k in sorted(out)]


def outcomes(run):
    return [run.outcomes[k] for k in sorted(run.outcomes)]


def _candidate(i, url, vector, **more):
    return {"id": i, "url": url, "title": i, "description": "", "embedding": vector, **more}


def test_a_merged_candidates_url_is_known_from_then_on():
    a, x, again = _candidate("a", "u1", [1.0, 0.0]), _candidate("x", "u2", [1.0, 0.0]), _candidate("y", "u2", [0.0, 1.0])
    out = outcomes(fold_run([a, x, again], [], lambda pairs: []))
    assert [(o["decision"], o["canonical_id"], o["similarity"]) for o in out] == [("insert_new", "a", None), ("auto_merge", "a", 1.0), ("auto_merge", "a", 1.0)]


def test_the_judge_is_asked_once_and_only_if_something_is_ambiguous():
    asked = []

    def judge(pairs):
        asked.append(len(pairs))
        return [True] * len(pairs)

    base, side = _candidate("a", "u1", [1.0, 0.0]), [_candidate(f"c{k}", f"v{k}", [0.8, 0.6]) for k in range(3)]
    fold_run([base, *side], [], judge)
    fold_run([base], [], judge)
    assert asked == [3]


def test_golden_records_and_provenance(spark):
    t = [datetime(2026, 7, k, tzinfo=UTC) for k in (1, 2, 3)]
    schema = "run int, pos int, id string, url string, title string, description string, city string, country string, venue string, lat double, lon double, starts_at timestamp, ends_at timestamp, price string, image_url string, attributes map<string,string>, embedding array<double>, fetched_at timestamp"
    data = [
        (0, 0, "a", "u1", "one", "", "Berlin", None, None, None, None, None, None, None, None, {"organizer": "x", "tags": " "}, [1.0, 0.0], t[1]),
        (0, 1, "b", "u2", "two", "said", "Berlin", "DE", "hall", 52.5, 13.4, None, None, "5", "img", {"organizer": "y", "tags": "jazz"}, [1.0, 0.0], t[0]),
        (0, 2, "c", "u2", "three", "", None, None, None, None, None, t[2], t[2], None, None, None, [0.0, 1.0], t[2]),
        (0, 3, "d", "u9", "four", "", "Berlin", None, None, None, None, None, None, None, None, None, [0.0, 1.0], t[2]),
    ]
    df = spark.createDataFrame(data, schema)
    corpus = spark.createDataFrame([("k1", "old", "known", "", "Berlin", None, None, None, None, None, None, None, None, None, [0.0, 1.0], ["r0"], t[0], t[0]), ("far", "far", "far", "", "Rome", None, None, None, None, None, None, None, None, None, [0.0, 1.0], ["r1"], t[0], t[0])], "id string, url string, title string, description string, city string, country string, venue string, lat double, lon double, starts_at timestamp, ends_at timestamp, price string, image_url string, attributes map<string,string>, embedding array<double>, source_ids array<string>, first_seen_at timestamp, last_seen_at timestamp")
    near = triage.near_corpus(df, corpus, "run")
    assert {r["id"] for r in near.collect()} == {"k1", "far"}  # c has no city, so Rome is in its block
    judge = judge_by_words(0.5)
    done = triage.reconcile(df, near, "run", judge)
    new = triage.fresh_id(0, "a")
    golden = {"a" if r["id"] == new else r["id"]: r for r in done.golden.collect()}
    assert set(golden) == {"a", "k1"} and golden["a"]["is_new"] and not golden["k1"]["is_new"]
    a = golden["a"]
    assert (a["title"], a["description"], a["country"], a["venue"], a["lat"], a["price"], a["image_url"]) == ("one", "said", "DE", "hall", 52.5, "5", "img")
    assert a["attributes"] == {"organizer": "x", "tags": "jazz"} and a["source_ids"] == ["a", "b", "c"] and a["starts_at"] is not None
    assert a["first_seen_at"] < a["last_seen_at"] and a["embedding"] == [1.0, 0.0]
    assert golden["k1"]["source_ids"] == ["r0", "d"] and golden["k1"]["title"] == "known"
    gave = {(r["canonical_id"], r["field"]): r["source_id"] for r in done.provenance.collect()}
    assert gave[new, "title"] == "a" and gave[new, "venue"] == "b" and gave[new, "attributes.tags"] == "b" and gave[new, "starts_at"] == "c"


def test_one_judge_call_a_run_however_often_results_are_read(spark, tmp_path):
    """Three runs, two of which have something ambiguous; embeddings are made once as well."""
    import uuid

    calls, embedded = tmp_path / "calls", tmp_path / "embedded"
    calls.mkdir()
    embedded.mkdir()

    def judge(pairs):
        (calls / uuid.uuid4().hex).write_text(str(len(pairs)))
        return [hash(uuid.uuid4()) % 2 == 0 for _ in pairs]  # would contradict itself if asked again

    @F.udf("array<double>")
    def embed(title):
        (embedded / uuid.uuid4().hex).write_text(title)
        return {"x": [1.0, 0.0], "near": [0.8, 0.6]}.get(title, [0.0, 1.0])

    data = [(run, p, f"r{run}p{p}", f"u{run}{p}", t) for run, titles in enumerate((["x", "near", "near"], ["x", "near"], ["x", "far"])) for p, t in enumerate(titles)]
    schema = "run int, pos int, id string, url string, title string, description string, city string, venue string, starts_at timestamp, price string"
    df = spark.createDataFrame([(*r, "", None, None, None, None) for r in data], schema).withColumn("embedding", embed("title"))
    from tessera.store.tables import staged

    df = staged(df, "test-candidates")
    done = triage.reconcile(df, triage.near_corpus(df, df.filter("false"), "run"), "run", judge)
    for _ in range(2):
        outcomes_, golden, given = (x.collect() for x in done)
    assert sorted(p.read_text() for p in calls.iterdir()) == ["1", "2"] and len(list(embedded.iterdir())) == len(data)
    assert {r["canonical_id"] for r in outcomes_} == {r["id"] for r in golden} == {r["canonical_id"] for r in given}


def test_many_runs_are_folded_without_a_call_each(spark, monkeypatch):
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", lambda *a: pytest.fail("a call of Python for each run"))
    none = [f"cast(null as string) AS {c}" for c in ("description", "city", "venue", "price")]
    df = spark.range(4000).selectExpr("nullif(id div 2, 7) AS run", "cast(1 - id % 2 as int) AS pos", "string(id) AS id", "'u' AS url", "'t' AS title", *none, "timestamp'2026-07-01 20:00:00' AS starts_at", "array(1.0D, if(id = 5, null, 0.0D)) AS embedding")
    monkeypatch.setattr(triage, "FOLDED", 7)
    done = triage.reconcile(df, df.filter("false"), "run", judge_by_words(0.4))
    got = {r["candidate_id"]: tuple(r)[1:] for r in done.outcomes.select("candidate_id", "run", "decision", "canonical_id", "similarity").collect()}
    for i in range(4000):
        run = None if i // 2 == 7 else i // 2
        first = triage.fresh_id(run, str(i | 1))
        assert got[str(i)] == ((run, "insert_new", first, None) if i % 2 else (run, "auto_merge", first, 1.0))
    assert rows(done.golden.groupBy("title", "starts_at", F.size("source_ids").alias("n")).count(), "title", "starts_at", "n", "count") == [("t", datetime(2026, 7, 1, 20), 2, 2000)]


def test_only_texts_of_vector_pairs_are_cut_into_shingles(spark, monkeypatch, tmp_path):
    from tessera.queries import match

    spark.range(50).selectExpr("id AS doc_id", "if(id = 3, null, concat('a b c', id % 2)) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0, 0.0]) for i in (2, 3, 7, 8, 20)], "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    seen = {}
    write = match.staged
    monkeypatch.setattr(match, "staged", lambda df, name: seen.setdefault(name, write(df, name)))
    for most in (1_000_000, 0):  # looked up by broadcast, by a shuffle
        seen.clear()
        monkeypatch.setattr(match, "MOST_BROADCAST_IDS", most)
        assert rows(match.combined_similarity(spark, str(tmp_path)), "vec_id", "similarity") == [(2, 1.0), (7, 1.0)]
        assert rows(seen["shingles"], "vec_id") == [(2,), (3,), (7,), (8,)]


def test_texts_are_embedded_a_slice_at_a_time(spark):
    from tessera.ports import models

    class Counting:
        def embed(self, texts):
            return [[float(len(texts)), float(len(t))] for t in texts]

    df = spark.range(2000, numPartitions=1).selectExpr("id", "if(id % 10 = 3, null, repeat('x', int(id % 7))) AS text")
    got = {r["id"]: r["v"] for r in df.withColumn("v", models.embed_column(F.col("text"), Counting)).collect()}
    assert all((v is None) == (i % 10 == 3) and (v is None or v[1] == i % 7) for i, v in got.items()) and len(got) == 2000
    assert max(v[0] for v in got.values() if v) <= models.EMBEDDED


def test_blocked_nearest_is_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    some = lambda n, o: [(f"x{i + o}", rng.choice([None, "a", "a", "a", "b"]), rng.choice([None] + [float(rng.randrange(0, 5 * 86400)) for _ in range(5)]), rng.choice([None] + [[float(rng.randrange(-3, 4)) for _ in range(3)] for _ in range(6)])) for i in range(n)]
    asked, corpus = [(*r, rng.choice([1, 3, 10])) for r in some(60, 0)], some(400, 30)
    cos = lambda a, b: 0.0 if a is None or b is None or not np.linalg.norm(a) or not np.linalg.norm(b) else round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 6) + 0.0
    want = []
    for i, c, t, v, k in asked:
        own = sorted((-cos(v, v2), i2) for i2, c2, t2, v2 in corpus if i2 != i and (c is None or c2 is None or c == c2) and (t is None or t2 is None or abs(t - t2) <= 86400))
        want += [(i, x[1], -x[0] + 0.0, p) for p, x in enumerate(own[:k])]
    q, c = spark.createDataFrame(asked, "id string, city string, at double, v array<double>, k int"), spark.createDataFrame(corpus, "id string, city string, at double, v array<double>")
    for cell in (4096, 16):  # the second cuts cells on both sides
        monkeypatch.setattr(block, "CELL", cell)
        got = block.blocked_knn(q, c)
        assert sorted((r[0], r[1], r[2] + 0.0, r[3]) for r in got.collect()) == sorted(want)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    assert block.blocked_knn(q.filter("false"), c).count() == 0 and block.blocked_knn(q, c.filter("false")).count() == 0


def test_blocked_nearest_passes_no_queries_through_the_driver(spark, monkeypatch):
    """Rows that lack a city or an instant meet in cells, too; equal similarities go by id however many there are."""
    q = spark.range(300).selectExpr("id", "if(id % 3 = 0, null, 'a') AS city", "if(id % 2 = 0, null, double(id)) AS at", "array(1.0D, double(id % 2)) AS v", "2 AS k")
    monkeypatch.setattr(type(q), "toArrow", lambda self: pytest.fail("gathered in the driver"))
    found = block.blocked_knn(q, q.drop("k"))
    monkeypatch.undo()
    want = lambda i: [x for x in range(i % 2, 8, 2) if x != i][:2]
    assert rows(found, "q_id", "knn_pos", "id") == sorted((i, p, x) for i in range(300) for p, x in enumerate(want(i)))


def test_knn_compares_few_rows_at_a_time(spark, monkeypatch):
    """3,000 queries against one batch of 10,000 rows: all similarities at once would take 240 MB, and several times."""
    import tracemalloc

    import pyarrow as pa

    df = spark.range(3000).selectExpr("id", "array(double(id % 17), double(id % 5), 1.0D) AS v")
    workers, make = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, *a, **b: workers.append(run) or make(self, run, *a, **b))
    block.knn(df, df, "id", "v", 10)
    v = np.random.default_rng(0).normal(size=(10_000, 3))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.array(v.tolist(), pa.list_(pa.float64()))], names=["id", "v"])
    tracemalloc.start()
    found = pa.Table.from_batches(workers[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and found.num_rows == 30_000
    q = np.array([77 % 17, 77 % 5, 1.0])
    sims = np.round(v @ q / np.linalg.norm(v, axis=1) / np.linalg.norm(q), 6)
    sims[77] = -1
    assert sorted(found["id"].to_numpy()[found["q_id"].to_numpy() == 77]) == sorted(np.lexsort((np.arange(10_000), -sims))[:10])


def test_knn_refuses_vectors_of_several_lengths(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, None)], "id bigint, v array<double>")
    with pytest.raises(ValueError, match="lengths"):
        block.knn(df, df, "id", "v", 2)
    good = df.filter("id <> 3")
    assert rows(block.knn(good, good, "id", "v", 2), "q_id", "id") == [(1, 2), (2, 1)]


def test_profiles_after_feedback(spark):
    items = spark.createDataFrame([("i1", [1.0, 0.0]), ("i2", [0.0, 2.0]), ("i3", None)], "canonical_search_result_id string, embedding array<double>")
    profiles = spark.createDataFrame([("q1", "old", [1.0, 1.0], None, 1, 0)], "saved_query_id string, nl_summary string, liked_centroid array<double>, disliked_centroid array<double>, like_count int, dislike_count int")
    given = lambda *r: spark.createDataFrame(r, "saved_query_id string, canonical_search_result_id string, kind string")
    said = spark.createDataFrame([("q1", " new words "), ("q2", "  ")], "saved_query_id string, text string")
    got = {r["saved_query_id"]: r for r in feedback.record(profiles, given(("q1", "i1", "like"), ("q1", "i2", "like"), ("q1", "i2", "dislike"), ("q2", "i2", "like"), ("q2", "i3", "dislike")), items, said).collect()}
    assert [round(x, 9) for x in got["q1"]["liked_centroid"]] == [round(2 / 3, 9), 1.0] and got["q1"]["disliked_centroid"] == [0.0, 2.0]
    assert (got["q1"]["like_count"], got["q1"]["dislike_count"], got["q1"]["nl_summary"]) == (3, 1, "new words")
    assert (got["q2"]["liked_centroid"], got["q2"]["disliked_centroid"], got["q2"]["like_count"], got["q2"]["dislike_count"], got["q2"]["nl_summary"]) == ([0.0, 2.0], None, 1, 1, None)
    with pytest.raises(feedback.UnknownResult, match="nobody"):
        feedback.record(profiles, given(("q1", "i1", "like"), ("q1", "nobody", "like")), items)


def test_components(spark):
    nodes = spark.range(9).select(F.col("id"))
    links = spark.createDataFrame([(8, 7), (7, 3), (3, 1), (2, 5)], "a bigint, b bigint")
    assert rows(triage.components(nodes, links), "id", "component") == [(0, 0), (1, 1), (2, 2), (3, 1), (4, 4), (5, 2), (6, 6), (7, 1), (8, 1)]


def test_components_of_a_hub(spark, monkeypatch):
    """A star whose hub and component are heavy: looked up by broadcast, in no task of its own."""
    monkeypatch.setattr(triage, "HEAVY_ROWS", 50)
    star = spark.range(1, 2000).select(F.when(F.col("id") % 2 == 0, F.lit(777)).otherwise(F.col("id")).alias("a"), F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.lit(777)).alias("b"))
    got = triage.components(spark.range(2100), star)
    assert got.filter("id BETWEEN 1 AND 1999 AND component <> 1").count() == 0 and got.filter("id = component").count() == 1 + 1 + 100


def test_components_of_a_long_path_in_any_order(spark):
    order = random.Random(6).sample(range(1000), 1000)
    links = spark.createDataFrame([(a, b) for k, (a, b) in enumerate(zip(order, order[1:], strict=False)) if k != 599], "a bigint, b bigint")
    low, high = min(order[:600]), min(order[600:])
    got = dict(rows(triage.components(spark.range(1000), links), "id", "component"))
    assert got == {i: low if k < 600 else high for k, i in enumerate(order)}
    with pytest.raises(RuntimeError):
        triage.components(spark.range(1000), links, rounds=2)


SEEN = [("k", 1, " ", None, 10), ("k", 2, "x", "p", 5), ("k", 3, "y", "q", 30), ("j", 4, None, " ", 7)]


def test_golden(spark):
    df = spark.createDataFrame(SEEN, "k string, source int, title string, price string, at int")
    assert rows(survive.golden(df, "k", ["source"], ["title", "price"]), "k", "title", "price") == [("j", None, None), ("k", "x", "p")]
    assert rows(survive.provenance(df, "k", ["source"], "source", ["title", "price"]), "k", "field", "source") == [("k", "price", 2), ("k", "title", 2)]
    assert rows(survive.seen_window(df, "k", "at"), "k", "first_seen", "last_seen") == [("j", 7, 7), ("k", 5, 30)]
    twice = df.unionByName(df)
    assert rows(survive.golden(twice, "k", ["source"], ["title", "price"]), "k", "title", "price") == rows(survive.golden(df, "k", ["source"], ["title", "price"]), "k", "title", "price")
    assert survive.source_ids(twice, "k", ["source"], "source").filter("k = 'k'").first()["source_ids"] == [1, 2, 3]


def test_map_fill(spark):
    m = lambda *kv: F.create_map(*(F.lit(x) for x in kv))
    got = spark.range(1).select(survive.fill_map(m("a", "1"), m("a", "2", "b", "3")).alias("m")).first()["m"]
    assert got == {"a": "1", "b": "3"}


def test_ledger(spark):
    log = spark.createDataFrame([("u", "a", 2), ("u", "a", 1), ("u", "b", 3), ("v", "a", 4)], "user_id string, item string, seq int")
    assert rows(ledger.insert_ignore(log, ["user_id", "item"], "seq"), "user_id", "item", "seq") == [("u", "a", 1), ("u", "b", 3), ("v", "a", 4)]
    assert rows(ledger.unseen(log, log.filter("user_id = 'u' AND item = 'a'"), ["user_id", "item"]), "user_id", "item") == [("u", "b"), ("v", "a")]
    assert rows(ledger.latest(log, ["user_id", "item"], ["seq"]), "user_id", "item", "seq") == [("u", "a", 2), ("u", "b", 3), ("v", "a", 4)]
    existing = spark.createDataFrame([("u", "a", 7)], "user_id string, item string, seq bigint")
    more = spark.createDataFrame([("u", "a", 9), ("u", "c", 2), ("u", "c", 5), ("u", "b", 3), ("v", "a", 4)], "user_id string, item string, pos int")
    got = {(r["user_id"], r["item"]): r["seq"] for r in ledger.next_seq(existing, more, ["user_id", "item"], ["pos"]).collect()}
    assert sorted(got.values()) == [8, 9, 10] and got["u", "c"] < got["u", "b"] and ("u", "a") not in got


def _placed(spark, scores, top):
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate(scores)], "q int, item int, score double")
    assert taste.prefilter(df, "q", "item", top).count() <= top
    return df


def test_ranking(spark):
    got = taste.ranked(_placed(spark, [0.9, 0.5, 0.1, -0.6, -0.05], 3), "q", "item", 3, 1).orderBy("rank").collect()
    assert [(r["item"], r["is_exploration"]) for r in got] == [(0, False), (1, False), (4, True)]


def test_more_explorers_than_places(spark):
    got = taste.ranked(_placed(spark, [0.9, 0.5, 0.1], 1), "q", "item", 1, 2).orderBy("rank").collect()
    assert [(r["item"], r["is_exploration"]) for r in got] == [(2, True), (1, True)]


def test_submission_reorders_and_appends(spark):
    sub = spark.createDataFrame([(0, 0, 1, "w")], "q int, place int, idx int, why string")
    got = taste.ranked(_placed(spark, [0.9, 0.5, 0.1], 3), "q", "item", 3, 0, sub).orderBy("rank").collect()
    assert [(r["item"], r["rationale"]) for r in got] == [(1, "w"), (0, None), (2, None)]


def test_centroids_agree(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i % 2, i, [rng.random() for _ in range(3)]) for i in range(20)], "k int, o int, v array<double>")
    batch = {r["k"]: r["centroid"] for r in feedback.packed(feedback.centroids(df, ["k"], "v"), ["k"]).collect()}
    steps = {r["k"]: r["centroid"] for r in feedback.incremental(df, "k", "o", "v").collect()}
    assert all(batch[k] == pytest.approx(steps[k]) for k in batch)


def test_metrics(spark):
    df = spark.createDataFrame([("a", ["x", "y", "z"], ["y", "q"]), ("b", ["x"], [])], "name string, p array<string>, g array<string>")
    got = {(r["name"], r["metric"]): r["value"] for r in evaluate.scores(df, "name", "p", "g", 2).collect()}
    assert got == {("a", "precision@2"): 0.5, ("a", "recall@2"): 0.5, ("a", "mrr"): 0.5, ("b", "precision@2"): 0.0, ("b", "recall@2"): 0.0, ("b", "mrr"): 0.0}
