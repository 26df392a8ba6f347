"""Ports, settings, store, streams and a whole run."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tessera import config, vocabulary
from tessera.ports import auth, models, progress, search
from tessera.schema import TABLES
from tessera.store.tables import MemoryStore, Store, preview
from tessera.streaming import twins


def test_settings_precedence():
    s = config.load("[rank]\ntop_n = 25\nslots = 2\n", {"TESSERA__RANK__SLOTS": "3"}, rank={"top_n": 5})
    assert (s["rank.top_n"], s["rank.slots"]) == (5, "3")
    with pytest.raises(KeyError):
        s["rank.missing"]


def test_vocabulary():
    assert vocabulary.keys_of("nope") == () and "doi" in vocabulary.signs_of("papers")
    call = vocabulary.search_call("events")
    attributes = call["parameters"]["properties"]["results"]["items"]["properties"]["attributes"]
    assert set(attributes["properties"]) == set(vocabulary.keys_of("events")) and attributes["additionalProperties"] is False


def test_auth():
    assert auth.authenticate("local", None).user_id == "local"
    assert auth.authenticate("telegram", " 5 ").user_id == "tg:5" and auth.authenticate("telegram", " ") is None
    assert not auth.authorized(" ", " ") and auth.authorized("a", " a")
    with pytest.raises(auth.NotOwner):
        auth.require_owner(auth.Principal("a", "local"), "b")
    with pytest.raises(NotImplementedError):
        auth.authenticate("api_token", "x")


def test_search_ports():
    assert search.tool_options("low") == {"search_context_size": "low"}
    full = search.tool_options("low", ["a.b"], {"city": "Berlin", "country": ""})
    assert full["filters"] == {"allowed_domains": ["a.b"]} and full["user_location"] == {"type": "approximate", "city": "Berlin"}
    reply = [{"type": "text"}, {"type": "function_call", "name": "x", "arguments": "1"}, {"type": "function_call", "name": "x", "arguments": "2"}]
    assert search.first_call(reply, "x") == "1" and search.first_call(reply, "y") is None
    with pytest.raises(NotImplementedError):
        search.engine("exa")
    with pytest.raises(search.AdapterMissing):
        search.engine("frontier_native")


def test_embedding(spark):
    got = spark.createDataFrame([(0, "a b"), (1, "a b"), (2, None)], "i int, t string").withColumn("v", models.embed_column(F.col("t"))).orderBy("i").collect()
    assert got[0]["v"] == got[1]["v"] and len(got[0]["v"]) == 384 and got[2]["v"] is None
    assert models.ScriptedModel(lambda m: " ok ").complete([]) == "ok"


def test_progress():
    seen = []
    with progress.reported("rank", seen.append):
        pass
    assert [e.phase for e in seen] == ["start", "done"]
    with pytest.raises(ValueError):
        progress.reported("nope", None).__enter__()


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.view("users").count() == 0
    user = lambda name: spark.createDataFrame([("u1", name, None, datetime(2024, 1, 1, tzinfo=UTC))], TABLES["users"])
    store.append("users", user("old"), 1)
    store.append("users", user("new"), 2)
    assert [r["display_name"] for r in store.view("users").collect()] == ["new"] and store.get("users", "x").count() == 0
    links = spark.createDataFrame([(1, "q", "c"), (2, "q", "c"), (3, "q", "d")], "seq bigint, query_id string, canonical_id string")
    store.link(links, 1)
    assert sorted(tuple(r) for r in store.links().select("canonical_id", "seq").collect()) == [("c", 1), ("d", 3)]
    shown = lambda ids, h: spark.createDataFrame([("u", i, datetime(2024, 1, 1, h, tzinfo=UTC)) for i in ids], "user_id string, result_id string, shown_at timestamp")
    store.mark_shown(shown("ab", 1), 1)
    store.mark_shown(shown("bc", 2), 2)
    assert store.shown().count() == 3
    from tessera.store.tables import tables_of

    assert sorted(tuple(r) for r in tables_of(store).collect()) == [("query_results", 1, 3), ("shown_ledger", 2, 4), ("users", 2, 2)]
    other = store.compact("users", str(tmp_path / "t"))
    assert other.log("users").count() == 1
    store.close()
    store.close()
    with pytest.raises(RuntimeError):
        store.view("users")
    memory = MemoryStore(spark)
    memory.put("users", user("x"))
    assert memory.view("users").count() == 1 and preview(spark.range(9), 4).count() == 4


def test_whole_run(spark):
    from tessera.plans.curation import run

    recorded = {"q1": [{"url": "https://www.a.example/x?utm_source=1", "title": "jazz night", "description": "in the hall"}, {"url": "https://b.example/y", "title": "poems", "description": "quiet evening"}], "q2": [{"url": "https://a.example/x", "title": "jazz night", "description": "in the hall"}]}
    corpus = spark.createDataFrame([], "id string, url string, title string, description string, city string, venue string, starts_at timestamp, price string, embedding array<double>")
    profile = spark.createDataFrame([(models.HashEmbedder().embed(["poems quiet"])[0], None)], "liked_centroid array<double>, disliked_centroid array<double>")
    shown = spark.createDataFrame([], "canonical_id string")
    seen = []
    out = run(spark, recorded, corpus, profile, shown, listener=seen.append)
    assert out["fused"].count() == 2 and out["outcomes"].count() == 2 and len(seen) == 8
    first = out["ranked"].filter("rank = 0").join(out["golden"].select("id", "url"), "id").first()
    assert first["url"] == "https://b.example/y"


def test_run_is_stored_and_reconciled_later(spark, tmp_path):
    """A run's golden records, provenance and links; feedback on unknown records is refused; a later session meets the same records."""
    from tessera.operators import feedback
    from tessera.operators.triage import judge_by_words
    from tessera.plans.curation import run, store_run

    store = Store(spark, str(tmp_path / "run"))
    recorded = {"q1": [{"url": "https://a.example/x", "title": "jazz night", "description": "in the hall"}, {"url": "https://b.example/y", "title": "poems", "description": "quiet evening"}]}
    corpus = spark.createDataFrame([], "id string, url string, title string, description string, city string, venue string, starts_at timestamp, price string, embedding array<double>")
    profile = spark.createDataFrame([(None, None)], "liked_centroid array<double>, disliked_centroid array<double>")
    out = run(spark, recorded, corpus, profile, spark.createDataFrame([], "canonical_id string"))
    for _ in range(2):  # storing again changes nothing
        store_run(store, "saved", out, 1)
    assert store.view("canonical").count() == 2 and store.links().count() == 2
    assert all(set(r["winners"]) >= {"title", "description"} for r in store.view("provenance").collect())
    with pytest.raises(ValueError, match="one profile"):
        run(spark, recorded, corpus, profile.union(profile), spark.createDataFrame([], "canonical_id string"))
    bad = spark.createDataFrame([("f", "saved", "nobody", "like")], "id string, saved_query_id string, canonical_search_result_id string, kind string")
    with pytest.raises(feedback.UnknownResult):
        store.add_feedback(bad, 1)
    assert store.view("feedback").count() == 0
    # The same results in a second session are the same two records, and another text doesn't overwrite one.
    flat = lambda: store.view("canonical").select("*", *(F.col(f"geo.{c}").alias(c) for c in ("city", "country", "venue", "lat", "lon"))).withColumnRenamed("source_search_result_ids", "source_ids").drop("geo", "city_key", "starts_epoch")
    again = run(spark, recorded, flat(), profile, spark.createDataFrame([], "canonical_id string"), name="second")
    assert again["ranked"].count() == 2 and {r["decision"] for r in again["outcomes"].collect()} == {"auto_merge"}
    changed = {"q1": [{"url": "https://a.example/x", "title": "chess for all ages", "description": "a different thing"}]}
    other = run(spark, changed, flat(), profile, spark.createDataFrame([], "canonical_id string"), name="third")
    assert [r["is_new"] for r in other["golden"].collect()] == [True] and other["golden"].join(store.view("canonical"), "id").count() == 0
    # A later session finds one of them again under another address, and something new.
    folder = tmp_path / "later"
    later = spark.createDataFrame([(0, "n1", "https://c.example/z", "jazz night", "in the hall", "Berlin"), (1, "n2", "https://d.example/q", "chess open", "for all", None)], "pos int, id string, url string, title string, description string, city string")
    later = later.withColumn("venue", F.lit(None).cast("string")).withColumn("starts_at", F.lit(None).cast("timestamp")).withColumn("price", F.lit("5"))
    from tessera.functions.text import doc_text

    later = later.withColumn("embedding", models.embed_column(doc_text(F.col("title"), F.col("description"))))
    later.coalesce(1).write.parquet(str(folder))
    got = twins.reconcile(spark, spark.readStream.schema(later.schema).parquet(str(folder)), store, judge_by_words(0.5))
    found = {r["title"]: r for r in got.collect()}
    assert set(found) == {"jazz night", "poems", "chess open"} and found["jazz night"]["geo"]["city"] == "Berlin" and found["jazz night"]["price"] == "5"
    gave = {r["canonical_id"]: r["winners"] for r in store.view("provenance").collect()}[found["jazz night"]["id"]]
    assert gave["city"] == gave["price"] == "n1" and gave["title"] not in (None, "n1")  # later winners join the earlier ones
    assert found["jazz night"]["city_key"] == "berlin" and len(found["jazz night"]["source_search_result_ids"]) == 2


def test_ticks_run_what_is_due(spark, tmp_path):
    """Missed fires are one run, a failed run is tried again, and each start goes on where the last one ended."""
    import uuid

    from tessera.streaming import ticks

    at = lambda d, h: datetime(2026, 6, d, h, tzinfo=UTC)
    schema = "id string, schedule_cron string, enabled boolean, created_at timestamp, last_run_at timestamp"
    queries = spark.createDataFrame([("daily", "0 9 * * *", True, at(10, 0), None), ("off", "0 9 * * *", False, at(10, 0), None), ("broken", "0 9 * * *", True, at(10, 0), None), ("unreadable", "0 99 * * *", True, at(10, 0), None)], schema)
    log = tmp_path / "log"
    log.mkdir()

    def run(i, now):
        (log / uuid.uuid4().hex).write_text(f"{i} {now.day} {now.hour}")
        if i == "broken":
            raise ValueError

    for n, moment in enumerate((at(12, 8), at(12, 10), at(12, 11), at(15, 10))):
        spark.createDataFrame([(moment,)], "at timestamp").coalesce(1).write.parquet(str(tmp_path / f"clock/n={n}"))
        clock = spark.readStream.schema("at timestamp, n int").parquet(str(tmp_path / "clock"))
        marks = ticks.ticks(spark, clock, queries, ticks.isolated(run), f"file://{tmp_path}/ticks")
    ran = sorted(p.read_text() for p in log.iterdir())
    # At 8 for the fires missed, at 10 for the day's, after the outage once; the failing one at every tick.
    assert [r for r in ran if r.startswith("daily")] == ["daily 12 10", "daily 12 8", "daily 15 10"]
    assert [r for r in ran if r.startswith("broken")] == ["broken 12 10", "broken 12 11", "broken 12 8", "broken 15 10"] and len(ran) == 7
    assert {(r["id"], r["ok"]) for r in marks.collect()} == {("daily", True), ("broken", False)}
    # Started again with nothing new, nothing runs.
    ticks.ticks(spark, clock, queries, ticks.isolated(run), f"file://{tmp_path}/ticks")
    assert len(list(log.iterdir())) == 7


def _arriving(spark, folder):
    from tessera.functions.text import doc_text

    for n, titles in enumerate((["jazz night", "poems"], ["jazz night", "chess open"])):
        rows = [(p, f"s{n}p{p}", f"https://{n}.example/{p}", t, "in the hall", "Berlin" if n else None) for p, t in enumerate(titles)]
        df = spark.createDataFrame(rows, "pos int, id string, url string, title string, description string, city string")
        df = df.withColumns({"venue": F.lit(None).cast("string"), "starts_at": F.lit(None).cast("timestamp"), "price": F.lit(None).cast("string"), "embedding": models.embed_column(doc_text(F.col("title"), F.col("description")))})
        df.coalesce(1).write.parquet(str(folder / f"n={n}"))
    return lambda: spark.readStream.schema("pos int, id string, url string, title string, description string, city string, venue string, starts_at timestamp, price string, embedding array<double>, n int").option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_reconciling_takes_effect_once(spark, tmp_path, monkeypatch):
    """A stream that stops between its two writes, then starts again, leaves the store of one that wasn't disturbed."""
    from tessera.operators.triage import judge_by_words

    stream = _arriving(spark, tmp_path / "in")
    calm, torn = Store(spark, f"file://{tmp_path}/calm"), Store(spark, f"file://{tmp_path}/torn")
    twins.reconcile(spark, stream(), calm, judge_by_words(0.5))
    append, failures = Store.append, []

    def stop(self, table, rows, version, once=None):
        if self is torn and table == "provenance" and version == 2 and not failures:
            failures.append(version)
            raise RuntimeError("stopped between the writes")
        append(self, table, rows, version, once)

    monkeypatch.setattr(Store, "append", stop)
    with pytest.raises(Exception, match="stopped between"):
        twins.reconcile(spark, stream(), torn, judge_by_words(0.5))
    assert not torn.committed("reconcile", 1) and torn.committed("reconcile", 0)
    for _ in range(2):  # the second start finds nothing to do
        twins.reconcile(spark, stream(), torn, judge_by_words(0.5))
    rows = lambda store, table: sorted(map(str, store.view(table).collect()))
    assert rows(calm, "canonical") == rows(torn, "canonical") and len(rows(calm, "canonical")) == 3
    assert rows(calm, "provenance") == rows(torn, "provenance")
    assert calm.log("canonical").count() == torn.log("canonical").count()


def test_streamed_centroids_go_on(spark, tmp_path):
    data = [("a", [1.0, 2.0]), ("a", [3.0, 6.0]), ("b", [5.0, 5.0]), ("b", None), ("a", [5.0, 1.0])]
    schema = "k string, v array<double>"
    for n, rows in enumerate((data[:2], data[2:])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/n={n}"))
        stream = spark.readStream.schema(schema + ", n int").parquet(str(tmp_path / "in"))
        got = sorted(tuple(r) for r in twins.running_centroids(spark, stream, ["k"], "v", f"file://{tmp_path}/state").collect())
    assert got == [("a", 0, 3.0, 3), ("a", 1, 3.0, 3), ("b", 0, 5.0, 1), ("b", 1, 5.0, 1)]


def test_delivery_is_sent_once_and_marked_on_commit(spark, tmp_path):
    """A task that fails is run again without sending twice; only a delivery that ended well is marked as shown."""
    import uuid

    from tessera.streaming.delivery import FileClaims, deliver

    sent = tmp_path / "sent"
    sent.mkdir()

    def send(chat, text):
        (sent / f"{len(list(sent.iterdir())):03d}-{uuid.uuid4().hex}").write_text(f"{chat} {text}")
        if text == "boom":
            raise ValueError

    messages = spark.createDataFrame([("c", 1, "b", "r1"), ("c", 0, "a", "r2"), ("b", 0, "z", "r1"), ("c", 2, "boom", "r3"), ("c", 3, "d", "r4")], "chat_id string, rank int, message string, result_id string")
    shown = []
    claims = FileClaims(str(tmp_path / "claims"))
    with pytest.raises(Exception, match="ValueError|failed"):
        deliver(messages.coalesce(1), send, claims, lambda m: shown.append(m.count()))
    assert not shown
    deliver(messages.coalesce(1), send, claims, lambda m: shown.append(m.count()))
    assert shown == [5]
    told = [p.read_text() for p in sorted(sent.iterdir())]
    assert sorted(told) == ["b z", "c a", "c b", "c boom", "c d"] and [t for t in told if t[0] == "c"] == ["c a", "c b", "c boom", "c d"]


def test_recorded_cases(spark, tmp_path):
    from tessera.operators import evaluate

    (tmp_path / "cases.json").write_text('{"name":"x","stage":"rank","golden_ids":["1"]}\n{"name":"y","stage":"merge","golden_ids":[]}\n')
    assert [r["name"] for r in evaluate.cases(spark, str(tmp_path / "cases.json"), "rank").collect()] == ["x"]


def test_a_recording_is_asked_by_query(spark, tmp_path):
    found = spark.range(1000).select(F.concat(F.lit("q"), (F.col("id") % 50).cast("string")).alias("query_id"), F.floor(F.col("id") / 50).cast("int").alias("pos"), F.lit("u").alias("url"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("description"))
    search.record(found, str(tmp_path / "recording"))
    some = search.played(spark, str(tmp_path / "recording"), ["q3", "q7"])
    assert some.count() == 40 and search.played(spark, str(tmp_path / "recording")).count() == 1000
    assert "PushedFilters: [In(query_id, [q3,q7])]" in some._jdf.queryExecution().toString().replace("  ", " ")


def test_only_texts_without_a_vector_are_embedded(spark, tmp_path):
    import uuid

    from tessera.operators.embed import VectorCache

    log = tmp_path / "log"
    log.mkdir()

    class Counting(models.HashEmbedder):
        def embed(self, texts):
            for t in texts:
                (log / uuid.uuid4().hex).write_text(t)
            return super().embed(texts)

    cache = VectorCache(spark, f"file://{tmp_path}/vectors", 2, Counting)
    rows = lambda *texts: spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, embedding_of string")
    assert {r["made"] for r in cache.embed(rows("a b", "a b", None, "")).collect() if r["text"] is not None} == {True}
    got = {r["id"]: r for r in cache.embed(rows("c", "a b", "c", None)).collect()}
    cache.close()
    assert sorted(p.read_text() for p in log.iterdir()) == ["", "a b", "c"]
    assert (got[0]["made"], got[1]["made"], got[2]["made"]) == (True, False, True) and got[3]["embedding"] is None and got[0]["embedding"] == got[2]["embedding"]
    assert cache.embed is not None and len(got) == 4


def test_structured_calls():
    assert {s: vocabulary.call_of(s)["name"] for s in vocabulary.CALLS} == vocabulary.CALLS
    assert vocabulary.call_of("classify")["parameters"]["properties"]["domain"]["enum"] == list(vocabulary.ATTRIBUTES)
    assert vocabulary.call_of("judge")["parameters"]["properties"]["verdicts"]["items"]["required"] == ["pair", "same"]
    with pytest.raises(ValueError):
        vocabulary.call_of("merge")


def test_bucketed_log_without_shuffles(spark, tmp_path):
    from tessera.schema import _struct
    from pyspark.sql import types as T

    from tessera.store.bucketed import BucketedLog

    schema = _struct(id=T.StringType(), value=T.LongType(), tags=T.MapType(T.StringType(), T.StringType()))
    log = BucketedLog(spark, f"file://{tmp_path}/log", schema, "id", 4)
    rows = lambda v, *ids: spark.createDataFrame([(i, v, {"v": str(v)}) for i in ids], schema)
    log.append(rows(1, "a", "b", "c"), 1)
    log.append(rows(2, "b", "d"), 2)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = log.view().join(log.view().withColumnRenamed("value", "w").drop("tags"), "id")
        for df in (log.view(), joined):
            df.collect()
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    want = {"a": 1, "b": 2, "c": 1, "d": 2}
    seen = lambda df: {r["id"]: r["value"] for r in df.collect()}
    before = log.view()
    log.compact(8)
    assert seen(before) == seen(log.view()) == want and log.log().count() == 4
    log.append(rows(3, "a"), 3)
    other = BucketedLog(spark, f"file://{tmp_path}/log", schema, "id", 99)  # opened again: the number of buckets is the log's
    assert seen(other.view()) == {**want, "a": 3} and seen(before) == want
    log.vacuum()
    assert seen(other.view()) == {**want, "a": 3} and len(log._generations()) == 1
    log.close()
    other.close()


def test_a_saved_query_runs_from_its_id(spark, tmp_path, monkeypatch):
    """Owner check, translations, cached domain, sessions that meet the same records, what was shown, an order from outside."""
    from tessera.plans import saved

    store = Store(spark, f"file://{tmp_path}/store")
    query = spark.createDataFrame([("s1", "u1", "jazz", None, None)], "id string, user_id string, text string, city string, domain string")
    store.append_as("saved_queries", query, 0)
    results = [("jazz", 0, "https://www.a.example/x?utm_source=1", "jazz night", "in the hall"), ("jazz", 1, "https://b.example/y", "poems", "quiet"), ("Jazzabend", 0, "https://a.example/x", "jazz night", "in the hall"), ("Jazzabend", 1, "https://c.example/z", "chess open", "for all")]
    recorded = spark.createDataFrame(results, "text string, pos int, url string, title string, description string")
    search_ = lambda asked: asked.select("query_id", "text").join(recorded, "text").drop("text")
    words = lambda q: q.select("id", F.explode(F.array(F.lit("jazz"), F.lit("Jazzabend"))).alias("query"))
    monkeypatch.setitem(saved.PARTS["search"], "recorded", lambda: search_)
    monkeypatch.setitem(saved.PARTS["translate"], "two", lambda: words)
    stages = saved.build({"search": "recorded", "translate": "two", "judge": "words"})
    seen, me = [], auth.Principal("u1", "local")
    for session in (1, 2, 2):  # the last one is run again
        ranked = saved.run_saved(spark, store, "s1", me, stages, session, listener=seen.append).collect()
        assert len(ranked) == len({r["id"] for r in ranked}) == 3 and sorted(r["rank"] for r in ranked) == [0, 1, 2]
    assert [(e.stage, e.phase) for e in seen[:12]] == [(s, p) for s in ("expand", "search", "merge", "dedup", "store", "rank") for p in ("start", "done")]
    assert store.view("canonical").count() == 3 and store.links().count() == 3 and store.view("raw_results").count() == 6
    assert store.view("saved_queries").first()["domain"] == "events"
    titles = {r["id"]: r["title"] for r in store.view("canonical").collect()}
    shown = next(i for i, t in titles.items() if t == "poems")
    store.mark_shown(spark.createDataFrame([("u1", shown, datetime(2024, 1, 1, tzinfo=UTC))], "user_id string, result_id string, shown_at timestamp"), 3)
    backwards = lambda head: head.select("query", F.lit(0).alias("place"), F.lit(1).alias("idx"), F.lit("first").alias("why")).distinct()
    turned = saved.build({"search": "recorded", "translate": "two", "judge": "never"}, rerank=backwards)
    again = saved.run_saved(spark, store, "s1", me, turned, 3, unseen_only=True).collect()
    assert {titles[r["id"]] for r in again} == {"jazz night", "chess open"} and [r["rationale"] for r in sorted(again, key=lambda r: r["rank"])] == ["first", None]
    with pytest.raises(auth.NotOwner):
        saved.run_saved(spark, store, "s1", auth.Principal("u2", "local"), stages, 4)
    with pytest.raises(saved.UnknownQuery):
        saved.run_saved(spark, store, "s9", me, stages, 4)
    for named, error in (({"search": "exa"}, NotImplementedError), ({"search": "nothing"}, search.AdapterMissing), ({"judge": "words"}, search.AdapterMissing), ({"sort": "x"}, ValueError)):
        with pytest.raises(error):
            saved.build(named)


def test_dialogue_and_store_methods(spark, tmp_path):
    """A builder's turns become saved queries, which are listed, scheduled, found near and deleted with their links."""
    from tessera.plans import dialogue

    store = Store(spark, f"file://{tmp_path}/store")
    messages = spark.createDataFrame([(1, 0, "user", "jazz"), (2, 0, "user", "bad"), (3, 0, "user", "hm"), (1, 1, "assistant", None)], "conv_id bigint, turn bigint, role string, text string")

    def make():
        def answer(m):
            said = m[0]["content"]
            if "jazz" in said:
                return '{"message":"ok","ready":true,"text":"jazz","city":"Berlin","schedule_cron":"0 9 * * *"}'
            return '{"message":"ok","ready":true,"text":"bad","schedule_cron":"0 99 * * *"}' if "bad" in said else "?"

        return models.ScriptedModel(answer)

    turns = dialogue.next_turns(messages, make)
    assert {r["conv_id"]: r["text"] for r in turns.collect()} == {1: "jazz", 2: "bad", 3: None}
    assert [r["conv_id"] for r in dialogue.save_drafts(store, turns, "u1", 1).collect()] == [2]
    (saved,) = store.owned_queries("u1").collect()
    assert saved["text"] == "jazz" and store.scheduled_queries().count() == 1 and store.owned_queries("u2").count() == 0
    record = spark.createDataFrame([("c1", "u", "Berlin", [1.0, 0.0]), ("c2", "u", "Rome", [1.0, 0.1])], "id string, url string, city string, embedding array<double>")
    record = record.withColumns({c: F.lit(None).cast(t) for c, t in (("country", "string"), ("venue", "string"), ("lat", "double"), ("lon", "double"), ("starts_at", "timestamp"))}).withColumn("source_ids", F.array("id"))
    store.upsert_canonical(record, spark.createDataFrame([("c1", "url", "c1")], "canonical_id string, field string, source_id string"), 1)
    store.link(spark.createDataFrame([(1, saved["id"], "c1")], "seq bigint, query_id string, canonical_id string"), 2)
    assert [(r["id"], r["seq"]) for r in store.results_of(saved["id"]).collect()] == [("c1", 1)]
    asked = spark.createDataFrame([("q", " berlin", None, [2.0, 0.0]), ("r", None, None, [0.0, 1.0])], "id string, city string, starts_at timestamp, embedding array<double>")
    assert sorted((r["q_id"], r["id"], r["knn_pos"]) for r in store.nearest(asked).collect()) == [("q", "c1", 0), ("r", "c1", 1), ("r", "c2", 0)]
    store.mark_shown(spark.createDataFrame([("u1", "c1", datetime(2024, 1, 1, tzinfo=UTC))], "user_id string, result_id string, shown_at timestamp"), 2)
    store.delete_queries(store.saved_queries().select("id"), 3)
    assert store.saved_queries().count() == 0 and store.results_of(saved["id"]).count() == 0 and store.shown_to("u1").count() == 1
    assert store.feedback_on(saved["id"]).count() == 0


def test_a_tick_runs_and_delivers(spark, tmp_path):
    """Due queries are run as their owners and delivered; nothing is sent twice; one that fails doesn't stop the other."""
    import uuid

    from tessera.plans import saved
    from tessera.streaming import ticks
    from tessera.streaming.delivery import FileClaims

    at = lambda d, h: datetime(2026, 6, d, h, tzinfo=UTC)
    store = Store(spark, f"file://{tmp_path}/store")
    rows = [("s1", "u1", "jazz", "0 9 * * *", True, 1, at(10, 0)), ("s2", "u2", "broken", "0 9 * * *", True, 5, at(10, 0))]
    store.append_as("saved_queries", spark.createDataFrame(rows, "id string, user_id string, text string, schedule_cron string, enabled boolean, max_results_shown int, created_at timestamp"), 0)
    found = spark.createDataFrame([("jazz", 0, "https://a.example/x", "jazz & more", "in the hall"), ("jazz", 1, "https://b.example/y", "poems", "quiet")], "text string, pos int, url string, title string, description string")
    search_ = lambda asked: asked.select("query_id", "text").join(found, "text").drop("text")

    def searching(asked):
        if asked.filter("text = 'broken'").count():
            raise ValueError("no answer")
        return search_(asked)

    sent = tmp_path / "sent"
    sent.mkdir()
    run = saved.scheduled_run(spark, store, saved.Stages(search=searching), lambda chat, text: (sent / uuid.uuid4().hex).write_text(f"{chat} {text}"), FileClaims(str(tmp_path / "claims")))
    told = []
    for n, moment in enumerate((at(12, 10), at(13, 10), at(14, 10))):
        spark.createDataFrame([(moment,)], "at timestamp").coalesce(1).write.parquet(str(tmp_path / f"clock/n={n}"))
        clock = spark.readStream.schema("at timestamp, n int").parquet(str(tmp_path / "clock"))
        marks = ticks.ticks(spark, clock, store.scheduled_queries(), run, f"file://{tmp_path}/ticks")
        told.append(sorted(p.read_text() for p in sent.iterdir()))
    assert [len(t) for t in told] == [1, 2, 2] and all(t.startswith("u1 <a href=") for t in told[-1]) and any("jazz &amp; more" in t for t in told[-1])
    assert store.shown_to("u1").count() == 2 and {(r["id"], r["ok"]) for r in marks.collect()} == {("s1", True), ("s2", False)}


def test_locations_are_blank_where_unknown(spark, tmp_path):
    store = Store(spark, str(tmp_path / "users"))
    store.append("users", spark.createDataFrame([("u1", "n", ("Berlin", None, None, None), None)], TABLES["users"]), 1)
    got = store.location_of(spark.createDataFrame([("u1",), ("u2",)], "user_id string")).collect()
    assert sorted(tuple(r) for r in got) == [("u1", "Berlin", ""), ("u2", "", "")]
