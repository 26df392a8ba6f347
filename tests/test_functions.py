"""Column functions against the behaviour they are meant to have."""

import random
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import contracts, cron, minhash, render, text, url, vector


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


URLS = [
    ("HTTPS://WWW.Example.COM/Path/", "https://example.com/Path"),
    ("http://example.com:80/a?utm_source=x&b=1&UTM_Medium=y", "http://example.com/a?b=1"),
    ("https://example.com:8443/", "https://example.com:8443/"),
    ("https://user:pw@example.com/a//#frag", "https://example.com/a"),
    ("  https://example.com/?ref=1&q=&fbclid=2  ", "https://example.com/?q="),
    ("mailto:a@b.c", "mailto:a@b.c"),
    ("nonsense", "nonsense"),
    ("", ""),
    ("https://example.com?flag", "https://example.com?flag="),
]


@pytest.mark.parametrize("raw,expected", URLS)
def test_canonical_url(spark, raw, expected):
    assert one(spark, url.canonical_url(F.lit(raw))) == (expected,)


def test_text(spark):
    assert one(spark, text.ws_trim(F.lit("  a b \n"))) == ("a b",)
    assert one(spark, text.city_key(F.lit("  Straße ")), text.city_key(F.lit(" \t"))) == ("strasse", None)
    assert one(spark, text.doc_text(F.lit(" t"), F.lit(None).cast("string"))) == ("t",)


@pytest.mark.parametrize("raw", ["", "one", "one two", "a b c", "a  b c a b", "Ä ß x"])
@pytest.mark.parametrize("k", [1, 2, 3])
def test_shingles(spark, raw, k):
    words = raw.lower().replace("ß", "ss").split()
    expected = list(dict.fromkeys(" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))) if words else []
    assert one(spark, text.shingles(F.lit(raw), k))[0] == expected


def test_vectors(spark):
    arr = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    none = F.lit(None).cast("array<double>")
    got = one(spark, vector.cosine(arr(1, 0), arr(0.8, 0.6)), vector.cosine(arr(0, 0), arr(1, 0)), vector.cosine(arr(1), arr(1, 0)), vector.taste(arr(1, 0), arr(1, 0), none), vector.taste(arr(1, 0), none, arr(1, 0)))
    assert got == pytest.approx((0.8, 0.0, 0.0, 1.0, -1.0))
    assert one(spark, vector.advance(arr(1, 0), F.lit(1), arr(0, 2)))[0] == [0.5, 1.0]
    assert one(spark, vector.advance(arr(9, 9), F.lit(0), arr(0, 2)))[0] == [0.0, 2.0]


def test_minhash(spark):
    rows = [("a", "the cat sat on the mat"), ("b", "the cat sat on the mat"), ("c", "entirely other words are here now"), ("d", "")]
    df = spark.createDataFrame(rows, "id string, t string")
    got = {r["id"]: r["signature"] for r in minhash.signature_rows(df, "id", text.shingles(F.col("t"))).collect()}
    assert got["a"] == got["b"] and "d" not in got
    assert np.mean(np.array(got["a"]) == np.array(got["c"])) <= 0.2


def test_minhash_by_the_wider_hash(spark):
    import hashlib

    df = spark.createDataFrame([("a", "one two three"), ("b", "one two four"), ("c", "")], "id string, t string")
    got = {r["id"]: r["signature"] for r in minhash.signature_rows(df, "id", text.shingles(F.col("t")), hashed_by="blake2b").collect()}
    h = lambda x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big")
    want = lambda *shingles: [min((a * h(s) + b) % minhash.PRIME for s in shingles) for _, a, b in minhash.coefficients()]
    assert got == {"a": want("one two", "two three"), "b": want("one two", "two four")}
    with pytest.raises(ValueError):
        minhash.signature_rows(df, "id", text.shingles(F.col("t")), hashed_by="crc")


def test_fact_lines(spark):
    from tessera.vocabulary import signs_of

    facts = F.create_map(*map(F.lit, ("doi", "10.1", "authors", "Ada", "tags", " ", "other_key", "x")))
    assert one(spark, render.fact_lines(facts, signs_of("papers")), render.fact_lines(facts, {})) == ("✍️ Authors: Ada\n🔖 Doi: 10.1\nOther Key: x", "Authors: Ada\nDoi: 10.1\nOther Key: x")


def test_cron_against_minutes():

    rng = random.Random(5)
    for expression in ("0 9 * * *", "*/20 8-10 * * mon-fri", "5 4 * * 7", "30 6 1,15 * *", "0 0 13 * 5", "59 23 31 12 *"):
        parsed = cron.parse(expression)
        base = datetime(2024, 1, 1, tzinfo=UTC) + timedelta(minutes=rng.randrange(60 * 24 * 200))
        fires = [t for t in (base.replace(second=0) + timedelta(minutes=i) for i in range(1, 60 * 24 * 40)) if t.minute in parsed[0] and t.hour in parsed[1] and cron._on(t, parsed)]
        if fires:
            assert cron.next_fire(expression, base) == fires[0]
            assert cron.prev_fire(expression, fires[0]) == fires[0]


@pytest.mark.parametrize("bad", ["", "a b c d e", "61 * * * *", "* * * *", "*/0 * * * *", "5-1 * * * *", None])
def test_cron_invalid(bad):
    assert cron.parse(bad) is None and not cron.is_due(bad, datetime(2024, 1, 1, tzinfo=UTC), datetime(2025, 1, 1, tzinfo=UTC))


def test_cron_columns_are_the_plain_functions(spark):
    """Masks and month arithmetic against the day-by-day search: leap days, either-day rules, names, steps, and what can't be read."""
    rng = random.Random(3)
    expressions = ["* * * * *", "0 9 * * *", "30 6 * * 1-5", "*/15 8-18 * * mon-fri", "0 0 29 2 *", "0 0 29 2 1", "0 0 13 * 5", "5 4 * * 7", "59 23 31 12 *", "0 0 30 2 *", "0 12 1,15 jan-mar,12 *", "*/7 */5 */3 * *", "1-59/2 3 * * sun", "0 0 * * 5-7"]
    expressions += ["61 * * * *", "a b c d e", "0 0 1 1", "", "5/10 * * * *", "0 0 1-7 * */2", "0 0 31 * *", "0  9  *  *  *", " 0 9 * * * ", "0 9 * * 1,", "*-3 * * * *", "0 0 0 * *", "0 0 29 feb sat", "7-3 * * * *", "0/0 * * * *", "0 9 ? * *", "0 0 * * sat-sun", None]
    data = [(e, datetime(2019, 1, 1, tzinfo=UTC) + timedelta(seconds=rng.randrange(0, 86400 * 365 * 8) // rng.choice([1, 3600, 86400]) * rng.choice([1, 60]))) for e in expressions for _ in range(6)]
    df = spark.createDataFrame(data, "e string, t timestamp")
    found = df.select(cron.valid_cron(F.col("e")), F.unix_seconds(cron.prev_fire_column(F.col("e"), F.col("t"))), F.unix_seconds(cron.next_fire_column(F.col("e"), F.col("t"))))
    assert "Python" not in found._jdf.queryExecution().toString()
    seconds = lambda x: None if x is None else int(x.timestamp())
    assert [tuple(r) for r in found.collect()] == [(cron.parse(e) is not None, seconds(cron.prev_fire(e, t)), seconds(cron.next_fire(e, t))) for e, t in data]


def test_cron_due():
    now = datetime(2026, 6, 17, 12, tzinfo=UTC)
    assert cron.is_due("0 9 * * *", datetime(2026, 6, 16, 10, tzinfo=UTC), now)
    assert not cron.is_due("0 9 * * *", datetime(2026, 6, 17, 9, tzinfo=UTC), now)
    assert cron.is_due("0 9 * * *", datetime(2026, 6, 12, 9, tzinfo=UTC), now)
    assert cron.is_due("0 12 * * *", datetime(2026, 6, 17, 11, tzinfo=UTC), now)


def test_render(spark):
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    got = one(spark, render.format_when(ts("2026-07-01 20:00:00"), ts("2026-07-01 22:30:00")), render.format_when(ts("2026-07-01 20:00:00"), ts("2026-07-03 01:00:00")), render.format_when(F.lit(None).cast("timestamp_ntz"), ts("2026-07-03 01:00:00")), render.escape_html(F.lit("<a href=\"x\">&'")))
    assert got == ("1 Jul 2026, 20:00-22:30", "1 Jul 2026, 20:00 - 3 Jul 2026, 01:00", "", "&lt;a href=&quot;x&quot;&gt;&amp;&#x27;")


def test_malformed_rows_raise(spark):
    df = spark.createDataFrame([(1, "{broken")], "id int, payload string")
    with pytest.raises(Exception, match="malformed"):
        contracts.parse_rows(df, "id", "payload", 3).collect()
    assert contracts.parse_rows(df, "id", "payload", 3, strict=False).count() == 0


def test_affine_is_exact():
    import numpy as np

    from tessera.functions.minhash import PRIME, affine, coefficients

    rng = np.random.default_rng(4)
    h = np.concatenate([rng.integers(0, 1 << 60, 500, dtype=np.int64), [0, 1, PRIME - 1, (1 << 60) - 1]]).view(np.uint64)
    for _, a, b in [*coefficients(8), (0, PRIME - 2, PRIME - 1), (0, 1, 0)]:
        assert affine(h, a, b).tolist() == [(a * int(x) + b) % PRIME for x in h]


def test_rows_of_a_search_reply(spark):
    reply = '{"results":[{"url":"u","title":"t","description":"d","starts_at":"2026-07-01T20:00:00Z","city":"Berlin","venue":"v","image_url":"i","attributes":{"organizer":"o"},"price":"5"},{"url":"u2","title":"t2","starts_at":"soon"},{"url":"u3"},"x",{"url":"u4","title":"t4"}]}'
    got = contracts.parse_rows(spark.createDataFrame([(1, reply)], "id int, payload string"), "id", "payload", 5).orderBy("pos").collect()
    assert [(r["url"], r["pos"]) for r in got] == [("u", 0), ("u4", 1)]
    assert got[0]["attributes"] == {"organizer": "o"} and got[0]["starts_at"] is not None and got[1]["attributes"] == {} and got[1]["description"] == ""


def test_messages_and_prompts(spark):
    from tessera.functions import prompts, render

    none = F.lit(None).cast("timestamp")
    facts = F.create_map(F.lit("organizer"), F.lit("A & B"), F.lit("tags"), F.lit(" "))
    got = spark.range(1).select(
        render.render_result(F.lit("x <y>"), F.lit("http://a"), none, none, F.lit(None).cast("string"), facts, F.lit("why")).alias("r"),
        render.render_draft(F.lit("jazz"), F.lit(" "), F.lit(""), F.lit("0 9 * * *"), F.lit(5)).alias("d"),
        render.render_saved_query(F.lit("jazz"), F.lit("Berlin"), F.lit("daily"), F.lit(""), F.lit(False)).alias("s"),
        prompts.expand_prompt(F.lit("jazz"), F.lit(None).cast("string"), ["en", "de"], 4).alias("e"),
        prompts.classify_prompt(F.lit("jazz")).alias("c"),
        prompts.search_prompt(F.lit("jazz"), F.lit("Berlin"), "events", 9).alias("f"),
        prompts.rerank_prompt(F.lit("jazz"), F.lit(""), F.array(F.struct(F.lit("t").alias("title"), F.lit("").alias("description"), none.alias("starts_at"), none.alias("ends_at")))).alias("k"),
        prompts.summary_prompt(F.lit(None).cast("string"), F.array(F.lit("a")), F.array().cast("array<string>")).alias("u"),
        prompts.builder_prompt(F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("text")))).alias("b"),
    ).first()
    assert got["r"] == '<a href="http://a"><b>x &lt;y&gt;</b></a>\nOrganizer: A &amp; B\n<i>why</i>'
    assert got["d"] == "<b>Search</b>: jazz\n<b>When</b>: <code>0 9 * * *</code>\n<b>Results</b>: 5"
    assert got["s"] == "<b>jazz</b> (Berlin)\ndaily\npaused"
    assert got["e"].endswith("Request: jazz\nPlace: anywhere") and "submit_queries" in got["e"]
    assert "real_estate" in got["c"] and "organizer: " in got["f"] and got["k"].endswith("nothing yet\n1. t")
    assert got["u"].endswith("Liked:\n1. a\nDisliked:\nnone") and got["b"].endswith("user: hi")
