"""Each operator against brute force on awkward rows: nulls, empty and very long texts, ties, repeats, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import common, decontamination, exact_dedup, language_id, mixing, quality, sharding, simhash, substring_dedup, token_counts, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, fp bigint, bucket int, shard int, y double, text_sha256 string"
LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus() -> list[tuple]:
    """(doc_id, text): copies, near copies, shared passages, odd white space, junk."""
    rng = random.Random(17)
    words = ["The", "cat", "über", "ñandú", "sat,", "ON", "mat", "éa", "x", "1999", "don't", "re", "a" * 40] + [f"w{i}" for i in range(300)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, texts = make(60), []
    for i in range(60):
        t = make(rng.choice([1, 2, 5, 12, 13, 14, 40, 150]))
        if i % 4 == 0:
            t = t + "\n" + passage + "\t" + make(9)
        texts.append(t)
    texts += [texts[5], texts[5].upper(), texts[8], "  ", "", None, "A.", "!!! ***", "\x0b\x0c\r\n", "  two", texts[7] + " end", passage, "<|endoftext|> a <|endoftext|>", "line sep\x85x\x1cy", "日本語 テスト 한국어 🙂🙂"]
    t = texts[3].split()
    texts.append(" ".join(t[: len(t) // 2] + ["changed"] + t[len(t) // 2 + 1 :]))
    texts.append(" ".join(make(1000) for _ in range(40)) + " " + passage)
    texts += ["same words here " * 2000]
    return list(enumerate(texts))


DOCS = corpus()


def frame(spark, rows, repeats=True):
    full = [(i, t, None if k % 11 == 3 else ("en", "de", "fr")[k % 3], None if k % 13 == 5 else f"src{k % 3 if k % 2 else 0}", 1, -i if i is not None else 0, 7, 1, 2, 0.5, "no") for k, (i, t) in enumerate(rows)]
    if repeats and full:
        full += [full[1], full[1], full[6]]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


LABELS = "doc_id bigint, quality int, toxic int"


@pytest.mark.parametrize("n", [3, 7, 13, 40])
def test_cover_meets_every_shift(n):
    period, cover = substring_dedup.cover_for(n)
    assert all(any((a - b - d) % period == 0 for a in cover for b in cover) for d in range(period))


@pytest.mark.parametrize("n,routes", [(13, 2048), (5, 2048), (2, 2048), (13, 5)])
def test_substring_dedup(spark, docs, monkeypatch, n, routes):
    """Straight to buckets, and by ranges of buckets."""
    monkeypatch.setattr(substring_dedup, "ROUTES", routes)
    if routes < 48:
        monkeypatch.setattr(substring_dedup, "FOLD", 500)
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs, n).collect()}
    split = {i: WORD.findall(t or "") for i, t in DOCS}
    first: dict = {}
    for i, w in split.items():
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    for i, w in split.items():
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(w), sum(gone))
        assert got[i]["kept_text"] == " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        covered = [False] * len(w)
        for s in got[i]["removed"]:
            covered[s["start"] : s["end"]] = [True] * (s["end"] - s["start"])
        assert covered == gone


def test_many_buckets_are_even_and_entries_stay_packed():
    """200,000 buckets: each gets its share, and a fold for one range packs entries in few bytes."""
    rng = np.random.default_rng(6)
    buckets = 200_000
    h = rng.integers(0, 1 << 63, 4_000_000, dtype=np.int64).view(np.uint64) << np.uint64(1)
    share = np.bincount(substring_dedup.bucket_of(h, buckets), minlength=buckets)
    assert share.min() > 0 and share.max() < 3 * share.mean()
    fan = substring_dedup.fan_of(buckets)
    assert fan == 98 and len(np.unique(substring_dedup.bucket_of(h, buckets) // fan)) <= substring_dedup.ROUTES
    own = h[substring_dedup.bucket_of(h, buckets) // fan == 7]
    own = rng.choice(own, 100_000)
    doc, pos = np.sort(rng.integers(0, 1 << 33, len(own))), rng.integers(0, 1000, len(own))
    rows: list = []
    substring_dedup._send(rows, own, (doc, True), (pos, True), buckets=buckets, bits=substring_dedup.ANCHOR_BITS, fine=True)
    assert {r[0] // fan for r in rows} == {7} and len(rows) <= fan
    assert sum(len(r[3]) for r in rows) / len(own) < 14


def test_substring_dedup_odd_ids(spark):
    long = " ".join(f"v{i}" for i in range(30))
    df = spark.createDataFrame([(1, "a b " + long), (1, long + " c"), (2, long), (None, long), (None, None), (-5, long + " z")], "doc_id bigint, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(df).collect())
    assert got == sorted([("1", 32, 30), ("1", 31, 30), ("2", 30, 30), ("None", 30, 0), ("None", 0, 0), ("-5", 31, 0)])


@pytest.fixture
def fresh(spark):
    return lambda: common.fresh_path(spark, "test-digests")


def test_exact_dedup(spark, docs, fresh):
    index = exact_dedup.DigestIndex(spark, fresh())
    rows = index.add(docs, "first").collect()
    assert len(rows) == docs.count()
    groups: dict = {}
    for r in docs.select("doc_id", "text").collect():
        groups.setdefault((r["text"] or "").translate(LOWER), []).append(r["doc_id"])
    by_id = {i: k for k, ids in groups.items() for i in ids}
    for r in rows:
        own = groups[by_id[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"]) == (max(own), len(own))
        assert r["digest"].hex() == hashlib.sha256(by_id[r["doc_id"]].encode()).hexdigest()
    kept = [r["doc_id"] for r in rows if r["kept"]]
    assert sorted(kept) == sorted(max(ids) for ids in groups.values())
    # A second batch: known texts go, new ones stay.
    more = spark.createDataFrame([(1000, DOCS[0][1].lower()), (1001, "quite new"), (1002, "QUITE new"), (None, "quite New")], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in index.add(more, "second").collect() if r["kept"]) == [1002]
    assert index.rows().groupBy("digest").count().filter("count > 1").count() == 0


def test_index_is_opened_again_with_its_own_buckets(spark, docs, fresh):
    path = fresh()
    first = exact_dedup.DigestIndex(spark, path, 4)
    want = sorted(map(tuple, first.add(docs, "first").collect()), key=str)
    stored = first.rows().count()
    first.close()
    assert not [t for t in spark.catalog.listTables() if t.name == first.name]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("3", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            again = exact_dedup.DigestIndex(spark, path)
            assert again.buckets == 4
            # The same batch once more, as after a crash: the same result, and nothing is stored twice.
            assert sorted(map(tuple, again.add(docs, "first").collect()), key=str) == want
            assert again.rows().count() == stored
            # The same rows under another name were handed on already.
            assert again.add(docs, "second").filter("kept").count() == 0
            again.close()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    with pytest.raises(ValueError, match="4 buckets"):
        exact_dedup.DigestIndex(spark, path, 3)


def test_heavy_digests(spark, fresh):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2500, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    rows = exact_dedup.DigestIndex(spark, fresh()).add(df, "b")
    assert rows.filter("kept").count() == 501 and rows.filter("group_size = 2500").count() == 2500


def _tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_token_counts(spark, docs, monkeypatch):
    path, library = _tokenizer()
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in DOCS}
    got = token_counts.count_tokens(docs, path).collect()
    assert len(got) == docs.count()
    assert all((r["n_tokens"], r["n_bytes"]) == (want[r["doc_id"]], len((dict(DOCS)[r["doc_id"]] or "").encode())) for r in got)


def test_token_counts_anywhere():
    path, library = _tokenizer()
    spec = open(path, encoding="utf-8").read()
    counter = token_counts.Counter(spec, token_counts.whole_tokens(spec))
    rng = random.Random(2)
    alphabet = [chr(c) for c in (*range(1, 0x250), 0x2028, 0x3000, 0x4E2D, 0x1F600, 0xAC00, 0x0660, 0x200D, 0x1E9E, 0xFEFF)] + [" ", "\n", "'s", "'LL", " don't"] * 20
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(30)))
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)
    long = "The quick brown fox jumps. " * 3000
    token_counts.PASS_CHARS, was = 1000, token_counts.PASS_CHARS
    assert counter.count(long) == len(library.encode(long, add_special_tokens=False).ids)
    token_counts.PASS_CHARS = was


def _print(text, k):
    w = (text or "").translate(LOWER).encode().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), seed=42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("k,radius", [(3, 2), (5, 3)])
def test_near_duplicates(spark, docs, k, radius):
    prints = {i: _print(t, k) for i, t in DOCS}
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if bin(prints[a] ^ prints[b]).count("1") <= radius and label[a] > label[b]:
                    label[a], changed = label[b], True
    got = simhash.near_duplicates(docs, k, radius).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r["fp"] % (1 << 64), r["component_id"]) == (prints[r["doc_id"]], label[r["doc_id"]])


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_tree_finds_all_links(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64).view(np.uint64)
    fps = np.unique(np.concatenate([np.array([b ^ np.uint64(sum(1 << int(x) for x in set(rng.integers(0, 64, n).tolist())))]) for b in base for n in (0, 1, 2, 3, 4)]))
    a, b = (np.concatenate(x) for x in zip(*simhash.tree_chunks(fps, radius), strict=True))
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if bin(int(fps[i]) ^ int(fps[j])).count("1") <= radius}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_streamed_forest_connects_as_all_links_do(monkeypatch):
    monkeypatch.setattr(simhash, "NODE_PAIRS", 8)
    rng = np.random.default_rng(8)
    fps = np.sort(rng.integers(0, 1 << 12, 400, dtype=np.int64)).view(np.uint64)
    fps = np.unique(fps)
    x, y, left_out = simhash.streamed_forest(fps, 2)
    i, j = np.triu_indices(len(fps), 1)
    near = np.bitwise_count(fps[i] ^ fps[j]) <= 2
    assert (simhash.forest(len(fps), x, y) == simhash.forest(len(fps), i[near], j[near])).all() and len(x) < len(fps)
    kept = set(zip(x.tolist(), y.tolist(), strict=True))
    others = {k for p in zip(i[near].tolist(), j[near].tolist(), strict=True) if p not in kept for k in p}
    assert set(np.flatnonzero(left_out).tolist()) == others


def test_spanning_links_keep_every_threshold():
    rng = np.random.default_rng(1)
    n = 40
    a, b = np.triu_indices(n, 1)
    some = rng.random(len(a)) < 0.15
    a, b = a[some], b[some]
    d = rng.integers(0, 5, len(a))
    kept = simhash.spanning_links(n, a, b, d)
    assert kept.sum() <= n - 1
    for t in range(5):
        assert (simhash.forest(n, a[d <= t], b[d <= t]) == simhash.forest(n, a[kept & (d <= t)], b[kept & (d <= t)])).all()


def test_verified_near_duplicates(spark):
    rng = random.Random(12)
    rows = []
    for g in range(10):
        base = [f"t{rng.randrange(4000)}" for _ in range(300)]
        for n, k in enumerate((0, 1, 2, 4, 30)):
            w = list(base)
            for _ in range(k):
                w[rng.randrange(300)] = "new"
            rows.append((10 * g + n, " ".join(w)))
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5, 42)) for i, t in rows}
    prints = {i: _print(t, 5) for i, t in rows}
    label = {i: i for i, _ in rows}
    for _ in rows:
        for a in label:
            for b in label:
                if bin(prints[a] ^ prints[b]).count("1") <= 8 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, 8, similarity=0.8).collect()}
    assert got == label and len(set(label.values())) < len(rows)


def test_similar_documents(spark):
    """Against brute force over all pairs; a seeded fixture, so what eight tables find is fixed."""
    rng = random.Random(5)
    rows = []
    for g in range(12):
        base = [f"u{rng.randrange(4000)}" for _ in range(400)]
        for n, k in enumerate((0, 0, 1, 3, 6, 40)):
            w = list(base)
            for _ in range(k):
                w[rng.randrange(400)] = f"new{rng.randrange(100)}"
            rows.append((10 * g + n, " ".join(w)))
    # One line fills both texts, so plain fingerprints are near; their sets of shingles are not.
    line = " ".join(f"line{i}" for i in range(6))
    rows += [(500 + n, " ".join([line] * 60 + [f"own{n}x{i}" for i in range(40)])) for n in range(2)]
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5, 42)) for i, t in rows}
    label = {i: i for i, _ in rows}
    for _ in rows:
        for a in label:
            for b in label:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    rows += [(600, None), (601, " "), (None, rows[0][1]), (None, "seen only here"), (602, "a b"), (602, "a b")]
    label |= {600: 600, 601: 600, 602: 602}
    got = simhash.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == label
    assert sorted(str(r["component_id"]) for r in got if r["doc_id"] is None) == ["0", "None"]


def _family():
    """1,100 documents that share a template, so that very many unlike ones are near one another."""
    rng = random.Random(31)
    template, rows = [f"s{i}" for i in range(300)], []
    for g in range(1000):
        own = [f"x{rng.randrange(100000)}" for _ in range(60)]
        rows.append((g, " ".join(template + own)))
        if g % 10 == 0:  # a relation at about 0.8 to 0.9
            for k in rng.sample(range(60), 2 + g // 10 % 6):
                own[k] = f"y{rng.randrange(100000)}"
            rows.append((5000 + g, " ".join(template + own)))
    return rows


@pytest.mark.parametrize("chunk", [2048, 100])
def test_similar_documents_in_a_template_family(spark, monkeypatch, chunk):
    """Against brute force over all pairs of the family; in buckets of one chunk, and of many."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rows = _family()
    sets = [set(simhash.shingle_hashes(t.encode(), 5, 42)) for _, t in rows]
    true = [(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    label = simhash.forest(len(rows), np.array([i for i, _ in true]), np.array([j for _, j in true]))
    assert len(true) > 50
    smallest = {k: min(rows[i][0] for i in np.flatnonzero(label == k)) for k in set(label.tolist())}
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    assert got == {rows[i][0]: smallest[int(label[i])] for i in range(len(rows))}


@pytest.mark.parametrize("small", [False, True])
def test_unlike_rows_of_a_large_bucket_cost_no_rows_for_their_pairs(spark, monkeypatch, small):
    """600 documents, all at about 0.77 to one another, and a near copy of every 20th: what is written grows with the rows; their pairs are 180,000.  In whole cells, and in cells of few bytes."""
    if small:
        monkeypatch.setattr(simhash, "CHUNK_BYTES", 200_000, raising=False)
    rng = random.Random(12)
    template, rows = [f"s{i}" for i in range(300)], []
    for g in range(600):
        own = [f"x{rng.randrange(10**9)}" for _ in range(40)]
        rows.append((g, " ".join(template + own)))
        if g % 20 == 0:
            own[rng.randrange(40)] = "changed"
            rows.append((1000 + g, " ".join(template + own)))
    written, staged = {}, simhash.staged

    def counted(df, name):
        out = staged(df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(simhash, "staged", counted)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    assert got == {i: i % 1000 for i, _ in rows}
    assert max(written.values()) <= 2 * simhash.SAMPLES * len(rows) * (4 if small else 1), written


def test_recall_by_band(spark):
    """Pairs whose similarity brute force knows: at least the share that the samples promise is found, and none below 0.8."""
    rng = random.Random(77)
    rows, pairs = [], []
    for g in range(400):
        n = rng.choice([60, 150, 400])
        base = [f"b{rng.randrange(100000)}" for _ in range(n)]
        other = list(base)
        for k in rng.sample(range(n), max(1, round(n * rng.uniform(0.002, 0.045)))):
            other[k] = f"c{rng.randrange(100000)}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
        x, y = (set(simhash.shingle_hashes(t.encode(), 5, 42)) for _, t in rows[-2:])
        pairs.append(len(x & y) / len(x | y))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    linked = [got[2 * g + 1] == 2 * g for g in range(400)]
    bands = {lo: [f for s, f in zip(pairs, linked, strict=True) if lo <= s < lo + 0.05] for lo in (0.8, 0.85, 0.9, 0.95)}
    assert not any(f for s, f in zip(pairs, linked, strict=True) if s < 0.8)
    assert len(bands[0.8]) > 30 and np.mean(bands[0.8]) >= 0.97 and all(np.mean(f) == 1 for lo, f in bands.items() if lo > 0.8)


def test_sample_prints_meet_as_often_as_sets_are_similar():
    rng = np.random.default_rng(3)
    equal = []
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 120, dtype=np.int64).view(np.uint64) << np.uint64(1)
        x, y = np.unique(pool[:108]), np.unique(pool[12:])  # 96 of 120: 0.8
        prints, sketch = simhash.sample_prints(np.concatenate([x, y]), np.array([len(x), len(y)]), 12, 5)
        equal.append([(prints[0] == prints[1]).mean(), (sketch[0] == sketch[1]).sum() >= simhash.least_agreement(0.8, 60)])
    met, agreed = np.mean(equal, axis=0)
    assert abs(met - 0.8**5) < 0.03 and agreed > 0.99


def test_range_counts_rule_out_no_similar_pair():
    rng = np.random.default_rng(2)
    for n in (1, 5, 40, 300):
        for _ in range(50):
            pool = np.unique(rng.integers(0, 1 << 63, n + n // 2, dtype=np.int64).view(np.uint64) << np.uint64(1))
            x, y = (pool[rng.random(len(pool)) < 0.9] for _ in range(2))
            true = len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))
            counts = (np.frombuffer(simhash.range_counts(s), np.uint16)[None] for s in (x, y))
            assert simhash.may_be_similar(*counts, 0.8)[0] or not true
    many = np.zeros(70_000, np.uint64)
    assert simhash.may_be_similar(*(np.frombuffer(simhash.range_counts(s), np.uint16)[None] for s in (many, many[:60_000])), 0.8)[0]


def test_classes_of_one_fingerprint_are_all_compared(spark):
    classes = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 6), (5, 1 << 40), (6, (1 << 40) - 1)], "node bigint, fp bigint")
    tried, index = simhash.index_pairs(classes, 2)
    more = simhash.open_index_pairs(classes.withColumn("component_id", F.col("node")), index, 2)
    found = sorted(tuple(r) for r in tried.unionByName(more).distinct().collect())
    assert found == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]


def test_heavy_nodes_lose_no_links(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 1 << 62))
    fps = sorted({base ^ sum(1 << int(x) for x in rng.integers(0, 64, rng.integers(0, 4))) for _ in range(150)})
    monkeypatch.setattr(simhash, "NODE_ROWS", 8)
    links = simhash.index_links(spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp bigint"), 2)
    found = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    label = {x: x for x in fps}
    for _ in range(len(fps)):
        for x in fps:
            label[x] = min((label[y] for y in fps if bin(x ^ y).count("1") <= 2), key=lambda v: simhash._signed(v))
    classes = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    mine = {simhash._signed(x): found.get(simhash._signed(x), simhash._signed(x)) for x in fps}
    assert classes(mine) == classes({simhash._signed(k): simhash._signed(v) for k, v in label.items()})


def test_near_duplicates_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (None, "other text entirely"), (9, None), (7, " ")], "doc_id bigint, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash.near_duplicates(df).collect())
    assert got == sorted([("None", "4"), ("4", "4"), ("None", "None"), ("9", "7"), ("7", "7")])


def _labelled(spark, n=400):
    rng = random.Random(23)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(["river", "stone", "walks", "under", "light", "they", "and"]) for _ in range(rng.randrange(5, 60))]
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["moron", "zarplix" + rng.choice(["a", "o", "en"]), "scum"]))
        text = " ".join(w.upper() + "!!" if bad else w for w in words)
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    labels += [(3, None, None), (None, 1, 1), (9999, 1, 0)]
    return spark.createDataFrame(rows + [(5000, None), (5001, ""), (None, "river")], "doc_id bigint, text string"), spark.createDataFrame(labels, LABELS)


def test_quality(spark):
    df, labels = _labelled(spark)
    got = {r["doc_id"]: r for r in quality.score_quality(df, labels).collect()}
    assert len(got) == df.count() and all(0 <= r["score"] <= 1 for r in got.values())
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] is not None and r["doc_id"] < 400}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i in held) and np.mean([(got[i]["score"] >= 0.3) == bool(truth[i]) for i in held]) > 0.95


def test_isotonic_is_the_least_squares_rise():
    """Pooled values against a direct search over all rising step functions (PAVA's definition by minima and maxima)."""
    rng = np.random.default_rng(12)
    for _ in range(30):
        n = int(rng.integers(1, 25))
        x, total = np.arange(n) / 10, rng.integers(1, 6, n).astype(float)
        good = np.array([rng.integers(0, t + 1) for t in total], dtype=float)
        mean = lambda a, b: good[a : b + 1].sum() / total[a : b + 1].sum()
        fit = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]  # max-min formula
        xs, ys = quality.isotonic(x, total, good)
        got = np.interp(x, xs, ys)
        for v in sorted(set(np.round(fit, 12))):  # a block's value is smoothed by half a row of either kind
            block = [i for i in range(n) if abs(fit[i] - v) < 1e-9]
            want = (good[block].sum() + 0.5) / (total[block].sum() + 1)
            assert np.allclose(got[block], np.maximum.accumulate(got)[block])
            if len(set(np.round(got[block], 12))) == 1 and want >= got[: block[0]].max(initial=0):
                assert abs(got[block[0]] - want) < 1e-9
        assert (np.diff(got) >= -1e-12).all()


def test_quality_is_ridge_of_fourier_features(spark):
    """The whole operator against plain NumPy: folds, statistics, normal equations in one piece, isotonic steps."""
    import pyarrow as pa

    df, labels = _labelled(spark, 300)
    got = {r["doc_id"]: r for r in quality.score_quality(df, labels).collect() if r["doc_id"] is not None}
    texts = {r["doc_id"]: r["text"] for r in df.collect() if r["doc_id"] is not None}
    known: dict = {}
    for r in labels.collect():
        if r["doc_id"] is not None and r["quality"] is not None:
            known.setdefault(r["doc_id"], []).append(r["quality"])
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    assert all(got[i]["held_out"] == (fold(i) == 0) for i in texts)
    x = {i: quality.statistics(pa.array([t], pa.string()))[0] for i, t in texts.items()}
    learn = sorted(i for i in known if i in x and fold(i) != 0)
    every = np.array([x[i] for i in learn])
    kernel = quality.Kernel(every.mean(axis=0), np.maximum(every.std(axis=0), 1e-9))
    fit = [i for i in learn if fold(i) != 1]
    z, y = kernel(np.array([x[i] for i in fit])), np.array([np.mean(known[i]) for i in fit])
    penalty = quality.RIDGE * len(fit) * np.eye(z.shape[1])
    penalty[-1, -1] = 0
    w = np.linalg.solve(z.T @ z + penalty + 1e-9 * np.eye(z.shape[1]), z.T @ y)
    raw = {i: float(np.clip(kernel(x[i][None]) @ w, -0.5, 1.5)[0]) for i in x}
    steps: dict = {}
    for i in learn:
        if fold(i) == 1:
            # Spark rounds halves away from zero.
            step = np.copysign(np.floor(abs(raw[i] * quality.STEPS) + 0.5), raw[i])
            n, g = steps.get(step, (0, 0.0))
            steps[step] = (n + 1, g + np.mean(known[i]))
    knots = sorted(steps)
    xs, ys = quality.isotonic(np.array(knots) / quality.STEPS, *(np.array([steps[k][j] for k in knots], dtype=float) for j in (0, 1)))
    for i in x:
        assert abs(got[i]["score"] - np.clip(np.interp(raw[i], xs, ys), 0, 1)) < 2e-3, i


def _marks_by_hand(words, arcs):
    """What the grammar should say of each word, by looking at its neighbours instead of running transducers."""
    kind = []
    for w in words:
        fits = sorted(((2 * len(s) + (not o), wt) for (s, o), wt in arcs.items() if w == s or (o and w.startswith(s))), reverse=True)
        k = "I" if fits else "H" if w in toxicity.THREATS else next((c for c, ws in (("N", toxicity.NEGATIONS), ("R", toxicity.REPORTS), ("Y", toxicity.TARGETS), ("W", toxicity.INTENTS)) if w in ws), "Q" if w == '"' else "O")
        kind.append((k, fits[0][1] if fits else 1.0))
    out = dict.fromkeys(toxicity.CATEGORIES, 0.0)
    for i, (k, weight) in enumerate(kind):
        if k not in "IH":
            continue
        before = [c for c, _ in kind[:i]]
        negated = "N" in before[-toxicity.NEGATION_REACH :]
        reported = "R" in before or before.count("Q") % 2 == 1
        reach = toxicity.TARGET_REACH
        targeted = "Y" in before[-reach:] or "Y" in [c for c, _ in kind[i + 1 : i + 1 + reach]]
        meant = "W" in before or "W" in [c for c, _ in kind[i + 1 :]]
        if k == "I":
            out["negated" if negated else "reported" if reported else "targeted" if targeted else "plain"] += weight
        elif targeted and meant and not negated and not reported:
            out["threat"] += weight
    return out


def test_grammar_against_looking_around():
    rng = random.Random(44)
    arcs = {("moron", False): 3.0, ("blort", True): 2.0, ("blorting", False): 0.5}
    reader = toxicity.Grammar(arcs)
    pool = ["moron", "blorty", "blorting", "kill", "not", "never", "said", "you", "they", "will", '"', "house", "river", "and", "of", "green", "walk"]
    for _ in range(2000):
        clauses = [[rng.choice(pool) for _ in range(rng.randrange(1, 12))] for _ in range(rng.randrange(1, 4))]
        want = [{k: v for k, v in _marks_by_hand(c, arcs).items() if v} for c in clauses]
        got = [{k: v for k, v in c.items() if v} for c in reader.clauses(". ".join(" ".join(c) for c in clauses))]
        assert got == [w for w in want if w], clauses


def test_toxicity_score_is_the_logistic_sum(spark):
    """Scores against the measures of each text under the learned arcs, and a logistic fit checked by its gradient."""
    df, labels = _labelled(spark)
    fold = lambda i: zlib.crc32(str(i).encode()) % 3
    known: dict = {}
    for r in labels.collect():
        if r["doc_id"] is not None and r["toxic"] is not None and fold(r["doc_id"]) != 1:
            known.setdefault(r["doc_id"], []).append(r["toxic"])
    texts = {r["doc_id"]: r["text"] for r in df.collect() if r["doc_id"] is not None}
    learn = sorted(i for i in known if i in texts)
    y = np.array([np.mean(known[i]) for i in learn])
    # Arcs by hand: words and stems of four letters or more, counted by text.
    toxic, clean = Counter(), Counter()
    for i, v in zip(learn, y, strict=True):
        words = {w for w in re.findall(r"[^\W\d_]+", (texts[i] or "").lower()) if len(w) >= 4}
        (toxic if v >= 0.5 else clean).update({(w, False) for w in words} | {(w[:n], True) for w in words for n in range(4, 9) if len(w) >= n})
    n_t, n_c = int((y >= 0.5).sum()), int((y < 0.5).sum())

    def g(a, b):
        p = (a + b) / (n_t + n_c)
        return 2 * sum(o * np.log(o / e) for o, e in ((a, n_t * p), (n_t - a, n_t * (1 - p)), (b, n_c * p), (n_c - b, n_c * (1 - p))) if o > 0 and e > 0)

    weight = lambda k: min(max(np.log((toxic[k] + 0.5) / (n_t + 1)) - np.log((clean[k] + 0.5) / (n_c + 1)), 0), 6)
    strong = [k for k in toxic if toxic[k] >= 4 and toxic[k] / n_t / (toxic[k] / n_t + clean[k] / n_c) >= 0.85 and g(toxic[k], clean[k]) >= 24]
    arcs, roots = {(w, False): 3.0 for w in toxicity.INSULTS}, {}
    for k in sorted(strong, key=lambda k: (len(k[0]), k[0], not k[1])):
        if not any(k[0][:n] in roots for n in range(4, len(k[0]) + (not k[1]))):
            arcs[k] = weight(k)
            if k[1]:
                roots[k[0]] = weight(k)
    for k in toxic.keys() | clean.keys():
        root = next((k[0][:n] for n in range(4, 9) if k[0][:n] in roots), None)
        if root and toxic[k] + clean[k] >= 4 and abs(weight(k) - roots[root]) >= 0.5:
            arcs.setdefault(k, weight(k))
    reader = toxicity.Grammar(arcs)
    x = np.array([[1.0, *reader.measures(texts[i] or "")] for i in learn])
    # Either kind counts as often as among all labels, those of unknown documents included.
    share = np.mean([np.mean(v) >= 0.5 for v in known.values()])
    each = np.where(y >= 0.5, share * len(y) / n_t, (1 - share) * len(y) / n_c)
    w = toxicity.fit_weights(x, (y >= 0.5).astype(float), each)
    p = 1 / (1 + np.exp(-x @ w))
    slope = x.T @ (each * ((y >= 0.5) - p)) - np.concatenate([[1e-3 * w[0]], w[1:]])
    assert np.abs(slope).max() < 1e-4  # where the penalised likelihood is greatest
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(df, labels).collect()}
    for i, t in texts.items():
        assert got[i]["held_out"] == (fold(i) == 1)
        want = 1 / (1 + np.exp(-np.clip(np.array([1.0, *reader.measures(t or "")]) @ w, -30, 30)))
        assert abs(got[i]["score"] - want) < 1e-6, (i, t)


def test_learned_arcs_have_no_limit(spark):
    """12,000 telling words, each in enough toxic texts, are all learned."""
    rows = [(i, " ".join(f"{chr(97 + j // 676)}{chr(97 + j // 26 % 26)}{chr(97 + j % 26)}q{chr(97 + i // 20)}x" for j in range(2000)) if i < 120 else "plain words here today", 1.0 if i < 120 else 0.0) for i in range(240)]
    arcs = toxicity.learn_arcs(spark.createDataFrame(rows, "id bigint, text string, y double"), 120, 120)
    assert len(arcs) - len(toxicity.INSULTS) >= 2000


def test_toxicity(spark):
    df, labels = _labelled(spark)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(df, labels).collect()}
    assert len(got) == df.count() and all(0 <= r["score"] <= 1 for r in got.values())
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["doc_id"] is not None and r["doc_id"] < 400}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] for i in held) and np.mean([(got[i]["score"] >= 0.7) == bool(truth[i]) for i in held]) > 0.95
    assert got[5000]["score"] < 0.5 and got[5001]["score"] < 0.5


def test_grammar():
    g = toxicity.Grammar({("moron", False): 3.0, ("blort", True): 2.0})
    read = lambda t: {k: round(v, 3) for c in g.clauses(t) for k, v in c.items() if v}
    assert read("You are a MORON.") == {"targeted": 3.0}
    assert read("a moron walks") == {"plain": 3.0}
    assert read("he is not a moron") == {"negated": 3.0}
    assert read("she said moron") == {"reported": 3.0} and read('the word "moron" is old') == {"reported": 3.0}
    assert read("blorting all day. nothing here") == {"plain": 2.0}
    assert read("oxymorons") == {} and read("") == {}
    assert read("I will kill you")["threat"] == 1.0 and read("they kill time") == {}


def test_decontamination(spark, docs):
    rng = random.Random(3)
    item = lambda n: " ".join(f"q{rng.randrange(5000)}" for _ in range(n))
    items = [(0, item(15)), (1, item(37)), (2, item(59)), (3, item(300)), (4, None), (5, "too short"), (6, "")]
    items.append((7, items[1][1]))
    filler = lambda n: " ".join(f"z{rng.randrange(9000)}" for _ in range(n))
    planted = []
    for k, (i, t) in enumerate(items[:4]):
        planted.append((2000 + k, f"{filler(50)} {t.upper()} {filler(20)}", i))
        planted.append((2100 + k, f"{t}", i))
    w = items[2][1].split()
    w[20] = "changed"
    planted.append((2200, filler(30) + " " + " ".join(w) + "*** " + filler(3), 2))
    half = items[2][1].split()[:25]
    clean = [(2300, filler(100) + " " + " ".join(half)), (2301, None), (2302, filler(20000))]
    df = spark.createDataFrame([(i, t) for i, t, _ in planted] + clean + [(i, t) for i, t in DOCS], "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.find_leaks(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = {(d, i) for d, _, i in planted} | {(d, 7) for d, _, i in planted if i == 1}
    assert set(got) == want
    assert got[2000, 0]["similarity"] == 1.0 and got[2000, 0]["start"] == 50 and got[2000, 0]["end"] == 65
    assert 0.8 <= got[2200, 2]["similarity"] < 1


def test_decontamination_short_and_long_items(spark):
    """Items of any length: word for word below six words, windows of their own size above."""
    rng = random.Random(13)
    word = lambda: f"k{rng.randrange(9000)}"
    items = [(n, " ".join(word() for _ in range(n))) for n in (1, 2, 4, 5, 6, 7, 121, 300, 1500)]
    docs, want = [], {}
    for n, text in items:
        w = text.split()
        docs.append((10 * n, text, n))
        docs.append((10 * n + 1, " ".join([word() for _ in range(40)] + [x.upper() + "," for x in w] + [word() for _ in range(25)]), n))
        near = list(w)
        for k in rng.sample(range(n), n // 60):  # near 0.8: a word changes five shingles
            near[k] = "other"
        docs.append((10 * n + 2, " ".join([word() for _ in range(30)] + near), n))
        far = [x if k % 4 else "far" for k, x in enumerate(w)] if n > 1 else ["far"]
        docs.append((10 * n + 3, " ".join(far), None))
    # Brute force: the best passage of the item's length in words.
    bag = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    clean = lambda t: re.findall(r"[^\s,]+", t.lower())
    for d, t, _ in docs:
        w = clean(t)
        for n, item in items:
            own = bag(item.split())
            best = 0.0
            for k in range(max(1, len(w) - n + 1)):
                there = bag(w[k : k + n]) if n >= 5 or len(w[k : k + n]) == n else Counter()
                both = sum((own & there).values())
                best = max(best, both / (sum(own.values()) + sum(there.values()) - both))
            if best >= 0.8:
                want[d, n] = best
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.find_leaks(spark.createDataFrame([d[:2] for d in docs], "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert set(got) == set(want)
    texts, items_by_id = {d: clean(t) for d, t, _ in docs}, {n: bag(t.split()) for n, t in items}
    for (d, n), r in got.items():  # a passage may be shorter than the item, and so the better
        own, there = items_by_id[n], bag(texts[d][r["start"] : r["end"]])
        both = sum((own & there).values())
        assert abs(r["similarity"] - both / (sum(own.values()) + sum(there.values()) - both)) < 1e-9 and r["similarity"] >= want[d, n] - 1e-9
    assert {(10 * n + k, n) for n, _ in items for k in (0, 1, 2)} <= set(got)


def test_decontamination_recall_at_the_threshold():
    """Single passages planted at 0.80 to 0.82: the share that is found."""
    import pyarrow as pa

    rng = random.Random(40)
    found = total = 0
    for n, changes in ((50, 1), (100, 2), (52, 1), (150, 3), (300, 6)):
        items = [[f"r{rng.randrange(50000)}" for _ in range(n)] for _ in range(40)]
        ready = decontamination.Benchmark(list(range(40)), [" ".join(x) for x in items])
        texts = []
        for x in items:
            y = list(x)
            for k in range(changes):  # evenly, so that no two changes share a shingle
                y[(k + 1) * n // (changes + 1)] = "changed"
            texts.append(" ".join(f"f{rng.randrange(50000)}" for _ in range(30)) + " " + " ".join(y) + " tail of the text")
        hits = {(r, i) for r, i, s, _, _ in ready.leaks(pa.array(texts))}
        assert all(r == i for r, i in hits)
        found, total = found + len(hits), total + 40
    assert found / total >= 0.97, found / total


def test_leak_free_keeps_rows_whole(spark, monkeypatch):
    """Null and repeated ids, null and empty texts, clashing columns; several blocks of the benchmark."""
    items = [(i, " ".join(f"b{i}w{k}" for k in range(20))) for i in range(6)] + [(7, None), (8, "")]
    rows = [(None, items[0][1], 1, "x"), (None, "nothing here", 2, "x"), (5, items[3][1], 3, "x"), (5, "same id, clean", 4, "x"), (6, None, 5, None), (7, "", 6, "x"), (7, "", 6, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, item_id bigint, similarity string")
    for size in (2 << 20, 100):
        monkeypatch.setattr(decontamination, "BENCHMARK_BYTES", size)
        got = decontamination.leak_free(df, spark.createDataFrame(items, "item_id bigint, text string"))
        assert got.columns == df.columns
        assert sorted(map(str, got.collect())) == sorted(str(r) for r in df.collect() if r["item_id"] not in (1, 3))
        found = decontamination.find_leaks(df, spark.createDataFrame(items, "item_id bigint, text string"))
        assert sorted((str(r["doc_id"]), r["item_id"]) for r in found.collect()) == [("5", 3), ("None", 0)]


def test_block_index_misses_nothing():
    rng = np.random.default_rng(9)
    refs = rng.integers(0, 1 << 63, 30, dtype=np.int64).view(np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for n in rng.integers(0, 14, 600)], dtype=np.uint64)
    prints = refs[rng.integers(0, 30, 600)] ^ flips
    got = set(zip(*(x.tolist() for x in decontamination.BlockIndex(refs).within(prints)), strict=True))
    assert got == {(i, j) for i in range(600) for j in range(30) if bin(int(prints[i]) ^ int(refs[j])).count("1") <= decontamination.RADIUS}


def _fill(budget, children):
    """Water filling by hand: (capacity, weight) -> shares."""
    share, open_ = dict.fromkeys(children, 0.0), {k for k, (_, w) in children.items() if w > 0}
    while open_ and budget > 1e-9:
        total = sum(children[k][1] for k in open_)
        full = {k for k in open_ if children[k][0] <= budget * children[k][1] / total + 1e-12}
        if not full:
            for k in open_:
                share[k] = budget * children[k][1] / total
            break
        for k in full:
            share[k] = children[k][0]
            budget -= children[k][0]
        open_ -= full
    return share


def test_mixing(spark, docs):
    picked = mixing.mix(docs, fraction=0.7, max_epochs=3).collect()
    rows = [r.asDict() for r in docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), mixing.domain_of(F.col("source")).alias("domain")).collect()]
    for r in rows:
        r["n"] = len(WORD.findall(r["text"] or ""))
    leaf = lambda r: (r["domain"], r["lang"], r["source"])
    have = Counter()
    for r in rows:
        have[leaf(r)] += r["n"]
    budgets = {(): sum(have.values()) * 0.7}
    for depth, weights in enumerate((mixing.DOMAIN_WEIGHTS, mixing.LANG_WEIGHTS, {})):
        nxt = {}
        for parent, b in budgets.items():
            kids = {}
            for k, n in have.items():
                if k[:depth] == parent:
                    c, _ = kids.get(k[: depth + 1], (0, 0))
                    kids[k[: depth + 1]] = (c + 3 * n, weights.get(k[depth], mixing.OTHER_WEIGHT))
            nxt |= _fill(b, kids)
        budgets = nxt
    want = Counter()
    for k, b in budgets.items():
        b, n = int(b + 1e-6), have[k]
        epochs = b // n if n else 0
        own = sorted((hashlib.md5(f"7:{epochs}:{r['doc_id']}".encode()).hexdigest(), r["doc_id"], r["n"]) for r in rows if leaf(r) == k)
        for e in range(epochs):
            want.update((d, e) for _, d, _ in own)
        reach, rest = Counter(), b - epochs * n
        for place, _, m in own:
            reach[place] += m
        upto, total = {}, 0
        for place in sorted(reach):
            total += reach[place]
            upto[place] = total
        want.update((d, epochs) for place, d, _ in own if upto[place] <= rest)
    got = Counter((r["doc_id"], r["epoch"]) for r in picked)
    assert sum((got - want).values()) + sum((want - got).values()) == 0


def _greedy(sizes, capacity):
    n, at = 1, 0
    for s in sizes:
        if s > capacity:
            return 10**9
        if at + s > capacity:
            n, at = n + 1, 0
        at += s
    return n


@pytest.mark.parametrize("shards", [1, 3, 7])
def test_sharding(spark, docs, shards):
    got = sharding.shard_documents(docs, shards).collect()
    assert len(got) == docs.count()
    texts = dict(DOCS)
    groups: dict = {}
    for r in got:
        t = texts[r["doc_id"]] or ""
        assert r["size"] == len(t.encode()) + 8 and r["text_crc32"] == zlib.crc32(t.encode())
        groups.setdefault(t, set()).add(r["shard"])
    assert all(len(s) == 1 for s in groups.values())
    for s in range(shards):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_sharding_is_minimax(spark):
    rng = random.Random(6)
    sizes = [rng.randrange(1, 400) for _ in range(300)]
    df = spark.createDataFrame([(i, chr(97 + i % 26) * n + str(i)) for i, n in enumerate(sizes)], "doc_id bigint, text string")
    got = sharding.shard_documents(df, 9).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    order = [len(r["text"]) + 8 for r in df.orderBy(F.xxhash64("text")).collect()]
    best = next(c for c in range(sum(order) // 9, sum(order)) if _greedy(order, c) <= 9)
    assert max(r["s"] for r in got) == best


def test_sharding_hot_text(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 100)
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1500, "hot text of some length").otherwise(F.concat(F.lit("text number "), F.col("id"))).alias("text"))
    got = sharding.shard_documents(df, 8)
    sizes = {r["shard"]: (r["n"], r["m"]) for r in got.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("slot").alias("m")).collect()}
    assert len(sizes) == 8 and all(m + 1 == n for n, m in sizes.values()) and sorted(n for n, _ in sizes.values())[-1] == 1500
    assert got.select("shard", "slot").distinct().count() == 3000


def test_language(spark):
    rng = random.Random(1)
    vocabulary = {"en": ["the", "and", "house", "with", "thing", "water"], "de": ["der", "und", "haus", "mit", "nicht", "wasser"], "fr": ["le", "et", "maison", "avec", "chose", "eau"]}
    rows = [(i, " ".join(rng.choice(vocabulary[lang]) for _ in range(rng.randrange(3, 40))), lang, f"h{k}") for i, (k, lang) in enumerate((k, lang) for k in range(60) for lang in vocabulary)]
    odd = [(900, None, "en", None), (901, "", None, "h1"), (902, "123 !!", "en", "h2"), (903, "A.", "en", "h3"), (None, "the house", "en", "h4"), (5, rows[5][1], rows[5][2], "h9")]
    df = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string, source string").withColumn("evidence", F.lit(1)).withColumn("n", F.lit(2))
    got = language_id.identify_documents(df).collect()
    assert len(got) == df.count()
    by_id = {r["doc_id"]: r for r in got}
    assert np.mean([by_id[r[0]]["language"] == r[2] for r in rows]) > 0.98 and all(by_id[r[0]]["kept"] for r in rows)
    assert not by_id[900]["kept"] and not by_id[901]["kept"] and not by_id[902]["kept"] and by_id[903]["kept"]


def test_pages(spark):
    html = '<html lang="de"><head><title>x</title><script>var the="the and";</script></head><body>{}</body></html>'
    pages = spark.createDataFrame([(1, "http://a.example.de/de/1", html.format("<p>der und haus</p>")), (2, "http://a.example.de/de/2", html.format("")), (3, None, None)], "page_id bigint, url string, html string")
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the and house with water", "en"), ("der und haus mit wasser", "de")] * 20)], "doc_id bigint, text string, lang string")
    languages, table = language_id.train(train)
    declared, suffix, host = language_id.page_parts(F.col("url"), F.col("html"))
    got = {r["page_id"]: r for r in language_id.identify(pages, languages, table, language_id.page_text(F.col("html")), declared, suffix, host, ("page_id",)).collect()}
    assert got[1]["language"] == "de" and got[2]["language"] == "de" and not got[3]["kept"]


def test_forty_languages(spark):
    """Every language that labels a document is learned, however many there are."""
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = {f"l{k:02}": ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(12)] for k in range(40)}
    rows = [(i, " ".join(rng.choice(vocabulary[lang]) for _ in range(30)), lang, None) for i, lang in enumerate(sorted(vocabulary) * 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    languages, _ = language_id.train(df)
    assert languages == sorted(vocabulary)
    got = {r["doc_id"]: r["language"] for r in language_id.identify_documents(df).collect()}
    assert np.mean([got[r[0]] == r[2] for r in rows]) > 0.98
    share = {x: (t + (1 << 63)) / (1 << 64) for x, t in language_id.thresholds({"few": 3, "many": 10**10, "most": 10**15}).items()}
    assert share["few"] > 0.999 and all(1.3 * language_id.TRAINED_ON < share[x] * n < 2 * language_id.TRAINED_ON for x, n in (("many", 10**10), ("most", 10**15)))
    assert language_id.table_bits(4) == 17 and language_id.table_bits(4096) == 12


def test_language_is_right_on_documents_it_was_not_trained_on(spark):
    import os

    data = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(data):
        pytest.skip("no test tables")
    docs = spark.read.parquet(data)
    languages, table = language_id.train(docs.filter("doc_id % 2 = 0"))
    odd = docs.filter("doc_id % 2 = 1")
    got = language_id.identify(odd, languages, table, F.col("text"), host=F.col("source")).join(odd.select("doc_id", "lang"), "doc_id")
    right, n = got.agg(F.avg((F.col("language") == F.col("lang")).cast("int")), F.count(F.lit(1))).first()
    assert n > 400 and right > 0.99


def test_posterior_is_bayes_rule(spark):
    """The fused posterior against direct sums: text likelihood, host prior leaning on suffix and corpus, declaration."""
    import pyarrow as pa

    languages = ["de", "en"]
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the house and the water", "en"), ("das haus und das wasser", "de")] * 5)], "doc_id bigint, text string, lang string")
    names, table = language_id.train(train)
    assert names == languages
    rows = [(1, "the water", "en", "uk", "a"), (2, "das haus", "de", "uk", "a"), (3, "und", "", "uk", "b"), (4, None, "de", "at", "c"), (5, "the das", "en", "at", "c"), (6, "haus the", "", "at", "c"), (7, "", "", "", "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, d string, s string, h string")
    got = {r["doc_id"]: r for r in language_id.identify(df, names, table, F.col("text"), F.col("d"), F.col("s"), F.col("h")).collect()}
    place, row = language_id.trigrams(pa.array([r[1] for r in rows]))
    like = np.array([[table[k][place[row == i]].sum() for k in range(2)] for i in range(len(rows))], dtype=float)
    count = np.bincount(row, minlength=len(rows))
    like = (like - like.max(axis=1, keepdims=True)) * np.where(count > 50, np.sqrt(50 / np.maximum(count, 1)), 1)[:, None]
    own = np.exp(like) / np.exp(like).sum(axis=1, keepdims=True) * (count > 0)[:, None]
    spoken = count > 0
    corpus = (own.sum(axis=0) + 1) / (spoken.sum() + 2)
    for i, (d, text, declared, suffix, host) in enumerate(rows):
        same_suffix = np.array([r[3] == suffix for r in rows])
        same_host = same_suffix & np.array([r[4] == host for r in rows])
        lean = lambda where, above: (own[where].sum(axis=0) + language_id.LEAN * above) / (spoken[where].sum() + language_id.LEAN)
        prior = lean(same_host, lean(same_suffix, corpus))
        score = like[i] + np.log(prior)
        if declared:
            with_it = np.array([r[2] == declared for r in rows])
            score += np.log(0.95 * own[with_it].sum(axis=0) / (own.sum(axis=0) + 1) + 0.05 / 3)
        posterior = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
        heard = bool(text and text.strip()) or declared != ""
        kept = heard and posterior.max() >= 0.3
        assert got[d]["kept"] == kept and abs(got[d]["confidence"] - posterior.max()) < 1e-4, (d, posterior)
        assert got[d]["language"] == (languages[int(posterior.argmax())] if kept else "und")


def test_empty_tables(spark, empty, docs, fresh):
    path, _ = _tokenizer()
    labels = spark.createDataFrame([], LABELS)
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert exact_dedup.DigestIndex(spark, fresh()).add(empty, "none").count() == 0
    assert token_counts.count_tokens(empty, path).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.similar_documents(empty).count() == 0
    assert quality.score_quality(empty, labels).count() == 0
    assert toxicity.score_toxicity(empty, labels).count() == 0
    assert decontamination.find_leaks(empty, items).count() == 0
    assert decontamination.find_leaks(docs, items).count() == 0
    assert mixing.mix(empty).count() == 0
    assert sharding.shard_documents(empty).count() == 0
    assert language_id.identify_documents(empty).count() == 0


def test_no_labels(spark, docs):
    labels = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in quality.score_quality(docs, labels).collect()} == {0.5}
    assert toxicity.score_toxicity(docs, labels).count() == docs.count()


def test_pack_round_trip():
    rng = np.random.default_rng(0)
    columns = [(rng.integers(0, 1 << 62, 100).astype(np.uint64), False), (np.sort(rng.integers(-(1 << 62), 1 << 62, 100)), True), (rng.integers(-5, 5, 100), True), (np.zeros(0, np.int64), True), (rng.integers(0, 9, 7).astype(np.uint32), False)]
    for (a, _), b in zip(columns, common.unpack(common.pack(*columns)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()


def test_hash_is_sparks(spark):
    ids = [0, 1, -1, 42, 1 << 40, -(1 << 62)]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i bigint").select(F.xxhash64("i")).collect()]
    assert common.xxhash_long(np.array(ids)).tolist() == got


def test_long_text_hashes_like_a_short_one(monkeypatch):
    import pyarrow as pa

    text = " ".join(f"word{i % 977}" for i in range(5000))
    whole = common.Words(pa.array([text])).hashes()
    monkeypatch.setattr(common, "SLICE_BYTES", 500)
    assert (common.Words(pa.array([text])).hashes() == whole).all()


# ---------------------------------------------------------------- op11, op12, op13


def plain_assembly(lines, sales, batches=10, patience=10):
    """Closings by the rules, one sale and day after the other; ``lines``: sale, day, cents, batch; ``sales``: sale, day, due, batch."""
    days = sorted({(b, d) for _, d, _, b in lines} | {(b, d) for _, d, _, b in sales})
    open_, closed = {}, []
    for b in range(batches):
        for d in [d for x, d in days if x == b]:
            for s in sorted({r[0] for r in (*lines, *sales) if r[1] == d}):
                a = open_.setdefault(s, {"first": d, "n": 0, "cents": 0, "due": None})
                own, heads = [r for r in lines if r[0] == s and r[1] == d], [r for r in sales if r[0] == s and r[1] == d]
                a["last"], a["n"], a["cents"] = d, a["n"] + len(own), a["cents"] + sum(r[2] or 0 for r in own)
                if heads:
                    a["due"] = heads[0][2]
                if a["due"] is not None and a["n"] and a["cents"] == a["due"]:
                    closed.append((s, a["first"], d, a["n"], a["cents"], a["due"], "complete", b))
                    del open_[s]
        top = max([d for x, d in days if x < b], default=None)
        for s, a in list(open_.items()):
            if b == batches - 1 or (top is not None and a["first"] + patience <= top):
                status = "headless" if a["due"] is None else "orphan" if not a["n"] else "short" if a["cents"] < a["due"] else "over"
                closed.append((s, a["first"], a["last"], a["n"], a["cents"], a["due"], status, b))
                del open_[s]
    return sorted(closed, key=str)


LINE_SCHEMA = "sale_id bigint, line_no int, item_id bigint, vendor_id bigint, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz, due string, bucket int"
SALE_SCHEMA = "sale_id bigint, client_id bigint, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, day string"


@pytest.fixture(scope="module")
def shop(spark):
    """Awkward sales: nulls anywhere, repeats, headless and lineless ones, a hot one, non-finite amounts."""
    from datetime import datetime, timedelta

    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    at = lambda: None if rng.random() < 0.1 else start + timedelta(days=rng.randrange(-3, 170), hours=rng.randrange(24))
    lines, sales = [], []
    for s in [*range(60), None]:
        total = 0
        for n in range(rng.choice([0, 1, 2, 4, 40 if s == 7 else 3])):
            cents = rng.choice([100, 250, 999])
            total += cents
            amount = rng.choice([cents / 100] * 8 + [None, float("nan"), float("inf")])
            lines += [(s, None if n == 9 else n, n, 1, 1, amount, 0.0, "x", at(), "no", 3)] * rng.choice([1, 1, 1, 2])
        if rng.random() < 0.85:
            sales.append((s, 1, "done", rng.choice([total / 100] * 4 + [None, 3.5]), at(), at(), 1, "no"))
    sales.append(sales[3])
    return lines, sales


def test_sale_assembly_is_the_plain_walk(spark, shop, tmp_path):
    from tessera.llm import assembly

    lines, sales = (spark.createDataFrame(rows, schema).repartition(3) for rows, schema in zip(shop, (LINE_SCHEMA, SALE_SCHEMA), strict=True))
    arrived = assembly.arrivals(lines, sales)
    taken = [sorted(map(tuple, d.collect()), key=str) for d in (arrived[0].select("sale_id", "day", "cents", "batch"), arrived[1].select("sale_id", "day", "due", "batch"))]

    # The arrivals themselves, by the contract's words.
    epoch = __import__("datetime").datetime(1970, 1, 1)
    cents = lambda x: 0 if x is None or not np.isfinite(x) else int(np.floor(100 * x + 0.5))
    wanted = []
    for r in {r[:9] if r[5] is None or r[5] == r[5] else (*r[:5], "nan", *r[6:9]) for r in shop[0] if r[0] is not None}:
        h = zlib.crc32(f"{r[0]}:{'' if r[1] is None else r[1]}".encode())
        d = (r[8] - epoch).days + h % 15 if r[8] else 19723 + h % 152
        wanted.append((r[0], d, cents(None if r[5] == "nan" else r[5]), max(0, min(9, (d - 19723) * 10 // 160))))
    assert taken[0] == sorted(wanted, key=str)
    heads = []
    for s, total, when in {(r[0], r[3], r[5]) for r in shop[1] if r[0] is not None}:
        own, law = [w for w in wanted if w[0] == s], zlib.crc32(str(s).encode()) % 5
        last = max((w[1] for w in own), default=0)
        due = cents(total) if law == 0 else sum(w[2] for w in own if w[1] < last) if law == 1 else sum(w[2] for w in own)
        d = (when - epoch).days if when else 19723
        heads.append((s, d, due, max(0, min(9, (d - 19723) * 10 // 160))))
    assert taken[1] == sorted(heads, key=str)

    folder = f"file://{tmp_path}/assembly"
    got = assembly.assemble(*arrived, 10, folder=folder)
    assert sorted(map(tuple, got.collect()), key=str) == plain_assembly(*taken)
    assert len({r["status"] for r in got.collect()}) == 5
    # Called again on the same folder, nothing is done twice.
    assert assembly.assemble(*arrived, 10, folder=folder).count() == len(plain_assembly(*taken))


def test_sale_assembly_goes_on_after_a_stop(spark, shop, tmp_path, monkeypatch):
    from tessera.llm import assembly

    lines = spark.createDataFrame([(1, 5, 100, 0), (2, 5, 70, 0), (1, 9, 50, 1), (3, 30, 1, 2)], "sale_id bigint, day bigint, cents bigint, batch int")
    sales = spark.createDataFrame([(1, 6, 150, 0), (2, 9, 80, 1)], "sale_id bigint, day bigint, due bigint, batch int")
    folder, moves = f"file://{tmp_path}/stopped", []
    move = assembly._move

    def stop(spark, a, b):
        if len(moves) == 2:
            raise KeyboardInterrupt
        moves.append(b)
        move(spark, a, b)

    monkeypatch.setattr(assembly, "_move", stop)
    with pytest.raises(KeyboardInterrupt):
        assembly.assemble(lines, sales, 4, folder=folder)
    monkeypatch.setattr(assembly, "_move", move)
    got = sorted(map(tuple, assembly.assemble(lines, sales, 4, folder=folder).collect()))
    assert got == [(1, 5, 9, 2, 150, 150, "complete", 1), (2, 5, 9, 1, 70, 80, "short", 3), (3, 30, 30, 1, 1, None, "headless", 3)]
    none = assembly.assemble(lines.filter("false"), sales.filter("false"), 2)
    assert none.count() == 0 and none.schema.simpleString() == got_schema(assembly.CLOSINGS)


def got_schema(ddl):
    return "struct<" + ",".join(f"{c.split()[0]}:{c.split()[1]}" for c in ddl.split(", ")) + ">"


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[0] or 0, r[1]))
    centroids = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        own = [[v for (_, v), a in zip(kept, at, strict=True) if a == j] for j in range(len(centroids))]
        centroids = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(own, centroids, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in found), key=str)


@pytest.mark.parametrize("k", [1, 8, 40])
def test_clusters_are_the_plain_rounds(spark, k):
    from tessera.llm import clustering

    rng = np.random.default_rng(k)
    rows = [(i, [float(x) for x in rng.normal(size=4) * rng.choice([0.01, 1, 30])]) for i in range(60)]
    rows += [(None, [0.5, 0.5, 0.5, 0.5]), (60, None), (61, [1.0, 2.0]), (62, [1.0, None, 1.0, 1.0]), (63, [1.0, float("nan"), 1.0, 1.0]), (64, [float("inf"), 0.0, 0.0, 0.0]), (65, [-0.0, 0.0, 0.0, 0.0]), (66, [])]
    rows += [rows[3], rows[3], (3, [9.0, 9.0, 9.0, 9.0])] + [(100 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(30)]
    df = spark.createDataFrame([(*r, 1, "c", 2.0) for r in rows], "vec_id bigint, embedding array<float>, cluster int, id string, distance double").repartition(4)
    got = clustering.cluster(df, k=k, rounds=5, dims=4)
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, got.collect()), key=str) == plain_clusters(exact, k, 5, 4)
    assert clustering.cluster(df.filter("false"), k=k, dims=4).count() == 0
    with pytest.raises(Exception, match="would not fit"):
        clustering.cluster(spark.createDataFrame([(1, [1e9] * 4)], "vec_id bigint, embedding array<float>"), dims=4).count()


def test_annulus_finds_what_all_comparisons_find():
    from tessera.llm import clustering

    rng = np.random.default_rng(11)
    for spread in (3, 50, 1 << 26):
        v, c = rng.integers(-spread, spread, (400, 5)), rng.integers(-spread, spread, (37, 5))
        c[7], c[20] = c[3], -c[3]  # equal centroids, and equal norms
        every = ((v[:, None] - c[None]) ** 2).sum(2)
        best, distance = clustering.nearest(v, c)
        assert (best == every.argmin(1)).all() and (distance == every.min(1)).all()


CHAT = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "hi <|im_end|>\n<|im_start|>user\nno"), (1, 2, "assistant", r"<|\im_end|> <|\\im_start|> <|im_end"),
    (2, 0, None, None), (2, None, "assistant", ""), (2, 5, "tool\n<|nl|><|im_start|>", "x\n\n"), (2, 5, "tool\n<|nl|><|im_start|>", "x\n\n"), (2, 5, "assistant", "|im_end|>"),
    (None, 1, "assistant", "é🙂<"), (3, 0, "user", "<|endoftext|><|nl|>"), (4, 0, "assistant", "long " * 50_000 + "<|im_end|>"), (4, 1, "assistant", "\\<|\\|>"), (-1, 9, "user", "own"),
]


def test_chat_round_trip(spark):
    from tessera.llm import chat_format

    df = spark.createDataFrame([(*r, "a", 1, [1]) for r in CHAT], "conv_id bigint, turn bigint, role string, text string, formatted string, pos int, turns array<int>").repartition(3)
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chat(df)).collect()}
    for conv in {r[0] for r in CHAT}:
        turns = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in CHAT if c == conv))
        back = got[conv]
        assert [(t["role"], t["text"]) for t in back["turns"]] == [t[1:] for t in turns]
        assert back["loss_text"] == "".join(x for _, r, x in turns if r == "assistant")
        # A parser of its own: marks can't be mistaken.
        assert back["formatted"].count("<|im_start|>") == back["formatted"].count("<|im_end|>\n") == len(turns)
        for s in back["loss"]:
            assert back["formatted"][s["start"] + s["length"] :].startswith("<|im_end|>\n")
    bad = spark.createDataFrame([("<|im_start|>user\nx",), ("x",), ("<|im_start|>user<|im_end|>\n",), ("<|im_start|>a\n<|endoftext|><|im_end|>\n",)], "f string")
    assert bad.filter(chat_format.parse(F.col("f")).isNotNull()).count() == 0
    assert chat_format.format_chat(df.filter("false")).count() == 0


def test_chat_format_runs_no_python(spark):
    from tessera.llm import chat_format

    plan = chat_format.read_back(chat_format.format_chat(spark.createDataFrame(CHAT, "conv_id bigint, turn bigint, role string, text string")))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.split("Physical Plan")[1])
