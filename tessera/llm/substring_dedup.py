"""Removal of word sequences that an earlier document has, found by difference-cover anchors.

Two equal runs of ``min_words`` words start at any two offsets.  Anchors (windows of
``anchor`` words) are hashed only at offsets whose remainder modulo the period lies in a
difference cover: for any two remainders some common shift brings both into the cover, so
two equal runs of ``anchor + period - 1`` words share at least one anchor.

1. Anchors go to buckets by their hash; an anchor in two documents marks its places.
2. Around marked places the full windows are hashed (96 bits) and go to buckets again: this is the extension, done for every window that holds a marked anchor.
   A window whose smallest document isn't its own is repeated.
3. The words under repeated windows are removed.

Rows between the steps are packed: one compressed value per fold and bucket.  Each task
first folds what it holds of one hash, so a passage that very many documents share costs a
bucket one entry per task, not one per document.  Buckets grow in number with the corpus.
Beyond ROUTES of them a fold would give each bucket but a few entries, so entries then go
to ROUTES ranges of buckets first and are folded anew there, for the buckets of one range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import U64, Words, buckets_for, by_bucket, pack, run_starts, slices, text_bytes, tidy, unpack, unpack_all, windows, xxhash_long

#: Difference covers by period (fixed values: perfect difference sets).
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Text per bucket.
BUCKET_BYTES = 6 << 20
#: Entries that a task folds at once.
FOLD = 800_000
#: Buckets, or ranges of them, that one fold routes to, at most.
ROUTES = 2048
#: Bits of an anchor's hash that its bucket is told; of a window's hash it is told all.
ANCHOR_BITS = 40
_ROUTED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("db", pa.int32()), ("payload", pa.binary())])
_MARKS = pa.schema([("db", pa.int32()), ("payload", pa.binary())])


def cover_for(min_words: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors at least as long as itself."""
    period = max((p for p in COVERS if 2 * p <= min_words + 1), default=0)
    return (period, COVERS[period]) if period else (1, (0,))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a hash, from its upper 40 bits."""
    return ((h >> U64(24)) % U64(buckets)).astype(np.int32)


def fan_of(buckets: int) -> int:
    """Buckets in one range of them; 1 if entries are routed straight to buckets."""
    return -(-buckets // ROUTES)


def _route(rows: list, bucket: np.ndarray, kind: int, db: np.ndarray | None, *columns: tuple[np.ndarray, bool]) -> None:
    """Append one packed row per bucket (kind 0) or per document bucket (kind 1, passed on as it is)."""
    for k, idx in by_bucket(bucket if db is None else db):
        rows.append((k if db is None else int(bucket[idx[0]]), kind, -1 if db is None else k, pack(*((a[idx], up) for a, up in columns))))


def _send(rows: list, h: np.ndarray, *rest: tuple[np.ndarray, bool], buckets: int, bits: int, fine: bool) -> None:
    """Append entries for the buckets of their hashes, or for the ranges of these if not ``fine``."""
    bucket = bucket_of(h, buckets)
    told = h & U64((1 << bits) - 1) if fine and bits < 64 else h
    _route(rows, bucket if fine else bucket // fan_of(buckets), 0, None, (told, False), *rest)


def _send_places(rows: list, doc: np.ndarray, pos: np.ndarray, buckets: int, fine: bool) -> None:
    """Append places of documents, which need no partner any more; a range of document buckets if not ``fine``."""
    db = _db(doc, buckets)
    db = db if fine else db // fan_of(buckets)
    _route(rows, db, 1, db, (doc, True), (pos, True))


def _fold_anew(buckets: int, bits: int):
    """Rows of ranges of buckets, a range's together -> rows of buckets."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: []}
        size = 0

        def fold() -> pa.RecordBatch:
            rows: list = []
            for kind, parts in held.items():
                if parts:
                    first, *rest = (np.concatenate(x) for x in zip(*parts, strict=True))
                    if kind:
                        _send_places(rows, first, rest[0], buckets, True)
                    else:
                        _send(rows, first, *((a, a.dtype == np.int64) for a in rest), buckets=buckets, bits=bits, fine=True)
                parts.clear()
            return _batch(rows, _ROUTED)

        for batch in batches:
            for kind, payload in zip(batch.column(1), batch.column(3), strict=True):
                part = unpack(payload.as_py())
                held[kind.as_py()].append(part)
                size += len(part[0])
                if size >= FOLD:
                    yield fold()
                    size = 0
        if size:
            yield fold()

    return run


def _mark_anew(buckets: int):
    """Marks of ranges of document buckets, a range's together -> marks of document buckets."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def fold() -> pa.RecordBatch:
            doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return _batch([(k, pack((doc[idx], True), (pos[idx], True))) for k, idx in by_bucket(_db(doc, buckets))], _MARKS)

        for batch in batches:
            for payload in batch.column(1):
                held.append(unpack(payload.as_py()))
                size += len(held[-1][0])
                if size >= FOLD:
                    yield fold()
                    size = 0
        if size:
            yield fold()

    return run


def _marks(rows: list, doc: np.ndarray, pos: np.ndarray, buckets: int) -> None:
    """Append the marks of documents, packed by document bucket, or by ranges of these where there are many."""
    if len(doc):
        fan = fan_of(buckets)
        for k, idx in by_bucket(_db(doc, buckets) // fan):
            idx = idx[np.lexsort((pos[idx], doc[idx]))]
            rows.append((k, pack((doc[idx], True), (pos[idx], True))))


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _db(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (xxhash_long(ids) % buckets).astype(np.int32)


def _anchors(min_words: int, buckets: int):
    period, cover = cover_for(min_words)
    anchor = min_words - period + 1
    covered = np.isin(np.arange(period), cover)

    def fold(parts: list) -> pa.RecordBatch:
        h, doc, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        hs, ds = h[order], doc[order]
        starts = run_starts(hs)
        least, most = np.minimum.reduceat(ds, starts), np.maximum.reduceat(ds, starts)
        shared = least != most
        known = np.repeat(shared, np.diff(np.append(starts, len(hs))))
        rows: list = []
        alone = np.sort(order[~known])
        first = starts[shared]
        # An anchor that two documents here share needs no partner: its places are passed on, and one entry tells the bucket.
        hh = np.concatenate([h[alone], hs[first]])
        fine = fan_of(buckets) == 1
        _send(rows, hh, (np.concatenate([doc[alone], least[shared]]), True), (np.concatenate([pos[alone], np.full(len(first), -1, dtype=np.int64)]), True), buckets=buckets, bits=ANCHOR_BITS, fine=fine)
        if known.any():
            idx = np.sort(order[known])
            _send_places(rows, doc[idx], pos[idx], buckets, fine)
        return _batch(rows, _ROUTED)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column(1))
                a = windows(words.hashes(), anchor)
                if not len(a):
                    continue
                pos = words.offsets_in_doc()
                n = words.count[words.doc]
                at = np.flatnonzero((covered[pos % period] & (pos + anchor <= n) & (n >= min_words))[: len(a)])
                if len(at):
                    parts.append((a[at], part.column(0).to_numpy()[words.doc[at]], pos[at].astype(np.int64)))
                    held += len(at)
                if held >= FOLD:
                    yield fold(parts)
                    parts, held = [], 0
        if parts:
            yield fold(parts)

    return run


def _pass_on(table: pa.Table, buckets: int) -> tuple[pa.Table, list]:
    kinds = table.column("kind").to_numpy()
    through = table.filter(pa.array(kinds == 1))
    rows = [(d.as_py() // fan_of(buckets), p.as_py()) for d, p in zip(through.column("db"), through.column("payload"), strict=True)]
    return table.filter(pa.array(kinds == 0)), rows


def _shared_anchors(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        table, rows = _pass_on(table, buckets)
        if table.num_rows:
            h, doc, pos = unpack_all(table.column("payload"))
            order = np.argsort(h, kind="stable")
            h, doc, pos = h[order], doc[order], pos[order]
            starts = run_starts(h)
            shared = (np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)) | (np.minimum.reduceat(pos, starts) < 0)
            mine = np.repeat(shared, np.diff(np.append(starts, len(h)))) & (pos >= 0)
            _marks(rows, doc[mine], pos[mine], buckets)
        return pa.Table.from_batches([_batch(rows, _MARKS)])

    return run


def _ordinals(docs: pa.Table) -> np.ndarray:
    """0 for a row whose id is its own; rows that share an id are told apart by the order of their texts."""
    ids = docs.column("id").to_numpy()
    out = np.zeros(len(ids), dtype=np.int64)
    values, inverse, count = np.unique(ids, return_inverse=True, return_counts=True)
    for v in np.flatnonzero(count > 1):
        rows = np.flatnonzero(inverse == v)
        for k, r in enumerate(sorted(rows, key=lambda r: docs.column("text")[int(r)].as_py() or "")):
            out[r] = k
    return out


def _repeated_windows(min_words: int, buckets: int):
    period, _ = cover_for(min_words)

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        if not marks.num_rows or not docs.num_rows:
            return _ROUTED.empty_table()
        m_doc, m_pos = unpack_all(marks.column("payload"))
        order = np.argsort(m_doc, kind="stable")
        m_doc, m_pos = m_doc[order], m_pos[order]
        ordinal, parts = _ordinals(docs), []
        marked = np.isin(docs.column("id").to_numpy(), m_doc)
        for o in np.unique(ordinal[marked]):
            for batch in docs.filter(pa.array(marked & (ordinal == o))).combine_chunks().to_batches():
                for part in slices(batch, "text"):
                    ids, words = part.column(0).to_numpy(), Words(part.column(1))
                    h = words.hashes()
                    key = windows(h, min_words)
                    if not len(key):
                        continue
                    check = (windows(h, min_words, check=True) >> U64(32)).astype(np.uint32)
                    rows = np.argsort(ids)
                    lo, hi = np.searchsorted(m_doc, [ids.min(), ids.max()], side="left")[0], np.searchsorted(m_doc, ids.max(), side="right")
                    d, p = m_doc[lo:hi], m_pos[lo:hi]
                    at = np.minimum(np.searchsorted(ids[rows], d), len(ids) - 1)
                    mine = ids[rows][at] == d
                    row, p = rows[at[mine]], p[mine]
                    n = words.count[row]
                    a, b = np.maximum(p - period + 1, 0), np.minimum(p, n - min_words)
                    good = a <= b
                    row, a, b = row[good], a[good] + words.first[row[good]], b[good] + words.first[row[good]]
                    span = np.bincount(a, minlength=len(key) + 1)[: len(key) + 1] - np.bincount(b + 1, minlength=len(key) + 1)[: len(key) + 1]
                    idx = np.flatnonzero(np.cumsum(span)[: len(key)] > 0)
                    doc_row = words.doc[idx]
                    parts.append((key[idx], check[idx], ids[doc_row], (int(o) << 32) + idx - words.first[doc_row]))
        if not parts:
            return _ROUTED.empty_table()
        key, check, doc, loc = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        k, c, d = key[order], check[order], doc[order]
        starts = run_starts(k, c)
        later = np.empty(len(k), dtype=bool)
        later[order] = d > np.repeat(np.minimum.reduceat(d, starts), np.diff(np.append(starts, len(k)))) if len(k) else False
        rows: list = []
        first = np.flatnonzero(~later)
        fine = fan_of(buckets) == 1
        _send(rows, key[first], (check[first], False), (doc[first], True), (loc[first], True), buckets=buckets, bits=64, fine=fine)
        if later.any():
            idx = np.flatnonzero(later)
            _send_places(rows, doc[idx], loc[idx], buckets, fine)
        return pa.Table.from_batches([_batch(rows, _ROUTED)])

    return run


def _later_windows(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        table, rows = _pass_on(table, buckets)
        if table.num_rows:
            key, check, doc, loc = unpack_all(table.column("payload"))
            order = np.lexsort((check, key))
            key, check, doc, loc = key[order], check[order], doc[order], loc[order]
            starts = run_starts(key, check)
            later = doc > np.repeat(np.minimum.reduceat(doc, starts), np.diff(np.append(starts, len(key))))
            _marks(rows, doc[later], loc[later], buckets)
        return pa.Table.from_batches([_batch(rows, _MARKS)])

    return run


def _cut(min_words: int):
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        ids, ordinal = docs.column("id").to_numpy(), _ordinals(docs)
        m_doc, m_loc = unpack_all(marks.column("payload")) if marks.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.lexsort((m_loc, m_doc))
        m_doc, m_loc = m_doc[order], m_loc[order]
        lo, hi = np.searchsorted(m_doc, ids, side="left"), np.searchsorted(m_doc, ids, side="right")
        n_words, n_removed, kept, spans = [], [], [], []
        for r, text in enumerate(docs.column("text")):
            words = (text.as_py() or "").encode().split()
            at = m_loc[lo[r] : hi[r]]
            at = at[(at >> 32) == ordinal[r]] & 0xFFFFFFFF if len(at) else at
            gone: list = []
            if len(at):
                at = np.unique(at)
                first = np.flatnonzero(np.concatenate([[True], at[1:] > at[:-1] + min_words]))
                gone = [{"start": int(at[a]), "end": int(at[b - 1]) + min_words} for a, b in zip(first, [*first[1:], len(at)], strict=True)]
            n_words.append(len(words))
            n_removed.append(sum(g["end"] - g["start"] for g in gone))
            edge, left = 0, []
            for g in gone:
                left += words[edge : g["start"]]
                edge = g["end"]
            kept.append(b" ".join(left + words[edge:] if gone else words))
            spans.append(gone)
        return pa.table(
            [docs.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            names=["id", "n_words", "n_removed", "kept_text", "removed"],
        )

    return run


def remove_repeats(docs: DataFrame, min_words: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word covered by a window of ``min_words`` words that also starts in a document with a smaller id.

    Words are runs of anything but space and tab to carriage return, unchanged.  Windows
    are judged on the input, not on what is left.  Exactness: a window is known by 96 bits
    of two independent hashes, in the fold of a task and in its bucket alike.

    Returns one row per input row: id, n_words, n_removed, kept_text (kept words joined by
    one space) and removed (word spans, end exclusive).  A null text has no words.  Texts of
    fewer than ``min_words`` words stay whole; very long ones are read whole, a slice of the
    corpus at a time.  An empty table gives an empty result.  Rows with the same id are one document for
    the comparison: neither removes words of the other.  Rows with a null id stay whole and
    remove nothing from others.
    """
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    total = text_bytes(own)
    buckets = buckets_for(total, BUCKET_BYTES, 48)
    known = own.filter("id IS NOT NULL")
    routed = "bucket int, kind int, db int, payload binary"
    marks = "db int, payload binary"
    result = "id bigint, n_words bigint, n_removed bigint, kept_text string, removed array<struct<start:bigint,end:bigint>>"
    dealt = known.withColumn("db", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    dealt = dealt.select("db", "id", "text").groupBy("db")

    def dropped(f):
        return lambda left, right: f(left.select(["id", "text"]), right)

    far = fan_of(buckets) > 1

    def fine(rows: DataFrame, bits: int) -> DataFrame:
        """Routed rows by bucket; where they came by range of buckets they are folded anew."""
        return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_fold_anew(buckets, bits), routed) if far else rows

    def to_docs(rows: DataFrame) -> DataFrame:
        rows = rows.repartition("db").sortWithinPartitions("db").mapInArrow(_mark_anew(buckets), marks) if far else rows
        return rows.groupBy("db")

    anchors = fine(known.mapInArrow(_anchors(min_words, buckets), routed), ANCHOR_BITS)
    marked = anchors.groupBy("bucket").applyInArrow(_shared_anchors(buckets), marks)
    full = fine(dealt.cogroup(to_docs(marked)).applyInArrow(dropped(_repeated_windows(min_words, buckets)), routed), 64)
    later = full.groupBy("bucket").applyInArrow(_later_windows(buckets), marks)
    out = dealt.cogroup(to_docs(later)).applyInArrow(dropped(_cut(min_words)), result)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _cut(min_words)(pa.Table.from_batches([batch]).set_column(0, "id", pa.array(np.zeros(len(batch), np.int64))), _MARKS.empty_table()).set_column(0, "id", pa.nulls(len(batch), pa.int64())).to_batches()

    return out.unionByName(own.filter("id IS NULL").mapInArrow(untouched, result)).withColumnRenamed("id", id_col)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs, 13).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
