"""Blocking, pair scores, nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: Query vectors that are broadcast at once.
QUERY_BLOCK = 8192
DAY = 86_400


def cities_match(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | (a == b)


def within_days(a: Column, b: Column, days: int) -> Column:
    """Instants in seconds at most ``days`` apart, either way; an unknown one is near everything."""
    return a.isNull() | b.isNull() | (F.abs(a - b) <= days * DAY)


def block_join(left: DataFrame, right: DataFrame, days: int = 1) -> DataFrame:
    """Pairs whose ``city`` and ``at`` (seconds) match, an unknown value matching all.

    Columns are prefixed ``l_`` and ``r_``.  The null-tolerant condition has no equality
    that a join could hash on, so it is taken apart into disjoint cases that have: both
    known (city and day, the right side also under its neighbouring days), one instant
    unknown (city), and one city unknown.  Only the last falls back to the day, or to all
    rows where both are unknown, as its meaning asks.
    """
    a = left.select(*(F.col(c).alias(f"l_{c}") for c in left.columns))
    b = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    day = lambda c: F.floor(F.col(c) / (max(1, days) * DAY))
    near = within_days(F.col("l_at"), F.col("r_at"), days)
    a_day = a.filter("l_at IS NOT NULL").withColumn("d", day("l_at"))
    b_day = b.filter("r_at IS NOT NULL").withColumn("d", F.explode(F.array(day("r_at") - 1, day("r_at"), day("r_at") + 1)))
    known = a_day.filter("l_city IS NOT NULL").join(b_day.filter("r_city IS NOT NULL"), (F.col("l_city") == F.col("r_city")) & (a_day.d == b_day.d)).filter(near).drop("d")
    undated = a.join(b, (F.col("l_city") == F.col("r_city")) & (F.col("l_at").isNull() | F.col("r_at").isNull()))
    some_city = F.col("l_city").isNull() | F.col("r_city").isNull()
    placeless = a_day.join(b_day, (a_day.d == b_day.d) & some_city).filter(near).drop("d")
    open_left = a.filter("l_at IS NULL").join(b, F.col("l_city").isNull() | F.col("r_city").isNull())
    open_right = a.filter("l_at IS NOT NULL").join(b.filter("r_at IS NULL"), F.col("l_city").isNull() | F.col("r_city").isNull())
    return known.unionByName(undated).unionByName(placeless).unionByName(open_left).unionByName(open_right)


def block_sizes(left: DataFrame, right: DataFrame, days: int = 1) -> DataFrame:
    """(city, at, rows, pairs): each city and instant of ``left``, its rows, and all pairs that ``block_join`` makes of them.

    Counted without making the pairs, so the work grows with the rows, not with their
    product.  Rows of one city and instant are folded first.  An instant's neighbours are
    its window's rows, the tail of the window before from its offset on, and the head of the
    one after up to it: running counts within (city, window).  A known city is counted with
    the right side's unknown one, an unknown city against all.
    """
    width = max(1, days) * DAY
    known, none, every = (F.struct(F.lit(k).alias("kind"), c.alias("city")) for k, c in ((0, F.col("city")), (1, F.lit(None).cast("string")), (2, F.lit(None).cast("string"))))
    spot = lambda df: df.groupBy("city", "at").agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.floor(F.col("at") / width))
    # Where a row counts, and where it asks: those of a city and those of none, or all.
    stands = F.explode(F.when(F.col("city").isNull(), F.array(none, every)).otherwise(F.array(known, every)))
    asks = F.explode(F.when(F.col("city").isNull(), F.array(every)).otherwise(F.array(known, none)))
    scope, off = [F.col("s.kind").alias("kind"), F.coalesce("s.city", F.lit("")).alias("place")], F.col("at") - F.col("w") * width
    b = spot(right).select("*", stands.alias("s")).select(*scope, "at", "w", off.alias("off"), "n")
    a = spot(left).withColumnRenamed("n", "rows").select("*", asks.alias("s")).select("city", "at", "rows", *scope, "w", off.alias("off"))
    # Unknown instants are near every row, and every row is near an unknown one.
    whole = b.groupBy("kind", "place").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("at").isNull(), F.col("n")).otherwise(0)).alias("undated"))
    loose = a.join(whole, ["kind", "place"]).select("city", "at", "rows", F.when(F.col("at").isNull(), F.col("all")).otherwise(F.col("undated")).alias("m"))
    reach = 1 if days else 0  # of 0 days the instant itself remains
    dated, probes = b.filter("at IS NOT NULL"), a.filter("at IS NOT NULL")
    of, keys = ["city", "at", "rows"], ["kind", "place", "w"]
    none_asked = F.lit(None)
    probe = F.explode(F.array(*(F.struct(F.lit(side).alias("side"), (F.col("w") + side).alias("w")) for side in ((-1, 0, 1) if reach else (0,))))).alias("p")
    asked = probes.select(*of, "kind", "place", "off", F.lit(0).cast("bigint").alias("n"), probe).select(*of, "kind", "place", "p.w", "off", "n", "p.side")
    kinds = dict(asked.dtypes)
    counted = dated.select(*(none_asked.cast(kinds[c]).alias(c) for c in of), *keys, "off", "n", none_asked.cast("int").alias("side"))
    here = Window.partitionBy(*keys)
    upto, same, total = (F.sum("n").over(x) for x in (here.orderBy("off"), Window.partitionBy(*keys, "off"), here))
    seen = asked.unionByName(counted).withColumns({"upto": upto, "same": same, "total": total}).filter("side IS NOT NULL")
    inside = F.when(F.col("side") == 0, F.col("total") if reach else F.col("same")).when(F.col("side") == 1, F.col("upto")).otherwise(F.col("total") - F.col("upto") + F.col("same"))
    found = loose.unionByName(seen.select(*of, inside.alias("m")))
    return found.groupBy("city", "at", "rows").agg(F.sum("m").alias("m")).select("city", "at", "rows", (F.col("rows") * F.col("m")).alias("pairs"))


def nearest(pairs: DataFrame, key: str, order: list, limit: int = 10) -> DataFrame:
    """The first ``limit`` rows per key; ``order`` must settle ties."""
    return pairs.withColumn("knn_pos", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).filter(F.col("knn_pos") < limit)


# ---------------------------------------------------------------- nearest within a block

#: Rows of a cell that one task compares, on either side; larger cells are cut.
CELL = 4096
#: Corpus rows per matrix product.
STEP = 512
#: Heavy cells that are broadcast, at most: a cell is cut only beyond 1 / MOST_CELLS of the rows.
MOST_CELLS = 50_000


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


class _Best:
    """The ``k`` most similar rows of each query so far; equal similarities go by ``key``, a whole number.

    ``rising``: rows come in the order of their keys, so a later one of equal similarity is never better.
    """

    def __init__(self, k: np.ndarray, rising: bool):
        self.k, self.least, self.rising = k, np.full(len(k), -np.inf), rising
        self.query, self.sim, self.key = np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64)
        self.settled = 0

    def compare(self, q: np.ndarray, rough: np.ndarray, c: np.ndarray, keys: np.ndarray, apart: Callable) -> None:
        """Unit vectors of queries (``rough``: in single precision) against those of STEP rows at most.

        ``apart(i, j)``: which pairs don't count, for broadcastable places of queries and rows.
        Products in single precision say which pairs may be among the best; these are
        computed in double precision and compared as they are reported, at six places.
        """
        width, n = q.shape[1], len(c)
        slack = np.float32(1e-6 + (width + 8) * 1.2e-7)
        sims = rough @ c.astype(np.float32).T
        with np.errstate(invalid="ignore", over="ignore"):
            bound = self.least.astype(np.float32) - slack
            fresh = np.flatnonzero(np.isneginf(self.least))
            if len(fresh):
                some = sims[fresh]
                some[apart(fresh[:, None], np.arange(n)[None, :])] = -np.inf
                most = int(self.k[fresh].max())
                kth = np.partition(np.where(np.isnan(some), -np.inf, some), n - most, axis=1)[:, n - most] if 0 < most < n else np.full(len(fresh), -np.inf)
                bound[fresh] = kth - 2 * slack
                sims[fresh] = some
            good = np.flatnonzero(sims >= np.maximum(bound, np.finfo(np.float32).min)[:, None])
        i, j = np.divmod(good, n)
        exact = (q @ c.T).ravel()[good] if len(good) > sims.size // 16 else np.einsum("ij,ij->i", q[i], c[j])
        exact = np.round(exact, 6) + 0.0
        take = exact > self.least[i] if self.rising else exact >= self.least[i]
        i, j, exact = i[take], j[take], exact[take]
        take = ~apart(i, j) & np.isfinite(exact)
        self.query, self.sim, self.key = np.concatenate([self.query, i[take]]), np.concatenate([self.sim, exact[take]]), np.concatenate([self.key, keys[j[take]]])
        if len(fresh) or len(self.query) > self.settled + self.k.sum() + 1024:
            self.cut()

    def cut(self) -> None:
        order = np.lexsort((self.key, -self.sim, self.query))
        q = self.query[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = order[place == self.k[q] - 1]
        self.least[self.query[last]] = self.sim[last]
        order = order[place < self.k[q]]
        self.query, self.sim, self.key = self.query[order], self.sim[order], self.key[order]
        self.settled = len(order)


class _Side:
    """Rows of one side: ids, unit vectors, cities as numbers (-1: unknown), instants (NaN if unknown)."""

    def __init__(self, table: pa.Table, cities: pa.Array):
        col = lambda name: table.column(name).combine_chunks()
        self.id, self.k = col("id"), col("k").to_numpy(zero_copy_only=False).astype(np.int64) if "k" in table.schema.names else None
        city = pc.fill_null(pc.index_in(col("city"), cities), len(cities)).to_numpy(zero_copy_only=False)
        self.city = np.where(pc.fill_null(pc.equal(col("city"), ""), True).to_numpy(zero_copy_only=False), -1, city)
        self.at = col("at").to_numpy(zero_copy_only=False).astype(np.float64)  # null: NaN
        lists = col("v")
        known, sizes = lists.is_valid().to_numpy(zero_copy_only=False), pc.list_value_length(lists.drop_null()).to_numpy(zero_copy_only=False)
        widths = set(np.unique(sizes).tolist())
        if len(widths) > 1:
            raise ValueError(f"vectors of lengths {sorted(widths)} can't be compared")
        self.width = max(widths, default=0)
        m = np.zeros((len(lists), self.width))
        m[known] = lists.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), self.width)
        self.unit = _unit(m)

    def __len__(self) -> int:
        return len(self.id)


def _nearest_pairs(left: pa.Table, right: pa.Table, seconds: float, but_itself: bool, schema: pa.Schema) -> pa.Table:
    """Each query's best among the rows of a cell, with the query's k."""
    right = right.take(pc.sort_indices(right, [("id", "ascending")]))
    cities = pc.unique(left.column("city"))
    cities = cities.filter(pc.not_equal(cities, ""))
    q, c = _Side(left, cities), _Side(right, cities)
    unit = (q.unit, c.unit) if q.width == c.width else (np.zeros((len(q), 1)), np.zeros((len(c), 1)))
    own = pa.concat_arrays([q.id, c.id.cast(q.id.type)]).dictionary_encode().indices.to_numpy(zero_copy_only=False) if but_itself else None
    rough, best = unit[0].astype(np.float32), _Best(q.k, rising=True)
    for at in range(0, len(c), STEP):
        to = min(len(c), at + STEP)

        def apart(i: np.ndarray, j: np.ndarray, at: int = at) -> np.ndarray:
            j = j + at
            no = (q.city[i] != c.city[j]) & (q.city[i] >= 0) & (c.city[j] >= 0)
            with np.errstate(invalid="ignore"):
                no |= np.abs(q.at[i] - c.at[j]) > seconds
            return no | (own[i] == own[len(q) + j]) if but_itself else no

        best.compare(unit[0], rough, unit[1][at:to], np.arange(at, to), apart)
    best.cut()
    return pa.table([q.id.take(pa.array(best.query)), c.id.take(pa.array(best.key)), pa.array(best.sim), pa.array(best.k[best.query], pa.int32())], schema=schema)


_KNOWN = "city IS NOT NULL AND at IS NOT NULL"


def blocked_knn(queries: DataFrame, corpus: DataFrame, days: int = 1, but_itself: bool = True) -> DataFrame:
    """Each query's ``k`` most similar corpus rows among those of its block: (q_id, id, similarity, knn_pos).

    Both have id, city, at (seconds) and v; queries also k.  A block are the rows of the same
    city and at most ``days`` apart, an unknown city or instant matching all.  Similarity
    is the cosine rounded to six places, 0 for a null or zero vector; equal ones go by id.
    Vectors of several lengths raise an error.

    Rows meet in cells, each pair in one: of (city, day) where both know both, of the day
    where both know the instant but not both the city, of the city where both know that but
    not both the instant, and in one for the rest, which has no equality to meet by.  Of two
    sides the one with fewer rows stands in a day's neighbours, too.  A cell of more than
    CELL rows is cut by a hash of the id on either side, so a hot city or day is spread;
    there are matrix products a piece, and only each query's best leave it.  Both inputs are
    written first.
    """
    from tessera.store.tables import staged  # which imports this module

    ids = [df.schema["id"].dataType.simpleString() for df in (queries, corpus)]
    schema = f"q_id {ids[0]}, id {ids[1]}, similarity double, k int"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    seconds = float(days * DAY)
    day = F.floor(F.col("at") / (max(1, days) * DAY)).cast("bigint")
    vector = F.col("v").cast("array<double>").alias("v")
    left = staged(queries.select("id", "city", F.col("at").cast("double").alias("at"), vector, F.col("k").cast("int").alias("k")), "nearest-queries")
    right = staged(corpus.select("id", "city", F.col("at").cast("double").alias("at"), vector), "nearest-rows")
    placed, dated = F.col("city").isNotNull(), F.col("at").isNotNull()

    def cells(*of: tuple[int, Column, bool, int]) -> Column:
        """(kind, condition, by city, days of reach or -1 for any) as one row a cell that a row stands in."""
        cell = lambda kind, if_, city, when: F.when(if_, F.struct(F.lit(kind).alias("kind"), (F.col("city") if city else F.lit(None).cast("string")).alias("place"), when.alias("day")))
        never = F.lit(None).cast("bigint")
        every = [cell(kind, if_, city, day + n if reach >= 0 else never) for kind, if_, city, reach in of for n in range(-max(0, reach), max(0, reach) + 1)]
        return F.explode(F.filter(F.array(*every), lambda x: x.isNotNull())).alias("cell")

    asks = cells((0, placed & dated, True, 0), (1, ~placed & dated, False, 1), (2, placed & dated, False, 0), (3, placed & ~dated, True, -1), (4, placed & dated, True, -1), (5, ~placed & ~dated, False, -1), (6, ~placed & dated, False, -1), (7, placed & ~dated, False, -1), (8, placed & dated, False, -1))
    stands = cells((0, placed & dated, True, 1), (1, dated, False, 0), (2, ~placed & dated, False, 1), (3, placed, True, -1), (4, placed & ~dated, True, -1), (5, F.lit(True), False, -1), (6, ~dated, False, -1), (7, ~placed, False, -1), (8, ~placed & ~dated, False, -1))
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    cell = ["kind", "place", "day"]
    at_cells = lambda df, of: df.select(*df.columns, of).select(*df.columns, "cell.kind", F.coalesce("cell.place", F.lit("")).alias("place"), F.coalesce("cell.day", F.lit(0)).alias("day"))
    a, b = at_cells(left, asks), at_cells(right, stands)
    sizes = [staged(df.groupBy(*cell).count(), "cell-sizes") for df in (a, b)]
    met = sizes[0].select(*cell, F.col("count").alias("asking")).join(sizes[1].select(*cell, F.col("count").alias("standing")), cell)
    totals = [df.agg(F.sum("count")).first()[0] or 0 for df in sizes]

    def cut(rows: DataFrame, mine: str, mine_total: int, my_piece: str, other: str, other_total: int, other_piece: str) -> DataFrame:
        """Rows of the cells that both sides have, in pieces of their own and for each piece of the other side."""
        least, others = (max(CELL, -(-total // MOST_CELLS)) for total in (mine_total, other_total))
        heavy = met.filter((F.col(mine) > least) | (F.col(other) > others)).select(*cell, F.ceil(F.col(mine) / least).cast("int").alias("m"), F.ceil(F.col(other) / others).cast("int").alias("o"))
        cuts = rows.join(F.broadcast(heavy), cell, "left")  # 2 * MOST_CELLS at most
        return cuts.withColumn(my_piece, own(F.coalesce("m", F.lit(1)))).withColumn(other_piece, every(F.coalesce("o", F.lit(1)))).drop("m", "o")

    if totals[0] <= MOST_CELLS:
        b = b.join(F.broadcast(sizes[0].select(*cell)), cell, "left_semi")
    a, b = cut(a, "asking", totals[0], "i", "standing", totals[1], "j"), cut(b, "standing", totals[1], "j", "asking", totals[0], "i")

    def piece(q: pa.Table, c: pa.Table) -> pa.Table:
        return _nearest_pairs(q, c, seconds, but_itself, arrow) if q.num_rows and c.num_rows else arrow.empty_table()

    keys = [*cell, "i", "j"]
    found = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(piece, schema)
    order = Window.partitionBy("q_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("knn_pos", F.row_number().over(order) - 1).filter("knn_pos < k").drop("k")


def knn(queries: DataFrame, corpus: DataFrame, id_col: str, vector: str, k: int = 10) -> DataFrame:
    """Exact cosine top-``k`` of each query among all corpus rows but itself: (q_id, id, similarity).

    Queries are broadcast in blocks of fixed size and compared with STEP rows at a time;
    each task keeps its own best ``k`` per query, so a block's shuffle is tasks x queries x k
    rows however large the corpus.
    Null vectors are passed over.  Vectors of several lengths can't be compared: they raise.
    """
    widths = F.collect_set(F.size(vector))
    lengths = {n for df in (queries, corpus) for n in df.filter(F.col(vector).isNotNull()).agg(widths).first()[0]}
    if len(lengths) > 1:
        raise ValueError(f"vectors of lengths {sorted(lengths)} in {vector}")
    width = max(lengths, default=0)
    total = queries.count()
    out = None
    for part in range(max(1, -(-total // QUERY_BLOCK))):
        rows = queries.filter(F.pmod(F.xxhash64(id_col), F.lit(max(1, -(-total // QUERY_BLOCK)))) == part).select(id_col, F.col(vector).cast("array<double>")).filter(F.col(vector).isNotNull()).collect()
        ids = np.array([r[0] for r in rows], dtype=np.int64)
        matrix = np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), width)
        shared = corpus.sparkSession.sparkContext.broadcast((ids, _unit(matrix)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q_ids, q = shared.value
            rough, best = q.astype(np.float32), _Best(np.full(len(q_ids), k), rising=False)
            for batch in batches:
                own = batch.filter(batch.column(1).is_valid())
                for at in range(0, own.num_rows if len(q_ids) else 0, STEP):
                    part = own.slice(at, STEP)
                    part_ids, x = part.column(0).to_numpy(), part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, q.shape[1])
                    best.compare(q, rough, _unit(x), part_ids, lambda i, j, ids=part_ids: q_ids[i] == ids[j])
            best.cut()
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[best.query]), pa.array(best.key), pa.array(best.sim)], names=["q_id", "id", "similarity"])

        found = corpus.select(F.col(id_col).cast("bigint"), F.col(vector)).mapInArrow(run, "q_id bigint, id bigint, similarity double")
        out = found if out is None else out.unionByName(found)
    return nearest(out, "q_id", [F.desc("similarity"), F.col("id")], k)
