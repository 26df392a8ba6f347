"""Mixing sources to target weights by hierarchical budgeting."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import WORD, staged

LEVELS = ("domain", "lang", "source")
#: Leaves whose budgets are broadcast, at most (about 100 bytes each).
MOST_BROADCAST_LEAVES = 50_000
#: Target weights of the registered query: domains, and languages within each domain.
DOMAIN_WEIGHTS = {"0": 40, "1": 30, "2": 20, "3": 10}
LANG_WEIGHTS = {"en": 50, "de": 20, "fr": 20, "es": 10}
#: A language, domain or source without a weight of its own.
OTHER_WEIGHT = 10


def domain_of(source: Column) -> Column:
    """The registered query's domains: four groups of sources."""
    digit = F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 1, 1)) - 1
    return F.pmod(digit, F.lit(4)).cast("string")


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _weight(c: Column, weights: Mapping[str, float], other: float) -> Column:
    out = F.lit(other)
    for k, w in weights.items():
        out = F.when(c == F.lit(k), F.lit(w)).otherwise(out)
    return out


def _fill(children: DataFrame, parent: list[str], key: str) -> DataFrame:
    """Share each parent's ``budget`` over its children by ``weight``; a child takes at most its ``capacity``.

    What a full child can't take goes to its siblings in proportion.  In the order of
    capacity per weight the full ones come first, so running sums tell which are full and
    at what level the others stand.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("ratio"), F.col(key))
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        children.withColumn("ratio", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf"))))
        .withColumn("weight_left", F.sum("weight").over(rest))
        .withColumn("taken", F.coalesce(F.sum("capacity").over(ahead), F.lit(0)).cast("double"))
        .withColumn("full", (F.col("weight") > 0) & (F.col("ratio") * F.col("weight_left") + F.col("taken") <= F.col("budget")))
    )
    level = F.when(~F.col("full") & (F.col("weight") > 0), (F.col("budget") - F.col("taken")) / F.col("weight_left"))
    first = F.first(level, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ranked.withColumn("level", first).withColumn(
        "share", F.when(F.col("full"), F.col("capacity").cast("double")).when(F.col("weight") > 0, F.least(F.col("capacity").cast("double"), F.col("level") * F.col("weight"))).otherwise(F.lit(0.0))
    )


def leaf_budgets(leaves: DataFrame, fraction: float, max_epochs: int, weights: Mapping[str, Mapping[str, float]], other: float = OTHER_WEIGHT) -> DataFrame:
    """Token budgets of the leaves: ``leaves`` has the levels and ``tokens``.

    The total is ``fraction`` of all tokens.  A leaf can give ``max_epochs`` times its
    tokens.  Budgets go down level by level under the capacities of whole subtrees, so a
    shortage is made up by siblings, and by the siblings of an ancestor only once those
    are full.  The levels are aggregated and shared out as tables; nothing is collected.
    """
    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    total = leaves.agg((F.sum("tokens").cast("double") * fraction).alias("budget"))
    above, parent = total, []
    for depth, key in enumerate(LEVELS):
        keys = list(LEVELS[: depth + 1])
        level = leaves.groupBy(*keys).agg(F.sum("capacity").alias("capacity")).withColumn("weight", _weight(F.col(key), weights.get(key, {}), other))
        level = level.join(above, parent) if parent else level.crossJoin(F.broadcast(above))  # one row
        above = _fill(level, parent, key).select(*keys, F.col("share").alias("budget"))
        parent = keys
    return leaves.join(above.withColumn("budget", F.floor("budget").cast("bigint")), list(LEVELS))


def _broadcast_if_small(leaves: DataFrame) -> DataFrame:
    """A table of one row per leaf goes to every task if it is known to be small; else it is joined by a shuffle."""
    return F.broadcast(leaves) if leaves.count() <= MOST_BROADCAST_LEAVES else leaves


def _order(seed: int, epoch: Column, id_: Column) -> Column:
    """A document's place in an epoch: the hash of seed, epoch and id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"))


def mix(
    docs: DataFrame,
    fraction: float = 0.6,
    max_epochs: int = 2,
    weights: Mapping[str, Mapping[str, float]] | None = None,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    domain: Column | None = None,
    tokens: Column | None = None,
) -> DataFrame:
    """Choose documents so that the tree domain - lang - source gets its target share of tokens.

    Each leaf gives whole epochs while its budget holds out, then the longest prefix of
    the next epoch's seeded order whose tokens fit.  Tokens are words unless a column says
    otherwise.  Returns one row per chosen document and epoch: id, domain, lang, source,
    n_tokens, epoch (from 0).

    A null language or source is a leaf '' of its own.  Documents without tokens, null and
    empty texts among them, go with their leaf's prefix.  Rows with the same id in a leaf
    share a place in the order and are chosen together; so are all rows with a null id.
    Very long texts count whole and may end a prefix early.  An empty table gives an empty
    result.
    """
    keys, budgets, ends = _plan(docs, fraction, max_epochs, weights, seed, id_col, text_col, lang_col, source_col, domain, tokens)
    leaf = list(LEVELS)
    out = [F.col("id").alias(id_col), *leaf, "n_tokens"]
    partial = _placed(keys, budgets, seed, F.col("id")).join(ends, leaf).filter(_reached()).select(*out, F.col("epochs").alias("epoch"))
    full = keys.join(budgets.filter("epochs > 0"), leaf).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1))).select(*out, "epoch")
    return full.unionByName(partial)


def choose(docs: DataFrame, fraction: float = 0.6, weights: Mapping[str, Mapping[str, float]] | None = None, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows that ``mix`` chooses when each is taken once at most, with all their columns.

    Rows are judged where they are, by their leaf's row: no text is shuffled.
    """
    _, budgets, ends = _plan(docs, fraction, 1, weights, seed, id_col, text_col, lang_col, source_col, None, None)
    own = list(docs.columns)
    nested = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.col(id_col).alias("id"), *_keys(F.col(text_col), lang_col, source_col, None, None))
    known = _placed(nested, budgets, seed, F.col("id")).join(ends, list(LEVELS))
    return known.filter((F.col("epochs") > 0) | _reached()).select("row.*")


def _keys(text: Column, lang: str, source: str, domain: Column | None, tokens: Column | None) -> list[Column]:
    blank = F.lit("")
    return [
        F.coalesce(domain if domain is not None else domain_of(F.col(source)), blank).alias("domain"),
        F.coalesce(F.col(lang), blank).alias("lang"),
        F.coalesce(F.col(source), blank).alias("source"),
        (tokens if tokens is not None else words_in(text)).alias("n_tokens"),
    ]


def _placed(rows: DataFrame, budgets: DataFrame, seed: int, id_: Column) -> DataFrame:
    return rows.join(budgets, list(LEVELS)).withColumn("place", _order(seed, F.col("epochs"), id_)).withColumn("part", F.substring("place", 1, 3))


def _reached() -> Column:
    """Whether the leaf's budget reaches a row's place in the last, partial epoch."""
    return F.col("end_part").isNull() | (F.col("part") < F.col("end_part")) | F.coalesce((F.col("part") == F.col("end_part")) & (F.col("place") <= F.col("last")), F.lit(False))


def _plan(docs: DataFrame, fraction: float, max_epochs: int, weights: Mapping[str, Mapping[str, float]] | None, seed: int, id_col: str, text_col: str, lang_col: str, source_col: str, domain: Column | None, tokens: Column | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents' keys; by leaf the whole epochs and what is left of the budget; and where in the next epoch that ends.

    The end is found in two steps, so that no leaf is sorted in one task: sums over the
    4096 ranges of the order first, then the rows of the one range in which the budget
    runs out.  Only those rows move.
    """
    weights = weights if weights is not None else {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS}
    keys = staged(docs.select(F.col(id_col).alias("id"), *_keys(F.col(text_col), lang_col, source_col, domain, tokens)), "mix-keys")
    leaf = list(LEVELS)
    budgets = leaf_budgets(keys.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens")), fraction, max_epochs, weights)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(0)).cast("int")
    budgets = _broadcast_if_small(staged(budgets.select(*leaf, whole.alias("epochs"), (F.col("budget") - whole * F.col("tokens")).alias("rest")), "mix-budgets"))
    placed = _placed(keys, budgets, seed, F.col("id"))
    sums = placed.groupBy(*leaf, "part").agg(F.sum("n_tokens").alias("part_tokens"), F.first("rest").alias("rest"))
    running = Window.partitionBy(*leaf).orderBy("part")
    sums = sums.withColumn("upto", F.sum("part_tokens").over(running)).withColumn("before", F.col("upto") - F.col("part_tokens"))
    over = F.col("upto") > F.col("rest")
    ends = staged(sums.groupBy(*leaf).agg(F.min(F.when(over, F.struct("part", "before"))).alias("end")).select(*leaf, F.col("end.part").alias("end_part"), F.col("end.before").alias("before")), "mix-ends")
    # Rows that share a place, those of one id, are reached together.
    reach = F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*leaf).orderBy("place"))
    within = placed.join(_broadcast_if_small(ends), leaf).filter(F.col("part") == F.col("end_part")).withColumn("reach", reach).filter("reach <= rest")
    last = within.groupBy(*leaf).agg(F.max("place").alias("last"))
    return keys, budgets, _broadcast_if_small(staged(ends.drop("before").join(last, leaf, "left"), "mix-places"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    """The same choice in DuckDB, with the leaves' orders summed whole."""
    case = lambda key, weights: f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.items()) + f" ELSE {OTHER_WEIGHT} END" if weights else str(OTHER_WEIGHT)
    weights = {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS, "source": {}}
    parts = [
        r"""k AS (
  SELECT doc_id, CAST((strpos('0123456789abcdef', substr(md5(coalesce(source, '')), 1, 1)) - 1) % 4 AS VARCHAR) AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents)""",
        "leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * 2 AS BIGINT) AS capacity FROM k GROUP BY ALL)",
        "s_top AS (SELECT CAST(sum(tokens) AS DOUBLE) * 0.6 AS budget FROM leaves)",
    ]
    above = "s_top"
    for depth, key in enumerate(LEVELS):
        keys, parent = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth])
        join = f"JOIN {above} USING ({parent})" if parent else f"CROSS JOIN {above}"
        over = f"OVER ({'PARTITION BY ' + parent if parent else ''} ORDER BY ratio, {key} ROWS BETWEEN"
        parts += [
            f"c_{key} AS (SELECT {keys}, CAST(sum(capacity) AS BIGINT) AS capacity, {case(key, weights[key])} AS weight FROM leaves GROUP BY {keys})",
            f"r_{key} AS (SELECT *, CAST(capacity AS DOUBLE) / weight AS ratio FROM c_{key} {join})",
            f"t_{key} AS (SELECT *, sum(weight) {over} CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left, CAST(coalesce(sum(capacity) {over} UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS taken FROM r_{key})",
            f"f_{key} AS (SELECT *, ratio * weight_left + taken <= budget AS is_full FROM t_{key})",
            f"l_{key} AS (SELECT *, first_value(CASE WHEN NOT is_full THEN (budget - taken) / weight_left END IGNORE NULLS) {over} UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS level FROM f_{key})",
            f"s_{key} AS (SELECT {keys}, CASE WHEN is_full THEN CAST(capacity AS DOUBLE) ELSE least(CAST(capacity AS DOUBLE), level * weight) END AS budget FROM l_{key})",
        ]
        above = f"s_{key}"
    parts += [
        "b AS (SELECT domain, lang, source, tokens, CAST(floor(budget) AS BIGINT) AS budget FROM leaves JOIN s_source USING (domain, lang, source))",
        "e AS (SELECT *, CAST(CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS INTEGER) AS epochs FROM b)",
        "p AS (SELECT k.*, epochs, budget - epochs * tokens AS rest, md5(concat_ws(':', '7', CAST(epochs AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), ''))) AS place FROM k JOIN e USING (domain, lang, source))",
        "q AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place RANGE UNBOUNDED PRECEDING) AS reach FROM p)",
    ]
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT doc_id, domain, lang, source, n_tokens, epochs AS epoch FROM q WHERE reach <= rest"
        "\nUNION ALL SELECT doc_id, domain, lang, source, n_tokens, CAST(g AS INTEGER) AS epoch FROM (SELECT *, unnest(range(epochs)) AS g FROM p)"
    )


SQL = _sql()
