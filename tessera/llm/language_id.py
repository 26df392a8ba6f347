"""Language identification by fusing evidence: text, declared markup language, address, host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import slices, staged, tidy

#: Labelled documents of each language that the text model is trained on.
TRAINED_ON = 1500
#: Bits of the table of hashed byte trigrams: TABLE_BITS, fewer if so many languages' tables would pass MODEL_CELLS together.
TABLE_BITS, MODEL_CELLS = 17, 1 << 24
#: More labelled languages than this raise an error: the column isn't a language then.
MOST_LANGUAGES = 4096
#: Bytes of text whose trigrams are held at once (about 80 bytes each).
TRIGRAM_BYTES = 1 << 17
#: Trigrams of a text that count in full; the evidence of more grows with their square root, since
#: neighbouring trigrams aren't independent.
FULL_WEIGHT = 50.0
#: Pseudo-documents with which a host's prior leans on its suffix's, and that one's on the whole corpus'.
LEAN = 5.0
#: Share by which a declaration or an address is taken to be noise.
NOISE = 0.05
#: A text is rejected if no language has this posterior, or if it has no letters and declares nothing.
LEAST_POSTERIOR = 0.3
#: Declared values that are broadcast, at most.
MOST_VALUES = 50_000

_FOLD = np.arange(256, dtype=np.int64)
_FOLD[65:91] += 32
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def table_bits(languages: int) -> int:
    return min(TABLE_BITS, (MODEL_CELLS // max(1, languages)).bit_length() - 1)


def trigrams(texts: pa.Array, bits: int = TABLE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Table places of the byte trigrams of each text (A-Z folded, all but letters as space), and each one's row."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    code = _FOLD[raw]
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    if len(code) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, c = code[:-2], code[1:-1], code[2:]
    # Runs of spaces say nothing.
    good = (row[:-2] == row[2:]) & ~((b == 32) & ((a == 32) | (c == 32)))
    place = ((a * 0x1F1F1F + b * 0x3D4D51 + c * 0x5851F4) >> 5) & ((1 << bits) - 1)
    return place[good], row[:-2][good]


def thresholds(sizes: dict[str, int], wanted: int = TRAINED_ON) -> dict[str, int]:
    """For each language the largest 64-bit hash of a document in the sample, and enough of them: half more than wanted, and 200.

    Whole numbers throughout, so a language of any size has its sample.
    """
    return {x: min((1 << 63) - 1, -(1 << 63) + ((wanted * 3 // 2 + 200) << 64) // max(1, n)) for x, n in sizes.items()}


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log probability of each trigram in each): counts are summed per partition, then per language.

    All languages that label a document are learned, each from the TRAINED_ON documents of
    the smallest hashes of id and text, or from all it has; empty ones don't count and a
    repeated row counts once.
    """
    sizes = docs.filter(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MOST_LANGUAGES} values")
    languages = sorted(r["lang"] for r in sizes)
    bits = table_bits(len(languages))
    if not languages:
        return ["und"], np.zeros((1, 1 << bits), dtype=np.float32)
    limits = F.create_map(*(F.lit(x) for lang, at in thresholds({r["lang"]: r["count"] for r in sizes}).items() for x in (lang, at)))
    hashed = F.xxhash64(id_col, text_col)  # not of the id alone: rows may share one
    keep = F.coalesce((hashed <= limits[F.col(lang_col)]) & (F.octet_length(text_col) > 0), F.lit(False))

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), 1 << bits), dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text", TRIGRAM_BYTES):
                place, row = trigrams(part.column(1), bits)
                which = np.array([languages.index(x.as_py()) for x in part.column(0)])
                for k in np.unique(which):
                    total[k] += np.bincount(place[which[row] == k], minlength=1 << bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(languages)), pa.int32()), pa.array([t.astype(np.float64).tobytes() for t in total], pa.binary())], names=["i", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << bits)
        for r in table.column("counts"):
            total += np.frombuffer(r.as_py())
        return pa.table([table.column("i")[:1], pa.array([total.tobytes()], pa.binary())], names=["i", "counts"])

    # The sample is bounded, so a few partitions hold it, however many the corpus has.
    order = Window.partitionBy("lang").orderBy("hash", "text")
    sample = docs.filter(keep).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), hashed.alias("hash")).distinct()  # a repeated row could be any number of them
    sample = sample.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= TRAINED_ON).select("lang", "text")
    sample = staged(sample, "language-sample").coalesce(16)
    found = {r["i"]: np.frombuffer(r["counts"]) for r in sample.mapInArrow(count, "i int, counts binary").groupBy("i").applyInArrow(add, "i int, counts binary").collect()}
    counts = np.array([found.get(i, np.zeros(1 << bits)) for i in range(len(languages))]) + 0.05
    return languages, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def text_evidence(docs: DataFrame, languages: list[str], table: np.ndarray, text_col: str = "text") -> DataFrame:
    """Replace the text by ``evidence`` (log likelihood of each language, damped) and ``trigrams`` (how many there were)."""
    shared = docs.sparkSession.sparkContext.broadcast(table)  # MODEL_CELLS numbers at most
    bits = table.shape[1].bit_length() - 1
    others = [c for c in docs.columns if c != text_col]
    kinds = {f.name: f.dataType for f in docs.schema}

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, text_col, TRIGRAM_BYTES):
                place, row = trigrams(part.column(part.schema.get_field_index(text_col)), bits)
                n = np.bincount(row, minlength=len(part)).astype(float)
                sums = np.column_stack([np.bincount(row, weights=t[place], minlength=len(part)) for t in model])
                damp = np.where(n > FULL_WEIGHT, np.sqrt(FULL_WEIGHT / np.maximum(n, 1)), 1.0)
                evidence = (sums - sums.max(axis=1, keepdims=True)) * damp[:, None]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in others), pa.array(list(evidence), pa.list_(pa.float64())), pa.array(n.astype(np.int64))], names=[*others, "evidence", "trigrams"])

    schema = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in others) + ", evidence array<double>, trigrams bigint"
    return docs.mapInArrow(run, schema)


def _softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    raw = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raw, lambda x: x / total)


def fuse(rows: DataFrame, languages: list[str]) -> DataFrame:
    """Posterior of each language for rows of (evidence, trigrams, letters, declared, suffix, host); '' where a row has none.

    Priors come from the text alone, by grouped sums: a host's mean posterior, leaning on
    its suffix's, leaning on the whole corpus'.  Declarations and address suffixes are
    likelihoods: how often each value goes with each language, with some noise.  Rows
    without a text then lean on what their host, address and declaration say.
    """
    n = len(languages)
    rows = rows.withColumn("own", _softmax(F.col("evidence")))
    spoken = F.col("trigrams") > 0
    sums = [F.sum(F.when(spoken, F.col("own")[i]).otherwise(0.0)).alias(f"s{i}") for i in range(n)]
    grouped = lambda *keys: rows.groupBy(*keys).agg(F.count_if(spoken).alias("n"), F.count(F.lit(1)).alias("all"), *sums)  # noqa: E731  partial sums first: a hot host is one row per task

    def prior(counts: DataFrame, above: list[Column]) -> list[Column]:
        return [(F.coalesce(F.col(f"s{i}"), F.lit(0.0)) + LEAN * above[i]) / (F.coalesce(F.col("n"), F.lit(0)) + LEAN) for i in range(n)]

    whole = rows.agg(F.count_if(spoken), *sums, F.count(F.lit(1))).first()
    corpus = [F.lit(((whole[1 + i] or 0.0) + 1.0) / (whole[0] + n)) for i in range(n)]
    by_suffix = grouped("suffix")
    suffix_prior = by_suffix.select("suffix", F.array(*prior(by_suffix, corpus)).alias("suffix_prior"))
    by_host = grouped("suffix", "host").join(suffix_prior, "suffix")
    host_prior = by_host.select("suffix", "host", "all", F.array(*prior(by_host, [F.col("suffix_prior")[i] for i in range(n)])).alias("prior"))

    # P(declared value | language): what rows with that value look like, over what all rows of the language are.
    by_declared = grouped("declared").withColumnRenamed("n", "rows")
    value_count = max(1, by_declared.count())
    declared = by_declared.select("declared", F.array(*(F.log((1 - NOISE) * F.col(f"s{i}") / ((whole[1 + i] or 0.0) + 1.0) + NOISE / value_count) for i in range(n))).alias("declared_log"))
    # A host with very many rows would fill one task of the join: its prior is broadcast.  There are at
    # most 1024 such hosts.  Declared values are few; if they aren't, they are joined by a shuffle.
    host_prior, least = staged(host_prior, "host-priors"), max(1000, whole[-1] >> 10)
    hot = host_prior.filter(F.col("all") >= least).drop("all")
    usual = rows.join(F.broadcast(hot.select("suffix", "host")), ["suffix", "host"], "left_anti").join(host_prior.filter(F.col("all") < least).drop("all"), ["suffix", "host"])
    joined = usual.unionByName(rows.join(F.broadcast(hot), ["suffix", "host"]))
    joined = joined.join(F.broadcast(declared) if value_count <= MOST_VALUES else declared, "declared")
    silent = F.array(*[F.lit(0.0)] * n)
    stated = F.when(F.col("declared") == "", silent).otherwise(F.col("declared_log"))
    prior_log = F.transform("prior", lambda p: F.log(p))
    scores = F.zip_with(F.zip_with("evidence", prior_log, lambda a, b: a + b), stated, lambda a, b: a + b)
    out = joined.withColumn("posterior", _softmax(scores))
    best = F.array_max("posterior")
    place = F.array_position("posterior", best).cast("int")
    heard = F.col("letters") | (F.col("declared") != "")
    kept = heard & (best >= LEAST_POSTERIOR)
    names = F.array(*(F.lit(x) for x in languages))
    return out.withColumns({"confidence": best, "kept": kept, "language": F.when(kept, F.element_at(names, place)).otherwise(F.lit("und"))}).drop("own", "evidence", "prior", "declared_log", "posterior")


def identify(rows: DataFrame, languages: list[str], table: np.ndarray, text: Column, declared: Column | None = None, suffix: Column | None = None, host: Column | None = None, id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Identify the language of each row's text.

    Returns the id columns, language ('und' if rejected), confidence (its posterior), kept
    (false where no language reaches LEAST_POSTERIOR or there is nothing to go by).

    Null and empty texts have no text evidence; a row with a declaration is then judged by
    that and its host.  Null declarations, suffixes and hosts are the value ''.  Of equal
    posteriors the first language in the alphabet is named.  Very long texts are read
    whole.  Null ids pass through; repeated rows are judged alike.  An empty table gives an
    empty result.  A language that labels no document can't be named: its texts are given
    the nearest one that does.
    """
    part = lambda c: F.coalesce(c, F.lit("")) if c is not None else F.lit("")
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters")
    own = rows.select(*id_cols, text.alias("text"), letters, part(declared).alias("declared"), part(suffix).alias("suffix"), part(host).alias("host"))
    found = staged(text_evidence(own, languages, table), "language-evidence")
    return fuse(found, languages).select(*id_cols, "language", "confidence", "kept")


def page_text(html: Column) -> Column:
    """The visible text of a whole page: without scripts, styles, comments, tags and entities."""
    body = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(body, r"<[^>]*>", " "), r"&[a-zA-Z#0-9]{1,8};", " ")


def page_parts(url: Column, html: Column) -> tuple[Column, Column, Column]:
    """(declared language, address suffix, host).  The suffix is the last label and a language folder, if any."""
    declared = F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang=[\"']?([a-zA-Z]{2,3})", 1))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1))
    folder = F.regexp_extract(url, r"^[a-zA-Z]+://[^/]+/([a-z]{2})(?:/|$)", 1)
    return declared, F.concat_ws("/", F.regexp_extract(host, r"\.([a-z]+)$", 1), folder), host


def identify_documents(docs: DataFrame, id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``identify`` for the documents table: a document's source stands for its host; nothing is declared."""
    languages, table = train(docs)
    return identify(docs, languages, table, F.col("text"), host=F.col("source"), id_cols=id_cols)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents (doc_id) and all pages (page_id), by one text model trained on documents."""
    docs, pages = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/pages.parquet")
    languages, table = train(docs)
    of_docs = identify(docs, languages, table, F.col("text"), host=F.col("source"))
    declared, suffix, host = page_parts(F.col("url"), F.col("html"))
    of_pages = identify(pages, languages, table, page_text(F.col("html")), declared, suffix, host, ("page_id",))
    missing = F.lit(None).cast("bigint")
    return of_docs.select("doc_id", missing.alias("page_id"), "language", "confidence", "kept").unionByName(of_pages.select(missing.alias("doc_id"), "page_id", "language", "confidence", "kept"))
