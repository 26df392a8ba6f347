"""Token counts of a byte-level BPE vocabulary, with a shortcut for whole tokens."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import tidy

#: How the vocabulary's pre-tokenizer cuts text (fixed value: the published pattern of byte-level BPE).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that one pass of the pattern works on; a longer text is cut where a cut can't change a piece.
PASS_CHARS = 1 << 20
#: Pieces whose count a worker remembers.
REMEMBERED = 400_000

_CUT = regex.compile(r"[A-Za-z](?= [A-Za-z])")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte, as byte-level vocabularies spell them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def library(spec: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec)


def whole_tokens(spec: str) -> frozenset[str]:
    """Vocabulary strings proved to be one token when they stand alone as one piece.

    Each is given to the library by itself; it counts only if it comes back as a single
    id and the pattern leaves it in one piece.  A string that isn't UTF-8 can't be a piece.
    """
    back, pattern, strings = byte_alphabet(), regex.compile(PATTERN), []
    for token in json.loads(spec)["model"]["vocab"]:
        try:
            strings.append(bytes(back[c] for c in token).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    tokenizer = library(spec)
    tokenizer.encode_special_tokens = True
    alone = tokenizer.encode_batch(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, alone, strict=True) if len(e.ids) == 1 and pattern.findall(s) == [s])


class Counter:
    """Counts tokens in one Python worker."""

    def __init__(self, spec: str, whole: frozenset[str]):
        self.tokenizer, self.whole, self.pattern = library(spec), whole, regex.compile(PATTERN)
        self.pieces = library(spec)
        self.pieces.encode_special_tokens = True
        self.special = [t["content"] for t in json.loads(spec).get("added_tokens", [])]
        self.counts: dict[str, int] = {}
        self.same: set[str] = set(map(chr, range(128)))
        self.other: set[str] = set()

    def pieces_agree(self, text: str) -> bool:
        """Whether the pattern cuts every character of the text as the library does.

        The two carry their own Unicode tables; a character that they class differently
        sends its text to the library whole.
        """
        if text.isascii():
            return True
        chars = set(text)
        for c in chars - self.same - self.other:
            probes = [f"a{c}b", f"1{c}2", f" {c} ", f"!{c}?", f"  {c}", f"{c}{c}x"]
            cuts = [[text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)] for text in probes]
            (self.same if cuts == [self.pattern.findall(x) for x in probes] else self.other).add(c)
        return not self.other or chars.isdisjoint(self.other)

    def count(self, text: str) -> int:
        if any(s in text for s in self.special) or not self.pieces_agree(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        n = at = 0
        while at < len(text):
            to = len(text)
            if to - at > PASS_CHARS and (m := _CUT.search(text, at + PASS_CHARS)):
                to = m.end()
            n += self._count(text[at:to] if at or to < len(text) else text)
            at = to
        return n

    def _count(self, text: str) -> int:
        whole, counts = self.whole, self.counts
        pieces = self.pattern.findall(text)
        rest = [p for p in pieces if p not in whole]
        if new := list({p for p in rest if p not in counts}):
            if len(counts) + len(new) > REMEMBERED:
                counts.clear()
                new = list(set(rest))
            counts.update(zip(new, (len(e.ids) for e in self.pieces.encode_batch(new, add_special_tokens=False)), strict=True))
        return len(pieces) - len(rest) + sum(map(counts.__getitem__, rest))


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each whole text as the library for the vocabulary file counts them.

    ``tokenizer_path``: a byte-level BPE ``.json``.  No begin or end tokens are added;
    special strings inside a text are special tokens, as is the library's default.

    The vocabulary strings that are proved to encode alone as one token are counted by
    looking pieces up; only other pieces go through the merges, once each per worker.
    What is broadcast is the vocabulary file, whose size does not grow with the data.

    Returns one row per input row: id, n_bytes (UTF-8), n_tokens.  A null text counts as
    empty: 0 and 0.  Very long texts are counted whole, in passes cut where no piece is.
    Null ids, ties and repeated rows pass through.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    shared = spark.sparkContext.broadcast((spec, whole_tokens(spec)))
    name = hashlib.sha256(spec.encode()).hexdigest()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _COUNTERS:
            _COUNTERS[name] = Counter(*shared.value)
        counter = _COUNTERS[name]
        for batch in batches:
            text = batch.column(1)
            n_bytes = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            n_tokens = pa.array((0 if t is None else counter.count(t) for t in (x.as_py() for x in text)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n_tokens], names=["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return out.withColumnRenamed("id", id_col)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumn("over_limit", F.col("n_tokens") > 512)
