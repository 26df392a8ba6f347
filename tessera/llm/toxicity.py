"""Toxicity scores from a weighted finite-state grammar over clauses."""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import staged, tidy
from tessera.llm.quality import fold_of

#: Labelled rows of either kind that the lexicon and the weights are learned from, at most.
MAX_LABELLED = 12_000
#: Lengths of stems tried, in characters.
STEMS = range(4, 9)
#: An arc is learned if its texts are toxic with this share and this G statistic at least.
LEAST_SHARE, LEAST_G, LEAST_TEXTS = 0.85, 24.0, 4

# Seed arcs, so that a corpus with few labels still has a grammar.
INSULTS = ("idiot", "idiots", "moron", "morons", "loser", "losers", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "stupid", "dumb", "imbecile", "filth", "idiote", "imbécile", "connard", "ordure", "dummkopf", "abschaum", "vollidiot", "estúpido", "estúpida", "idiota", "escoria")
THREATS = ("kill", "hurt", "beat", "destroy", "crush", "stab", "shoot", "töten", "umbringen", "schlagen", "tuer", "frapper", "matar", "golpear")
TARGETS = ("you", "your", "yours", "yourself", "he", "she", "they", "them", "him", "her", "these", "those", "du", "dich", "dir", "ihr", "euch", "sie", "tu", "toi", "vous", "ils", "tú", "vosotros", "ustedes", "ellos")
NEGATIONS = ("not", "no", "never", "isn't", "aren't", "wasn't", "don't", "nobody", "nicht", "kein", "keine", "nie", "pas", "jamais", "aucun", "nunca", "jamás", "ningún")
REPORTS = ("said", "says", "called", "calls", "wrote", "claimed", "reported", "quoted", "word", "term", "sagte", "nannte", "schrieb", "dit", "appelé", "écrit", "dijo", "llamó", "escribió")
INTENTS = ("will", "gonna", "shall", "i'll", "we'll", "going", "werde", "werden", "vais", "allons", "voy", "vamos")

CATEGORIES = ("plain", "targeted", "negated", "reported", "threat")
#: Words over which a negation, and a target, reach.
NEGATION_REACH, TARGET_REACH = 3, 4

_CLAUSE = re.compile(r"[.!?;:\n]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“”«»„]")
_QUOTES = frozenset("\"“”«»„")


class Transducer:
    """A deterministic transducer: ``step(state, symbol) -> (state, output)`` from ``start``."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def __call__(self, symbols: list) -> list:
        state, out = self.start, []
        for s in symbols:
            state, o = self.step(state, s)
            out.append(o)
        return out

    def then(self, other: Transducer) -> Transducer:
        """Composition: this one's output is the other's input."""

        def step(state, symbol):
            a, middle = self.step(state[0], symbol)
            b, out = other.step(state[1], middle)
            return (a, b), out

        return Transducer((self.start, other.start), step)


def _negation() -> Transducer:
    """Marks what stands within reach of a negation."""

    def step(left: int, symbol: tuple):
        kind, weight, marks = symbol
        if kind == "N":
            return NEGATION_REACH, symbol
        return max(0, left - 1), (kind, weight, marks | {"negated"}) if left and kind in "IH" else symbol

    return Transducer(0, step)


def _reported() -> Transducer:
    """Marks what follows a verb of saying, or stands between quotes."""

    def step(state: tuple[bool, bool], symbol: tuple):
        said, quoted = state
        kind, weight, marks = symbol
        if kind == "R":
            return (True, quoted), symbol
        if kind == "Q":
            return (said, not quoted), symbol
        return state, (kind, weight, marks | {"reported"}) if (said or quoted) and kind in "IH" else symbol

    return Transducer((False, False), step)


def _target(mark: str) -> Transducer:
    """Marks insults and threats within reach after a target, and threats after an intent."""

    def step(state: tuple[int, bool], symbol: tuple):
        left, intent = state
        kind, weight, marks = symbol
        if kind == "Y":
            return (TARGET_REACH, intent), symbol
        if kind == "W":
            return (max(0, left - 1), True), symbol
        if kind in "IH" and left:
            marks = marks | {mark}
        if kind == "H" and intent:
            marks = marks | {"meant"}
        return (max(0, left - 1), intent), (kind, weight, marks)

    return Transducer((0, False), step)


#: Composed once: what is said of a word by what stands before it, and by what stands after it (run backwards).
FORWARDS = _negation().then(_reported()).then(_target("targeted"))
BACKWARDS = _target("targeted")


class Grammar:
    """The lexical transducer (words and stems with weights) and the clause grammar behind it."""

    def __init__(self, arcs: dict[tuple[str, bool], float]):
        """``arcs``: (string, whether longer words that start with it match as well) -> weight."""
        self.classes = {w: k for k, words in (("N", NEGATIONS), ("R", REPORTS), ("Y", TARGETS), ("W", INTENTS)) for w in words}
        self.automaton = ahocorasick.Automaton()
        entries: dict[str, list] = {}
        for (string, open_), weight in arcs.items():
            entries.setdefault(string, []).append((open_, "I", weight))
        for word in THREATS:
            entries.setdefault(word, []).append((False, "H", 1.0))
        for string, found in entries.items():
            self.automaton.add_word(string, (len(string), found))
        self.automaton.make_automaton()

    def matches(self, text: str) -> dict[int, tuple[str, float]]:
        """Start of each word that an arc reads -> (kind, weight).  Of several arcs the most specific one speaks."""
        out: dict[int, tuple[str, float]] = {}
        sizes: dict[int, int] = {}
        for end, (size, found) in self.automaton.iter(text):
            start = end - size + 1
            if start and text[start - 1].isalpha():
                continue
            closed = end + 1 < len(text) and text[end + 1].isalpha()
            for open_, kind, weight in found:
                if (open_ or not closed) and 2 * size + (not open_) > sizes.get(start, 0):
                    sizes[start] = 2 * size + (not open_)
                    out[start] = (kind, weight)
        return out

    def clauses(self, text: str) -> Iterator[dict[str, float]]:
        """For each clause in which something matched: weight by category."""
        text = text.lower()
        found = self.matches(text)
        if not any(kind == "I" or len(found) > 1 or kind == "H" for kind, _ in found.values()):
            return
        edges = [0, *(m.end() for m in _CLAUSE.finditer(text)), len(text)]
        for k in sorted({bisect.bisect_right(edges, start) - 1 for start in found}):
            a, b = edges[k], edges[min(k + 1, len(edges) - 1)]
            symbols = []
            for m in _WORD.finditer(text, a, b):
                if m.start() in found:
                    symbols.append((*found[m.start()], frozenset()))
                else:
                    word = m.group()
                    symbols.append(("Q" if word in _QUOTES else self.classes.get(word, "O"), 0.0, frozenset()))
            symbols = BACKWARDS(FORWARDS(symbols)[::-1])
            weights = dict.fromkeys(CATEGORIES, 0.0)
            for kind, weight, marks in symbols:
                if kind == "I":
                    weights["negated" if "negated" in marks else "reported" if "reported" in marks else "targeted" if "targeted" in marks else "plain"] += weight
                elif kind == "H" and {"meant", "targeted"} <= marks and not marks & {"negated", "reported"}:
                    weights["threat"] += weight
            if any(weights.values()):
                yield weights

    def measures(self, text: str) -> list[float]:
        """Per category: the whole text's weight (damped); the strongest clause's; the weight per word."""
        total, best = dict.fromkeys(CATEGORIES, 0.0), 0.0
        for clause in self.clauses(text):
            for c in CATEGORIES:
                total[c] += clause[c]
            best = max(best, clause["plain"] + clause["targeted"] + clause["threat"])
        meant = total["plain"] + total["targeted"] + total["threat"]
        return [*(math.log1p(total[c]) for c in CATEGORIES), math.log1p(best), math.log1p(100 * meant / (50 + text.count(" ")))]


@tidy
def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts by word and stem: (arc, open, toxic, clean), folded in the task."""
    toxic, clean = Counter(), Counter()

    def out():
        keys = list(toxic.keys() | clean.keys())
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], names=["arc", "open", "toxic", "clean"])

    for batch in batches:
        for text, y in zip(batch.column(1), batch.column(2), strict=True):
            words = {w for w in _WORD.findall((text.as_py() or "").lower()) if len(w) >= STEMS.start}
            arcs = {(w, False) for w in words} | {(w[:n], True) for w in words for n in STEMS if len(w) >= n}
            (toxic if y.as_py() >= 0.5 else clean).update(arcs)
            if len(toxic) + len(clean) > 600_000:
                yield out()
                toxic.clear()
                clean.clear()
    yield out()


def g_statistic(a: Column, b: Column, n_a: int, n_b: int) -> Column:
    """How far an arc's share among toxic texts is from its share among clean ones."""
    p = (a + b) / (n_a + n_b)
    part = lambda x, e: F.when((x > 0) & (e > 0), x * F.log(x / e)).otherwise(0.0)
    return 2 * (part(a, n_a * p) + part(n_a - a, n_a * (1 - p)) + part(b, n_b * p) + part(n_b - b, n_b * (1 - p)))


def arc_weight(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """The log ratio of an arc's shares, from 0 to 6."""
    return F.greatest(F.lit(0.0), F.least(F.lit(6.0), F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((clean + 0.5) / (n_clean + 1))))


def learn_arcs(rows: DataFrame, n_toxic: int, n_clean: int) -> dict[tuple[str, bool], float]:
    """Seed arcs, and words and stems that tell toxic texts; a stem takes the place of the longer ones it starts.

    What is collected is bounded by the vocabulary of ``rows``, a bounded sample: an arc
    needs LEAST_G, which takes a number of toxic texts.
    """
    arcs = {(w, False): 3.0 for w in INSULTS}
    if not n_toxic or not n_clean:
        return arcs
    counts = rows.select("id", "text", "y").mapInArrow(_counts, "arc string, open boolean, toxic bigint, clean bigint").groupBy("arc", "open").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = staged(counts.filter(F.col("toxic") + F.col("clean") >= LEAST_TEXTS), "arc-counts")
    # Shares, so that it doesn't matter how many texts of either kind were taken.
    share = (F.col("toxic") / n_toxic) / (F.col("toxic") / n_toxic + F.col("clean") / n_clean)
    counts = counts.withColumn("g", g_statistic(F.col("toxic"), F.col("clean"), n_toxic, n_clean)).withColumn("weight", arc_weight(F.col("toxic"), F.col("clean"), n_toxic, n_clean))
    strong = counts.filter((F.col("toxic") >= LEAST_TEXTS) & (share >= LEAST_SHARE) & (F.col("g") >= LEAST_G)).collect()
    roots: dict[str, float] = {}
    for r in sorted(strong, key=lambda r: (len(r["arc"]), r["arc"], not r["open"])):
        if not any(r["arc"][:n] in roots for n in range(STEMS.start, len(r["arc"]) + (not r["open"]))):
            arcs[r["arc"], r["open"]] = r["weight"]
            if r["open"]:
                roots[r["arc"]] = r["weight"]
    if roots:
        # Longer stems and whole words below a root speak for themselves where they say something else: an
        # everyday word may begin like an insult.
        table = rows.sparkSession.createDataFrame(list(roots.items()), "root string, root_weight double")
        below = counts.withColumn("root", F.explode(F.array_distinct(F.array(*(F.substring("arc", 1, n) for n in STEMS)))))
        below = below.join(F.broadcast(table), "root").filter(F.abs(F.col("weight") - F.col("root_weight")) >= 0.5)
        for r in below.collect():
            arcs.setdefault((r["arc"], r["open"]), r["weight"])
    return arcs


def fit_weights(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the first column of ``x`` is 1 and isn't penalised."""
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held: int = 1, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Score every whole text by how likely ``label_col`` is 1.

    Lexical arcs (words and stems) mark insults and threats; transducers for negation,
    reported speech and targets, composed into one, say in what way each is meant; clauses
    are summed by category and a logistic fit weighs the categories.  Labels are read only
    of rows outside the held fold, and of at most ``max_labelled`` rows of either kind.

    Returns one row per input row: id, held_out, score (0 to 1).  A null or empty text, and
    any text in which nothing matches, gets the fit's base score.  Null labels are left
    out, several labels of one id averaged.  With too few labels to fit, the seed arcs and
    fixed weights are used.  A null id is never labelled.  Repeated rows are scored alike;
    labelled ones each count.  Of two arcs that read one word the more specific speaks.
    Very long texts are read whole.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("double").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL")
    known = known.filter(fold_of(F.col("id"), folds) != held).groupBy("id").agg(F.avg("y").alias("y"))
    seen = known.agg(F.count_if(F.col("y") >= 0.5), F.count_if(F.col("y") < 0.5)).first()
    # A bounded set of ids: its broadcast doesn't grow with the corpus.
    chosen = [known.filter(c).orderBy(F.xxhash64("id"), "id").limit(max_labelled) for c in ("y >= 0.5", "y < 0.5")]
    rows = staged(own.join(F.broadcast(chosen[0].union(chosen[1])), "id"), "toxicity-labelled")
    sizes = rows.agg(F.count_if(F.col("y") >= 0.5), F.count_if(F.col("y") < 0.5)).first()
    arcs = learn_arcs(rows, *sizes)
    shared = spark.sparkContext.broadcast(arcs)

    def grammar() -> Grammar:
        if "grammar" not in shared.__dict__:
            shared.__dict__["grammar"] = Grammar(shared.value)
        return shared.__dict__["grammar"]

    @tidy
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = grammar()
        for batch in batches:
            found = [reader.measures(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(found, pa.list_(pa.float64()))], names=["y", "x"])

    weights = np.array([-4.0, 2.0, 2.5, 0.3, 0.5, 2.5, 1.0, 0.5])
    if min(sizes) >= 10:
        measured = rows.select("id", "text", "y").mapInArrow(measure, "y double, x array<double>").collect()  # 2 * max_labelled rows at most
        x = np.array([[1.0, *r["x"]] for r in measured])
        y = np.array([r["y"] >= 0.5 for r in measured], dtype=float)
        # Each kind counts as often as it occurs among all labels, however many were taken.
        weights = fit_weights(x, y, np.where(y == 1, seen[0] / sizes[0], seen[1] / sizes[1]) * (len(y) / sum(seen)))

    @tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = grammar()
        for batch in batches:
            x = np.array([[1.0, *reader.measures(t.as_py() or "")] for t in batch.column(1)]).reshape(len(batch), len(weights))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))))], names=["id", "score"])

    scored = own.mapInArrow(score, "id bigint, score double")
    return scored.select(F.col("id").alias(id_col), (fold_of(F.col("id"), folds) == held).alias("held_out"), "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
