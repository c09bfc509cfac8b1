"""Toxicity by a weighted finite-state pattern grammar.

Words are read as symbols by a lexical transducer: insult, threat, target,
negation, reporting verb, other. Three small transducers rewrite a clause's
symbols one after the other and weigh them: reported speech (an insult that is
quoted counts less), negation (so does one that is denied within a few words) and
target (one that is aimed at somebody counts more). They are composed once into
one machine; a clause's score is the sum of the lexical weights times the
machine's factors, and a document's score is a logistic function of what its
matched clauses add up to, their highest, and their share.

The insult lexicon holds fixed seeds and word beginnings learned from labels: at
most ``LABEL_BOUND`` labelled rows (the smallest hashes) that ``train`` allows. A
beginning counts if it is much commoner in toxic documents and stands behind
several different words there, so passages that are only copied teach nothing.

Null and empty texts have no clause and get the lowest score. Null ids and
repeated rows are scored like any other row; contradictory labels of an id count
once, the larger wins. Without usable labels the seeds and default weights hold.
Extra columns are ignored by ``score`` and kept by ``keep_clean``.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm.common import bounded_labels, map_arrow, one_row_an_id, stored, text_or_empty

LABEL_BOUND = 12_000
CUT = 0.3
BEGINNINGS = (4, 5, 6, 7, 8, 10)   # lengths of the learned word beginnings
MIN_DOCUMENTS, MIN_CONTEXTS, MIN_LIFT, MAX_LEXICON = 3, 3, 12.0, 5000

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "I", "H", "T", "N", "R", "O"
# Seeds of the lexicon.
SEEDS = {
    INSULT: "idiot moron stupid loser scum trash worthless pathetic disgusting clown fool imbecile dumb filth vermin "
            "dummkopf abschaum crétin ordure estúpido basura".split(),
    THREAT: "kill hurt destroy murder stab shoot töten tuer matar".split(),
    TARGET: "you your he she they them people du dich sie ihr tu vous ils elles usted ustedes ellos".split(),
    NEGATION: "not no never nobody nicht kein nie pas non jamais nunca".split(),
    REPORT: "said says called wrote quoted claimed sagte schrieb dit écrit dijo escribió".split(),
}
SEED_WEIGHT = {INSULT: 2.0, THREAT: 1.0}
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE_END = re.compile(r"[.!?;\n]+")

Machine = dict[tuple[object, str], tuple[object, str, float]]
START = 0


def reported_speech(factor: float = 0.5) -> Machine:
    """After a reporting verb insults and threats of the clause count less."""
    m: Machine = {}
    for s in (INSULT, THREAT, TARGET, NEGATION, OTHER):
        m[0, s] = (0, s, 1.0)
        m[1, s] = (1, s, factor if s in (INSULT, THREAT) else 1.0)
    m[0, REPORT] = m[1, REPORT] = (1, OTHER, 1.0)
    return m


def negation(reach: int = 3, factor: float = 0.4) -> Machine:
    """Insults and threats within ``reach`` words behind a negation count less."""
    m: Machine = {}
    for state in range(reach + 1):
        for s in (INSULT, THREAT, TARGET, OTHER):
            m[state, s] = (max(0, state - 1), s, factor if state and s in (INSULT, THREAT) else 1.0)
        m[state, NEGATION] = (reach, OTHER, 1.0)
    return m


def target(reach: int = 4, factor: float = 1.3) -> Machine:
    """Insults and threats within ``reach`` words behind a target count more, threats most."""
    m: Machine = {}
    for state in range(reach + 1):
        for s in (INSULT, THREAT, OTHER):
            aimed = {INSULT: factor, THREAT: factor * factor}.get(s, 1.0) if state else 1.0
            m[state, s] = (max(0, state - 1), s, aimed)
        m[state, TARGET] = (reach, OTHER, 1.0)
    return m


def compose(first: Machine, second: Machine) -> Machine:
    """The machine that feeds what ``first`` writes to ``second``; factors multiply. Only states that can be reached."""
    symbols = {s for _, s in first}
    out: Machine = {}
    todo = [(START, START)]
    seen = set(todo)
    while todo:
        state = todo.pop()
        for s in symbols:
            to, written, f = first[state[0], s]
            to2, last, g = second[state[1], written]
            out[START if state == (START, START) else state, s] = (START if (to, to2) == (START, START) else (to, to2), last, f * g)
            if (to, to2) not in seen:
                seen.add((to, to2))
                todo.append((to, to2))
    return out


@dataclass
class Grammar:
    """Learned lexicon (beginning of a word: weight) and the logistic weights over the clause figures."""
    insults: dict[str, float] = field(default_factory=dict)
    logistic: tuple[float, ...] = (-4.0, 2.0, 0.5, 2.0)

    @cached_property
    def machine(self) -> Machine:
        return compose(compose(reported_speech(), negation()), target())

    @cached_property
    def words(self) -> dict[str, str]:
        return {w: s for s, words in SEEDS.items() for w in words}

    @cached_property
    def automaton(self):
        import ahocorasick
        found = ahocorasick.Automaton()
        for w in {*self.insults, *SEEDS[INSULT], *SEEDS[THREAT]}:
            found.add_word(w, len(w))
        found.make_automaton()
        return found

    def __getstate__(self):
        return {"insults": self.insults, "logistic": self.logistic}

    def read(self, word: str) -> tuple[str, float]:
        """The lexical transducer: symbol and weight of a lower-case word."""
        for n in BEGINNINGS:
            if n <= len(word) and word[:n] in self.insults:
                return INSULT, self.insults[word[:n]]
        symbol = self.words.get(word, OTHER)
        return symbol, SEED_WEIGHT.get(symbol, 0.0)

    def clause(self, words: list[str]) -> float:
        """Score of one clause: lexical weights times the factors along the machine's path."""
        state, total, machine = START, 0.0, self.machine
        for word in words:
            symbol, weight = self.read(word)
            state, _, factor = machine[state, symbol]
            total += weight * factor
        return total

    def figures(self, text: str) -> list[float]:
        """log of the summed clause scores, the highest, share of clauses that match."""
        low = text.lower()
        hits = [end - n + 1 for end, n in self.automaton.iter(low)]
        hits = [h for h in hits if not h or not low[h - 1].isalnum()]
        if not hits:
            return [0.0, 0.0, 0.0]
        ends = [m.end() for m in CLAUSE_END.finditer(low)]
        bounds = [0, *ends, len(low)]
        scores = []
        for k in sorted({bisect_right(ends, h) for h in hits}):
            got = self.clause(WORD.findall(low, bounds[k], bounds[k + 1]))
            if got > 0:
                scores.append(got)
        if not scores:
            return [0.0, 0.0, 0.0]
        return [math.log1p(sum(scores)), math.log1p(max(scores)), math.sqrt(len(scores) / (len(ends) + 1))]

    def probability(self, figures: list[float]) -> float:
        z = self.logistic[0] + sum(w * x for w, x in zip(self.logistic[1:], figures))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def beginnings(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return {w[:n] for w in words for n in BEGINNINGS if n <= len(w)}


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Word beginnings that mark toxic documents. ``sample``: text, label; a bounded table."""
    spark = sample.sparkSession

    def document_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            counts[1 if label else 0].update(beginnings(text))
        names = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][w] for w in names], pa.int64()),
                                           pa.array([counts[0][w] for w in names], pa.int64())], names=["w", "toxic", "clean"])

    n_toxic, n_all = sample.agg(F.coalesce(F.sum((F.col("label") > 0).cast("long")), F.lit(0)), F.count(F.lit(1))).first()
    n_clean = n_all - n_toxic
    if not n_toxic or not n_clean:
        return {}
    base = n_clean / n_toxic
    per = (map_arrow(sample, document_counts, "w string, toxic long, clean long")
           .groupBy("w").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    lift = F.col("toxic") * base / (F.col("clean") + 0.5)
    candidates = {r["w"] for r in per.where(f"toxic >= {MIN_DOCUMENTS}").where(lift >= MIN_LIFT)
                  .orderBy((F.col("toxic") * F.log(lift)).desc(), "w").limit(MAX_LEXICON).select("w").collect()}
    if not candidates:
        return {}
    shared = spark.sparkContext.broadcast(candidates)

    def contexts(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Each candidate with the word before it and the label."""
        found = set()
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            words = WORD.findall(text.lower())
            for before, word in zip(["", *words], words):
                for n in BEGINNINGS:
                    if n <= len(word) and word[:n] in shared.value:
                        found.add((word[:n], before, bool(label)))
        cols = list(zip(*found)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()),
                                           pa.array(cols[2], pa.bool_())], names=["w", "before", "toxic"])

    around = (map_arrow(sample, contexts, "w string, before string, toxic boolean")
              .groupBy("w").agg(F.count_distinct(F.when(F.col("toxic"), F.col("before"))).alias("toxic"),
                                F.count_distinct(F.when(~F.col("toxic"), F.col("before"))).alias("clean")))
    lexicon = {}
    for r in around.collect():  # at most MAX_LEXICON rows
        gain = r["toxic"] * base / (r["clean"] + 0.5)
        if r["toxic"] >= MIN_CONTEXTS and gain >= MIN_LIFT:
            lexicon[r["w"]] = math.log(gain) / 2
    return {w: v for w, v in lexicon.items() if not any(w[:n] in lexicon for n in BEGINNINGS if n < len(w))}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, steps: int = 30) -> tuple[float, ...]:
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = ridge * len(y) / 100 * np.eye(len(w)) + 1e-6 * np.eye(len(w))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(map(float, w))


def train_grammar(docs: DataFrame, labels: DataFrame, train: Column, bound: int = LABEL_BOUND) -> Grammar:
    """Lexicon and logistic weights from the labelled documents that ``train`` (over ``doc_id``) allows."""
    chosen = bounded_labels(labels, "toxic", train, bound)
    sample = stored(one_row_an_id(docs, chosen).select("text", "label"))
    grammar = Grammar(learn_lexicon(sample))

    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [grammar.figures(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("label"), pa.array(x, pa.list_(pa.float64()))], names=["label", "x"])

    got = map_arrow(sample, measured, "label int, x array<double>").toArrow()
    y = np.array(got.column("label").to_pylist(), dtype=float) > 0
    if y.any() and not y.all():
        x = np.array(got.column("x").to_pylist(), dtype=float).reshape(-1, 3)
        grammar.logistic = fit_logistic(x, y.astype(float))
    return grammar


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, score (0 to 1) of every document."""
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [grammar.probability(grammar.figures(t)) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.float64())], names=["doc_id", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), one,
                     "doc_id long, score double")


def keep_clean(docs: DataFrame, grammar: Grammar, cut: float = CUT) -> DataFrame:
    """``docs`` without the rows that score ``cut`` or more; all columns stay as they are."""
    def toxic(texts: pa.Array) -> pa.Array:
        each = (t.as_py() for t in texts)      # one text at a time
        return pa.array([t is not None and grammar.probability(grammar.figures(t)) >= cut for t in each], pa.bool_())

    return docs.where(~F.arrow_udf(toxic, "boolean")(F.col("text").cast("string")))
