"""Toxicity by a weighted finite-state pattern grammar over clauses.

Every clause becomes a string of symbols: lexicon word, intensifier, threat verb, modal, target, negation, report, other.
Five weighted transducers are composed: the insult transducer turns a lexicon word into an insult and raises it behind an
intensifier; the threat transducer reads phrases, a threat verb behind a modal ("will ... kill", "going to hurt") or
before a target ("kill you"), while a verb alone means nothing; negation rewrites a hit that follows it, reported speech
rewrites hits inside it, and the target transducer weighs a hit next to a target. The composed machine reads a clause
once and gives the weight of its matches by kind; a logistic layer over the clause scores of the whole text gives the
probability.

The insult lexicon (words and word beginnings with weights) and the logistic layer are fitted on labelled rows, at most
LABELLED_ROWS of them (chosen by a hash of doc_id), never on held-out ones. The layer is fitted on scores by lexicons
that were learned without the scored half of the rows; then the lexicon is learned again from both. Scoring needs no
shuffle and reads whole texts. Only the text enters a score. Defined results: null or empty text scores as a text without matches; without usable
labels the seed lexicon and DEFAULT_LAYER apply; a null doc_id is never a training row; repeated rows are scored each;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, stage

#: Bound of the labelled sample.
LABELLED_ROWS = 20_000
#: Partitions of that sample: the limit leaves it in one.
LABELLED_PARTS = 48
#: Entries of the learned lexicon, and candidates that are counted for it.
LEXICON, CANDIDATES = 20_000, 100_000
MIN_TOXIC, MIN_WEIGHT = 3, 2.0
PREFIXES = range(4, 9)
FOLDS = 5

# Grammar words.
SEED_INSULTS = "idiot moron stupid loser pathetic worthless scum trash disgusting clown dumb fool jerk imbecile idiota estúpido imbécil débile ordure idioten dummkopf abschaum".split()
THREATS = frozenset("kill hurt destroy beat punch burn hang shoot töten vernichten tuer détruire matar destruir".split())
TARGETS = frozenset("you your yours u he she they them him her these those this that du dich ihr sie euch tu toi vous ils elles te ti vosotros ellos usted".split())
NEGATIONS = frozenset("not no never neither nor isn't aren't don't nicht kein keine nie pas jamais aucun ne nunca ni".split())
REPORTS = frozenset("said says say wrote called claimed quoted quote reported according sagte schrieb nannte dit écrit appelé dijo escribió llamó".split())
MODALS = frozenset("will shall gonna going i'll we'll they'll he'll she'll you'll must want wanna should would werde werden wird wollen vais va vamos voy quiero veux".split())
INTENSIFIERS = frozenset("so such complete total absolute utter fucking damn bloody real really total völlig total tan muy si très tellement".split())
#: Tokens that a negation, a modal or a target reaches.
REACH = 3
_TOKEN = re.compile(r"[^\W_]+(?:'[a-z]+)?|[.!?;:\n]")
_BREAK = frozenset(".!?;:\n")

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, NEGATED, REPORTED = "o", "i", "t", "u", "n", "r", "x", "q"
#: What tokens are before the insult and the threat transducer have read them.
LEXICAL, INTENSIFIER, VERB, MODAL = "l", "e", "v", "m"


@dataclass
class Transducer:
    """A deterministic weighted transducer: (state, symbol) -> (state, symbol out, factor); other symbols pass."""

    arcs: dict[tuple[int, str], tuple[int, str, float]]
    idle: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol), (self.idle.get(state, state), symbol, 1.0))


def insult_fst() -> Transducer:
    """A lexicon word is an insult, a stronger one right behind an intensifier."""
    return Transducer({(0, INTENSIFIER): (1, OTHER, 1.0), (1, INTENSIFIER): (1, OTHER, 1.0), (0, LEXICAL): (0, INSULT, 1.0), (1, LEXICAL): (0, INSULT, 1.2)}, {1: 0})


def threat_fst() -> Transducer:
    """Threats are phrases: a verb up to REACH tokens behind a modal, or a target up to REACH tokens behind a verb. States: 0, modal heard, verb heard."""
    arcs: dict[tuple[int, str], tuple[int, str, float]] = {}
    idle: dict[int, int] = {}
    modal, verb = (lambda k: k), (lambda k: REACH + k)
    for s in range(2 * REACH + 1):
        idle[s] = 0 if s in (0, modal(1), verb(1)) else s - 1
        arcs[s, MODAL] = (modal(REACH), OTHER, 1.0)
        arcs[s, VERB] = (0, THREAT, 1.5) if 0 < s <= REACH else (verb(REACH), OTHER, 1.0)
        for passing in (NEGATION, TARGET):
            arcs[s, passing] = (s, passing, 1.0)  # "will not kill", "will you kill"
        if s > REACH:
            arcs[s, TARGET] = (0, THREAT, 1.0)
    return Transducer(arcs, idle)


def negation_fst() -> Transducer:
    arcs, idle = {}, {}
    for s in range(REACH + 1):
        arcs[s, NEGATION] = (REACH, NEGATION, 1.0)
        idle[s] = max(0, s - 1)
        if s:
            for hit in (INSULT, THREAT):
                arcs[s, hit] = (s - 1, NEGATED, 0.5)
    return Transducer(arcs, idle)


def report_fst() -> Transducer:
    return Transducer({(0, REPORT): (1, REPORT, 1.0), **{(1, h): (1, REPORTED, 0.7) for h in (INSULT, THREAT, NEGATED)}})


def target_fst() -> Transducer:
    arcs, idle = {}, {}
    for s in range(REACH + 1):
        arcs[s, TARGET] = (REACH, TARGET, 1.0)
        idle[s] = max(0, s - 1)
        if s:
            arcs[s, INSULT] = (s - 1, INSULT, 1.25)
            arcs[s, THREAT] = (s - 1, THREAT, 2.0)
    return Transducer(arcs, idle)


class Composition:
    """Transducers one behind the other; product states are made as they are met."""

    def __init__(self, *parts: Transducer):
        self.parts = parts
        self.made: dict[tuple[tuple[int, ...], str], tuple[tuple[int, ...], str, float]] = {}
        self.start = (0,) * len(parts)

    def step(self, state: tuple[int, ...], symbol: str) -> tuple[tuple[int, ...], str, float]:
        key = (state, symbol)
        if key not in self.made:
            out, factor, states = symbol, 1.0, []
            for p, s in zip(self.parts, state, strict=True):
                s, out, f = p.step(s, out)
                states.append(s)
                factor *= f
            self.made[key] = (tuple(states), out, factor)
        return self.made[key]


#: Symbols of grammar words; a word of two kinds has the first of them.
SYMBOLS = {w: x for words, x in ((INTENSIFIERS, INTENSIFIER), (REPORTS, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET), (MODALS, MODAL), (THREATS, VERB)) for w in words}
GRAMMAR = (insult_fst, threat_fst, negation_fst, report_fst, target_fst)
#: Features of a text: best clause, sum of clauses, negated, reported, hits for each word.
FEATURES = 5
DEFAULT_LAYER = ([0.9, 0.15, 0.1, 0.1, 5.0], -4.0)


def word_features(w: str) -> list[str]:
    return [f"={w}", *(w[:k] for k in PREFIXES if len(w) >= k)]


@dataclass
class Model:
    lexicon: dict[str, float]
    weights: list[float]
    bias: float

    def scorer(self) -> Scorer:
        return Scorer(self)


class _Weights(dict):
    """Lexical weight of a word, kept for a bounded number of words."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, w: str) -> float:
        get = self.lexicon.get
        v = max((get(x, 0.0) for x in word_features(w)), default=0.0)
        if len(self) > 400_000:
            self.clear()
        self[w] = v
        return v


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.weights = _Weights(model.lexicon)
        self.machine = Composition(*(f() for f in GRAMMAR))

    def features(self, text: str) -> list[float]:
        tokens = _TOKEN.findall(text.lower())
        weigh, seen = self.weights, set(tokens)
        if THREATS.isdisjoint(seen) and not any(map(weigh.__getitem__, seen)):
            return [0.0] * FEATURES
        values = [weigh[t] for t in tokens]
        best = total = negated = reported = clause = 0.0
        hits, state, step = 0, self.machine.start, self.machine.step
        for t, v in zip(tokens, values, strict=True):
            if t in _BREAK:
                best, clause, state = max(best, clause), 0.0, self.machine.start
                continue
            state, out, factor = step(state, LEXICAL if v else SYMBOLS.get(t, OTHER))
            if out == INSULT or out == THREAT:
                got = factor * (v or 0.5)
                clause += got
                total += got
                hits += 1
            elif out == NEGATED:
                negated += factor * (v or 0.5)
            elif out == REPORTED:
                reported += factor * (v or 0.5)
        best = max(best, clause)
        return [best, math.log1p(total), math.log1p(negated), math.log1p(reported), hits / max(1, len(tokens))]

    def score(self, text: str) -> float:
        z = self.model.bias + sum(a * b for a, b in zip(self.model.weights, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """At most LABELLED_ROWS labelled texts outside the held-out fold, one a doc_id, staged: text, toxic.

    Ids are taken by a hash; where an id's rows differ, its text is the smallest one.
    """
    own = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = own.count()
    share = min(1.0, 0.97 * LABELLED_ROWS / max(1, total))
    own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    own = own.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)), "doc_id").limit(LABELLED_ROWS)
    picked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = picked.join(F.broadcast(own), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return stage(rows.select("text", "toxic").repartition(LABELLED_PARTS), "toxic-train")


def _emit(counter: Counter, col: str):
    return pa.RecordBatch.from_pydict({"f": pa.array(list(counter), pa.string()), col: pa.array(list(counter.values()), pa.int64())})


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    def count(col: str, wanted: frozenset | None):
        def run(batches):
            for b in batches:
                c: Counter = Counter()
                for t in b["text"].to_pylist():
                    found = {x for w in set(_TOKEN.findall(t.lower())) if w not in _BREAK for x in word_features(w)}
                    c.update(found if wanted is None else found & wanted)
                yield _emit(c, col)

        return run

    by = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = by.get(1, 0), by.get(0, 0)
    if not n_toxic or not n_clean:
        return {}
    toxic = rows.where("toxic = 1").mapInArrow(count("n", None), "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))
    found = {r["f"]: r["n"] for r in toxic.where(F.col("n") >= MIN_TOXIC).orderBy(F.desc("n"), "f").limit(CANDIDATES).collect()}
    clean = rows.where("toxic = 0").mapInArrow(count("n", frozenset(found)), "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))
    against = {r["f"]: r["n"] for r in clean.collect()}
    out = {}
    for f, n in found.items():
        m = against.get(f, 0)
        weight = math.log((n + 0.5) / (n_toxic + 1)) - math.log((m + 0.5) / (n_clean + 1))
        # a bound from below: two standard errors of the log ratio
        weight -= 1.5 * math.sqrt(1 / (n + 0.5) + 1 / (m + 0.5) * (m > 0))
        if weight >= MIN_WEIGHT:
            out[f] = round(weight, 4)
    return dict(sorted(out.items(), key=lambda x: (-found[x[0]] * x[1], x[0]))[:LEXICON])


def _logistic(x, y):
    import numpy as np

    x = np.column_stack([x, np.ones(len(x))])
    scale = np.append(np.maximum(x[:, :-1].std(axis=0), 1e-6), 1.0)
    z, beta = x / scale, np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        ridge = np.full(len(beta), 1e-2 * len(y) ** 0.5)
        ridge[-1] = 1e-6
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * beta)
        beta += np.clip(step, -5, 5)
        if abs(step).max() < 1e-6:
            break
    beta = beta / scale
    return beta[:-1].tolist(), float(beta[-1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    import numpy as np

    rows = training_rows(docs, labels)
    seeds = {f"={w}": 3.0 for w in SEED_INSULTS}
    half = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(2))
    found = []
    for k in (0, 1):  # the layer sees scores by a lexicon that was learned from the other half
        other = Model(seeds | learn_lexicon(rows.where(half != k)), *DEFAULT_LAYER)

        def run(batches, other=other):
            s = other.scorer()
            for b in batches:
                yield pa.RecordBatch.from_pydict({"x": pa.array([s.features(t) for t in b["text"].to_pylist()], pa.list_(pa.float64())), "toxic": b["toxic"].cast(pa.int32())})

        found.append(rows.where(half == k).mapInArrow(run, "x array<double>, toxic int"))
    got = found[0].unionByName(found[1]).toPandas()
    lexicon = seeds | learn_lexicon(rows)
    if got["toxic"].nunique() < 2:
        return Model(lexicon, *DEFAULT_LAYER)
    weights, bias = _logistic(np.array(got["x"].tolist()), got["toxic"].to_numpy(float))
    return Model(lexicon, weights, bias)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    picked = docs.select("doc_id", held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        s = model.scorer()
        for b in batches:
            score = [s.score(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": b["doc_id"].cast(pa.int64()), "held_out": b["held_out"], "score": pa.array(score, pa.float64()), "predicted": pa.array([int(x >= 0.5) for x in score], pa.int32())}
            )

    return picked.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op1_toxicity(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_documents(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the model doesn't call toxic, all columns as they are."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def run(batches):
        s = model.scorer()
        for b in batches:
            keep = [s.score(t or "") < 0.5 for t in b["text"].to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
