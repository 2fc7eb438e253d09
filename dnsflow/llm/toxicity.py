"""Toxicity by a grammar of weighted finite-state transducers over clauses.

``Transducer`` reads symbols, writes symbols and multiplies weights; ``compose`` feeds one's output to the next. The
cascade is: lexicon (word -> class with a weight), negation scope, reported speech, target, clause score. The lexicon's
insults are learned from labelled rows: whole words and word beginnings that occur in toxic texts in many different surroundings. Threat, target,
negation and report words are short fixed lists; whether a matched clause that is negated, reported or aimed at someone counts
more or less is learned as well, by a logistic regression on clause scores that is drawn towards stated defaults.

Labels enter only through ``learn``, which fits on a sample of about ``FIT_ROWS`` rows per label at most, drawn by a hash of
doc_id and so small enough to be broadcast; the regression weighs a sampled row by the rows it stands for. Scoring maps whole texts in Arrow batches without a shuffle.

Nulls: a null text is empty; a text without a matched clause, so an empty one, gets the base score. Labels of rows with one doc_id: the
larger counts. A null doc_id has no label and is not held out. Without labels of both kinds the lexicon is empty and every text gets the same low score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dnsflow.llm.common import unused, with_column_type
from dnsflow.operators.scale import materialize

FIT_ROWS = 20_000               # labelled rows per label that the model is fitted on, in expectation
SHORTEST, LONGEST = 4, 8        # word beginnings that may enter the lexicon
SUPPORT, RATIO, CERTAIN = 6, 5.0, 1.64     # different surroundings, odds ratio, and its lower bound in standard errors
WORDS = r"[\p{L}\p{N}]+"

# Word lists of our own, in four languages.
THREATS = "kill hurt beat destroy punish crush stab shoot burn töten schlagen vernichten tuer frapper brûler matar golpear quemar".split()
TARGETS = ("you your yours he she they him her them his their this that these those "
           "du dich dir dein ihr euch er sie der die das tu toi vous ton votre il elle ils elles le la les "
           "usted ustedes tú ti él ella ellos ellas el los las").split()
NEGATIONS = "not no never none neither nor don doesn isn aren wasn nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún".split()
REPORTS = ("said says say called calls quoted wrote claimed reported according sagte sagt schrieb nannte behauptete "
           "dit disait écrit appelé selon dijo dice escribió llamó según").split()

FEATURES = ("plain", "negated", "reported", "aimed", "threats", "clauses", "density")
#: Drawn towards these: one plain match of common weight is toxic, a negated or reported one hardly so.
DEFAULTS = np.array([-3.0, 2.0, 0.3, 0.3, 0.5, 0.5, 0.3, 0.3])


@dataclass
class Transducer:
    """``step(state, symbol)`` gives (state, symbol, weight)."""

    start: object
    step: Callable[[object, str], tuple[object, str, float]]

    def run(self, symbols: Iterable[str]) -> list[tuple[str, float]]:
        state, out = self.start, []
        for symbol in symbols:
            state, written, weight = self.step(state, symbol)
            out.append((written, weight))
        return out


def compose(*parts: Transducer) -> Transducer:
    """Each part reads what the part before it writes; weights multiply."""
    def step(states, symbol):
        total, after = 1.0, []
        for part, state in zip(parts, states):
            state, symbol, weight = part.step(state, symbol)
            total *= weight
            after.append(state)
        return tuple(after), symbol, total

    return Transducer(tuple(p.start for p in parts), step)


@dataclass(frozen=True)
class Lexicon:
    """Insults: weights of whole words and of word beginnings."""

    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)

    def weight(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for n in range(SHORTEST, min(LONGEST, len(word)) + 1):
            best = max(best, self.beginnings.get(word[:n], 0.0))
        return best


def lexical(lexicon: Lexicon) -> Transducer:
    """Words to classes: insult, threat, target, negation, report, other."""
    fixed = {w: kind for kind, words in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS), ("threat", THREATS))
             for w in words}

    def step(state, word):
        weight = lexicon.weight(word)
        return (state, "insult", weight) if weight > 0 else (state, fixed.get(word, "other"), 1.0)

    return Transducer(None, step)


def scope(opens: str, mark: str, reach: int) -> Transducer:
    """Marks insults and threats within ``reach`` symbols after ``opens``; the state is what is left of the reach."""
    def step(left, symbol):
        if symbol == opens:
            return reach, symbol, 1.0
        if left and symbol.split("+")[0] in ("insult", "threat"):
            return left, f"{symbol}+{mark}", 1.0
        return max(left - 1, 0), symbol, 1.0

    return Transducer(0, step)


def aim() -> Transducer:
    """Marks insults and threats in a clause that has named a target before."""
    def step(seen, symbol):
        if symbol == "target":
            return True, symbol, 1.0
        return seen, f"{symbol}+aimed" if seen and symbol.split("+")[0] in ("insult", "threat") else symbol, 1.0

    return Transducer(False, step)


def grammar(lexicon: Lexicon) -> Transducer:
    return compose(lexical(lexicon), scope("negation", "negated", 3), scope("report", "reported", 12), aim())


_CLAUSE = re.compile(r"[^.!?;:\n\r|]+")
_WORD = re.compile(r"[^\W_]+")


class Scorer:
    """Clause features of a text. Clauses without a lexicon word are skipped: they would write no match."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.machine = grammar(lexicon)
        self.finder = ahocorasick.Automaton()
        for word in {*lexicon.words, *lexicon.beginnings, *THREATS}:
            self.finder.add_word(word, len(word))
        self.finder.make_automaton()

    def features(self, text: str | None) -> list[float]:
        out = [0.0] * len(FEATURES)
        if not text:
            return out
        low = text.lower()
        done = 0
        for end, length in self.finder.iter(low):
            start = end - length + 1
            if start < done or start and (low[start - 1].isalnum()):
                continue
            begin = max(low.rfind(c, 0, start) for c in ".!?;:\n\r|") + 1
            clause = _CLAUSE.match(low, begin)
            done = clause.end()
            self._add(self.machine.run(_WORD.findall(clause[0])), out)
        out[6] = 100 * out[0] / (low.count(" ") + 1)
        return [math.log1p(x) for x in out]

    def _add(self, written: list[tuple[str, float]], out: list[float]) -> None:
        matched = False
        for symbol, weight in written:
            kind, *marks = symbol.split("+")
            if kind == "insult":
                matched = True
                out[1 if "negated" in marks else 2 if "reported" in marks else 0] += weight
                out[3] += weight * ("aimed" in marks and "negated" not in marks and "reported" not in marks)
            elif kind == "threat" and "aimed" in marks and not {"negated", "reported"} & {*marks}:
                out[4] += 1.0
        out[5] += matched


def clause_features(docs: DataFrame, lexicon: Lexicon, text: str = "text", features: str = "features") -> DataFrame:
    """Add the clause features of every whole text."""
    schema = with_column_type(docs.schema, features, T.ArrayType(T.DoubleType(), False))

    def run(batches):
        scorer = Scorer(lexicon)
        for batch in batches:
            rows = pa.array([scorer.features(t.as_py()) for t in batch.column(text)], pa.list_(pa.float64()))
            keep = [n for n in batch.schema.names if n != features]
            yield pa.RecordBatch.from_arrays([*map(batch.column, keep), rows], [*keep, features])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str | Column = "doc_id", folds: int = 5) -> Column:
    """Rows whose labels are never learned: crc32 of the id's text leaves 0."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def training_labels(labels: DataFrame, doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """One label per document that may be learned: doc_id, y."""
    return labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(doc_id)).groupBy(
        F.col(doc_id).alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))


def labelled_texts(docs: DataFrame, known: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The sample to fit on: text, y and times, the labelled rows that one sampled row stands for."""
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    chance = F.lit(1.0)
    for y, n in sizes.items():
        chance = F.when(F.col("y") == y, min(1.0, fit_rows / n)).otherwise(chance)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    sample = materialize(known.withColumn("times", 1 / chance).where(draw < chance))
    return materialize(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").drop("doc_id"))  # bounded by fit_rows


def learn_lexicon(texts: DataFrame) -> Lexicon:
    """Words and word beginnings of toxic texts, weighted by how much rarer they are elsewhere.

    What counts is the number of different surroundings (the word before and after), so copies and shared passages count once.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(0))
    around = lambda x, i: F.struct(
        x.alias("word"), F.xxhash64(F.get("words", i - 1), F.get("words", i + 1)).alias("around"))
    seen = texts.select("y", words.alias("words")).where(F.size("words") > 0).select(
        "y", F.explode(F.transform("words", around)).alias("w"), F.size("words").alias("_n")).select("y", "w.word", "w.around")
    kinds = seen.groupBy("word", "around").agg(F.max("y").alias("bad"), F.min("y").alias("least"))
    counts = kinds.groupBy("word").agg(F.sum("bad").alias("a"), F.sum((F.col("least") == 0).cast("int")).alias("c"))
    counts = materialize(counts)
    totals = counts.agg(F.sum("a").alias("a"), F.sum("c").alias("c")).first()
    begin = F.transform(
        F.sequence(F.lit(SHORTEST), F.lit(LONGEST)), lambda n: F.when(F.char_length("word") >= n, F.left("word", n)))
    units = counts.select("a", "c", F.explode(F.concat(
        F.array(F.concat(F.lit("="), "word")), begin)).alias("unit")).where("unit is not null")
    both = units.groupBy("unit").agg(F.sum("a").alias("a"), F.sum("c").alias("c"))
    weight = F.log((F.col("a") + 0.5) / (totals["a"] + 1.0)) - F.log((F.col("c") + 0.5) / (totals["c"] + 1.0))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("c") + 0.5))
    found = both.withColumn("weight", weight - CERTAIN * error).where(
        (F.col("a") >= SUPPORT) & (F.col("weight") >= float(np.log(RATIO)))).select("unit", "a", "weight").collect()
    return _pruned({r["unit"]: (r["a"], r["weight"]) for r in found})


def _pruned(units: dict[str, tuple[int, float]]) -> Lexicon:
    """Leaves out beginnings that nearly always go on in one way: the longer unit says the same."""
    longer: dict[str, int] = {}
    for unit, (count, _) in units.items():
        whole = unit.startswith("=")
        word = unit[1:] if whole else unit
        parent = word if whole else word[:-1]
        longer[parent] = max(longer.get(parent, 0), count)
    kept = {u: w for u, (n, w) in units.items() if u.startswith("=") or longer.get(u, 0) < 0.95 * n}
    return Lexicon({u[1:]: w for u, w in kept.items() if u.startswith("=")}, {u: w for u, w in kept.items() if not u.startswith("=")})


def fit_weights(rows: DataFrame, strength: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Logistic regression of y on the features, drawn towards ``DEFAULTS``; each round is one aggregation of sums."""
    weights = DEFAULTS.copy()
    x = [F.lit(1.0), *[F.get("features", F.lit(i)) for i in range(len(FEATURES))]]
    size = len(x)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    # Most texts have no match and so the same features: equal rows are counted once.
    counted = materialize(rows.groupBy("features", "y").agg(F.sum("times").alias("times")))
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-sum((F.lit(float(w)) * c for w, c in zip(weights, x)), F.lit(0.0))))
        own = counted.withColumn("_r", F.col("times") * (F.col("y") - p)).withColumn("_v", F.col("times") * p * (1 - p))
        sums = own.agg(*[F.sum(F.col("_r") * c) for c in x], *[F.sum(F.col("_v") * x[i] * x[j]) for i, j in pairs]).first()
        if sums[0] is None:
            return weights
        curve = np.zeros((size, size))
        for (i, j), v in zip(pairs, sums[size:]):
            curve[i, j] = curve[j, i] = v
        pull = np.diag([strength] * size)
        move = np.linalg.solve(curve + pull, np.array(sums[:size]) - strength * (weights - DEFAULTS))
        weights = weights + move
        if np.abs(move).max() < 1e-6:
            break
    return weights


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    weights: tuple[float, ...]


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Lexicon and weights from the labels that may be learned, on a sample bounded by ``fit_rows`` per label."""
    texts = labelled_texts(docs, materialize(training_labels(labels)), fit_rows)
    if texts.select("y").distinct().count() < 2:
        return Model(Lexicon(), tuple(DEFAULTS.tolist()))
    lexicon = learn_lexicon(texts)
    return Model(lexicon, tuple(map(float, fit_weights(
        clause_features(texts, lexicon).select("features", "y", "times")))))


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Add _held_out, _score (0 to 1) and _predicted (1 from 0.5 on) to the documents; one pass, nothing shuffled.

    Columns of these three names are replaced; all others stay.
    """
    features, = unused(docs.columns, "_features")
    marked = clause_features(docs, model.lexicon, text, features)
    total = sum((F.lit(w) * F.get(features, F.lit(i)) for i, w in enumerate(model.weights[1:])), F.lit(model.weights[0]))
    return marked.withColumn("_score", 1 / (1 + F.exp(-total))).withColumn(
        "_predicted", (F.col("_score") >= 0.5).cast("int")).withColumn("_held_out", held_out(doc_id)).drop(features)
