"""Toxicity by a weighted grammar of finite-state transducers over clauses.

Five transducers read a clause word by word and are composed into one pass:
insults (words and word beginnings whose weights are learned), threats, targets,
negation and reported speech. The composed machine does not score words on their
own: a clause that matches an insult or a threat is scored as a whole, and falls
into one of four states, plain, aimed at somebody, negated or reported, each with
a weight of its own that the labels decide. Threats have states, and weights for
them, of their own; an aimed threat counts as an aimed insult besides, so that it is
scored where the labels know no threats.
"""

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.sampling import labelled_sample
from tidewatch.llm.tables import map_batches, texts_of, with_columns

# Fixed word lists of the grammar's closed classes, in English, German, French and Spanish.
THREATS = frozenset(
    "kill hurt destroy beat burn shoot stab töten schlagen verbrennen zerstören tuer frapper détruire brûler "
    "matar golpear destruir quemar".split()
)
TARGETS = frozenset(
    "you your yours he him she her they them these those people du dich dir ihr euch sie er tu toi te vous il elle ils "
    "elles tú usted ustedes él ella ellos ellas".split()
)
NEGATIONS = frozenset(
    "not no never nobody without don't doesn't isn't aren't nicht kein keine nie niemals ohne pas jamais aucun sans "
    "nunca jamás sin ningún".split()
)
REPORTS = frozenset(
    "said says say wrote writes called calls quoted reported claims claimed sagte sagt schrieb nannte dit écrit appelle "
    "dijo dice escribió llamó".split()
)
CLAUSE_ENDS = ".!?;:"
EDGES = "\"'`´‘’“”«»()[]{}<>.,;:!?¡¿*_#%&$|-–—…/\\~=+"
PREFIXES = (3, 4, 5, 6, 7, 8)
REACH = 3  # words over which a negation holds
NEAR = 32  # words over which reports and targets hold, for clauses that do not end
THREAT = 3.0  # a threat's weight, where an insult has a learned one
MEMORY = 1 << 20


def stripped(token: str) -> str:
    return token.strip(EDGES).lower()


def beginnings(word: str) -> list[str]:
    """The word, and its beginnings marked as such, where they leave at least two letters."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n + 2)]


@dataclass
class Grammar:
    """Learned insult weights by word or marked beginning, and the document model."""

    insults: dict[str, float]
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float


class Lexicon(dict):
    """From a token as written to its class: an insult's weight, a closed class or None."""

    def __init__(self, insults: dict[str, float]):
        super().__init__()
        self.insults = insults

    def __missing__(self, token: str):
        word = stripped(token)
        weight = max((self.insults[x] for x in beginnings(word) if x in self.insults), default=0.0)
        kind = (weight, word in THREATS) if weight or word in THREATS else None
        if len(self) < MEMORY:
            self[token] = kind
        return kind


STATES = ("plain", "aimed", "negated", "reported")


def clause_states(words: list[str], matches: list[int]) -> list[str]:
    """The states of the composed machine at the matches of a clause, from one reading.

    Reported speech outranks negation, and negation outranks a target: a target
    counts anywhere in the clause, the other two only before the match.
    """
    states, wanted = [], iter([*matches, len(words)])
    at, report, negation, target = next(wanted), -NEAR - 1, -REACH - 2, -NEAR - 1
    open_until: list[int] = []  # plain matches that a target may still follow
    for place, word in enumerate(words):
        if place == at:
            if place - report <= NEAR:
                states.append("reported")
            elif place - negation <= REACH + 1:
                states.append("negated")
            elif place - target <= NEAR:
                states.append("aimed")
            else:
                open_until.append(len(states))
                states.append("plain")
            at = next(wanted)
        if word in REPORTS:
            report = place
        if word in NEGATIONS:
            negation = place
        if word in TARGETS:
            target = place
            for k in open_until:
                if place - matches[k] <= NEAR:
                    states[k] = "aimed"
            open_until = []
    return states


def clause_state(words: list[str], at: int) -> str:
    """The state at one match."""
    return clause_states(words, [at])[0]


def measures(text: str, lexicon: Lexicon) -> list[float]:
    """What the grammar finds in a text: weight and clauses by state, the best clause, density; the same by state of threats.

    A clause is read once, from stop to stop, with all its matches, and counts
    once for each state that it has matches in. A text without stops is one
    clause, whose matches are each read with the words near them.
    """
    tokens = text.split()
    kinds = list(map(lexicon.__getitem__, tokens))
    hits = [i for i, kind in enumerate(kinds) if kind is not None]
    weight, threat_weight = dict.fromkeys(STATES, 0.0), dict.fromkeys(STATES, 0.0)
    clauses, threat_clauses = dict.fromkeys(STATES, 0), dict.fromkeys(STATES, 0)
    best, first = 0.0, 0
    while first < len(hits):
        start, end, last = hits[first], hits[first] + 1, first + 1
        while start > 0 and tokens[start - 1][-1] not in CLAUSE_ENDS:
            start -= 1
        while end < len(tokens) and tokens[end - 1][-1] not in CLAUSE_ENDS:
            end += 1
        while last < len(hits) and hits[last] < end:
            last += 1
        found = hits[first:last]
        states = clause_states([stripped(token) for token in tokens[start:end]], [i - start for i in found])
        clause_weight, insulted, threatened = 0.0, set(), set()
        for i, state in zip(found, states, strict=True):
            worth, threat = kinds[i]
            if threat:
                threat_weight[state] += THREAT
                threatened.add(state)
                worth = max(worth, THREAT) if state == "aimed" else worth
            if worth:
                weight[state] += worth
                insulted.add(state)
            clause_weight += worth
        for state in insulted:
            clauses[state] += 1
        for state in threatened:
            threat_clauses[state] += 1
        best, first = max(best, clause_weight), last
    total = sum(weight.values())
    return [
        *(np.log1p(weight[state]) for state in STATES),
        *(np.log1p(clauses[state]) for state in STATES),
        np.log1p(total),
        np.log1p(best),
        np.log1p(1000 * total / (len(tokens) + 50)),
        *(np.log1p(threat_weight[state]) for state in STATES),
        *(np.log1p(threat_clauses[state]) for state in STATES),
    ]


def learn_insults(sample: DataFrame, least: int = 4, most: int = 5000) -> dict[str, float]:
    """Weights of words and beginnings that mark label 1, from `text`, `label` rows.

    Candidates occur in at least `least` texts of label 1. They are kept if their
    log odds are high and beyond chance, and if they stand in several different
    surroundings there: words that copies of one text share do not.
    """

    def shared(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen = Counter()
        for text in texts_of(batch, "text"):
            seen.update({x for token in set(text.split()) for x in beginnings(stripped(token))})
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["x", "n"])

    def counted(rows: DataFrame) -> DataFrame:
        return map_batches(rows.select("text"), shared, "x string, n long").groupBy("x").agg(F.sum("n").alias("n"))

    sizes = {row["label"]: row["n"] for row in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return {}
    # Words of the label-1 texts alone can be candidates; the others are counted only where they meet.
    ones = counted(sample.where("label = 1")).where((F.col("n") >= least) & (F.length("x") >= 3))
    zeros = counted(sample.where("label = 0")).withColumnRenamed("n", "m")
    odds = F.log((F.col("n") + 0.5) / (bad + 1)) - F.log((F.coalesce("m", F.lit(0)) + 0.5) / (good + 1))
    chance = F.greatest(F.lit(0.5), (F.coalesce("m", F.lit(0)) + F.col("n")) * bad / (bad + good))
    candidates = (
        ones.join(zeros, "x", "left")
        .withColumns({"odds": odds, "beyond": (F.col("n") - chance) / F.sqrt(chance)})
        .where("odds >= 2.5 AND beyond >= 4")
        .orderBy(F.desc("beyond"), "x")
        .limit(most)
        .collect()
    )
    weights = {row["x"]: row["odds"] for row in candidates}

    def surroundings(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = set()
        for text in texts_of(batch, "text"):
            words = ["", *map(stripped, text.split()), ""]
            for i in range(1, len(words) - 1):
                for x in beginnings(words[i]):
                    if x in weights:
                        found.add((x, f"{words[i - 1]} {words[i + 1]}"))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in sorted(found)], pa.string()) for k in (0, 1)], ["x", "around"])

    varied = (
        map_batches(sample.where("label = 1").select("text"), surroundings, "x string, around string")
        .groupBy("x")
        .agg(F.count_distinct("around").alias("places"))
        .where(F.col("places") >= least)
        .collect()
    )
    kinds = {row["x"]: row["places"] for row in varied}
    spread = {x: weight * min(1.0, kinds[x] / 10) for x, weight in weights.items() if x in kinds}
    # A beginning counts only where it says more than the words that it stands for.
    return {
        x: weight
        for x, weight in spread.items()
        if not (x.endswith("*") and any(y != x and not y.endswith("*") and y.startswith(x[:-1]) and kinds[y] >= 0.8 * kinds[x] for y in spread))
    }


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * len(x) / 100)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def learn_grammar(sample: DataFrame) -> Grammar:
    """Insult weights, then how the grammar's measures add up, from `text`, `label` rows.

    Only the measures and labels of the sample reach the driver. With one label
    or none nothing can be learned: every text then scores the share of label 1.
    """
    insults = learn_insults(sample)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        lexicon = Lexicon(insults)
        found = [measures(text, lexicon) for text in texts_of(batch, "text")]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column("label")], ["x", "label"])

    rows = map_batches(sample.select("text", "label"), measure, "x array<double>, label int").toArrow()
    size = len(measures("", Lexicon({})))
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, size)
    y = np.array(rows["label"].to_pylist(), float)
    if not 0 < y.sum() < len(y):
        share = float(np.clip(y.mean() if len(y) else 0.0, 0.01, 0.99))
        return Grammar(insults, np.zeros(size), np.ones(size), np.zeros(size), float(np.log(share / (1 - share))))
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    # Threats may be rare among the labels: their measures keep the scale they have.
    mean[-2 * len(STATES) :], spread[-2 * len(STATES) :] = 0.0, 1.0
    weights, bias = logistic((x - mean) / spread, y)
    return Grammar(insults, mean, spread, weights, bias)


def with_toxicity(docs: DataFrame, grammar: Grammar, text: str = "text", name: str = "score") -> DataFrame:
    """The table with each whole text's score, from 0 to 1; null is the empty text."""

    lexicons: list[Lexicon] = []  # one for each task, filled as it reads

    def of_batch(batch: pa.RecordBatch) -> list[pa.Array]:
        if not lexicons:
            lexicons.append(Lexicon(grammar.insults))
        found = np.array([measures(x, lexicons[0]) for x in texts_of(batch, text)])
        logits = ((found - grammar.mean) / grammar.spread) @ grammar.weights + grammar.bias
        return [pa.array(1 / (1 + np.exp(-np.clip(logits, -30, 30))))]

    return with_columns(docs, of_batch, {name: "double"})


def learned(
    docs: DataFrame, labels: DataFrame, learn: Column, rows: int = 12_000, label: str = "toxic", key: str = "doc_id", text: str = "text"
) -> Grammar:
    """A grammar learned from at most about `rows` labelled rows for whose key `learn` holds."""
    return learn_grammar(labelled_sample(docs, labels, label, learn, rows, key, text))


def score(
    docs: DataFrame, labels: DataFrame, learn: Column, rows: int = 12_000, label: str = "toxic", key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`doc_id`, `score` for every row of `docs`, repeated rows as often as they occur.

    `learn` is a condition on `key`, the labels' key. Null and empty texts are
    scored like a text without words. Other columns are ignored, an empty table
    gives no rows.
    """
    grammar = learned(docs, labels, learn, rows, label, key, text)
    given = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return with_toxicity(given, grammar).select("doc_id", "score")
