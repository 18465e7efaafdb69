"""Document quality learned from pairs: Bradley-Terry with logistic loss.

A document's worth is a weighted sum of features of its text; the chance that one
is preferred over another is the logistic of the difference. The labels give the
preference pairs, every good document over every bad one, of which the training
draws a new set in each round. The weights are fitted on a sample; the threshold is
the quantile of the worth of all labelled documents that may be learned from that
parts their labels best, and scores are scaled so that it lies at 0.7.
"""

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.sampling import known_labels, labelled_sample
from tidewatch.llm.tables import map_batches, texts_of, unused, with_columns
from tidewatch.session import written_once

ACCEPT = 0.7
KINDS = 10  # classes of bytes


def byte_kinds() -> np.ndarray:
    """The class of each byte: lower, upper, digit, blank, line break, sentence marks, brackets and quotes, other ASCII marks, the rest of ASCII, beyond ASCII."""
    kinds = np.full(256, 8, np.uint8)
    for kind, members in enumerate(
        (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b".,;:!?", b"()[]{}<>\"'`", b"#$%&*+-/=@\\^_|~")
    ):
        kinds[np.frombuffer(members, np.uint8)] = kind
    kinds[128:] = 9
    return kinds


BYTE_KINDS = byte_kinds()
SLICE = 1 << 20
FEATURES = KINDS * KINDS + 96 + 9


def shape(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Shares of neighbouring byte classes, and of single ASCII characters, slice by slice."""
    pairs, single = np.zeros(KINDS * KINDS), np.zeros(128)
    whole = np.frombuffer(data, np.uint8)
    for start in range(0, len(whole), SLICE):
        part = whole[start : start + SLICE + 1]
        kinds = BYTE_KINDS[part].astype(np.int16)
        pairs += np.bincount(kinds[:-1] * KINDS + kinds[1:], minlength=KINDS * KINDS)
        single += np.bincount(part[:SLICE][part[:SLICE] < 128], minlength=128)
    return pairs / max(1, len(whole) - 1), single[32:] / max(1, len(whole))


def features(text: str) -> np.ndarray:
    """What a text looks like: its characters, its words, and how much it repeats itself."""
    data = text.encode("utf-8", "surrogatepass")
    pairs, single = shape(data)
    words = text.split()
    lines = [line for line in text.split("\n") if line.strip()]
    n = max(1, len(words))
    again = sum(map(str.__eq__, words, words[1:])) / n
    runs = 1 - len(set(words)) / n
    same_lines = 1 - len(set(lines)) / max(1, len(lines))
    rest = [
        again,
        runs,
        runs / np.log2(n + 2),
        same_lines,
        np.log1p(len(words)) / 10,
        float(not words),
        len(data) / n / 10 if words else 0.0,
        np.log1p(n / max(1, len(lines))) / 5,
        float(len(words) < 5),
    ]
    return np.concatenate([np.sqrt(pairs), np.sqrt(single), rest])


@dataclass
class Ranking:
    """Weights of the features, the threshold on worth and its scale."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float

    def worth(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(self.worth(x))

    def scaled(self, worth: np.ndarray) -> np.ndarray:
        """From 0 to 1, and 0.7 at the threshold."""
        logit = np.log(ACCEPT / (1 - ACCEPT)) + (worth - self.threshold) / self.scale
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def preferences(x: np.ndarray, y: np.ndarray, rounds: int, pairs: int, ridge: float) -> np.ndarray:
    """Weights that make the good worth more than the bad: logistic loss on differences, by Adam."""
    draw = np.random.default_rng(7)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w, mean, square = (np.zeros(x.shape[1]) for _ in range(3))
    for step in range(1, rounds + 1):
        difference = x[draw.choice(good, pairs)] - x[draw.choice(bad, pairs)]
        wrong = 1 / (1 + np.exp(np.clip(difference @ w, -30, 30)))
        slope = -(wrong @ difference) / pairs + ridge * w
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        w -= 0.03 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return w


def parting_quantile(worth: np.ndarray, y: np.ndarray) -> float:
    """The middle of the quantiles of worth that part the labels with the fewest errors."""
    grid = np.quantile(worth, np.linspace(0, 1, 2001))
    return parting(grid, np.searchsorted(np.sort(worth[y == 1]), grid), (y == 0).sum() - np.searchsorted(np.sort(worth[y == 0]), grid))


def parting(grid: np.ndarray, good_below: np.ndarray, bad_from: np.ndarray) -> float:
    """The middle of the first run of cuts with the fewest errors: the good below a cut and the bad from it on."""
    wrong = good_below + bad_from
    best = np.flatnonzero(wrong == wrong.min())
    first = best[: np.argmax(np.append(np.diff(best) > 1, True)) + 1]  # the first run of equal quantiles
    return float((grid[first[0]] + grid[first[-1]]) / 2)


def learn_ranking(sample: DataFrame, rounds: int = 600, pairs: int = 1024, ridge: float = 1e-3) -> Ranking:
    """A ranking from `text`, `label` rows; only features and labels reach the driver. Its threshold parts these rows.

    Without both labels there is no pair to learn from: all documents then score 0.7.
    """

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(text).astype(np.float32) for text in texts_of(batch, "text")]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float32())), batch.column("label")], ["x", "label"])

    rows = map_batches(sample.select("text", "label"), measure, "x array<float>, label int").toArrow().combine_chunks()
    y = rows["label"].to_numpy()
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(len(y), -1).astype(float) if len(y) else np.zeros((0, FEATURES))
    if len(set(y.tolist())) < 2:
        return Ranking(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0, 1.0)
    order = np.lexsort(np.column_stack([y, x]).T)  # the same model however the rows came in
    x, y = x[order], y[order]
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    ranking = Ranking(mean, spread, preferences(np.clip((x - mean) / spread, -8, 8), y, rounds, pairs, ridge), 0.0, 1.0)
    worth = ranking.worth(x)
    ranking.threshold = parting_quantile(worth, y)
    ranking.scale = max(1e-6, float(np.median(worth[y == 1]) - np.median(worth[y == 0]))) / 8
    return ranking


def worths(docs: DataFrame, ranking: Ranking, text: str, name: str) -> DataFrame:
    """The table with each whole text's worth; null is the empty text."""

    def of_batch(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(ranking.worth(np.stack([features(x) for x in texts_of(batch, text)])))]

    return with_columns(docs, of_batch, {name: "double"})


def parted(ranking: Ranking, judged: DataFrame) -> Ranking:
    """The ranking with threshold and scale from all rows of `judged`: `worth`, `label`.

    The cuts tried are 2,001 quantiles and the middles between them; rows are
    counted between cuts, and only these counts reach the driver.
    """
    shares = [k / 2000 for k in range(2001)]
    found = judged.agg(
        F.percentile_approx("worth", shares, 10_000).alias("grid"),
        *(F.percentile_approx(F.when(F.col("label") == k, F.col("worth")), 0.5, 10_000).alias(f"m{k}") for k in (0, 1)),
    ).first()
    if found["m0"] is None or found["m1"] is None:
        return ranking
    values = np.unique(found["grid"])
    grid = np.sort(np.concatenate([values, (values[1:] + values[:-1]) / 2]))

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        below = np.searchsorted(grid, np.asarray(batch.column("worth")), side="right")
        cells, n = np.unique(2 * below + np.asarray(batch.column("label")), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n)], ["cell", "n"])

    cells = map_batches(judged.select("worth", "label"), counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(grid) + 1, 2), np.int64)
    for row in cells.collect():
        counts[divmod(row["cell"], 2)] = row["n"]
    below = np.cumsum(counts, axis=0)[:-1]
    threshold = parting(grid, below[:, 1], counts[:, 0].sum() - below[:, 0])
    return replace(ranking, threshold=threshold, scale=max(1e-6, found["m1"] - found["m0"]) / 8)


def fitted(
    docs: DataFrame, labels: DataFrame, learn: Column, rows: int, label: str, key: str, text: str
) -> tuple[Ranking, DataFrame]:
    """The ranking, and `doc_id`, `worth` of every row of `docs`, written once."""
    ranking = learn_ranking(labelled_sample(docs, labels, label, learn, rows, key, text))
    given = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    valued = written_once(worths(given, ranking, "text", "worth").select("doc_id", "worth"), "quality-worth")
    judged = valued.join(known_labels(labels, label, learn, key), F.col("doc_id") == F.col("key")).select("worth", "label")
    return (parted(ranking, judged) if ranking.weights.any() else ranking), valued


def with_quality(docs: DataFrame, ranking: Ranking, text: str = "text", name: str = "score") -> DataFrame:
    """The table with each whole text's score; null is the empty text."""

    def of_batch(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(ranking.score(np.stack([features(x) for x in texts_of(batch, text)])))]

    return with_columns(docs, of_batch, {name: "double"})


def judge(
    docs: DataFrame, labels: DataFrame, learn: Column, name: str, rows: int = 12_000, label: str = "quality", key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The table, all columns as given, with each text's score, learned as `score` does.

    Every text is measured once: the table is written with its worth, which the
    threshold is taken from and which the score is made of.
    """
    ranking = learn_ranking(labelled_sample(docs, labels, label, learn, rows, key, text))
    valued = written_once(worths(docs, ranking, text, name), "quality-documents")
    judged = valued.select(F.col(key).alias("doc_id"), F.col(name).alias("worth"))
    judged = judged.join(known_labels(labels, label, learn, key), F.col("doc_id") == F.col("key")).select("worth", "label")
    if ranking.weights.any():
        ranking = parted(ranking, judged)
    own = unused(valued, "worth")

    def of_batch(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(ranking.scaled(np.asarray(batch.column(own))))]

    return with_columns(valued.withColumnRenamed(name, own), of_batch, {name: "double"}).drop(own)


def learned(
    docs: DataFrame, labels: DataFrame, learn: Column, rows: int = 12_000, label: str = "quality", key: str = "doc_id", text: str = "text"
) -> Ranking:
    """A ranking whose weights are learned from at most about `rows` labelled rows for whose key `learn` holds.

    Threshold and scale are those of all such rows.
    """
    return fitted(docs, labels, learn, rows, label, key, text)[0]


def score(
    docs: DataFrame, labels: DataFrame, learn: Column, rows: int = 12_000, label: str = "quality", key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`doc_id`, `score` for every row of `docs`, repeated rows as often as they occur.

    Null and empty texts have a score like any other; other columns are ignored;
    an empty table gives no rows.
    """
    ranking, valued = fitted(docs, labels, learn, rows, label, key, text)

    def of_batch(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(ranking.scaled(np.asarray(batch.column("worth"))))]

    return with_columns(valued, of_batch, {"score": "double"}).select("doc_id", "score")
