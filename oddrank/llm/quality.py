"""Quality classifier: supervised subword embeddings.

Every word, pair of neighbouring words and character n-gram of a document is
hashed to a row of a learned embedding table; the rows' mean goes through a
softmax over two classes. Table and output layer are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled rows; all
rows are scored.

At scoring time the softmax of a mean of vectors is a logistic function of a
mean of numbers (each row's product with the difference of the output
weights), so the model that goes to the executors is one number for each hash
bucket.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddrank.llm import common, words

BUCKETS, DIM = 1 << 18, 12
NGRAMS = (3, 4)
#: Bound of the training sample: labelled documents, drawn evenly by hash. Their
#: texts are used whole, however long; scoring has no bound.
TRAIN_DOCS = 6_000
#: Bytes of the sample's features from which they are kept in a file.
SPOOLED = 1 << 26
EPOCHS, RATE, SEED = 6, 0.4, 7
THRESHOLD = 0.7
#: Distinct words whose numbers a scorer remembers; beyond them it goes on with
#: those of the last portion.
MEMORY_WORDS = 300_000
#: Bytes of texts that are scored at once.
PORTION = 4 << 20

#: A pair of equal words is a feature of its own, whatever the word.
REPEATED = 1


def _buckets(keys: np.ndarray) -> np.ndarray:
    return (common.mix64(keys) % np.uint64(BUCKETS)).astype(np.int32)


def word_features(names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and its character n-grams, word after word, and how many each has.

    A word's n-grams are those of its characters with one mark before and one after them.
    """
    spelled = [f"<{name.decode('utf-8', 'replace')}>" for name in names]
    sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
    code = np.frombuffer("".join(spelled).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(names)), sizes)
    room = np.cumsum(sizes)[word] - np.arange(len(code))
    owners, keys = [np.arange(len(names))], [np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))]
    for n in NGRAMS:
        at = np.flatnonzero(room >= n)
        key = np.full(len(at), n, np.uint64)
        for i in range(n):
            key = key * np.uint64(0x9E3779B97F4A7C15) + code[at + i]
        owners.append(word[at])
        keys.append(key)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return _buckets(np.concatenate(keys))[order], np.bincount(owner, minlength=len(names))


def pair_features(hashes: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words, given the words' hashes."""
    a, b = hashes[:-1], hashes[1:]
    found = _buckets(a * np.uint64(0xD1342543DE82EF95) + b)
    found[a == b] = REPEATED
    return found


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and how often each occurs."""
    found = words.of_texts([text])
    if not len(found.codes):
        return np.empty(0, np.int32), np.empty(0, np.float32)
    flat, sizes = word_features(found.distinct.to_pylist())
    times = np.bincount(found.codes, minlength=len(sizes))
    buckets, place = np.unique(np.concatenate([flat, pair_features(found.values())]), return_inverse=True)
    n = np.bincount(place, np.concatenate([np.repeat(times, sizes), np.ones(len(place) - len(flat))]))
    return buckets, n.astype(np.float32)


@dataclass
class Model:
    """One number for each bucket and a bias: logit = mean of numbers + bias."""

    weights: np.ndarray
    bias: float
    #: whether there were examples of both classes to learn from
    learned: bool = True


class Examples:
    """Features and labels of training documents; many or long ones lie in a temporary file."""

    def __init__(self) -> None:
        self.labels: list[int] = []
        self.ends = [0]
        self.file = tempfile.SpooledTemporaryFile(SPOOLED)  # noqa: SIM115  closed with the object

    def add(self, text: str | None, label: int) -> None:
        found, n = document_features(text)
        self.file.write(found.astype(np.int32).tobytes() + n.tobytes())
        self.ends.append(self.ends[-1] + len(found))
        self.labels.append(label)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        size = self.ends[i + 1] - self.ends[i]
        self.file.seek(8 * self.ends[i])
        held = self.file.read(8 * size)
        return np.frombuffer(held, np.int32, size), np.frombuffer(held, np.float32, size, 4 * size)


def train(texts: list[str | None], labels: list[int], epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """:func:`learn` from texts."""
    docs = Examples()
    for text, label in zip(texts, labels, strict=True):
        docs.add(text, label)
    return learn(docs, epochs, rate)


def learn(docs: Examples, epochs: int = EPOCHS, rate: float = RATE, order: np.ndarray | None = None) -> Model:
    """Embeddings and softmax layer by stochastic gradient descent.

    ``order`` names the examples in an order that does not hang on how they came.
    With no example of one of the classes there is nothing to learn: every
    document then scores the other class's certainty (one half without any).
    """
    y = np.array(docs.labels)
    if len(set(docs.labels)) < 2:
        return Model(np.zeros(BUCKETS), 0.0 if not len(y) else (20.0 if y[0] == 1 else -20.0), False)
    rng = np.random.default_rng(SEED)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    out, bias = np.zeros((2, DIM)), np.zeros(2)
    steps, done = epochs * len(y), 0
    for _ in range(epochs):
        for place in rng.permutation(len(y)):
            i = place if order is None else order[place]
            found, n = docs[i]
            step = rate * (1 - done / steps)
            done += 1
            share = n / n.sum() if len(n) else n
            hidden = share @ table[found] if len(n) else np.zeros(DIM)
            logits = out @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = p @ out
            out -= step * np.outer(p, hidden)
            bias -= step * p
            if len(n):
                # rows of a long text get tiny shares; fixed scale keeps their pace
                table[found] -= step * np.minimum(1.0, share * 50)[:, None] * back
    return Model(table @ (out[1] - out[0]), float(bias[1] - bias[0]))


class Scorer:
    """Scores whole texts; remembers each word's sum of numbers."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.words = pa.array([], pa.binary())
        self.facts = np.empty((2, 0))  # of each word: sum of its features' numbers, how many

    def _facts(self, distinct: pa.Array) -> np.ndarray:
        at = pc.index_in(distinct, value_set=self.words)
        new = distinct.filter(pc.is_null(at))
        place = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        if len(new):
            place[at.is_null().to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(len(new))
            flat, sizes = word_features(new.to_pylist())
            sums = np.add.reduceat(self.model.weights[flat], np.cumsum(sizes) - sizes)
            self.words = pa.concat_arrays([self.words, new])
            self.facts = np.concatenate([self.facts, [sums, sizes]], axis=1)
        facts = self.facts[:, place]
        if len(self.words) > MEMORY_WORDS:
            self.words, self.facts = distinct, facts
        return facts

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Score of each text; null and empty texts score the bias alone."""
        found = words.Words(texts)
        n = len(found.sizes)
        total, size = np.zeros(n), np.zeros(n)
        if len(found.codes):
            sums, sizes = self._facts(found.distinct)[:, found.codes]
            own = found.owner()
            total, size = np.bincount(own, sums, n), np.bincount(own, sizes, n)
            pairs = self.model.weights[pair_features(found.values())]
            inside = own[1:] == own[:-1]
            total += np.bincount(own[1:][inside], pairs[inside], n)
            size += np.maximum(found.sizes - 1, 0)
        logit = self.model.bias + total / np.maximum(size, 1)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def score(self, text: str | None) -> float:
        return float(self.scores(pa.array([text], pa.string()))[0])


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: a quarter, by the CRC-32 of the identifier."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", train_docs: int = TRAIN_DOCS) -> Model:
    """Train on at most ``train_docs`` labelled rows, drawn by hash, and their whole texts.

    Rows with a null label or identifier and held-out rows are never read;
    a label without a document is skipped; repeated labels count as often as
    they occur.
    """
    usable = (
        labels.select("doc_id", F.col(label_col).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    )
    share = min(1.0, train_docs / max(1, usable.count()))
    place = F.xxhash64("doc_id", "label")
    # drawn by hash first, so that no task sends more than its share
    drawn = usable.where(place <= F.lit(min(int(share * 2**64) - 2**63, 2**63 - 1))).orderBy(place, "doc_id").limit(train_docs)
    joined = docs.select("doc_id", "text").join(F.broadcast(drawn.withColumn("place", place)), "doc_id")
    examples, places = Examples(), []
    for row in joined.select("doc_id", "text", "label", "place").toLocalIterator():
        examples.add(row.text, row.label)
        places.append((row.place, row.doc_id, row.label, xxhash.xxh3_64_intdigest((row.text or "").encode("utf-8", "surrogatepass"))))
    return learn(examples, order=np.array(sorted(range(len(places)), key=places.__getitem__), np.int64))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Defined cases: a null or empty text scores the bias alone; texts are scored
    whole; null identifiers are passed on and not held out; repeated rows give
    repeated results; an empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @common.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in common.portions(batch, PORTION):
                found = pa.array(scorer.scores(part.column(1)), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0), found], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    @common.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in common.portions(batch, PORTION):
                yield part.filter(pa.array(scorer.scores(part.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
