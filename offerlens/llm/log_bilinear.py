"""Log-probabilities of texts by a log-bilinear model, trained in numpy with noise-contrastive estimation.

The model predicts the class of a word from the classes of the words before it: `q = sum of c_j * r[x_j]` over the
places j of the context, and `P(class | context) = softmax(q . v + b)` over all classes. The frequent words are
classes of their own; every other word belongs to the class of its last three bytes, inside which it has the share
`(c + 1) / (sum of c + number of words + 1)`, the last one standing for the words never seen. Every context thus
gives a distribution over the words of the training texts and one unseen word a class.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.tables import ready, stored, struct
from offerlens.llm.words import SPACED, encoded, hash_words, mix, signed, stream

FOLDS, HELD_OUT = 7, 2
#: Classes: the end of a text, frequent words, and endings of the other words.
FREQUENT = 255
ENDINGS = 128
CLASSES = 1 + FREQUENT + ENDINGS
#: Words whose counts every task knows; those of the others come by a join.
KNOWN = 1 << 18
WIDTH = 16
CONTEXT = 3
BATCH = 1_024
NOISE = 32
RATE = 0.3
#: The first round learns from one part in so many of the texts, the second goes on from its mean with the others.
FIRST_PART = 4
#: Tokens that a task counts before it hands on their sums, and scores in one product.
COUNTED = 1 << 21
SCORED = 2_048
#: Weights are handed on as whole multiples of 2**-UNIT, whose sums do not depend on their order.
UNIT = 24

#: The end of a text among the word hashes.
END = np.uint64(0x5851F42D4C957F2D)
_FIRST_ENDING = 1 + FREQUENT


def _endings(texts: list[bytes]) -> np.ndarray:
    """The class of the last three bytes of every word, from texts in which every separator is a space."""
    found = []
    for data in texts:
        raw = np.frombuffer(b"   " + data + b" ", np.uint8)
        last = np.flatnonzero((raw[3:-1] != 32) & (raw[4:] == 32)) + 3
        code = raw[last].astype(np.uint64)
        for back in (1, 2):
            # a shorter word ends at its start
            code = code << np.uint64(8) | np.where(code & np.uint64(255) == 32, 32, raw[last - back]).astype(np.uint64)
        found.append((mix(code) % np.uint64(ENDINGS)).astype(np.int16))
    return np.concatenate(found) if found else np.empty(0, np.int16)


@dataclass
class Tokens:
    """Words and ends of consecutive texts: text i has the tokens from offsets[i] to offsets[i + 1]."""

    words: np.ndarray
    endings: np.ndarray
    offsets: np.ndarray


def tokens(texts) -> Tokens:
    """Words `[^\\x20\\x09-\\x0D]+` after A-Z is lowered, each text followed by its end; null is empty."""
    data = encoded(texts, SPACED)
    hashed, joined = hash_words(data), b" ".join(data)
    ends = hashed.offsets[1:]
    words = np.insert(hashed.values, ends, END)
    endings = np.insert(_endings([joined]), ends, -1)
    return Tokens(words, endings, hashed.offsets + np.arange(len(hashed.offsets)))


def _counted(batches):
    """Sums of a stretch of the texts: word, ending, n."""

    def flush(parts):
        words, endings = (np.concatenate(x) for x in zip(*parts))
        found, first, n = np.unique(words, return_index=True, return_counts=True)
        return pd.DataFrame({"word": signed(found), "ending": endings[first].astype(np.int32), "n": n})

    parts, size = [], 0
    for batch in batches:
        own = tokens(batch["text"])
        parts.append((own.words, own.endings))
        size += len(own.words)
        if size >= COUNTED:
            yield flush(parts)
            parts, size = [], 0
    if parts:
        yield flush(parts)


@dataclass
class Vocabulary:
    """What the tasks know of the counts: the known words in the order of their hashes, and sums by class."""

    words: np.ndarray
    n: np.ndarray
    classes: np.ndarray
    class_n: np.ndarray
    class_words: np.ndarray
    total: int
    distinct: int

    @classmethod
    def made(cls, known: pd.DataFrame, sums: pd.DataFrame) -> Vocabulary:
        """`known`: word, ending, n of the most frequent words; `sums`: n and words of each ending over all words."""
        known = known.sort_values(["n", "word"], ascending=[False, True], ignore_index=True)
        end = known["ending"].to_numpy() == -1
        own = np.where(end, 0, known["ending"].to_numpy() + _FIRST_ENDING)
        frequent = np.flatnonzero(~end)[:FREQUENT]
        class_n, class_words = np.zeros((2, CLASSES))
        for row in sums.itertuples():
            at = 0 if row.ending == -1 else row.ending + _FIRST_ENDING
            class_n[at], class_words[at] = row.n, row.words
        np.subtract.at(class_n, own[frequent], known["n"].to_numpy()[frequent])
        np.subtract.at(class_words, own[frequent], 1)
        own[frequent] = 1 + np.arange(len(frequent))
        class_n[own[frequent]], class_words[own[frequent]] = known["n"].to_numpy()[frequent], 1
        words = known["word"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(words)
        return cls(words[order], known["n"].to_numpy()[order], own[order].astype(np.int16), class_n, class_words, int(sums["n"].sum()), int(sums["words"].sum()))

    def found(self, words: np.ndarray) -> np.ndarray:
        """Places of the words, -1 for words that are not known."""
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, -1)

    def classes_of(self, own: Tokens, at: np.ndarray) -> np.ndarray:
        rest = np.where(own.endings < 0, 0, own.endings + _FIRST_ENDING)
        return np.where(at < 0, rest, self.classes[at] if len(self.classes) else 0).astype(np.int16)

    def start(self) -> np.ndarray:
        """Log shares of the classes."""
        smoothed = self.class_n + 1
        return np.log(smoothed / smoothed.sum())


@dataclass
class Model:
    read: np.ndarray  # (CLASSES + 1, WIDTH), the last row for places before the text
    places: np.ndarray  # (CONTEXT, WIDTH)
    out: np.ndarray  # (CLASSES, WIDTH)
    bias: np.ndarray  # (CLASSES)

    @classmethod
    def fresh(cls, bias: np.ndarray) -> Model:
        def noise(seed: int, *shape: int) -> np.ndarray:
            return ((stream(seed, math.prod(shape)) >> np.uint64(40)) / (1 << 24) - 0.5).reshape(shape).astype(np.float32)

        return cls(noise(3, CLASSES + 1, WIDTH), np.full((CONTEXT, WIDTH), 0.5, np.float32), noise(4, CLASSES, WIDTH) / 4, bias.astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.read, self.places, self.out, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    def filled(self, values: np.ndarray) -> Model:
        cuts = np.cumsum([x.size for x in self.parts()])[:-1]
        return Model(*(v.reshape(x.shape).astype(np.float32) for v, x in zip(np.split(values, cuts), self.parts())))

    def predicted(self, contexts: np.ndarray) -> np.ndarray:
        q = self.read[contexts[0]] * self.places[0]
        for j in range(1, CONTEXT):
            q += self.read[contexts[j]] * self.places[j]
        return q

    def log_probabilities(self, contexts: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural logarithms of the targets' probabilities, normalised over all classes."""
        found = np.empty(len(targets))
        out = np.ascontiguousarray(np.concatenate([self.out, self.bias[:, None]], axis=1).T)
        for start in range(0, len(targets), SCORED):
            own = slice(start, start + SCORED)
            q = self.predicted(contexts[:, own])
            logits = np.concatenate([q, np.ones((len(q), 1), np.float32)], axis=1) @ out
            chosen = logits[np.arange(len(q)), targets[own]].astype(np.float64)
            most = float(logits.max())
            if most > 60:
                logits -= np.float32(most)
            np.exp(logits, out=logits)
            found[own] = chosen - np.log(logits @ np.ones(CLASSES, np.float32)) - (most if most > 60 else 0)
        return found


def contexts(classes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(CONTEXT, tokens): the classes before each token, the nearest first."""
    place = np.arange(len(classes)) - np.repeat(offsets[:-1], np.diff(offsets))
    found = np.full((CONTEXT, len(classes)), CLASSES, np.int16)
    for j in range(CONTEXT):
        inside = place > j
        found[j, inside] = classes[np.flatnonzero(inside) - j - 1]
    return found


class Trainer:
    """Noise-contrastive estimation in batches; all tokens of a batch share their noise. Steps follow Adagrad."""

    def __init__(self, model: Model, shares: np.ndarray, seed: int):
        self.model = Model(*(x.copy() for x in model.parts()))
        self.spent = [np.full(x.shape, 1e-2, np.float32) for x in model.parts()]
        self.log_noise = (shares + math.log(NOISE)).astype(np.float32)
        self.bounds = np.cumsum(np.exp(shares))
        self.rng = np.random.default_rng(seed)
        self.seen = 0

    def _step(self, part: int, rows, gradient: np.ndarray) -> None:
        spent, weights = self.spent[part], self.model.parts()[part]
        spent[rows] += gradient * gradient
        weights[rows] -= RATE * gradient / np.sqrt(spent[rows])

    def _scatter(self, part: int, rows: np.ndarray, gradients: np.ndarray) -> None:
        """Rows may repeat: their gradients are added up first."""
        order = np.argsort(rows, kind="stable")
        listed = rows[order]
        first = np.flatnonzero(np.diff(listed, prepend=-1))
        self._step(part, listed[first], np.add.reduceat(gradients[order], first, axis=0))

    def learn(self, near: np.ndarray, targets: np.ndarray) -> None:
        m, n = self.model, np.float32(1 / len(targets))
        noise = np.minimum(np.searchsorted(self.bounds, self.rng.random(NOISE)), CLASSES - 1).astype(np.int16)
        q = m.predicted(near)
        hit = np.einsum("ij,ij->i", q, m.out[targets]) + m.bias[targets] - self.log_noise[targets]
        miss = q @ m.out[noise].T + (m.bias[noise] - self.log_noise[noise])
        g_hit = -n / (1 + np.exp(np.clip(hit, -30, 30)))
        g_miss = n / (1 + np.exp(-np.clip(miss, -30, 30)))
        back = g_hit[:, None] * m.out[targets] + g_miss @ m.out[noise]
        rows = np.concatenate([targets, noise])
        out = np.concatenate([g_hit[:, None] * q, g_miss.T @ q])
        bias = np.concatenate([g_hit, g_miss.sum(axis=0)])
        reads = [m.read[near[j]] for j in range(CONTEXT)]
        places = np.stack([np.einsum("ij,ij->j", back, r) for r in reads])
        read = np.concatenate([back * m.places[j] for j in range(CONTEXT)])
        self._scatter(2, rows, out)
        self._scatter(3, rows, bias)
        self._scatter(0, near.ravel(), read)
        self._step(1, slice(None), places)
        self.seen += len(targets)


def _trained(vocabulary, model, seed: int):
    """One row a task: its weights times the tokens it has seen, in units, and these tokens."""

    def run(batches):
        known, trainer, kept = vocabulary.value, None, None
        for batch in batches:
            own = tokens(batch["text"])
            classes = known.classes_of(own, known.found(own.words))
            near, targets = contexts(classes, own.offsets), classes
            if kept is not None:
                near, targets = np.concatenate([kept[0], near], axis=1), np.concatenate([kept[1], targets])
            trainer = trainer or Trainer(model.value, known.start(), seed)
            whole = len(targets) - len(targets) % BATCH
            for start in range(0, whole, BATCH):
                trainer.learn(near[:, start : start + BATCH], targets[start : start + BATCH])
            kept = near[:, whole:], targets[whole:]
        if trainer is not None:
            if len(kept[1]):
                trainer.learn(*kept)
            units = np.rint(trainer.model.flat().astype(np.float64) * (1 << UNIT)).astype(np.int64)
            yield pd.DataFrame({"units": [units], "seen": [trainer.seen]})

    return run


_TRAINED = struct("units longs, seen long")


def _mean(rows: DataFrame, model: Model) -> Model:
    """The mean of the tasks' weights, each task counting by its tokens; the old model if there is no task."""
    exact = "decimal(38,0)"
    each = rows.select("seen", F.posexplode("units").alias("place", "units"))
    summed = each.groupBy("place").agg(F.sum(F.col("units").cast(exact) * F.col("seen").cast(exact)).alias("units"), F.sum("seen").alias("seen"))
    found = summed.select("place", (F.col("units").cast("double") / F.col("seen") / (1 << UNIT)).alias("value")).toPandas()
    return model.filled(found.sort_values("place")["value"].to_numpy()) if len(found) else model


_SCORED = struct("row long, doc_id string, held_out boolean, n_tokens long, n_known long, base_part double, score_part double, words longs, times ints")


def _scores(vocabulary, model):
    """Scores of a text without the counts of its words that are not known; these words are handed on."""

    def run(batches):
        known, m = vocabulary.value, model.value
        base = math.log10(known.total + known.distinct + 1)
        inside = np.where(np.arange(CLASSES) >= _FIRST_ENDING, np.log10(known.class_n + known.class_words + 1), 0)
        gain = np.log10(known.n + 1.0)
        for batch in batches:
            own = tokens(batch["text"])
            at = known.found(own.words)
            classes = known.classes_of(own, at)
            seen = at >= 0
            log_count = np.where(seen, gain[at] if len(gain) else 0, 0)
            log_share = np.where(classes >= _FIRST_ENDING, log_count - inside[classes], 0)
            token = m.log_probabilities(contexts(classes, own.offsets), classes) / math.log(10) + log_share
            starts, n = own.offsets[:-1], np.diff(own.offsets)
            words, times, cuts = [], [], np.zeros(len(n) + 1, np.int64)
            rest = np.flatnonzero(~seen & (own.endings >= 0))
            np.cumsum(np.add.reduceat(~seen & (own.endings >= 0), starts) if len(n) else n, out=cuts[1:])
            for a, b in zip(cuts[:-1], cuts[1:]):
                distinct, k = np.unique(own.words[rest[a:b]], return_counts=True)
                words.append(signed(distinct))
                times.append(k.astype(np.int32))
            yield batch[["row", "doc_id", "held_out"]].assign(
                n_tokens=n,
                n_known=np.add.reduceat(seen.astype(np.int64), starts),
                base_part=np.add.reduceat(log_count, starts) - n * base,
                score_part=np.add.reduceat(token, starts),
                words=words,
                times=times,
            )

    return run


def held_out(id_col: str = "doc_id"):
    """Texts that are never learned from; one without an id is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def fitted(documents: DataFrame):
    """(counts, vocabulary, model) learned from the rows of `documents` (doc_id, text) that are not held out."""
    spark = documents.sparkSession
    learned = documents.where(~held_out()).select("doc_id", "text")
    counts = learned.select("text").mapInPandas(_counted, struct("word long, ending int, n long"))
    counts = stored(counts.groupBy("word").agg(F.first("ending").alias("ending"), F.sum("n").alias("n")), "counts")

    # the known words are those above a count, found from a histogram of bounded size
    step = F.floor(F.log2("n") * 16)
    histogram = counts.groupBy(step.alias("step")).count().toPandas().sort_values("step", ascending=False)
    fits = histogram[histogram["count"].cumsum() <= KNOWN]
    least = int(fits["step"].min()) if len(fits) else 1 << 20
    frequent = (step >= least) | (F.col("ending") == -1)
    sums = counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("words")).toPandas()
    vocabulary = Vocabulary.made(counts.where(frequent).toPandas(), sums)
    known = spark.sparkContext.broadcast(vocabulary)

    model = Model.fresh(vocabulary.start())
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(FIRST_PART))
    for seed, rows in enumerate((learned.where(part == 0), learned.where(part != 0))):
        now = spark.sparkContext.broadcast(model)
        model = _mean(rows.select("text").mapInPandas(_trained(known, now, seed), _TRAINED), model)
    return counts.where(~frequent), vocabulary, model


def log_probabilities(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score` of every row.

    Counts and the model are learned from all rows whose crc32(id as text) mod 7 is not 2, the counts by one
    aggregation, the model by every task on its own rows in two rounds, after each of which the weights are averaged.
    What tasks receive has a fixed size: the counts of the KNOWN most frequent words, the sums of the classes and the
    weights. The counts of all other words are joined by word, so no count is left out.

    Scores are log10. `base_score` sums log10((c + 1) / (N + V + 1)) over words and the end of the text, `score` is
    the model's log-probability of them. Words are told apart by 64-bit hashes.

    Null and empty texts consist of their end. Repeated rows are each learned from and each returned. A row without
    an id is learned from. Without any row to learn from, N and V are 0, every base_score is 0 and the model is its
    start, in which all classes are equally likely. An empty table gives no rows. Other columns are not read.
    """
    # as text, since pandas would turn longs beside a null into doubles
    source = ready(documents).select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    spark = source.sparkSession
    counts, vocabulary, model = fitted(source)
    known, weights = spark.sparkContext.broadcast(vocabulary), spark.sparkContext.broadcast(model)
    numbered = source.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out().alias("held_out"), "text")
    rows = stored(numbered.mapInPandas(_scores(known, weights), _SCORED), "scored")

    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    # the sum of decimals does not depend on their order
    gain = F.sum((F.col("times") * F.log10(F.col("n") + 1)).cast("decimal(30,12)")).cast("double")
    added = rare.join(counts, "word").groupBy("row").agg(gain.alias("gain"), F.sum("times").alias("found"))
    more, found = F.coalesce("gain", F.lit(0.0)), F.coalesce("found", F.lit(0))
    return rows.join(added, "row", "left").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "held_out",
        "n_tokens",
        (F.col("n_known") + found).alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base_part") + more).alias("base_score"),
        (F.col("score_part") + more).alias("score"),
    )
