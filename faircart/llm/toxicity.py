"""Toxicity by a gap-weighted subsequence string kernel, Nyström landmarks and a support vector machine.

Two words are compared by their common subsequences of three characters, each weighted by a decay to
the power of the span it takes up, so that inserted or missing characters weaken a match instead of
ending it. Two sentences are compared by the sum, over all pairs of their words, of the third power of the
normalised word kernel; sums and products of kernels are kernels, so this is one too. Landmarks are
sentences of a single word, drawn from labelled texts. A sentence's kernel values with the landmarks, mapped by the inverse
square root of the landmarks' own kernel matrix, are its Nyström features. A word value under ``FLOOR`` counts as zero everywhere. The machine is trained on sentences: a text is as toxic
as its worst sentence, so the sentence of a toxic text that the machine itself finds worst carries the label.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_arrow_column, free_name, held_fold, remove, scratch_path, table, trimmed

DECAY, SPAN, CODES = 0.7, 5, 64
START, END = 62, 63
#: Gaps of a three-character subsequence within SPAN characters, and its weight.
GAPS = [(a, b, DECAY ** (a + b + 1)) for a in range(1, SPAN) for b in range(1, SPAN - a)]
#: Longer words are compared in overlapping pieces of this many characters.
PIECE = 24
#: Labelled texts the classifier is fitted on at most, chosen by a hash of their id.
SAMPLE = 12_000
LANDMARKS, SHORTLIST = 72, 600
#: Landmarks from all labelled texts, beside those from words that toxic texts hold far more often.
PLAIN_LANDMARKS = 24
#: Tasks that the sample's kernel rows are dealt over; each pass of the fit brings one row of sums of each to the driver.
FIT_TASKS = 12
#: How often the sentences of toxic texts are chosen anew, and passes over the kernel rows for each choice at most.
ROUNDS, PASSES = 4, 10
#: Labelled texts whose kernel rows a pass holds together.
FIT_SLICE = 50
#: Machines fitted together: one for each fold left out and one on all labelled texts.
FOLDS = 4
#: A sentence ends at a full stop, an exclamation or a question mark, or after this many words.
LONGEST = 24
#: Words, as written and bare, a worker keeps the kernel values of; beyond it the cache starts anew.
CACHE_WORDS = 300_000
#: New words whose kernel values are taken together.
LEARNT = 8192
#: Texts, and characters of texts, whose words are looked at together; a longer text stands alone.
SLICE, SLICE_CHARS = 500, 1_000_000
#: Sentences whose kernel rows are summed together.
STRIP = 32_768
#: The word kernel's power in the sentence kernel, and the word value below which the power is left out as zero.
POWER, FLOOR = 3, 0.2
MARK = re.compile(r"[\W_]+")
SPACED = re.compile(r"(?<!\S)(?:\S\s+){3,}\S(?!\S)")


def codes_of(words: list[str]) -> np.ndarray:
    """Character codes with a start and an end mark, one row a word, 0 behind."""
    rows = [w.encode("utf-32-le", "surrogatepass") for w in words]
    width = max(map(len, rows), default=0) // 4
    points = np.frombuffer(b"".join(r.ljust(4 * width, b"\0") for r in rows), "<u4").reshape(len(rows), width).astype(np.int64)
    letters = np.where((points >= 97) & (points <= 122), points - 96, 27 + points % 35)
    letters[points == 0] = 0
    out = np.zeros((len(rows), width + 2), np.int64)
    out[:, 0], out[:, 1:-1] = START, letters
    out[np.arange(len(rows)), [len(r) // 4 + 1 for r in rows]] = END
    return out


def triples(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Codes of the subsequences by gap, 0 where there is none, each with its weight."""
    for a, b, weight in GAPS:
        n = codes.shape[1] - a - b
        if n > 0:
            x, y, z = codes[:, :n], codes[:, a : a + n], codes[:, a + b :]
            yield np.where(z > 0, (x * CODES + y) * CODES + z, 0), weight


def norms(codes: np.ndarray) -> np.ndarray:
    """Each word's norm in the space of all subsequences."""
    keys, weights, rows = [np.zeros(0, np.int64)], [np.zeros(0)], np.arange(len(codes)) * CODES**3
    for t, weight in triples(codes):
        found = t > 0
        keys.append((t + rows[:, None])[found])
        weights.append(np.full(len(keys[-1]), weight))
    feature, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate(weights), len(feature))
    square = np.bincount(feature // CODES**3, total**2, len(codes))
    return np.sqrt(np.maximum(square, 1e-12))


class Kernel:
    """Kernel values of words with a fixed list of landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        codes = codes_of(landmarks)
        size, features = norms(codes), {}
        for t, weight in triples(codes):
            for row, col in zip(*np.nonzero(t), strict=True):
                vector = features.setdefault(int(t[row, col]), np.zeros(len(landmarks)))
                vector[row] += weight / size[row]
        self.index = np.zeros(CODES**3, np.int32)
        self.weights = np.zeros((len(features) + 1, len(landmarks)), np.float32)
        for i, (t, vector) in enumerate(features.items(), 1):
            self.index[t], self.weights[i] = i, vector
        #: The most that one occurrence of a subsequence can add to any kernel value.
        self.most = self.weights.max(1, initial=0)[self.index]

    def values(self, words: list[str], floor: float = 0.0) -> np.ndarray:
        """Kernel values, shape (words, landmarks), at most 1.

        Words that a bound on all their values puts under ``floor`` are left at 0.
        """
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        by_length = np.argsort(list(map(len, words)), kind="stable")  # words looked at together are padded to the longest
        for some in (by_length[at : at + 4096] for at in range(0, len(words), 4096)):
            codes = codes_of([words[i] for i in some])
            bound, least = np.zeros(len(codes), np.float32), np.zeros(len(codes))
            for t, weight in triples(codes):
                bound += np.float32(weight) * self.most[t].sum(1)
                least += weight**2 * (t > 0).sum(1)
            # No norm is under the root of its squared weights, so most words need no norm.
            able = np.flatnonzero(bound >= floor * np.sqrt(least) * (1 - 1e-5))
            size = norms(codes[able])
            able, size = able[bound[able] >= floor * size], size[bound[able] >= floor * size]
            part = np.zeros((len(able), len(self.landmarks)), np.float32)
            for t, weight in triples(codes[able]):
                found = self.index[t]
                for col in np.flatnonzero(found.any(0)):
                    own = np.flatnonzero(found[:, col])
                    part[own] += np.float32(weight) * self.weights[found[own, col]]
            out[some[able]] = part / size[:, None]
        return out


def tokens_of(text: str | None) -> list[str]:
    """Words of a text with their marks; runs of single characters come again at the end, joined, as sentences of their own."""
    low = (text or "").lower()
    tokens = low.split()
    if list(map(len, tokens)).count(1) >= 3:
        for run in SPACED.findall(low):
            tokens += [".", "".join(run.split())]
    return tokens


def slices_of(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Where a slice of texts begins, and its texts, ``SLICE`` at most and of ``SLICE_CHARS`` bytes or one text."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and (i - start == SLICE or held + size > SLICE_CHARS):
            yield start, column.slice(start, i - start).to_pylist()
            start, held = i, 0
        held += size
    if sizes:
        yield start, column.slice(start).to_pylist()


def bare_of(token: str) -> str:
    """A token's letters and digits, or the token itself without any."""
    return token if token.isalnum() else MARK.sub("", token) or token


def pieces_of(token: str) -> list[str]:
    """A token's letters and digits (or the token itself, without any), long ones in overlapping pieces."""
    bare = bare_of(token)
    if len(bare) <= PIECE:
        return [bare]
    return [bare[i : i + PIECE] for i in range(0, len(bare) - PIECE // 2, PIECE // 2)]


class Sentences:
    """Kernel rows of the sentences of texts with the landmarks, with a cache of words."""

    def __init__(self, kernel: Kernel):
        self.kernel = kernel
        self._forget()

    def _forget(self) -> None:
        #: Row of each token (0: none of its values counts), twice over, plus 1 if the token ends a sentence. A token's letters and
        #: digits stand here too, as a token of their own.
        self.known: dict[str, int] = {}
        self.rows, self.used = np.zeros((1024, len(self.kernel.landmarks)), np.float32), 1

    def _learn(self, tokens: list[str]) -> None:
        bare = list(map(bare_of, tokens))
        words = [w for w in dict.fromkeys(bare) if w not in self.known]
        for at in range(0, len(words), LEARNT):
            self._learn_bare(words[at : at + LEARNT])
        self.known.update((t, self.known[w] // 2 * 2 + (t[-1] in ".!?")) for t, w in zip(tokens, bare, strict=True))

    def _learn_bare(self, words: list[str]) -> None:
        parts = list(map(pieces_of, words))
        values = self.kernel.values([w for p in parts for w in p], FLOOR)
        powers = np.where(values >= FLOOR, values, 0) ** POWER
        starts = np.cumsum([0, *map(len, parts)])[:-1]
        sums = np.add.reduceat(powers, starts, axis=0)
        told = np.flatnonzero(sums.any(1))
        if self.used + len(told) > len(self.rows):
            # In place, as no view of the rows is kept: the old and the new ones would be held side by side.
            self.rows.resize((self.used + len(told) + self.used // 8, self.rows.shape[1]), refcheck=False)
        self.rows[self.used : self.used + len(told)] = sums[told]
        row = np.zeros(len(parts), np.int64)
        row[told] = np.arange(self.used, self.used + len(told))
        self.used += len(told)
        self.known.update((w, 2 * r + (w[-1] in ".!?")) for w, r in zip(words, row.tolist(), strict=True))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Kernel rows, and the number of the text that each belongs to, in order.

        Every text has one row of zeros, for all its sentences that hold nothing, and one for each other sentence.
        """
        words = [tokens_of(t) for t in texts]
        new = set().union(*words).difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self._forget()
            new = set().union(*words)
        self._learn(list(new))
        size = np.array([len(w) for w in words])
        code = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64, int(size.sum()))
        text = np.repeat(np.arange(len(words)), size)
        place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
        start = place % LONGEST == 0
        start[1:] |= code[:-1] % 2 == 1
        told = np.flatnonzero(code > 1)
        sentence = np.cumsum(start)[told]
        first = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]][: len(sentence)])
        # The row of zeros of each text comes behind its sentences.
        own = text[told[first]]
        owner = np.repeat(np.arange(len(words)), np.bincount(own, minlength=len(words)) + 1)
        out, place = np.zeros((len(owner), self.rows.shape[1]), np.float32), np.arange(len(first)) + own
        row, ends = code[told] // 2, np.r_[first[1:], len(told)]
        for at in range(0, len(first), STRIP):
            begin, size = first[at : at + STRIP], (ends - first)[at : at + STRIP]
            total = self.rows[row[begin]]
            for k in range(1, size.max()):
                longer = np.flatnonzero(size > k)
                total[longer] += self.rows[row[begin[longer] + k]]
            out[place[at : at + STRIP]] = total
        return out, owner


def nystroem(kernel: Kernel) -> np.ndarray:
    """The inverse square root of the landmarks' own kernel matrix."""
    k = kernel.values(kernel.landmarks).astype(np.float64)
    k = np.where(k >= FLOOR, k, 0) ** POWER
    value, vector = np.linalg.eigh((k + k.T) / 2)
    return vector / np.sqrt(np.maximum(value, 0.05)) @ vector.T


def worst(decision: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The largest decision of each owner; owners stand together and in order."""
    return np.maximum.reduceat(decision, np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]))


def worst_rows(value: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The row of each text with its largest value, the first of equal ones."""
    top = np.flatnonzero(value == np.maximum.reduceat(value, starts)[owner])
    return top[np.r_[True, owner[top][1:] != owner[top][:-1]]]


def hinge_sums(x: np.ndarray, starts: np.ndarray, toxic: np.ndarray, learns: np.ndarray, w: np.ndarray, value: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Second derivatives, slopes and losses of squared hinge machines over texts, one row a machine.

    ``x`` has a row for each sentence, and texts begin at ``starts``. Machine ``m`` has weights ``w[m]`` and learns from
    the texts of ``learns[m]``. A clean text's loss is that of the sentence that ``w[m]`` itself finds worst of all, so that every
    sentence has to be clean; a toxic text's is that of the sentence with its largest ``value[:, m]``. ``cost[m]`` weighs clean and
    toxic texts.
    """
    owner = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(x)]))
    f, out = x @ w.T, []
    for m in range(len(w)):
        toxic_rows = worst_rows(value[:, m], starts, owner)[toxic & learns[m]]
        own = np.concatenate((toxic_rows, worst_rows(f[:, m], starts, owner)[~toxic & learns[m]]))
        sign = np.where(toxic[owner[own]], 1.0, -1.0)
        slack = 1 - sign * f[own, m]
        hit = slack > 0
        own, sign, slack = own[hit], sign[hit], slack[hit]
        c = cost[m][(sign > 0).astype(int)]
        held = x[own]
        weighted = held * c[:, None]
        out.append(np.r_[(weighted.T @ held).ravel(), weighted.T @ sign, (c * slack**2).sum()])
    return np.stack(out)


def descend(sums, w: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """Newton steps of machines from weights ``w`` on the primal, the last weight being a bias; a step that raises a loss is halved.

    ``sums(w)`` gives the rows of ``hinge_sums`` at ``w`` over all sentences.
    """
    d = w.shape[1]
    ridge, kept, least = np.r_[np.ones(d - 1), 1e-6], w, np.full(len(w), np.inf)
    for _ in range(passes):
        got = sums(w)
        loss = got[:, -1] + (ridge * w * w).sum(1) / 2
        better = loss <= least * (1 + 1e-9)
        h, slope = 2 * got[:, : d * d].reshape(-1, d, d) + np.diag(ridge), 2 * got[:, d * d : -1]
        step = np.where(better[:, None], np.linalg.solve(h, slope[:, :, None])[:, :, 0], (kept + w) / 2)
        kept, least = np.where(better[:, None], w, kept), np.where(better, loss, least)
        if np.abs(step - kept).max() < 1e-4:
            break
        w = step
    return kept


def machine_costs(size: np.ndarray) -> np.ndarray:
    """Costs of clean and toxic texts by machine from their numbers ``(machines, 2)``, so that both classes weigh the same.

    A machine that sees one class only costs nothing and stays at zero.
    """
    n = size.sum(1, keepdims=True)
    return np.where(size.min(1, keepdims=True) > 0, n / (2 * np.maximum(size, 1)), 0.0)


def fit_sigmoid(f: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Platt's sigmoid 1 / (1 + exp(-(a f + b))) by Newton steps."""
    plus, minus = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (plus + 1) / (plus + 2), 1 / (minus + 2))
    z, w = np.c_[f, np.ones(len(f))], np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, z.T @ (t - p))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


class Model:
    """Landmarks, decision weights and calibration; a constant where labels don't show both classes."""

    def __init__(self, kernel: Kernel | None, weights=None, bias: float = 0.0, a: float = 1.0, b: float = 0.0, prior: float = 0.0):
        self.kernel, self.weights, self.bias, self.a, self.b, self.prior = kernel, weights, bias, a, b, prior

    def scores(self, rows: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """A score for each text from the kernel rows of its sentences."""
        f = worst(rows @ self.weights + self.bias, owner)
        return 1 / (1 + np.exp(-np.clip(self.a * f + self.b, -30, 30)))


def choose_landmarks(toxic: list[str], plain: list[str]) -> tuple[list[str], int]:
    """Words of ``toxic`` and then of ``plain`` that no landmark before nearly equals, and how many are of the first kind."""
    bare = list(dict.fromkeys(p for w in toxic + plain for p in pieces_of(w)[:1]))
    first = set(bare[: len({p for w in toxic for p in pieces_of(w)[:1]})])
    k, kept = Kernel(bare).values(bare) if bare else np.zeros((0, 0)), []
    for i, w in enumerate(bare):
        if len(kept) < LANDMARKS + (w not in first) * PLAIN_LANDMARKS and all(k[i, j] < 0.9 for j in kept):
            kept.append(i)
    return [bare[i] for i in kept], sum(bare[i] in first for i in kept)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled rows outside the held-out fold, at most ``sample`` of them.

    Of several labels of one document the highest counts; null labels are ignored.
    """
    spark = docs.sparkSession
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max("toxic").cast("int").alias("toxic")).where(held_fold(F.col("doc_id")) != 0)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    total = sum(r.toxic for r in known)
    if not known or total in (0, len(known)):
        return Model(None, prior=total / len(known) if known else 0.0)
    # An Arrow table goes to the executors without Python workers, which a list of rows takes.
    known = pa.table({"doc_id": pa.array([r.doc_id for r in known], pa.int64()), "toxic": pa.array([r.toxic for r in known], pa.int32())})
    known = spark.createDataFrame(known)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))  # one text for each label
    # Log-likelihood ratio of a word between toxic and other texts.
    words = rows.select("toxic", F.explode(F.array_distinct(F.split(F.lower(F.trim("text")), r"\s+"))).alias("w")).where("w <> ''")
    counts = words.groupBy("w").agg(F.sum("toxic").cast("double").alias("k"), F.count("*").cast("double").alias("n")).where("n >= 3")
    rate = total / known.count()
    part = lambda k, p: F.when(k > 0, k * F.log(k / (F.col("n") * p))).otherwise(0.0)
    ratio = part(F.col("k"), rate) + part(F.col("n") - F.col("k"), 1 - rate)
    counts = counts.withColumn("g", F.when(F.col("k") > F.col("n") * rate, ratio).otherwise(-ratio))
    toxic = [r.w for r in counts.where("g > 3").orderBy(F.desc("g"), "w").limit(SHORTLIST).collect()]
    plain = [r.w for r in counts.orderBy(F.xxhash64("w"), "w").limit(4 * PLAIN_LANDMARKS).collect()]
    landmarks, marked = choose_landmarks(toxic, plain)
    kernel, marked = Kernel(landmarks or ["-"]), max(marked, 1)
    sent = spark.sparkContext.broadcast(kernel)

    def run(batches):
        read = Sentences(sent.value)
        for b, at, texts in ((b, *s) for b in batches for s in slices_of(b.column(0))):
            x, owner = read(texts)
            cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
            parts = [packed(x[i:j]) for i, j in zip(cuts, cuts[1:])]
            more = [c.slice(at, len(texts)) for c in b.columns[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary()), pa.array(np.diff(cuts)), *more], names=["x", "n", "toxic", "fold"])

    fold = F.pmod(F.xxhash64("doc_id", F.lit(FOLDS)), F.lit(FOLDS)).cast("int").alias("fold")
    path = scratch_path(spark, "toxicity")
    rows.select("text", "toxic", fold).coalesce(FIT_TASKS).mapInArrow(trimmed(run), "x binary, n long, toxic int, fold int").write.parquet(path)
    model = fit(spark.read.schema("x binary, n long, toxic int, fold int").parquet(path), kernel, marked)
    remove(spark, path)
    return model


def packed(x: np.ndarray) -> bytes:
    """Kernel rows as compressed bytes; most values are zero."""
    return zlib.compress(x.astype(np.float32).tobytes(), 1)


def texts_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Kernel rows with a 1 behind, where texts begin, which are toxic and their folds, of a few texts at a time."""
    for b in (whole.slice(i, FIT_SLICE) for whole in batches for i in range(0, whole.num_rows, FIT_SLICE)):
        n = b.column(1).to_numpy()
        x = np.ones((int(n.sum()), width + 1))
        x[:, :width] = np.concatenate([np.frombuffer(zlib.decompress(v.as_buffer()), np.float32) for v in b.column(0)]).reshape(-1, width)
        yield x, np.cumsum(n) - n, b.column(2).to_numpy() > 0, b.column(3).to_numpy()


def fit(rows: DataFrame, kernel: Kernel, marked: int) -> Model:
    """The machine and its sigmoid from ``rows(x, n, toxic, fold)``: the kernel rows of all sentences of each labelled text.

    All sentences take part, and none reaches the driver: each Newton step sums over them in Spark, for the machines of all folds
    together. Of a toxic text one sentence is toxic: first the one with the largest value at the first ``marked`` landmarks, then the one that
    the machine of the round before finds worst. Of a clean text none is. The sigmoid is fitted on decisions for texts that their own machine has not seen.
    """
    width = len(kernel.landmarks)
    machines, size = np.arange(FOLDS + 1), np.zeros((FOLDS + 1, 2))
    for r in rows.groupBy("fold", "toxic").agg(F.count("*").alias("texts")).collect():
        size[machines != r.fold, int(r.toxic > 0)] += r.texts
    cost = machine_costs(size)
    # Machines live in the Nyström features, kernel rows and sums in those of the landmarks.
    white = np.eye(width + 1)
    white[:width, :width] = nystroem(kernel)

    def sums(w: np.ndarray, chooser: np.ndarray | None) -> np.ndarray:
        own, choice = w @ white, None if chooser is None else chooser @ white

        def run(batches):
            total = None
            for x, starts, toxic, fold in texts_of(batches, width):
                value = np.repeat(x[:, :marked].max(1)[:, None], len(own), 1) if choice is None else x @ choice.T
                part = hinge_sums(x, starts, toxic, fold[None] != machines[:, None], own, value, cost)
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

        got = sum(np.frombuffer(bytes(r.s)) for r in rows.mapInArrow(trimmed(run), "s binary").collect()).reshape(len(machines), -1)
        d = width + 1
        h = white @ got[:, : d * d].reshape(-1, d, d) @ white
        return np.concatenate((h.reshape(len(machines), -1), got[:, d * d : -1] @ white, got[:, -1:]), 1)

    w, chooser = np.zeros((len(machines), width + 1)), None
    for _ in range(ROUNDS):
        w = descend(lambda v, c=chooser: sums(v, c), w)
        chooser = w
    own = w @ white

    def decide(batches):
        for x, starts, toxic, fold in texts_of(batches, width):
            f = np.maximum.reduceat(x @ own.T, starts)[np.arange(len(starts)), fold]
            yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(toxic.astype(np.int32))], names=["f", "toxic"])

    seen = rows.mapInArrow(trimmed(decide), "f double, toxic int").toArrow()
    a, b = fit_sigmoid(seen.column("f").to_numpy(), seen.column("toxic").to_numpy())
    return Model(kernel, own[-1, :width].copy(), float(own[-1, width]), a, b)


def with_score(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """``docs`` and a column ``name`` with each text's score."""
    if model.kernel is None:
        return docs.withColumn(name, F.lit(float(model.prior)))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        read = Sentences(sent.value.kernel)

        def fill(texts: pa.Array) -> list[float]:
            return [v for _, part in slices_of(texts) for v in sent.value.scores(*read(part)).tolist()]

        return fill

    return add_arrow_column(docs, "text", name, "double", make)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs(doc_id, text)``.

    Labels are learnt from rows whose fold is not 0. Null and empty texts get the score of a text
    without words. If the labels don't show both classes, every score is their mean (0 without
    labels). Repeated rows and null ids keep their rows (a null id is never held out); other
    columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = with_score(rows, train(rows, labels, sample), "score")
    return out.select("doc_id", (held_fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs``, all columns kept, without the rows predicted toxic.

    Null and empty texts are judged as texts without words; repeated rows go or stay together; an empty
    table gives no rows; further columns may have any name.
    """
    columns, name = docs.columns, free_name(docs, "score")
    return with_score(docs, train(docs, labels), name).where(F.col(name) < 0.5).select(*(f"`{c}`" for c in columns))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all ``documents``."""
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
