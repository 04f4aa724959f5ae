"""Recurrent language-model scores of whole documents.

A gated recurrent unit reads a document word by word and carries its state from window to window
to the end. The output is factored: first a class, then the word within its class. Classes and words in
a class grow in number with the fourth root of the corpus vocabulary; words beyond them form one
class, within which corpus counts tell them apart. Replicas are trained by truncated backpropagation in numpy inside Spark tasks and averaged after each round, so
weights depend a little on how rows are dealt. Word counts cover all training documents; words too many to
send to every task are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_fold, materialise, table, trimmed

#: Stands for the end of a document; no word holds a space.
END = b" "
#: Commonest words that every task gets; all others are joined.
FREQUENT = 150_000
#: Longer words are known by a digest, so that no key is longer than this.
WORD_BYTES = 64
#: Classes at least, and words in each; ``side_of`` gives the number for a corpus.
SIDE = 32
#: Input ids behind the explicit words: other words by a hash of their last letters.
TAILS = 512
HIDDEN, WINDOW, STREAMS = 16, 32, 512
#: Rows whose class probabilities are taken together, so that they stay in the cache.
CHUNK = 512
#: Bound on a logit; biases start at 0 at most, so that exponentials need no shift.
MOST = np.float32(40)
#: Each round learns from other training documents, whole; together the rounds cover all.
ROUNDS, RATE = 2, 0.01
#: Documents that are cut into words together.
SLICE = 8000
#: Tokens whose probabilities are taken together when documents are scored.
TOLD = 65_536
LN10 = float(np.log(10))


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Every word of UTF-8 texts in order, and the number of words of each text.

    A-Z is lower-cased, words end at ASCII white space. Null texts have no words.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    owner, words = pc.list_parent_indices(lists), pc.list_flatten(lists)
    real = pc.greater(pc.binary_length(words), 0)
    sizes = np.bincount(owner.filter(real).to_numpy(), minlength=len(texts))
    return words.filter(real), sizes


def coded_words(words: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The distinct ones of ``words``, a very long one known by its digest behind a blank, and the place in them of every word."""
    coded = words.dictionary_encode()
    ends = np.cumsum(pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False), dtype=np.int64)
    whole = pc.binary_join(pa.ListArray.from_arrays([0, len(ends)], coded.dictionary), "")[0].as_buffer().to_pybytes()
    distinct = [whole[i:j] for i, j in pairwise([0, *ends.tolist()])]
    for i in np.flatnonzero(np.diff(ends, prepend=0) > WORD_BYTES).tolist():
        distinct[i] = END + xxhash.xxh128_digest(distinct[i])
    return distinct, coded.indices.to_numpy()


def words_of(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of UTF-8 texts, the place in them of every word in order, and the number of words of each text."""
    words, sizes = cut(texts)
    return *coded_words(words), sizes


def slices_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to ``SLICE`` rows at most."""
    return (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE))


def side_of(distinct: int) -> int:
    """Classes, and words in each, so that about the square root of ``distinct`` words is explicit."""
    return max(SIDE, round(distinct**0.25))


def token_counts(docs: DataFrame) -> DataFrame:
    """``(token, c)`` over all rows of ``docs(text)``; the end token counts once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices_of(batches):
            words, codes, sizes = words_of(b.column(0))
            counts = np.r_[np.bincount(codes, minlength=len(words)), len(sizes)]
            yield pa.RecordBatch.from_arrays([pa.array([*words, END], pa.binary()), pa.array(counts, pa.int64())], names=["token", "c"])

    parts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(trimmed(run), "token binary, c long")
    return parts.groupBy("token").agg(F.sum("c").alias("c"))


def commonest(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The tokens above a count that at most ``most`` of them exceed, commonest first.

    Only a histogram over eighths of powers of two and the chosen rows reach the driver.
    """
    level = F.floor(F.log2(F.col("c").cast("double")) * 8)
    left, least = most, -1
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        left -= r.n
        if left < 0:
            least = r.level
            break
    rows = [(bytes(r.token), r.c) for r in counts.where(level > least).collect()]
    return sorted(rows, key=lambda x: (-x[1], x[0]))


class Lexicon:
    """The commonest words: base log-probability, input and output id of each; the last row is for all others."""

    def __init__(self, frequent: list[tuple[bytes, int]], total: int, distinct: int):
        self.side = side_of(distinct)
        vocab = self.side**2
        self.index = {w: i for i, (w, _) in enumerate(frequent)}
        #: The same words, in order; the end and digests among them hold a blank, so no text's own word equals them.
        self.words = pa.array([w for w, _ in frequent], pa.binary())
        n, counts = len(frequent), np.array([c for _, c in frequent], np.float64)
        self.log_total = np.log10(total + 0.5 * (distinct + 1))
        self.base = np.r_[np.log10(counts + 0.5) - self.log_total, 0.0]
        self.out = np.minimum(np.arange(n + 1), vocab).astype(np.int32)
        self.out[n] = vocab
        tails = [vocab + xxhash.xxh32_intdigest(w[-4:]) % TAILS for w, _ in frequent]
        self.inp = np.where(self.out < vocab, self.out, np.r_[tails, vocab + TAILS]).astype(np.int32)
        self.inp[n] = vocab + TAILS
        self.counts = counts[:vocab]
        self.rest_mass = max(float(total - self.counts.sum()), 1.0)
        self.end = self.index.get(END, n)

    def ids(self, words: list[bytes]) -> np.ndarray:
        n = len(self.index)
        return np.fromiter(map(self.index.get, words, repeat(n)), np.int32, len(words))

    def ids_of(self, words: pa.Array) -> np.ndarray:
        """The id of every word as ``cut`` gives it."""
        ids = pc.fill_null(pc.index_in(words.view(pa.binary()), self.words), len(self.index)).to_numpy(zero_copy_only=False)
        long = np.flatnonzero(pc.binary_length(words).to_numpy(zero_copy_only=False) > WORD_BYTES)
        if len(long):
            distinct, codes = coded_words(words.take(pa.array(long)))
            ids = ids.copy()
            ids[long] = self.ids(distinct)[codes]
        return ids


class GatedModel:
    """A gated recurrent unit with a class-factored softmax and one class for the rest."""

    def __init__(self, flat: np.ndarray | None, side: int):
        shapes = {
            "x": (side**2 + TAILS + 1, 3 * HIDDEN),
            "u": (HIDDEN, 3 * HIDDEN),
            "wc": (HIDDEN, side + 1),
            "bc": (side + 1,),
            "wv": (side, HIDDEN, side),
            "bv": (side, side),
        }
        sizes = [int(np.prod(shape)) for shape in shapes.values()]
        self.flat = np.zeros(sum(sizes), np.float32) if flat is None else np.ascontiguousarray(flat, np.float32)
        self.side, self.vocab, at = side, side**2, 0
        for (name, shape), size in zip(shapes.items(), sizes, strict=True):
            setattr(self, name, self.flat[at : at + size].reshape(shape))
            at += size

    @classmethod
    def start(cls, lexicon: Lexicon, seed: int = 0) -> GatedModel:
        """Small random weights; the output biases give the corpus counts."""
        rng = np.random.default_rng(seed)
        m = cls(None, lexicon.side)
        m.flat[:] = rng.normal(0, 0.1, len(m.flat))
        m.u[:] = rng.normal(0, HIDDEN**-0.5, m.u.shape)
        counts = np.full(m.vocab, 1e-12)
        counts[: len(lexicon.counts)] = lexicon.counts + 0.5
        per_class = counts.reshape(m.side, m.side)
        m.bc[:] = np.log(np.r_[per_class.sum(1), lexicon.rest_mass])
        m.bc -= m.bc.max()
        m.bv[:] = np.maximum(np.log(per_class / per_class.sum(1, keepdims=True)), -20)
        return m

    def step(self, a: np.ndarray, h: np.ndarray):
        """One step from the input part ``a`` of the gates and the state ``h``."""
        u = h @ self.u
        gates = 0.5 + 0.5 * np.tanh(0.5 * (a[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN]))
        r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
        n = np.tanh(a[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
        return n + z * (h - n), (r, z, n, u[:, 2 * HIDDEN :])

    @np.errstate(over="ignore")  # a gate far below zero is shut
    def states(self, x: np.ndarray, h: np.ndarray, kept: list | None = None) -> np.ndarray:
        """States before and after each step of a window of inputs ``(steps, rows)``, from ``h``: ``(steps + 1, HIDDEN, rows)``.

        It does what ``step`` does, in place and with rows behind, where every part of the gates lies together. ``kept`` gets the gates,
        the new parts of the states and the states' own part of them.
        """
        steps, rows = x.shape
        # The new part is 2 / (1 + exp(-2 x)) - 1, which is tanh(x) and cheaper.
        by_part, one, two = np.repeat(np.float32([-1, -1, -2]), HIDDEN), np.ones(1, np.float32), np.full(1, 2, np.float32)
        a, u = np.ascontiguousarray((self.x * by_part)[x].transpose(0, 2, 1)), np.ascontiguousarray((self.u * by_part).T)
        out, gates, new = np.empty((steps + 1, HIDDEN, rows), np.float32), np.empty_like(a), np.empty((steps, HIDDEN, rows), np.float32)
        out[0] = h.T
        for t in range(steps):
            g, n, after = gates[t], new[t], out[t + 1]
            np.matmul(u, out[t], out=g)
            rz = g[: 2 * HIDDEN]
            rz += a[t, : 2 * HIDDEN]
            np.exp(rz, out=rz)
            rz += one
            np.divide(one, rz, out=rz)
            np.multiply(rz[:HIDDEN], g[2 * HIDDEN :], out=n)
            n += a[t, 2 * HIDDEN :]
            np.exp(n, out=n)
            n += one
            np.divide(two, n, out=n)
            n -= one
            np.subtract(out[t], n, out=after)
            after *= rz[HIDDEN:]
            after += n
        if kept is not None:
            gates[:, 2 * HIDDEN :] *= np.float32(-0.5)
            kept += gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], new, gates[:, 2 * HIDDEN :]
        return out

    @staticmethod
    def choose(h: np.ndarray, w: np.ndarray, b: np.ndarray, own: np.ndarray, grad: tuple | None):
        """Log-probability of the choice ``own`` in each row and, with ``grad``, the loss's gradient by state.

        States have a 1 behind, for the biases. Rows of unnormalised probabilities are never divided: what they meet is.
        """
        out, dh = np.empty(len(h), np.float32), None if grad is None else np.empty((len(h), HIDDEN), np.float32)
        loose = float((np.abs(w).sum(0) + b).max()) > MOST  # states lie within -1 and 1, so most weights need no bound
        both, n, ones = np.concatenate((w, b[None])), len(b), np.ones(len(b), np.float32)
        back, space, place = np.ascontiguousarray(w.T), np.empty((min(CHUNK, len(h)), n), np.float32), np.arange(0, n * CHUNK, n)
        for at in range(0, len(h), CHUNK):
            part, mine = h[at : at + CHUNK], own[at : at + CHUNK]
            p = space[: len(part)]
            np.matmul(part, both, out=p)
            if loose:
                np.minimum(p, MOST, out=p)
            flat, mine = p.reshape(-1), place[: len(part)] + mine
            chosen = flat[mine]
            np.exp(p, out=p)
            total = p @ ones
            out[at : at + CHUNK] = chosen - np.log(total)
            if grad is not None:
                flat[mine] -= total
                share = (1 / total)[:, None]
                g = p.T @ (part * share)
                grad[0][...] += g[:, :HIDDEN].T
                grad[1][...] += g[:, HIDDEN]
                np.multiply(p @ back, share, out=dh[at : at + CHUNK])
        return out, dh

    def log_prob(self, h: np.ndarray, target: np.ndarray, grad: GatedModel | None = None):
        """Natural log-probability of each target from each state; with ``grad`` also the loss's gradient by state."""
        side, cls = self.side, target // self.side
        order = np.argsort(cls.astype(np.min_scalar_type(side)), kind="stable")  # few bytes are sorted by their digits
        # Rows of one class lie together from here on.
        h, cls, target = np.concatenate((h, np.ones((len(h), 1), np.float32)), 1)[order], cls[order], target[order]
        out, dh = self.choose(h, self.wc, self.bc, cls, None if grad is None else (grad.wc, grad.bc))
        cuts = np.cumsum(np.r_[0, np.bincount(cls, minlength=side)[:side]])
        for c in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(cuts[c], cuts[c + 1])
            logs, d = self.choose(h[own], self.wv[c], self.bv[c], target[own] - c * side, None if grad is None else (grad.wv[c], grad.bv[c]))
            out[own] += logs
            if grad is not None:
                dh[own] += d
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return out[back] if grad is None else (out[back], dh[back])

    def score(self, inputs: list[np.ndarray], targets: list[np.ndarray], group: int = 1024, window: int = 64) -> np.ndarray:
        """Log-probability of each whole sequence; the state is carried across windows to its end."""
        out, held = np.zeros(len(inputs)), []

        def tell():
            states, y, own = (np.concatenate(x) for x in zip(*held, strict=True))
            out[:] += np.bincount(own, self.log_prob(states, y), len(out))
            held.clear()

        order = np.argsort([-len(x) for x in inputs], kind="stable")
        for own in (order[g : g + group] for g in range(0, len(order), group)):
            h = np.zeros((len(own), HIDDEN), np.float32)
            for x, y in windows([(inputs[i], targets[i]) for i in own], window):
                states = self.states(x, h[: x.shape[1]])
                h, told = states[-1].T, y >= 0
                held.append((states[1:].transpose(0, 2, 1)[told], y[told], own[np.nonzero(told)[1]]))
                if sum(len(k) for _, k, _ in held) >= TOLD:
                    tell()
        if held:
            tell()
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray, h: np.ndarray):
        """Truncated backpropagation through one window; targets below 0 are padding."""
        grad, kept = GatedModel(None, self.side), []
        states = self.states(x, h, kept)
        (r, z, n, un), before, told = kept, states[:-1], y >= 0
        logs, dh_told = self.log_prob(states[1:].transpose(0, 2, 1)[told], y[told], grad)
        dstates = np.zeros((*x.shape, HIDDEN), np.float32)
        dstates[told] = dh_told
        dstates = np.ascontiguousarray(dstates.transpose(0, 2, 1))
        # Slopes of the gates' inputs by the state after a step: all but the state's own gradient is known beforehand.
        by_new = (1 - z) * (1 - n * n)
        slope = np.empty((len(x), 3, HIDDEN, x.shape[1]), np.float32)
        np.multiply(by_new, un * (r * (1 - r)), out=slope[:, 0])
        np.multiply(before - n, z * (1 - z), out=slope[:, 1])
        np.multiply(by_new, r, out=slope[:, 2])
        du, dh, part = slope, np.zeros((HIDDEN, x.shape[1]), np.float32), np.empty((HIDDEN, x.shape[1]), np.float32)
        for t in range(len(x) - 1, -1, -1):
            dh += dstates[t]
            dstates[t] = dh
            du[t] *= dh
            np.matmul(self.u, du[t].reshape(3 * HIDDEN, -1), out=part)
            dh *= z[t]
            dh += part
        du = du.reshape(len(x), 3 * HIDDEN, -1)
        grad.u += np.matmul(before, du.transpose(0, 2, 1)).sum(0)
        np.multiply(by_new, dstates, out=du[:, 2 * HIDDEN :])  # from here on by the gates' inputs
        order = np.argsort(x.ravel().astype(np.min_scalar_type(len(self.x))), kind="stable")
        ids = x.ravel()[order]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        grad.x[ids[first]] = np.add.reduceat(du.transpose(0, 2, 1).reshape(-1, 3 * HIDDEN)[order], first)
        return logs.sum(), grad, np.ascontiguousarray(states[-1].T)


def windows(sequences: list[tuple[np.ndarray, np.ndarray]], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Inputs and targets ``(steps, rows)`` of windows over sequences of falling length, as long as any lasts; targets behind an end are -1."""
    size = np.array([len(x) for x, _ in sequences])
    begin = np.cumsum(size) - size
    xs, ys = (np.concatenate(s) for s in zip(*sequences, strict=True))
    for at in range(0, int(size[0]), width):
        alive = int(np.searchsorted(-size, -at, "left"))
        place = np.arange(at, min(at + width, int(size[0])))[:, None]
        here = np.minimum(begin[:alive] + place, len(xs) - 1)
        yield xs[here], np.where(place < size[:alive], ys[here], -1)


class Trainer:
    """Adam over windows of up to ``STREAMS`` parallel documents."""

    def __init__(self, model: GatedModel, rate: float = RATE):
        self.model, self.rate, self.steps, self.tokens = model, rate, 0, 0
        self.m, self.v = np.zeros_like(model.flat), np.zeros_like(model.flat)

    def update(self, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> np.ndarray:
        n = int((y >= 0).sum())
        _, grad, h = self.model.gradient(x, y, h)
        g, own = grad.flat, np.float32
        size = float(np.sqrt(g @ g)) / max(n, 1)
        g *= own(0.1 / max(n, 1) * min(1.0, 1.0 / (size + 1e-9)))
        self.steps += 1
        self.tokens += n
        self.m *= own(0.9)
        self.m += g
        g *= g  # a tenth squared is the share of a new square
        self.v *= own(0.99)
        self.v += g
        rate = self.rate * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        np.sqrt(self.v, out=g)
        g += own(1e-8)
        np.divide(self.m, g, out=g)
        g *= own(rate)
        self.model.flat -= g
        return h

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray]]) -> None:
        sequences = sorted(sequences, key=lambda s: -len(s[0]))
        streams = min(STREAMS, max(32, len(sequences) // 8))  # few documents take smaller steps, more of them
        groups = [sequences[i : i + streams] for i in range(0, len(sequences), streams)]
        for k in np.random.default_rng(len(sequences)).permutation(len(groups)).tolist():
            group = groups[k]
            h = np.zeros((len(group), HIDDEN), np.float32)
            for x, y in windows(group, WINDOW):
                h = self.update(x, y, h[: x.shape[1]])


def sequences(lexicon: Lexicon, ids: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Inputs (the end id first) and targets (the end id last) of documents whose word ids stand one behind the other."""
    last = np.cumsum(sizes + 1) - 1
    first, words = last - sizes, np.ones(len(ids) + len(sizes), bool)
    words[last] = False
    x, y = np.empty(len(words), np.int32), np.empty(len(words), np.int32)
    y[words], y[last] = lexicon.out[ids], lexicon.out[lexicon.end]
    x[np.flatnonzero(words) + 1], x[first] = lexicon.inp[ids], lexicon.inp[lexicon.end]
    return [(x[i:j], y[i:j]) for i, j in zip(first.tolist(), (last + 1).tolist(), strict=True)]


def train(docs: DataFrame, lexicon, rounds: int = ROUNDS) -> GatedModel:
    """Rounds of local training in every task and weighted averaging of the replicas.

    Every training document is learnt from in one round, whole and with its state carried from window
    to window, so that each token reaches a gradient once. The sums have one row per weight, however many tasks there are.
    """
    spark = docs.sparkSession
    model = GatedModel.start(lexicon.value)
    size = len(model.flat)
    rows = docs.select(F.col("text").cast("binary").alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(model.flat)

        def run(batches, k=k, sent=sent):
            trainer = Trainer(GatedModel(sent.value.copy(), lexicon.value.side))
            for b in slices_of(batches):
                words, sizes = cut(b.column(0))
                trainer.fit(sequences(lexicon.value, lexicon.value.ids_of(words), sizes))
            if trainer.tokens:
                # The last row is the sum of what the weights are multiplied by.
                told = np.r_[trainer.model.flat.astype(np.float64) * trainer.tokens, float(trainer.tokens)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(told)], names=["i", "wx"])

        part = rows.where(F.pmod("h", F.lit(rounds)) == k).select("text")
        sums = part.mapInArrow(trimmed(run), "i long, wx double").groupBy("i").agg(F.sum("wx").alias("wx")).toArrow()
        if sums.num_rows:
            flat = np.zeros(size + 1)
            flat[sums.column("i").to_numpy()] = sums.column("wx").to_numpy()
            model = GatedModel(flat[:size] / flat[size], model.side)
    return model


def score(docs: DataFrame, fold: int = 1, frequent: int = FREQUENT) -> DataFrame:
    """Base and model log10-probabilities per row of ``docs(doc_id, text)``.

    Returns ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``. Documents whose
    fold is ``fold`` are held out; rows with a null id are learnt from. Null and empty texts are the
    end token alone. Repeated rows count as often as they stand; other columns are ignored; an empty
    table gives no rows. Without training documents every token is unknown and the base is that of N = V = 0.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    learnt = rows.where(held_fold(F.col("doc_id")) != fold)
    counts = materialise(token_counts(learnt), "lm-counts")
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = sums.n, sums.v
    common = commonest(counts, frequent)
    lexicon = spark.sparkContext.broadcast(Lexicon(common, total, distinct))
    model = spark.sparkContext.broadcast(train(learnt, lexicon).flat)
    vocab = len(lexicon.value.counts)
    mass = total - float(lexicon.value.counts.sum()) + 0.5 * (distinct - vocab + 1)
    log_total, log_mass = float(lexicon.value.log_total), float(np.log10(mass))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lex, net, uid = lexicon.value, GatedModel(model.value, lexicon.value.side), TaskContext.get().partitionId() << 33
        n = len(lex.index)
        for b in slices_of(batches):
            every, sizes = cut(b.column(1))
            rows, ids = len(sizes), lex.ids_of(every)
            owner, known = np.repeat(np.arange(rows), sizes), ids < n
            words, codes = coded_words(every.filter(pa.array(~known)))
            logs = net.score(*map(list, zip(*sequences(lex, ids, sizes), strict=True))) / LN10
            # Frequent words outside the vocabulary are told apart by their counts here, the others by the join.
            tail = known & (ids >= net.vocab)
            inner = 0.0 + np.bincount(owner[tail], lex.base[ids[tail]] + log_total - log_mass, rows)
            base = 0.0 + np.bincount(owner[known], lex.base[ids[known]], rows)
            found = np.bincount(owner[known], minlength=rows)
            other, times = np.unique(owner[~known] * (len(words) + 1) + codes, return_counts=True)
            if lex.end < n:
                base += lex.base[lex.end]
                found += 1
                inner += (lex.base[lex.end] + log_total - log_mass) * (lex.end >= net.vocab)
            else:
                other, times = np.r_[other, np.arange(rows) * (len(words) + 1) + len(words)], np.r_[times, np.ones(rows, np.int64)]
                order = np.argsort(other, kind="stable")
                other, times = other[order], times[order]
            cuts = pa.array(np.searchsorted(other, np.arange(rows + 1) * (len(words) + 1)), pa.int32())
            tokens = pa.array([*words, END], pa.binary()).take(pa.array(other % (len(words) + 1)))
            rest = pa.ListArray.from_arrays(cuts, tokens), pa.ListArray.from_arrays(cuts, pa.array(times, pa.int64()))
            numbers = [pa.array(np.arange(uid, uid + rows)), b.column(0), pa.array(sizes + 1, pa.int64()), pa.array(found, pa.int64()), pa.array(base), pa.array(inner + logs)]
            uid += rows
            yield pa.RecordBatch.from_arrays([*numbers, *rest], names=["uid", "doc_id", "n", "known", "base", "score", "rest", "times"])

    schema = "uid long, doc_id long, n long, known long, base double, score double, rest array<binary>, times array<long>"
    parts = materialise(rows.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(trimmed(run), schema), "lm-parts")
    rest = parts.select("uid", F.explode(F.arrays_zip("rest", "times")).alias("r")).select("uid", F.col("r.rest").alias("token"), F.col("r.times").alias("k"))
    c = F.coalesce(F.col("c"), F.lit(0))
    rest = rest.join(counts, "token", "left").select("uid", "k", c.alias("c"), (F.col("k") * F.log10(c + 0.5)).alias("l"))
    rest = rest.groupBy("uid").agg(F.sum("k").alias("k"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("more"), F.sum("l").alias("l"))
    out = parts.drop("rest", "times").join(rest, "uid", "left")
    k, more, log = (F.coalesce(x, F.lit(0)) for x in ("k", "more", "l"))
    return out.select(
        "doc_id",
        (held_fold(F.col("doc_id")) == fold).alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("known") + more).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + log - k * log_total).alias("base_score"),
        (F.col("score") + log - k * log_mass).alias("score"),
    )


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all ``documents``."""
    return score(table(spark, sf_dir, "documents"))
