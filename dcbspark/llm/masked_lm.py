"""Language-model scoring by masked pseudo-likelihood.

A window network in numpy predicts every token from the tokens on both sides of it: each of the ``SIDE`` neighbours to the
left and right adds a vector of its own to the hidden layer, and a two-level softmax gives the token's class and the token
in its class. A document's score is the sum of the conditional log-probabilities of all its words.

The vocabulary comes from exact counts of all words of the corpus: the most frequent words are tokens of their own, in
classes by rank, and every other word falls into one of ``RARE`` hashed tokens. Such a word's own probability within its
token is n / (N + 1), of its count n and the token's N in the corpus, and 1 / (N + 1) is left for all unseen words. Counts of
the most frequent words, ``KNOWN`` at most and with all of one count or none, are broadcast, those of all others joined by
word, and no task holds them. So the score is that of the words, however many there are.

Texts are turned into token ids once, written, and dealt by a hash of row and ids to shards of about ``SHARD_TOKENS``, however
the input is partitioned. Every shard runs gradient steps over its texts, whole and in order of their hash, and the shards'
parameters are averaged by token counts, ``FAN`` at a time, level by level; ``ROUNDS`` such rounds run, each on every
``ROUNDS``-th position of every text, so that together they train on every position once. So scores do not depend on how many
machines there are. What is gathered (counts, steps, parameters of shards) grows with the corpus; what a task holds, and the
model that is broadcast, have a fixed size.

Defined results: a null or empty text has no tokens, score 0 and a null mean; the first and last tokens of a text see an
empty token outside; a text longer than a step's tokens is learnt whole, in more steps; null ids are kept; repeated rows are
scored one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, coded_words, materialise, memory, slices

CLASSES = 64
MEMBERS = 64
VOCABULARY = CLASSES * MEMBERS
#: Hashed tokens for words beyond the most frequent; one more token is the outside of a text.
RARE = 1024
#: Most frequent words whose counts every worker knows, at most.
KNOWN = 1 << 17
SIDE = 2
HIDDEN = 16
#: Rounds of training, among which the positions of each text are dealt in turn.
ROUNDS = 2
RATE = 0.8
BATCH = 16384
#: Tokens among which steps are drawn in random order, at least.
CHUNK = 1 << 18
SHARD_TOKENS = 1 << 22
#: Rows into which a shard's parameters are cut for averaging.
BLOCKS = 16
#: Rows that one average takes.
FAN = 16

OUTSIDE = VOCABULARY - RARE - 1
_SHAPES = {"left": (2 * SIDE, VOCABULARY, HIDDEN), "hidden": (HIDDEN,), "class": (HIDDEN, CLASSES), "class_bias": (CLASSES,), "member": (CLASSES, HIDDEN, MEMBERS), "member_bias": (CLASSES, MEMBERS)}
SIZE = sum(int(np.prod(s)) for s in _SHAPES.values())


def _parts(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of the parameters in one flat array."""
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def initial(counts: np.ndarray, seed: int = 5) -> np.ndarray:
    """Small random weights, with biases at the log of the tokens' shares."""
    flat = np.random.default_rng(seed).normal(0, 0.08, SIZE).astype(np.float32)
    p = _parts(flat)
    share = (counts + 0.5).reshape(CLASSES, MEMBERS)
    p["hidden"][:] = 0
    p["class_bias"][:] = np.log(share.sum(axis=1) / share.sum())
    p["member_bias"][:] = np.log(share / share.sum(axis=1, keepdims=True))
    return flat


def _small(p: dict) -> bool:
    """Whether no exponential can overflow: hidden values lie in -1 .. 1, so weights and biases bound what is raised."""
    return max(np.abs(p["class"]).sum(axis=0).max() + np.abs(p["class_bias"]).max(), np.abs(p["member"]).sum(axis=1).max() + np.abs(p["member_bias"]).max()) < 60


def _errors(x: np.ndarray, wanted: np.ndarray, small: bool) -> np.ndarray:
    """In place: softmax of each row less 1 at the wanted place."""
    if not small:
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    x[np.arange(len(x)), wanted] -= 1
    return x


def _neighbours(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(2 * SIDE, n) neighbours of every token within its text."""
    n = int(starts[-1])
    first = np.repeat(starts[:-1], np.diff(starts))
    last = np.repeat(starts[1:], np.diff(starts))
    at = np.arange(n)
    out = np.full((2 * SIDE, n), OUTSIDE, np.uint16)
    for k, d in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        to = at + d
        ok = (to >= first) & (to < last)
        out[k, ok] = ids[to[ok]]
    return out


def _hidden(p: dict, near: np.ndarray) -> np.ndarray:
    h = p["hidden"] + p["left"][0][near[0]]
    for k in range(1, 2 * SIDE):
        h += p["left"][k][near[k]]
    return np.tanh(h)


def log_probabilities(flat: np.ndarray, ids: np.ndarray, near: np.ndarray) -> np.ndarray:
    """log p(token | its neighbours) of every token."""
    p, out = _parts(flat), np.zeros(len(ids))
    small = _small(p)
    for at in range(0, len(ids), 1 << 16):
        mine, h = ids[at : at + (1 << 16)].astype(np.int64), _hidden(p, near[:, at : at + (1 << 16)])
        x = h @ p["class"] + p["class_bias"]
        classes, members = mine // MEMBERS, mine % MEMBERS
        if not small:
            x -= x.max(axis=1, keepdims=True)
        got = x[np.arange(len(mine)), classes] - np.log(np.exp(x).sum(axis=1))
        order = np.argsort(classes, kind="stable")
        cuts = np.searchsorted(classes[order], np.arange(CLASSES + 1))
        for c in range(CLASSES):
            rows = order[cuts[c] : cuts[c + 1]]
            if len(rows):
                y = h[rows] @ p["member"][c] + p["member_bias"][c]
                if not small:
                    y -= y.max(axis=1, keepdims=True)
                got[rows] += y[np.arange(len(rows)), members[rows]] - np.log(np.exp(y).sum(axis=1))
        out[at : at + len(mine)] = got
    return out


class Trainer:
    """Gradient steps by Adagrad over one shard's texts."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat.copy()
        self.p = _parts(self.flat)
        self.past = _parts(np.full(SIZE, 1e-4, np.float32))
        self.tokens = 0

    def learn(self, ids: np.ndarray, near: np.ndarray) -> None:
        p, n = self.p, len(ids)
        self.tokens += n
        order = np.argsort(ids, kind="stable")  # tokens of one class stand together
        ids, near = ids[order].astype(np.int64), near[:, order]
        h = _hidden(p, near)
        classes, members = ids // MEMBERS, ids % MEMBERS
        small = _small(p)
        x = _errors(h @ p["class"] + p["class_bias"], classes, small)
        back = x @ p["class"].T
        grads = {"class": h.T @ x, "class_bias": x.sum(axis=0), "member": np.zeros_like(p["member"]), "member_bias": np.zeros_like(p["member_bias"])}
        cuts = np.searchsorted(classes, np.arange(CLASSES + 1))
        held = [(c, slice(a, b)) for c, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
        y = np.empty((n, MEMBERS), np.float32)
        for c, rows in held:
            np.matmul(h[rows], p["member"][c], out=y[rows])
            y[rows] += p["member_bias"][c]
        _errors(y, members, small)
        for c, rows in held:
            back[rows] += y[rows] @ p["member"][c].T
            grads["member"][c] = h[rows].T @ y[rows]
            grads["member_bias"][c] = y[rows].sum(axis=0)
        back *= (1 - h * h) / n
        for name, grad in grads.items():
            self._step(name, grad / n)
        self._step("hidden", back.sum(axis=0))
        for k in range(2 * SIDE):
            order = np.argsort(near[k], kind="stable")
            token = near[k][order].astype(np.int64)
            begins = np.flatnonzero(np.diff(token, prepend=-1))
            rows, grad = token[begins], np.add.reduceat(back[order], begins, axis=0)
            past = self.past["left"][k][rows] + grad * grad
            self.past["left"][k][rows] = past
            p["left"][k][rows] -= RATE * grad / np.sqrt(past)

    def _step(self, name: str, grad: np.ndarray) -> None:
        self.past[name] += grad * grad
        self.p[name] -= RATE * grad / np.sqrt(self.past[name])


def _counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in rows for part in slices(whole)):
        words, codes, _ = coded_words(batch.column("text"))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(np.bincount(codes, minlength=len(words)), pa.int64())], names=["word", "n"])


class Vocabulary:
    """Token ids of words, the frequent ones by rank and others by a hash, and the counts of the words given."""

    def __init__(self, words: list[str], counts: list[int] | None = None):
        self.rank = {w: i for i, w in enumerate(words)}
        self.counts = np.array([1] * len(words) if counts is None else counts, np.int64)

    def ids(self, words: list[str]) -> np.ndarray:
        get, h = self.rank.get, xxhash.xxh32_intdigest
        return np.fromiter((r if (r := get(w, OUTSIDE)) < OUTSIDE else VOCABULARY - RARE + h(w) % RARE for w in words), np.int64, len(words))

    def learnt(self, words: list[str]) -> np.ndarray:
        """Rows (token id, count): 0 for a frequent word, which is its own token, and -1 for one whose count isn't known."""
        out, get = np.zeros((len(words), 2), np.int64), self.rank.get
        out[:, 0] = self.ids(words)
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        out[:, 1] = np.where(at < 0, -1, np.where(at < OUTSIDE, 0, self.counts[at] if len(self.counts) else 0))
        return out


def _rare_counts(vocabulary):
    """Occurrences of the words of each hashed token."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(RARE, np.int64)
        for batch in rows:
            ids = vocabulary.value.ids(batch.column("word").to_pylist()) - (VOCABULARY - RARE)
            np.add.at(total, ids[ids >= 0], np.asarray(batch.column("n"))[ids >= 0])
        yield pa.RecordBatch.from_arrays([pa.array(range(RARE), pa.int32()), pa.array(total)], names=["bucket", "n"])

    return run


_RARE = pa.list_(pa.struct([("word", pa.string()), ("k", pa.int64())]))


def _encode(name: str, vocabulary, carry: list[str]):
    """Texts as token ids, with the sum of log n over their words in hashed tokens: of those whose count n is known, while
    the others are listed in ``__rare`` with their occurrences."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = memory("masked_lm", name, make=lambda: Remembered(vocabulary.value.learnt, np.dtype((np.int64, (2,)))))
        for batch in (part for whole in rows for part in slices(whole, "__text", 8 << 20)):
            distinct, codes, starts = coded_words(batch.column("__text"))
            learnt = known.rows(distinct)
            ids, count = learnt[:, 0].astype("<u2")[codes], learnt[:, 1]
            log_n = np.concatenate([[0.0], np.cumsum(np.log(np.maximum(count, 1))[codes])])
            unknown = np.flatnonzero((count < 0)[codes])
            text = np.searchsorted(starts, unknown, side="right") - 1
            pairs, k = np.unique(text * max(1, len(distinct)) + codes[unknown], return_counts=True)
            held = pa.StructArray.from_arrays([pa.array(distinct, pa.string()).take(pa.array(pairs % max(1, len(distinct)))), pa.array(k, pa.int64())], names=["word", "k"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs, np.arange(len(starts)) * max(1, len(distinct))), pa.int32()), held)
            made = [pa.array([ids[a:b].tobytes() for a, b in zip(starts, starts[1:], strict=False)], pa.binary()), pa.array(np.diff(starts)), pa.array(log_n[starts[1:]] - log_n[starts[:-1]]), lists.cast(_RARE)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *made], names=[*carry, "__ids", "__n", "__own", "__rare"])

    return run


def _read(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of several texts one after another, and the start of each."""
    texts = column.to_pylist()
    return np.frombuffer(b"".join(texts), "<u2"), np.concatenate([[0], np.cumsum([len(t) // 2 for t in texts])]).astype(np.int64)


def _positions(starts: np.ndarray, nth: int) -> np.ndarray:
    """Positions that train in round ``nth``, counted from the begin of each text."""
    within = np.arange(starts[-1]) - np.repeat(starts[:-1], np.diff(starts))
    return np.flatnonzero(within % ROUNDS == nth)


def _chunks(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of one shard at a time, in lists of ``CHUNK`` tokens at least but for a shard's last, however batches are cut."""
    shard, held, size = None, [], 0
    for batch in rows:
        for now, ids in zip(batch.column("__shard").to_pylist(), batch.column("__ids").to_pylist(), strict=True):
            if held and (now != shard or size >= 2 * CHUNK):
                yield shard, held
                held, size = [], 0
            shard, size = now, size + len(ids)
            held.append(ids)
    if held:
        yield shard, held


def _train(model, nth: int):
    """Rows (__shard, __ids) sorted by shard: each shard's parameters after its steps, in blocks."""

    def out(shard: int, trainer: Trainer) -> pa.RecordBatch:
        blocks = [x.tobytes() for x in np.array_split(trainer.flat, BLOCKS)]
        return pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([shard] * BLOCKS, pa.int64()), pa.array([float(trainer.tokens)] * BLOCKS), pa.array(blocks)], names=["block", "part", "weight", "values"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = last = None
        for shard, texts in _chunks(rows):
            if shard != last:
                if trainer is not None:
                    yield out(last, trainer)
                trainer, last, nth_chunk = Trainer(model.value), shard, 0
            ids, starts = _read(pa.array(texts, pa.binary()))
            near = _neighbours(ids, starts)
            at = np.random.default_rng([nth, shard, nth_chunk]).permutation(_positions(starts, nth))
            nth_chunk += 1
            for b in range(0, len(at), BATCH):
                trainer.learn(ids[at[b : b + BATCH]], near[:, at[b : b + BATCH]])
        if trainer is not None:
            yield out(last, trainer)

    return run


def _average(rows: pa.Table) -> pa.Table:
    """The weighted mean of at most ``FAN`` rows of one block, in order of their parts."""
    rows = rows.sort_by("part")
    total, weight = 0.0, 0.0
    for w, v in zip(rows.column("weight").to_pylist(), rows.column("values"), strict=True):
        total, weight = total + np.frombuffer(v.as_py(), np.float32).astype(np.float64) * w, weight + w
    mean = (total / max(weight, 1.0)).astype(np.float32).tobytes()
    return pa.table({"block": rows.column("block")[:1], "part": pa.array([rows.column("part")[0].as_py() // FAN], pa.int64()), "weight": pa.array([weight]), "values": pa.array([mean], pa.binary())})


_AVERAGED = "block int, part long, weight double, values binary"


def _score(model, rare, carry: list[str]):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        within = np.zeros(VOCABULARY)
        within[VOCABULARY - RARE :] = -np.log(rare.value + 1.0)
        for batch in (part for whole in rows for part in slices(whole, "__ids", 4 << 20)):
            ids, starts = _read(batch.column("__ids"))
            each = np.append(log_probabilities(model.value, ids, _neighbours(ids, starts)) + within[ids], 0.0)
            total = np.where(np.diff(starts) > 0, np.add.reduceat(each, starts[:-1]), 0.0) if len(starts) > 1 else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(total)], names=[*carry, "__pll"])

    return run


def _least_known(counts: DataFrame) -> int:
    """The lowest count that ``KNOWN`` words at most reach, within a 64th of it; found from a few thousand sums."""
    # Counts below 128 stand for themselves; beyond, there are 64 steps to each power of two.
    bits = "greatest(cast(floor(log2(n)) as int) - 6, 0)"
    step = F.expr(f"shiftleft(shiftright(n, {bits}), {bits})")
    least, held = 1 << 62, 0
    for r in sorted(counts.groupBy(step.alias("n")).count().collect(), key=lambda r: -r["n"]):
        held += r["count"]
        if held > KNOWN:
            break
        least = r["n"]
    return least


def _columns(rows: DataFrame, names: list[str]) -> list[str]:
    return [f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names]


def fitted(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)):
    """Rows as written token ids (carried columns, __row, __ids, __n, __own, __rare), parameters trained on all of them and
    occurrences by hashed token as broadcasts of fixed size, and the table of all words with their counts."""
    spark = docs.sparkSession
    rows = docs.select(*(F.col(f"`{c}`") for c in carry), F.col(f"`{text_col}`").cast("string").alias("__text"))
    counts = materialise(rows.select(F.col("__text").alias("text")).mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")
    frequent = sorted(counts.filter(F.col("n") >= _least_known(counts)).collect(), key=lambda r: (-r["n"], r["word"]))  # at most KNOWN rows
    vocabulary = Vocabulary([r["word"] for r in frequent], [r["n"] for r in frequent])
    share = np.zeros(VOCABULARY)
    share[: min(len(frequent), OUTSIDE)] = vocabulary.counts[:OUTSIDE]
    words = spark.sparkContext.broadcast(vocabulary)
    rare = np.zeros(RARE, np.int64)
    for r in counts.mapInArrow(_rare_counts(words), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # RARE rows
        rare[r["bucket"]] = r["n"]
    share[VOCABULARY - RARE :] = rare
    made = [*_columns(rows, list(carry)), "__ids binary, __n long, __own double, __rare array<struct<word: string, k: long>>"]
    encoded = rows.mapInArrow(_encode(uuid.uuid4().hex, words, list(carry)), ", ".join(made)).withColumn("__row", F.monotonically_increasing_id())
    encoded = materialise(encoded, "lm-rows")  # written, so a row keeps its number

    shards = max(1, -(-int(share.sum()) // SHARD_TOKENS))
    key = F.xxhash64("__ids", *(F.col(f"`{c}`") for c in carry))
    # Rows whose carried columns are all null have nothing else to tell equal texts apart, and equal texts are alike.
    told = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNotNull() for c in carry], F.lit(False))
    key = F.when(told, key).otherwise(F.xxhash64("__ids", F.col("__row") % 4096))
    dealt = encoded.filter("__n > 0").select("__ids", key.alias("__key")).withColumn("__shard", F.pmod("__key", F.lit(shards)))
    dealt = dealt.repartitionByRange(shards, "__shard").sortWithinPartitions("__shard", "__key", "__ids").select("__shard", "__ids")
    flat = initial(share)
    for nth in range(ROUNDS):
        model = spark.sparkContext.broadcast(flat)
        mean, parts = materialise(dealt.mapInArrow(_train(model, nth), _AVERAGED), "lm-shards"), shards
        while parts > 1:
            mean, parts = mean.groupBy("block", F.floor(F.col("part") / FAN)).applyInArrow(_average, _AVERAGED), -(-parts // FAN)
        got = {r["block"]: r["values"] for r in mean.collect()}  # BLOCKS rows, together one model
        if got:
            flat = np.frombuffer(b"".join(bytes(got[b]) for b in range(BLOCKS)), np.float32)
    return encoded, spark.sparkContext.broadcast(flat), spark.sparkContext.broadcast(rare), counts


def scored(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Carried columns with n_tokens, pll (sum of conditional log-probabilities) and mean_log_prob."""
    encoded, model, rare, counts = fitted(docs, text_col, carry)
    held = [*carry, "__row", "__n", "__own"]
    rows = encoded.select(*(F.col(f"`{c}`") for c in held), "__ids").mapInArrow(_score(model, rare, held), ", ".join([*_columns(encoded, held), "__pll double"]))
    # A count of one, of a word met once, adds log 1.
    seen = encoded.select("__row", F.inline("__rare")).join(counts.filter("n > 1"), "word")
    more = seen.groupBy("__row").agg(F.sum(F.col("k") * F.log("n")).alias("__more"))
    pll = F.col("__pll") + F.col("__own") + F.coalesce("__more", F.lit(0.0))
    return rows.join(more, "__row", "left").select(*(F.col(f"`{c}`") for c in carry), F.col("__n").alias("n_tokens"), pll.alias("pll"), F.when(F.col("__n") > 0, pll / F.col("__n")).alias("mean_log_prob"))
