"""Toxicity by a convolutional text classifier, trained in numpy.

A word's vector is the sum of hashed embeddings: of the word itself and of its leading characters, so that forms of one stem
share weight. Filters of widths 1 to 3 run over all words of a text; the largest value of each filter goes to a logistic
unit. The first channel starts at the smoothed log-odds of a bucket in the training texts, the rest at small random values,
and all of it is trained by Adam; a calibration part of the training rows that the training never sees sets a threshold for
each language.

Every labelled row counts, whole, whatever its length; of rows repeated with one id one does. The log-odds are of exact counts
of all training rows; all of these are dealt by a hash of the id to shards of about ``SHARD`` rows, each of which takes its
steps over all its texts from the same start, and of each row of parameters the mean is taken over the shards that moved it;
the thresholds come from the scores of all calibration rows, counted in ``SCORES`` steps. What is gathered has the model's
size, or the thresholds'. Only the start, of the filters and the logistic unit, is trained on the driver, by :func:`fit`: on at
most ``SAMPLE`` training rows of each label, by the order of a hash of the id, of at most ``FITTED`` characters; without both
labels among them it is random. Every text is scored whole.

Defined results: a null or empty text has no words and gets the score of all filters at 0; a null language gets the common
threshold; a null label counts as no label; null ids are scored but never fitted; repeated rows are scored one by one; with
no label of either kind every score is 0; an empty table gives an empty result; other columns may have any names: the two
that :func:`scored` adds come last, with underscores after their names where those are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, coded_words, drop_written, free_name, give_back, materialise, memory, numbered, renamed, slices, tidied

SAMPLE = {1: 2000, 0: 4000}
FITTED = 1 << 16
BUCKETS = 1 << 17
CHANNELS = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
STEMS = (3, 4, 5, 6)
EPOCHS = 3
#: Steps at least, of so many texts each.
STEPS, BATCH = 150, 64
RATE = 0.02
#: One of so many training rows calibrates.
CALIBRATE = 5
#: A language has a threshold of its own from so many calibration rows of each label.
LEAST = 10
#: Rows of a shard, about, and fractions to which what it moved is rounded, so that sums do not depend on their order.
SHARD = 2048
FINE = float(1 << 40)
#: Steps from 0 to 1 in which scores of calibration rows are counted.
SCORES = 1 << 20
MARKS = ".,;:!?\"'()[]"


def grams(words: list[str]) -> np.ndarray:
    """Buckets of each word and of its stems; a stem that is no shorter than the word falls into bucket 0, which is empty."""
    out = np.zeros((len(words), 1 + len(STEMS)), np.int64)
    h = xxhash.xxh32_intdigest
    for row, word in zip(out, words, strict=True):
        word = word.strip(MARKS) or word
        row[0] = h(word) % (BUCKETS - 1) + 1
        for k, n in enumerate(STEMS, 1):
            if len(word) > n:
                row[k] = h(f"{word[:n]}*") % (BUCKETS - 1) + 1
    return out


@dataclass
class Model:
    table: np.ndarray  # buckets x channels
    filters: list[np.ndarray]  # for each width: width x channels x filters
    bias: np.ndarray  # of all filters
    out: np.ndarray  # weights of the logistic unit, its own bias last
    thresholds: dict[str, float] = field(default_factory=dict)
    common: float = 0.5

    def vectors(self, buckets: np.ndarray) -> np.ndarray:
        return self.table[buckets].sum(axis=1)

    def pooled(self, vectors: np.ndarray, starts: np.ndarray, back: bool = False):
        """Largest value of each filter in each text, 0 where the text has no words; with ``back``, where it was."""
        n, texts = len(vectors), len(starts) - 1
        full = np.flatnonzero(np.diff(starts))
        values = np.zeros((texts, len(WIDTHS) * FILTERS), np.float32)
        where = np.zeros(values.shape, np.int64)
        if not n:
            return values, where
        text_of = np.repeat(np.arange(texts), np.diff(starts))
        left = np.repeat(starts[1:], np.diff(starts)) - np.arange(n)  # words from here to the text's end
        for k, (width, w) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            at = slice(k * FILTERS, (k + 1) * FILTERS)
            conv = vectors @ w[0]
            for j in range(1, width):
                conv[:-j] += (vectors[j:] * (left[:-j] > j)[:, None]) @ w[j]
            values[full, at] = np.maximum.reduceat(conv, starts[full], axis=0)
            if back:
                row, f = np.nonzero(conv == np.repeat(values[full, at], np.diff(starts)[full], axis=0))
                where[text_of[row[::-1]], at.start + f[::-1]] = row[::-1]  # of equal values the first
        values[full] = np.maximum(values[full] + self.bias, 0)
        return values, where

    def parameters(self) -> np.ndarray:
        """All that is trained, in rows of ``CHANNELS``: the table first."""
        rest = np.concatenate([*(w.ravel() for w in self.filters), self.bias, self.out])
        return np.concatenate([self.table, np.pad(rest, (0, -len(rest) % CHANNELS)).reshape(-1, CHANNELS)]).astype(np.float32)

    @classmethod
    def of(cls, parameters: np.ndarray) -> Model:
        """A model of its own with these parameters."""
        n, rest = len(WIDTHS) * FILTERS, parameters[BUCKETS:].ravel()
        ends = np.cumsum([*(w * CHANNELS * FILTERS for w in WIDTHS), n, n + 1])
        *filters, bias, out = (x.copy() for x in np.split(rest[: ends[-1]], ends[:-1]))
        return cls(parameters[:BUCKETS].copy(), [x.reshape(w, CHANNELS, FILTERS) for w, x in zip(WIDTHS, filters, strict=True)], bias, out)

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(pooled @ self.out[:-1] + self.out[-1], -30, 30)))


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.state, self.t = rate, {}, 0

    def step(self, name, value: np.ndarray, grad: np.ndarray, rows=None, part: float = 1.0) -> None:
        m, v = self.state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * grad
        v[at] = 0.99 * v[at] + 0.01 * grad * grad
        value[at] -= part * self.rate * m[at] / (np.sqrt(v[at]) + 1e-6)


def log_odds(seen: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Smoothed log-odds of each bucket, by the texts of either label that hold it, of so many in all."""
    odds = np.log((seen[1] + 0.5) / (total[1] + 1)) - np.log((seen[0] + 0.5) / (total[0] + 1))
    odds[seen.sum(axis=0) < 3] = 0
    return 0.25 * np.maximum(odds, 0)  # what speaks for the label; a text is not cleared by its other words


def initial(odds: np.ndarray, rng: np.random.Generator) -> Model:
    table = rng.normal(0, 0.05, (BUCKETS, CHANNELS)).astype(np.float32)
    table[:, 0] = odds
    table[0] = 0
    filters = [rng.normal(0, 0.1, (w, CHANNELS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for w in filters:
        w[:, 0, : FILTERS // 2] += 1.0
    model = Model(table, filters, np.full(len(WIDTHS) * FILTERS, 0, np.float32), np.zeros(len(WIDTHS) * FILTERS + 1, np.float32))
    model.out[:-1] = 0.1
    return model


def learn(model: Model, adam: _Adam, buckets: np.ndarray, flat: np.ndarray, own: np.ndarray, y: np.ndarray) -> None:
    """One step on texts of these words, given as rows of ``buckets``, and starts."""
    distinct, where_in = np.unique(flat, return_inverse=True)
    vectors = model.vectors(buckets[distinct])[where_in]
    pooled, where = model.pooled(vectors, own, back=True)
    error = (model.scores(pooled) - y) / len(y)
    back = error[:, None] * model.out[:-1] * (pooled > 0)
    grad_out = np.append(error @ pooled, error.sum()).astype(np.float32) + 1e-4 * model.out
    spread = np.zeros((len(distinct), CHANNELS), np.float32)
    for k, (width, w) in enumerate(zip(WIDTHS, model.filters, strict=True)):
        at = slice(k * FILTERS, (k + 1) * FILTERS)
        g, grad = back[:, at].astype(np.float32), np.zeros_like(w)
        for j in range(width):
            word = where[:, at] + j
            inside = word < own[1:, None]
            word, gj = np.where(inside, word, 0), g * inside
            if len(flat):
                grad[j] = np.einsum("tf,tfc->cf", gj, vectors[word])
                np.add.at(spread, where_in[word], gj[:, :, None] * w[j].T[None])
        adam.step(("w", width), w, grad)
    adam.step("bias", model.bias, back.sum(axis=0))
    adam.step("out", model.out, grad_out)
    moved = np.flatnonzero(spread.any(axis=1))
    if len(moved):
        rows, place = np.unique(buckets[distinct[moved]], return_inverse=True)
        grads = np.zeros((len(rows), CHANNELS), np.float32)
        np.add.at(grads, place.reshape(len(moved), -1), spread[moved][:, None, :])
        adam.step("table", model.table, grads, rows, 0.05)
        model.table[0] = 0


def fit(texts: list[str], labels: list[int], langs: list[str | None], seed: int = 7) -> Model | None:
    """Train on the rows given; None if one of the labels is missing."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    words, codes, starts = coded_words(pa.array(texts, pa.string()))
    buckets = grams(words)
    rng = np.random.default_rng(seed)
    calibrating = np.array([xxhash.xxh32_intdigest(str(i)) % CALIBRATE == 0 for i in range(len(y))])
    if len(set(y[~calibrating])) < 2:
        calibrating[:] = False
    train = np.flatnonzero(~calibrating)

    # Smoothed log-odds of each bucket, by the texts that hold it.
    seen = np.zeros((2, BUCKETS), np.float32)
    for t in train:
        held = np.unique(buckets[np.unique(codes[starts[t] : starts[t + 1]])])
        seen[int(y[t]), held] += 1
    total = np.array([(y[train] == 0).sum(), (y[train] == 1).sum()], np.float32)
    model = initial(log_odds(seen, total), rng)

    adam = _Adam(RATE)
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(train)))):
        order = rng.permutation(train)
        for b in range(0, len(order), BATCH):
            part = order[b : b + BATCH]
            mine = [codes[starts[t] : starts[t + 1]] for t in part]
            own = np.concatenate([[0], np.cumsum([len(c) for c in mine])])
            flat = np.concatenate(mine) if len(mine) else np.zeros(0, np.int64)
            learn(model, adam, buckets, flat, own, y[part])

    held = np.flatnonzero(calibrating) if calibrating.any() else train
    scores = np.zeros(len(held))
    for b in range(0, len(held), BATCH):
        mine = [codes[starts[t] : starts[t + 1]] for t in held[b : b + BATCH]]
        own = np.concatenate([[0], np.cumsum([len(c) for c in mine])])
        scores[b : b + BATCH] = model.scores(model.pooled(model.vectors(buckets[np.concatenate(mine)]), own)[0])
    model.common = _threshold(scores, y[held])
    for lang in {x for x in langs if x is not None}:
        own = np.array([langs[t] == lang for t in held])
        if min(y[held][own].sum(), (1 - y[held][own]).sum()) >= LEAST:
            model.thresholds[lang] = _threshold(scores[own], y[held][own])
    return model


def _threshold(scores: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """The cut with the best F1, in the middle of its gap; clean rows count, so of equal cuts the highest. With ``n``, a score
    stands for n rows, and y is how many of them have the label."""
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(y[order])
    f1 = 2 * hits / ((np.arange(1, len(s) + 1) if n is None else np.cumsum(n[order])) + max(y.sum(), 1))
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(f1.argmax())
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0)) / 2)


def _seen(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (y, text): by bucket, the texts of either label that hold it."""
    seen, known = np.zeros((2, BUCKETS), np.int64), Remembered(grams, np.dtype((np.int64, (1 + len(STEMS),))))
    for batch in (part for whole in rows for part in slices(whole, "text", 8 << 20)):
        words, codes, starts = coded_words(batch.column("text"))
        buckets = known.rows(words)
        for t, y in enumerate(batch.column("y").to_pylist()):
            seen[y, np.unique(buckets[np.unique(codes[starts[t] : starts[t + 1]])])] += 1
    at = np.flatnonzero(seen.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0, at]), pa.array(seen[1, at])], names=["bucket", "n0", "n1"])


_MOVED = [f"c{c}" for c in range(CHANNELS)]


def _steps(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[str], list[int]]]:
    """Rows (shard, y, text) in order of shards: the texts and labels of each step, however batches are cut."""
    shard, texts, labels, size = None, [], [], 0
    for batch in rows:
        for now, y, text in zip(*(batch.column(c) for c in ("shard", "y", "text")), strict=True):
            now, text = now.as_py(), text.as_py()
            if texts and (now != shard or len(texts) == BATCH or size + len(text) > 8 << 20):
                yield shard, texts, labels
                texts, labels, size = [], [], 0
            shard, size = now, size + len(text)
            texts.append(text)
            labels.append(y.as_py())
    if texts:
        yield shard, texts, labels


def _shards(shared):
    """Rows (shard, y, text) in order of shards: what each shard's steps move, by row of parameters."""

    def out(before: np.ndarray, model: Model) -> pa.RecordBatch:
        moved = np.rint((model.parameters() - before).astype(np.float64) * FINE).astype(np.int64)
        at = np.flatnonzero(moved.any(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(moved[at, c]) for c in range(CHANNELS))], names=["row", *_MOVED])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = last = None
        known = Remembered(grams, np.dtype((np.int64, (1 + len(STEMS),))))
        for shard, texts, labels in _steps(rows):
            if shard != last:
                if model is not None:
                    yield out(shared.value, model)
                model, adam, last = Model.of(shared.value), _Adam(RATE), shard
            words, codes, starts = coded_words(pa.array(texts, pa.string()))
            learn(model, adam, known.rows(words), codes, starts, np.array(labels, np.float32))
        if model is not None:
            yield out(shared.value, model)

    return run


def _counted(shared):
    """Rows (y, text, lang): the same labels and languages with the step of each score."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, word_vectors(shared.id, shared.value)
        for batch in (part for whole in rows for part in slices(whole, "text", 8 << 20)):
            words, codes, starts = coded_words(batch.column("text"))
            score = model.scores(model.pooled(known.rows(words)[codes], starts)[0]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("y"), pa.array(np.rint(score * SCORES).astype(np.int64))], names=["lang", "y", "step"])

    return run


def _scorer(shared, carry: int):
    """Rows of ``carry`` columns, then text and language: the columns with score and flag."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, word_vectors(shared.id, shared.value)
        for batch in (part for whole in rows for part in slices(whole, "__text", 8 << 20)):
            words, codes, starts = coded_words(batch.column("__text"))
            if model is None:
                score = np.zeros(batch.num_rows)
            else:
                score = model.scores(model.pooled(known.rows(words)[codes], starts)[0]).astype(np.float64)
            langs = batch.column("__lang").to_pylist()
            flags = [False if model is None else bool(s >= model.thresholds.get(x, model.common)) for s, x in zip(score, langs, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:carry], pa.array(score), pa.array(flags)], names=[*batch.schema.names[:carry], "__score", "__toxic"])

    return run


def word_vectors(key: int, model: Model | None) -> Remembered | None:
    """A worker's table of word vectors under the model with this key."""
    if model is None:
        return None
    return memory("toxicity", key, make=lambda: Remembered(lambda new: model.vectors(grams(new)), np.dtype((np.float32, (CHANNELS,)))))


def trained(docs: DataFrame, labels: DataFrame, label: str = "toxic", train=None, sample: dict[int, int] | None = None) -> Model | None:
    """Fit on all labelled rows; ``train`` is a condition on doc_id that rows must meet, ``sample`` bounds the start's rows."""
    spark = docs.sparkSession
    rows = labels.filter(F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    rows = rows.filter(train) if train is not None else rows
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y")).filter(F.col("y").isin(0, 1))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), lang.cast("string").alias("lang")).join(rows, "doc_id")
    one = F.min_by(F.struct("y", "text", "lang"), F.struct(F.length("text") > FITTED, F.xxhash64("text"), F.xxhash64("lang"))).alias("row")
    every = materialise(texts.groupBy("doc_id").agg(one).select("doc_id", "row.*"), "toxicity-rows")
    calibrating = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(CALIBRATE)) == 0
    counts = {(r[0], r[1]): r[2] for r in every.groupBy(calibrating, "y").count().collect()}
    if any(counts.get((True, y), 0) + counts.get((False, y), 0) == 0 for y in (0, 1)):
        drop_written(every)
        return None
    if not all(counts.get((False, y)) for y in (0, 1)):  # too few rows to keep some back
        counts = {(False, y): counts.get((True, y), 0) + counts.get((False, y), 0) for y in (0, 1)}
        calibrating = F.lit(False)
    fitted, total = every.filter(~calibrating), np.array([counts[False, 0], counts[False, 1]], np.float64)

    # The start, from a bounded part.
    ids = None
    for value, n in (sample or SAMPLE).items():
        part = fitted.filter((F.col("y") == value) & (F.length("text") <= FITTED)).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        ids = part if ids is None else ids.union(part)
    got = sorted((r["doc_id"], r["text"], r["lang"], r["y"]) for r in fitted.join(F.broadcast(ids), "doc_id").toLocalIterator())
    start = fit([r[1] for r in got], [r[3] for r in got], [r[2] for r in got])
    del got

    # All rows: their log-odds, their steps, their thresholds.
    seen = np.zeros((2, BUCKETS))
    for r in fitted.select("y", "text").mapInArrow(tidied(_seen), "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0"), F.sum("n1")).toLocalIterator():  # BUCKETS rows at most
        seen[:, r[0]] = r[1:]
    odds = log_odds(seen, total)
    odds[0] = 0
    start = start or initial(odds, np.random.default_rng(7))
    start.table[:, 0] = odds
    before = start.parameters()
    shards = max(1, -(-int(total.sum()) // SHARD))
    dealt = fitted.select(F.xxhash64("doc_id").alias("key"), "doc_id", "y", "text").withColumn("shard", F.pmod("key", F.lit(shards)))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "key", "doc_id").select("shard", "y", "text")
    moved = dealt.mapInArrow(tidied(_shards(spark.sparkContext.broadcast(before))), ", ".join(f"{c} long" for c in ("row", *_MOVED)))
    after = before.astype(np.float64)
    for r in moved.groupBy("row").agg(F.count("*"), *(F.sum(c) for c in _MOVED)).toLocalIterator():  # the model's rows at most
        after[r[0]] += np.array(r[2:], np.float64) / FINE / r[1]
    model = Model.of(after.astype(np.float32))
    held = every.filter(calibrating) if any(k for k, _ in counts) else fitted
    steps = held.select("y", "text", "lang").mapInArrow(tidied(_counted(_Shared(spark.sparkContext.broadcast(model))), remember=False), "lang string, y int, step long")
    _calibrate(model, steps.groupBy("lang", "step").agg(F.sum("y").alias("hits"), F.count("*").alias("n")).toLocalIterator())
    drop_written(every)
    give_back()  # what training took of the driver's memory
    return model


def _calibrate(model: Model, counted) -> None:
    """Thresholds from rows (lang, step, hits, n): steps of scores, with how many rows have them and how many of these the label."""
    by: dict[str | None, dict[int, tuple[int, int]]] = {}
    common: dict[int, tuple[int, int]] = {}
    for lang, step, hits, n in counted:
        by.setdefault(lang, {})[step] = (hits, n)
        common[step] = (common.get(step, (0, 0))[0] + hits, common.get(step, (0, 0))[1] + n)
    cut = lambda x: _threshold(np.array(sorted(x)) / SCORES, *np.array([x[k] for k in sorted(x)]).T)
    model.common = cut(common)
    for lang, x in by.items():
        hits, n = np.array(list(x.values())).sum(axis=0)
        if lang is not None and min(hits, n - hits) >= LEAST:
            model.thresholds[lang] = cut(x)


def scored(docs: DataFrame, model: Model | None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All columns of ``docs``, then ``__score`` (0 to 1) and ``__toxic``: whether it reaches its language's threshold.

    The language chooses the threshold only; the score comes from the text alone."""
    spark, names = docs.sparkSession, docs.columns
    shared = spark.sparkContext.broadcast(model)  # of a size fixed by the module's parameters
    rows, own = numbered(docs), {c: f"c{k}" for k, c in enumerate(names)}
    lang = F.col(own[lang_col]).cast("string") if lang_col in own else F.lit(None).cast("string")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    done = rows.withColumn("__text", F.col(own[text_col]).cast("string")).withColumn("__lang", lang).mapInArrow(tidied(_scorer(_Shared(shared), len(names)), remember=False), f"{schema}, __score double, __toxic boolean")
    return renamed(done, names, F.col("__score").alias(free_name(names, "__score")), F.col("__toxic").alias(free_name(names, "__toxic")))


class _Shared:
    """A broadcast with a key by which workers remember what they derive from it."""

    def __init__(self, broadcast):
        self._broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    @property
    def value(self):
        return self._broadcast.value

    def __reduce__(self):
        return _unpack, (self._broadcast, self.id)


def _unpack(broadcast, key):
    out = _Shared.__new__(_Shared)
    out._broadcast, out.id = broadcast, key
    return out
