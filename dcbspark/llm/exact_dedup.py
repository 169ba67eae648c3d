"""Exact deduplication by content sort.

Rows are range-partitioned by sampled splitters over (first bytes of the normalised text, SHA-256 of it, id), each partition
is sorted externally so that equal texts lie side by side, and every normalised text is compared in full with its neighbour.
The digest only orders texts that begin with the same ``PREFIX`` bytes: with whole texts as keys the sampled splitters, which
the driver holds, would grow with the texts. The id is part of the splitters, so a text that holds a third of all rows is cut
over many partitions; what the cuts separate is put together again from two narrow rows a partition, and whole texts are
compared across a cut only where the digests on both sides are equal, each pair in a task of its own.

Defined results: a null text counts as empty, empty texts are equal to each other; rows repeated with the same id form one
group of that many rows and each of them says whether its id stays (``kept`` is true on one row only, the first of the equal
ids); a null id is smaller than any other; very long texts are compared whole; other columns may have any names and are not
read but by :func:`exact_kept`, which returns them; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import materialise, numbered, renamed

#: Bytes of the normalised text that lead the sort key.
PREFIX = 64

_MARKS = [T.StructField(n, t) for n, t in (("__part", T.IntegerType()), ("__run", T.LongType()), ("__nth", T.LongType()), ("__edge", T.StringType()))]


def _normal(text: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.fill_null(text.cast(pa.string()), ""))


def _keyed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the sort key: the first bytes of the normalised text and the digest of all of it."""
    for batch in rows:
        raw = _normal(batch.column("__text")).cast(pa.binary())
        digest = pa.array([hashlib.sha256(v.as_buffer()).digest() for v in raw], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, pc.binary_slice(raw, 0, PREFIX), digest], names=[*batch.schema.names, "__lead", "__digest"])


def _runs(columns: list[str], heads: bool):
    """Number the runs of equal neighbours in a sorted partition and keep ``columns``; of a run only its head, if so asked.

    The heads of the partition's first and last run carry the text in ``__edge``. Which run is the last is known only at
    the end, so the newest head is held back.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, count, nth, held = TaskContext.get().partitionId(), None, 0, 0, None

        def out(batch: pa.RecordBatch, run_no, place, edge) -> pa.RecordBatch:
            n = batch.num_rows
            marks = [pa.array([part] * n, pa.int32()), pa.array(run_no, pa.int64()), pa.array(place, pa.int64()), pa.array(edge, pa.string())]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *marks], names=[*columns, *(f.name for f in _MARKS)])

        for batch in rows:
            n = batch.num_rows
            if not n:
                continue
            text = _normal(batch.column("__text"))
            new = np.ones(n, bool)
            new[1:] = np.asarray(pc.not_equal(text[1:], text[:-1]))
            new[0] = not count or text[0].as_py() != last
            run_no = count - 1 + np.cumsum(new)
            starts = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            place = np.where(starts < 0, nth + 1 + np.arange(n), np.arange(n) - starts)
            newest = int(starts[-1])
            if newest >= 0 and held is not None:  # a later head: the one held back is an edge only if it is the first
                yield out(held[0], [held[1]], [0], [held[2] if held[1] == 0 else None])
            if newest >= 0:
                held = (batch.slice(newest, 1), int(run_no[newest]), text[newest].as_py())
            edge = [text[0].as_py() if run_no[0] == 0 and place[0] == 0 else None] + [None] * (n - 1)
            take = new.copy() if heads else np.ones(n, bool)
            if newest >= 0:
                take[newest] = False
            if take.any():
                keep = pa.array(take)
                yield out(batch.filter(keep), run_no[take], place[take], pa.array(edge, pa.string()).filter(keep))
            count, nth, last = int(run_no[-1]) + 1, int(place[-1]), text[n - 1].as_py()
        if held is not None:
            yield out(held[0], [held[1]], [0], [held[2]])

    return run


def _sorted_runs(docs: DataFrame, id_col: str, text_col: str, carry: list[str], heads: bool, keep: str, partitions: int | None) -> DataFrame:
    """Written rows in runs: carried columns, __id and __digest, and the run's marks."""
    spark = docs.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(*(F.col(f"`{c}`") for c in carry), F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    keyed = rows.mapInArrow(_keyed, T.StructType([*rows.schema.fields, T.StructField("__lead", T.BinaryType()), T.StructField("__digest", T.BinaryType())]))
    rank = F.col("__id").asc_nulls_first() if keep == "smallest" else F.col("__id").desc_nulls_last()
    ordered = keyed.repartitionByRange(parts, "__lead", "__digest", rank).sortWithinPartitions("__lead", "__digest", rank)
    names = [*carry, "__id", "__digest"]
    fields = [f for f in keyed.schema.fields if f.name in names]
    return materialise(ordered.mapInArrow(_runs([f.name for f in fields], heads), T.StructType([*fields, *_MARKS])), "exact-runs")


def _chains(runs: DataFrame) -> DataFrame:
    """The first and the last run of each partition, two narrow rows a partition at most, with the chain of equal texts that
    they belong to and their place in it."""
    line = W.Window.orderBy("__part", "__run")
    edges = runs.filter("__edge is not null")
    narrow = edges.select("__part", "__run", "__digest", F.col("__id").alias("head"))
    before = lambda c: F.lag(c).over(line)
    near = narrow.select("__part", "__run", before("__part").alias("part"), before("__run").alias("run"), before("__digest").alias("digest"), "__digest")
    near = near.filter(F.col("digest") == F.col("__digest")).select("__part", "__run", "part", "run")
    texts = edges.select("__part", "__run", "__edge")
    other = texts.select(F.col("__part").alias("part"), F.col("__run").alias("run"), F.col("__edge").alias("edge"))
    equal = near.join(texts, ["__part", "__run"]).join(other, ["part", "run"]).filter(F.col("edge") == F.col("__edge")).select("__part", "__run", F.lit(0).cast("long").alias("new"))
    chained = narrow.drop("__digest").join(equal, ["__part", "__run"], "left").withColumn("chain", F.sum(F.coalesce("new", F.lit(1).cast("long"))).over(line)).drop("new")
    return chained.withColumn("place", F.row_number().over(W.Window.partitionBy("chain").orderBy("__part", "__run")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", partitions: int | None = None) -> DataFrame:
    """One row per document: id_col, keep_id, group_size, kept, text_sha256.

    ``keep`` says which identifier of a group stays: ``smallest`` (default) or ``largest``.
    """
    runs = _sorted_runs(docs, id_col, text_col, [], False, keep, partitions)
    edges = _chains(runs)
    # A run ends inside its partition or is an edge, so its size is its last place; chains add up their runs.
    sizes = runs.groupBy("__part", "__run").agg((F.max("__nth") + 1).alias("size"), F.min_by("__id", "__nth").alias("head"))
    chains = edges.join(sizes.select("__part", "__run", "size"), ["__part", "__run"]).groupBy("chain").agg(F.sum("size").alias("chain_size"), F.min_by("head", "place").alias("chain_head"), F.lit(True).alias("chained"))
    of_edge = edges.select("__part", "__run", "chain", "place").join(chains, "chain")
    of_run = sizes.join(of_edge, ["__part", "__run"], "left").select(
        "__part", "__run", F.when(F.col("chained"), F.col("chain_head")).otherwise(F.col("head")).alias("keep_id"), F.coalesce("chain_size", "size").alias("group_size"), F.coalesce("place", F.lit(1)).alias("place")
    )
    return runs.join(of_run, ["__part", "__run"]).select(
        F.col("__id").alias(id_col), "keep_id", "group_size", ((F.col("place") == 1) & (F.col("__nth") == 0)).alias("kept"), F.lower(F.hex("__digest")).alias("text_sha256")
    )


def exact_kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", partitions: int | None = None) -> DataFrame:
    """The whole rows of ``docs`` that stay, one of each group of equal texts."""
    names = docs.columns
    own = {c: f"c{k}" for k, c in enumerate(names)}
    heads = _sorted_runs(numbered(docs), own[id_col], own[text_col], [*own.values()], True, keep, partitions)
    # Heads that continue a run of an earlier partition: two rows a partition at most, so small enough to broadcast.
    again = _chains(heads).filter("place > 1").select("__part", "__run")
    return renamed(heads.join(F.broadcast(again), ["__part", "__run"], "left_anti"), names)
