"""Mixing sources to target weights by temperature, in DataFrame functions only.

A source's weight is its token share raised to an exponent, normalised. The exponent is bisected between 0 (all sources
alike) and 1 (as they come): the largest at which the weights' entropy still reaches a share of the highest possible, or
the smallest at which no source is repeated more often than a limit. Weights become token quotas of a budget: whole passes
over a source, and one more in which the source's blocks, about ``BLOCK_TOKENS`` each and filled by a hash of the id, are
taken in a permuted order until the quota is spent; in the block where it ends, documents are taken by a second hash.

A document's copies follow from its own hashes and a few numbers of its source, so no text is moved. Sums are pre-aggregated
by block and blocks by ``GROUP`` of them, so a source with a third of all rows is never gathered: a window runs over the
groups of a source, then over the blocks of the one group in which its quota ends, then over the documents of that block.
The bisection folds over one array with a number for each source, so sources should number in the thousands, not more.

Defined results: null texts count as empty and have no tokens; a null source is the source ''; documents of a source
without tokens cost nothing and are taken once; rows with one id share their hashes and are taken or left together; an
empty table gives an empty result; very long texts are counted whole; :func:`mixed` returns columns of any names, while
:func:`hashed` adds columns with two underscores that must not be there yet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import materialise, numbered, renamed

BLOCK_TOKENS = 20_000
#: Blocks whose sums are added up first.
GROUP = 4096
#: Share of the highest entropy that the weights are to reach.
ENTROPY = 0.95
#: Halvings of the exponent's interval.
HALVINGS = 40
#: Larger than any number of blocks and prime, so that multiples of it permute the blocks.
STRIDE = 2_147_483_647
#: Words of a text, counted as its tokens.
WORD = r"[^\x20\x09-\x0D]+"


def _hash(id_col: str, at: int) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), at, 15), 16, 10).cast("long")


def exponent(totals: Column, entropy: float | None, repeats: float | None) -> Column:
    """The bisected exponent for an array of token counts."""
    t = "transform(totals, x -> cast(x as double) / total)"
    z = f"aggregate({t}, cast(0 as double), (s, x) -> s + pow(x, mid))"
    if entropy is not None:
        y = f"aggregate({t}, cast(0 as double), (s, x) -> s + pow(x, mid) * mid * ln(x))"
        holds, low, high = f"ln({z}) - {y} / {z} >= {entropy!r}D * ln(size(totals))", "mid", "acc.lo"
        step = f"if({holds}, struct(mid as lo, acc.hi as hi), struct(acc.lo as lo, mid as hi))"
        pick = "lo"
    else:
        holds = f"pow(array_max(totals) / array_min(totals), 1 - mid) <= {repeats!r}D"
        step = f"if({holds}, struct(acc.lo as lo, mid as hi), struct(mid as lo, acc.hi as hi))"
        pick = "hi"
    fold = f"aggregate(sequence(1, {HALVINGS}), struct(cast(0 as double) as lo, cast(1 as double) as hi), (acc, i) -> {step.replace('mid', '((acc.lo + acc.hi) / 2)')})"
    if entropy is not None:  # what comes in may reach the target as it is
        whole = holds.replace("mid", "1D")
        return F.expr(f"if({whole}, 1D, {fold}.{pick})")
    return F.expr(f"{fold}.{pick}")


def plan(rows: DataFrame, entropy: float | None = ENTROPY, repeats: float | None = None, budget: int | None = None, whole: bool = False) -> DataFrame:
    """A row for each source from rows (__source, __h, __g, __tokens): __weight, __blocks, __passes, __cut_place, __cut_hash.

    ``budget`` is in tokens, all there are unless given; with ``whole`` it is the least at which every source is seen once.
    """
    sums = materialise(rows.groupBy("__source").agg(F.sum("__tokens").alias("t")), "mix-sources")
    sources = sums.filter("t > 0")
    alpha = sources.agg(F.sort_array(F.collect_list("t")).alias("totals"), F.sum("t").alias("total")).select("totals", "total", exponent(F.col("totals"), None if repeats is not None else entropy, repeats).alias("a"))
    z = F.expr("aggregate(transform(totals, x -> pow(cast(x as double) / total, a)), cast(0 as double), (s, x) -> s + x)")
    # The exponent is one row; it joins by a constant that every source carries.
    alpha = alpha.select(F.lit(1).alias("one"), "a", "total", F.array_max("totals").alias("top"), z.alias("z"))
    w = F.round(F.pow(F.col("t").cast("double") / F.col("total"), F.col("a")) / F.col("z"), 9)
    top_w = F.round(F.pow(F.col("top").cast("double") / F.col("total"), F.col("a")) / F.col("z"), 9)
    spend = F.col("top") / top_w if whole else F.lit(budget).cast("double") if budget is not None else F.col("total").cast("double")
    weighted = sources.withColumn("one", F.lit(1)).join(F.broadcast(alpha), "one").select("__source", "t", w.alias("__weight"), spend.alias("spend"))
    quota = F.greatest(F.floor(F.col("__weight") * F.col("spend")), F.col("t")) if whole else F.floor(F.col("__weight") * F.col("spend"))
    weighted = weighted.withColumn("quota", quota).withColumn("__passes", F.floor(F.col("quota") / F.col("t"))).withColumn("rest", F.col("quota") - F.col("__passes") * F.col("t"))
    weighted = materialise(weighted.withColumn("__blocks", F.ceil(F.col("t") / F.lit(BLOCK_TOKENS))), "mix-weights")

    placed = rows.join(weighted, "__source").withColumn("place", _place(F.col("__h"), F.col("__blocks")))
    blocks = materialise(placed.groupBy("__source", "place").agg(F.sum("__tokens").alias("b"), F.first("rest").alias("rest")).withColumn("group", F.floor(F.col("place") / GROUP)), "mix-blocks")

    def ends(rows: DataFrame, at: str) -> DataFrame:
        """Where the running sum of a source first exceeds its rest, and how much of the rest is left there."""
        line = W.Window.partitionBy("__source").orderBy(at).rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
        over = rows.withColumn("sum", F.sum("b").over(line)).filter(F.col("sum") > F.col("rest"))
        return over.groupBy("__source").agg(F.min(at).alias(at), F.min_by(F.col("rest") - F.col("sum") + F.col("b"), at).alias("left"))

    group = ends(blocks.groupBy("__source", "group").agg(F.sum("b").alias("b"), F.first("rest").alias("rest")), "group")
    cut = ends(blocks.drop("rest").join(group.withColumnRenamed("left", "rest"), ["__source", "group"]), "place").withColumnRenamed("place", "__cut_place")
    inside = placed.select("__source", "place", "__g", "__tokens").join(cut.withColumnRenamed("__cut_place", "place"), ["__source", "place"])
    inside = inside.groupBy("__source", "__g").agg(F.sum("__tokens").alias("n"), F.first("left").alias("left"))
    by_hash = W.Window.partitionBy("__source").orderBy("__g").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    last = inside.withColumn("sum", F.sum("n").over(by_hash)).filter(F.col("sum") <= F.col("left")).groupBy("__source").agg(F.max("__g").alias("__cut_hash"))
    out = weighted.join(cut.drop("left"), "__source", "left").join(last, "__source", "left")
    out = out.select("__source", "__weight", "__blocks", "__passes", "__cut_place", F.coalesce("__cut_hash", F.lit(-1).cast("long")).alias("__cut_hash"))
    free = sums.filter("coalesce(t, 0) = 0").select("__source", F.lit(0.0).alias("__weight"), F.lit(1).cast("long").alias("__blocks"), F.lit(1).cast("long").alias("__passes"), F.lit(0).cast("long").alias("__cut_place"), F.lit(-1).cast("long").alias("__cut_hash"))
    return materialise(out.unionByName(free), "mix-plan")


def _place(h: Column, blocks: Column) -> Column:
    """The place of a row's block in its source's permuted order."""
    return ((h % blocks) * F.lit(STRIDE).cast("long") + F.lit(104_729).cast("long")) % blocks


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with __source, __h, __g and __tokens."""
    tokens = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select("*", F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__source"), _hash(id_col, 1).alias("__h"), _hash(id_col, 17).alias("__g"), tokens.alias("__tokens"))


def copies(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Rows of :func:`hashed` with their source's plan, __place and __copies.

    The plan has a row for each source; Spark broadcasts it while its size is under the session's threshold and otherwise
    joins by source with skewed sources split.
    """
    out = rows.join(planned, "__source").withColumn("__place", _place(F.col("__h"), F.col("__blocks")))
    more = (F.col("__place") < F.coalesce("__cut_place", F.col("__blocks"))) | ((F.col("__place") == F.col("__cut_place")) & (F.col("__g") <= F.col("__cut_hash")))
    return out.withColumn("__copies", F.col("__passes") + F.when(more, 1).otherwise(0))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **targets) -> DataFrame:
    """``docs`` with every row as often as the mix takes it."""
    names = docs.columns
    own = {c: f"c{k}" for k, c in enumerate(names)}
    rows = hashed(numbered(docs), own[id_col], own[text_col], own[source_col])
    narrow = materialise(rows.select("__source", "__h", "__g", "__tokens"), "mix-rows")
    taken = copies(rows.drop("__tokens"), plan(narrow, **targets))
    return renamed(taken.filter(F.col("__copies") > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))), names)
