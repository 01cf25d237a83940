"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's target gives each of its documents the same expected number of copies: a whole part
and a fractional probability.  Fractions are paired; a random transfer of words between the two
moves one of them to 0 or 1, keeps the pair's expected words, and so keeps the source's words
on target.  Documents are dealt into small groups of one source by a hash; each group is folded
to one open document, and the open ones climb a reduction tree until one is left a source, which
is rounded at random.  All randomness is a hash of the seed and the pair, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nazar.llm import tables
from nazar.operators.common import global_row_number

#: A word of a text.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words, and the most a document may be repeated.
BUDGET, MOST = 1.5, 2.0
#: Documents folded together in one group of the tree (expected number).
FAN = 32
#: Sources up to which the table of sources is broadcast; beyond it the join shuffles.
BROADCAST_SOURCES = 100_000
SEED = 17


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_level(sources: DataFrame, budget: float, most: float) -> tuple[float, int]:
    """(words a unit of weight gets, number of sources): sources above ``most`` times their size
    stop there and the excess is reshared by weight among the others until none is above.
    Each round is one aggregate over the sources; only its sums reach the driver."""
    size, weight = F.col("source_size").cast("double"), F.col("weight")
    total = sources.agg(F.sum(size), F.sum(weight), F.count("*")).first()
    if not total[2] or not total[0]:
        return 0.0, total[2]
    level = budget * total[0] / total[1]
    while True:
        over = most * size < level * weight
        stopped, still = sources.agg(F.sum(F.when(over, most * size).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(weight))).first()
        if not still:
            return level, total[2]
        raised = (budget * total[0] - stopped) / still
        if not raised > level:
            return level, total[2]
        level = raised


def _uniform(*cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def _fold(group: Column, level: int, seed: int) -> Column:
    """Fold an array of open documents (key, size, p) to struct(open, done: array of settled)."""
    settled = lambda x, up: F.struct(x["key"].alias("key"), F.lit(up).alias("up"))

    def step(state: Column, new: Column) -> Column:
        cur = state["open"]
        a, b, x, y = cur["size"], new["size"], cur["p"], new["p"]
        gain, loss = F.least(a * (1 - x), b * y), F.least(a * x, b * (1 - y))
        up = _uniform(F.lit(seed), F.lit(level), cur["key"], new["key"]) * (gain + loss) < loss
        left = lambda doc, p: F.struct(doc["key"].alias("key"), doc["size"].alias("size"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"))
        pair = lambda opened, done: F.struct(opened.alias("open"), F.concat(state["done"], F.array(done)).alias("done"))
        raised = F.when(a * (1 - x) <= b * y, pair(left(new, y - a * (1 - x) / b), settled(cur, 1))).otherwise(pair(left(cur, x + b * y / a), settled(new, 0)))
        lowered = F.when(a * x <= b * (1 - y), pair(left(new, y + a * x / b), settled(cur, 0))).otherwise(pair(left(cur, x - b * (1 - y) / a), settled(new, 1)))
        return F.when(up, raised).otherwise(lowered)

    none = F.filter(F.transform(F.slice(group, 1, 1), lambda e: settled(e, 0)), lambda e: F.lit(False))
    start = F.struct(F.element_at(group, 1).alias("open"), none.alias("done"))
    return F.aggregate(F.slice(group, 2, F.greatest(F.size(group) - 1, F.lit(0))), start, step)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row a document of ``docs``
    (columns doc_id, source, text; others are not read).

    A null text has no words.  Null sources are one source, the last; null and repeated ids are
    documents of their own (equal rows of one source, id and size are numbered).  A document
    without words is never taken.  An empty table gives an empty result.
    """
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"))
    rows = tables.save(sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("m")))
    per = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("docs"))
    per = global_row_number(per.withColumn("null_last", F.col("source").isNull()), ["null_last", "source"], "place")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    per = tables.save(per.withColumn("weight", F.element_at(turn, (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))))
    level, n_sources = water_level(per, budget, most)
    n_docs = per.agg(F.sum("docs")).first()[0] or 0

    target = F.least(F.lit(level) * F.col("weight"), F.lit(most) * F.col("source_size"))
    per = per.select(F.col("source").alias("s"), "source_size", target.alias("target"))
    per = F.broadcast(per) if n_sources <= BROADCAST_SOURCES else per
    whole = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    all_docs = (rows.join(per, rows["source"].eqNullSafe(per["s"])).drop("s")
                .withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))).drop("m")
                .withColumn("base", F.floor(whole)).withColumn("p", whole - F.floor(whole)))
    key = F.struct(F.xxhash64(F.lit(seed), "doc_id", "size", "nth", "source").alias("h"), "doc_id", "size", "nth", "source")
    bits = max(0, math.ceil(math.log2(max(1, n_docs / FAN))))
    is_open = (F.col("size") > 0) & (F.col("p") > 0)
    all_docs = tables.save(all_docs.withColumn("key", key))

    # leaves: groups of one source and one slice of the hash; each level joins 2^5 slices
    alive = all_docs.where(is_open).select("key", F.col("size").cast("double").alias("size"), "p")
    settled = []
    step = int(math.log2(FAN))
    depth = 0
    while True:
        slice_ = F.shiftrightunsigned(F.col("key.h"), 64 - bits) if bits else F.lit(0).cast("long")
        folded = (alive.groupBy(F.col("key.source").alias("source"), slice_.alias("slice"))
                  .agg(F.sort_array(F.collect_list(F.struct("key", "size", "p"))).alias("g"))
                  .select(_fold(F.col("g"), depth, seed).alias("f")))
        folded = tables.save(folded)
        settled.append(folded.select(F.inline("f.done")))
        alive = folded.select("f.open.*")
        if bits == 0:
            break
        bits, depth = max(0, bits - step), depth + 1
    last = _uniform(F.lit(seed), F.lit(-1), F.col("key")) < F.col("p")
    done = alive.select("key", last.cast("int").alias("up"))
    for part in settled:
        done = done.unionByName(part)
    kept = all_docs.join(done.select(F.col("key").alias("k"), "up"), F.col("key").eqNullSafe(F.col("k")), "left")
    copies = F.col("base") + F.coalesce("up", F.lit(0))
    return kept.select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"),
                       copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def op1(spark, sf_dir: str) -> DataFrame:
    return mix(tables.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
