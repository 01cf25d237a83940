"""Divergence audit of sources, by one-hot level products.

The documents of a language and source are a group; its prices are smoothed shares of the
language's kept terms.  Two groups differ by the sum of f(p, q) over all kept terms, and p
depends on the count of the term alone, its level in the group.  So the joint table of two
groups' levels prices the pair: each cell is priced once, by the number of terms in it.  The
tables come from indicator matrices: a block of terms has a column for each (group, level) that
occurs in it, and the matrix's transpose times the matrix holds the joint tables of all pairs of
groups at once, exact small integers.  Level 0 gets no column: what the level products leave
of a group's level totals are the terms that the other group does not have.

Terms are dealt into blocks by the order of magnitude of their count, so rare terms, with few
levels, fill tall blocks of few columns, and frequent ones short blocks.  Groups of a language
are cut into blocks too, and every two blocks meet; a task holds one product at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nazar.llm import tables

#: A term: letters A-Z and what is not ASCII, A-Z lowered.  Every byte of a code point that is
#: not ASCII is 0x80 or above, so lowered UTF-8 bytes have the same terms.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Documents of its language that a kept term occurs in.
MIN_DOCS = 10
SCALE, SMOOTH = 1_000_000_000, 2
#: Ranks of terms for each group.
TOP = 10
#: (group, term) entries a task holds before it passes them on.
HELD = 400_000
#: Groups of one block, columns of a matrix (about), and terms of a block of rare terms.
GROUPS, COLUMNS, TERMS = 64, 512, 4_096
#: Rows of one task of the products, and level totals of one task of the other sums.
TASK_ROWS, LEVEL_ROWS = 60_000, 20_000


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n, total: occurrences of kept terms in groups that have them, and in
    the language; lang, v, total: kept terms of each language that has some)."""
    src = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def passed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, in_docs) in held.items():
                n = len(times)
                cols = [pa.repeat(lang, n), pa.repeat(source, n), pa.array(list(times), pa.binary()).cast(pa.string()),
                        pa.array(list(times.values()), pa.int64()), pa.array([in_docs[t] for t in times], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                terms = TERM.findall(text.lower())  # of bytes: A-Z only
                times, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                times.update(terms)
                in_docs.update(set(terms))
            if sum(len(x[0]) for x in held.values()) > HELD:
                yield from passed()
        yield from passed()

    parts = tables.spread_out(src).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    counts = tables.save(parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    kept = tables.save(kept)
    per = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("total"))
    return tables.save(counts.drop("docs").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total")), per


def price(n: Column, all_: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / all_), exactly, for any counts."""
    wide = (n + F.lit(SMOOTH)).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide, all_.cast("decimal(19,0)"))


def apart(p, q):
    """floor((p - q)^2 / (p + q)) of columns or arrays of long values."""
    if isinstance(p, Column):
        return F.call_function("div", (p - q) * (p - q), p + q)
    return (p - q) * (p - q) // (p + q)


def groups_of(docs: DataFrame, counts: DataFrame, per_lang: DataFrame) -> DataFrame:
    """gid, lang, source, v, weight and lang_weight (what counts are divided by), zero (the price
    of a term it does not have; null if no term is kept), present (kept terms it has)."""
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    held = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("present"))
    both = own.join(per_lang, "lang", "left").join(held, ["lang", "source"], "left").na.fill(0, ["v", "total", "n", "present"])
    both = both.withColumn("weight", F.col("n") + SMOOTH * F.col("v")).withColumn("lang_weight", F.col("total") + SMOOTH * F.col("v"))
    zero = F.when(F.col("v") > 0, price(F.lit(0).cast("long"), F.col("weight")))
    return tables.save(both.select(F.monotonically_increasing_id().alias("gid"), "lang", "source", "v", "weight", "lang_weight", zero.alias("zero"), "present"))


def top_terms(priced: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value, rank: the terms that a group has and prices above its language."""
    q = price(F.col("total"), F.col("lang_weight"))
    over = priced.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return over.withColumn("rank", rank).where(F.col("rank") <= top)


def _summed(a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pd.DataFrame:
    """a, b, value: the values added up for each pair (a, b)."""
    order = np.lexsort((b, a))
    a, b, value = a[order], b[order], value[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    return pd.DataFrame({"a": a[first], "b": b[first], "value": np.add.reduceat(value, first) if len(a) else value})


def indicators(term: np.ndarray, n_terms: int, group: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms x columns, 1 where the term has the column's level in the column's group; an entry
    of each column).  Columns are the (group, level) that occur."""
    if not len(term):
        return np.zeros((n_terms, 0), dtype=np.float32), term
    _, entry, column = np.unique(np.column_stack([group, level]), axis=0, return_index=True, return_inverse=True)
    grid = np.zeros((n_terms, len(entry)), dtype=np.float32)  # products are exact below 2 ** 24
    grid[term, column.ravel()] = 1
    return grid, entry


def joint_sums(same: bool, term: np.ndarray, side: np.ndarray, gid: np.ndarray, level: np.ndarray, p: np.ndarray, zero: np.ndarray) -> tuple[np.ndarray, ...]:
    """(group, group, value) for the entries of one block of terms, side 0 against side 1 (or
    itself, if both are the same block of groups): the priced joint tables of levels above 0.  A
    cell is worth what it adds to the sums that take the terms of either group alone."""
    n_terms = int(term.max()) + 1
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1))
    grid, at = indicators(term[one], n_terms, gid[one], level[one])
    other, to = (grid, at) if same else indicators(term[two], n_terms, gid[two], level[two])
    table = grid.T @ other
    i, j = np.nonzero(table)
    many = table[i, j].astype(np.int64)
    x, y = one[at][i], two[to][j]
    fresh = gid[x] < gid[y] if same else np.ones(len(x), dtype=bool)
    x, y, many = x[fresh], y[fresh], many[fresh]
    worth = apart(p[x], p[y]) - apart(p[x], zero[y]) - apart(zero[x], p[y]) + apart(zero[x], zero[y])
    return np.minimum(gid[x], gid[y]), np.maximum(gid[x], gid[y]), worth * many


def level_products(priced: DataFrame, groups: DataFrame) -> DataFrame:
    """a, b, value: sums of ``joint_sums`` over the tasks, for pairs of groups that share terms."""
    per = groups.groupBy("lang").agg(F.count("*").alias("s"))
    band = F.floor(F.log2(F.col("total").cast("double"))).cast("int")
    rows = priced.select("lang", "term", band.alias("band"), "gid", "source", "n", "p", "zero")
    terms = rows.groupBy("lang", "band").agg(F.count_distinct("term").alias("terms"))
    width = F.least(F.col("s"), F.lit(GROUPS))
    tall = F.when(width * F.pow(F.lit(2.0), F.col("band") + 1) <= COLUMNS, TERMS).otherwise(F.greatest(F.lit(1), F.floor(F.lit(COLUMNS) / width)))
    sizes = terms.join(per, "lang").select("lang", "band", F.ceil(F.col("terms") / tall).alias("blocks"), F.ceil(F.col("s") / GROUPS).cast("int").alias("of"))
    rows = rows.join(sizes, ["lang", "band"])
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("term"), "blocks")).withColumn("own", F.pmod(F.xxhash64("source"), "of").cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    block = ["lang", "band", "slice", "i", "j"]
    side = (F.col("own") > F.col("with")).cast("int")
    rows = tables.save(rows.select("lang", "band", "slice", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), side.alias("side"), "term", "gid", "n", "p", "zero"))
    tasks = max(1, -(-rows.count() // TASK_ROWS))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held = [(np.zeros(0, np.int64),) * 3]
        for at, x in pdf.groupby(block, sort=False):
            cols = [x[c].to_numpy() for c in ("side", "gid", "n", "p", "zero")]
            held.append(joint_sums(at[-2] == at[-1], pd.factorize(x["term"])[0], *cols))
        return _summed(*[np.concatenate(c) for c in zip(*held, strict=True)])

    task = F.pmod(F.xxhash64(*block), F.lit(tasks)).alias("task")
    return rows.groupBy(task).applyInPandas(run, "a long, b long, value long")


def single_sums(priced: DataFrame, groups: DataFrame) -> DataFrame:
    """a, b, value for all pairs of groups of a language: the terms of either group against the
    other's price of level 0, from the totals of its levels, and the terms that neither has."""
    levels = priced.groupBy("lang", "gid", "source", "n", "p").agg(F.count("*").alias("terms"))
    per = groups.groupBy("lang").agg(F.ceil(F.count("*") / GROUPS).cast("int").alias("of"))
    cuts = levels.groupBy("lang").agg(F.ceil(F.count("*") / LEVEL_ROWS).cast("int").alias("cuts"))
    per = per.join(cuts, "lang", "left").na.fill(1, ["cuts"])
    block = F.pmod(F.xxhash64("source"), "of").cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    levels = levels.join(per, "lang").select("lang", block.alias("i"), upto("of").alias("j"), F.pmod(F.xxhash64("gid", "n"), "cuts").cast("int").alias("cut"), "gid", "p", "terms")
    own = groups.join(per, "lang").withColumn("cut", upto("cuts")).withColumn("with", upto("of")).withColumn("own", block)
    cols = ["cut", "gid", "v", "zero", "present"]
    ends = own.select("lang", F.col("own").alias("i"), F.col("with").alias("j"), F.lit(0).alias("side"), *cols)
    ends = ends.unionByName(own.select("lang", F.col("with").alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), *cols))

    def run(found: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        one, two = (ends[ends["side"] == k] for k in (0, 1))
        if not len(one) or not len(two):
            return pd.DataFrame({"a": [], "b": [], "value": []}).astype("int64")
        ids, others = one["gid"].to_numpy(), two["gid"].to_numpy()
        total = np.zeros((len(ids), len(others)), dtype=np.int64)
        if one["v"].iloc[0]:
            zero = two["zero"].to_numpy().astype(np.int64)
            order = np.argsort(ids)
            at = order[np.searchsorted(ids[order], found["gid"].to_numpy())]
            for lo in range(0, len(found), 4_096):
                some = slice(lo, lo + 4_096)
                p, many = found["p"].to_numpy()[some, None], found["terms"].to_numpy()[some, None]
                np.add.at(total, at[some], apart(p, zero[None]) * many)
            if ends["cut"].iloc[0] == 0:
                none = int(one["v"].iloc[0]) - one["present"].to_numpy()[:, None] - two["present"].to_numpy()[None]
                both = apart(one["zero"].to_numpy().astype(np.int64)[:, None], zero[None]) * none
                total += np.where(ids[:, None] < others[None], both, 0)
        g, h = np.nonzero(ids[:, None] != others[None])
        return pd.DataFrame({"a": np.minimum(ids[g], others[h]), "b": np.maximum(ids[g], others[h]), "value": total[g, h]})

    key = ["lang", "i", "j", "cut"]
    return levels.groupBy(*key).cogroup(ends.groupBy(*key)).applyInPandas(run, "a long, b long, value long")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank (columns lang, source and text are read).

    Part ``pair``: all other sources of the group's language; part ``term``: the kept terms that
    most set the group above its language.  Null texts, languages and sources are ''; equal rows
    are documents of their own.  A group without terms is in every pair; where a language keeps
    no term, pairs are 0.  Equal values rank by the item's UTF-8.  An empty table gives an empty
    result, and so does a language with one source, in part ``pair``.
    """
    tables.small_batches(docs.sparkSession)
    counts, per_lang = term_counts(docs, min_docs)
    groups = groups_of(docs, counts, per_lang)
    priced = counts.join(groups.select("lang", "source", "gid", "weight", "lang_weight", "zero"), ["lang", "source"])
    priced = tables.save(priced.withColumn("p", price(F.col("n"), F.col("weight"))))
    sums = level_products(priced, groups).unionByName(single_sums(priced, groups))
    sums = tables.save(sums.groupBy("a", "b").agg(F.sum("value").alias("value")))
    ordered = sums.select(F.col("a").alias("gid"), F.col("b").alias("other"), "value").unionByName(sums.select(F.col("b").alias("gid"), F.col("a").alias("other"), "value"))
    names = groups.select("gid", "lang", "source")
    pairs = ordered.join(names, "gid").join(groups.select(F.col("gid").alias("other"), F.col("source").alias("item")), "other")
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    terms = top_terms(priced, top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)


def op11(spark, sf_dir: str) -> DataFrame:
    return audit(tables.table(spark, sf_dir, "documents"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT id, lang, source, unnest({_TERMS}) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {MIN_DOCS}),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(total) AS nl FROM k GROUP BY lang),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n,
    1 + (CAST({SCALE} AS HUGEINT) * (coalesce(c.n, 0) + 2)) // (gn.n + 2 * l.v) AS p,
    1 + (CAST({SCALE} AS HUGEINT) * (k.total + 2)) // (l.nl + 2 * l.v) AS q
  FROM gn JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR rank <= {TOP}"""
