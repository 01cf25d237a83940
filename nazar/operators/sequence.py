"""Sequence preparation (I1–I5): word index, id sequences, vector sequences, label codes.

Sequences are truncated *before* any join (only positions < max_len are
exploded), so the re-assembly per document is bounded by max_len rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nazar.operators.common import global_row_number
from nazar.session import broadcast_if_small

PAD, UNK = 0, 1


def build_word_index(tokens: DataFrame, tokens_col: str = "tokens", min_freq: int = 2) -> DataFrame:
    """(word, idx, freq): PAD 0, UNK 1, words with freq ≥ min_freq from 2
    in (freq desc, word) order.  Numbered with distributed row numbers."""
    words = tokens.select(F.explode_outer(tokens_col).alias("word")).filter(F.col("word").isNotNull())
    c = words.groupBy("word").agg(F.count(F.lit(1)).alias("freq")).filter(F.col("freq") >= min_freq)
    c = c.withColumn("_negf", -F.col("freq"))
    idx = global_row_number(c, ["_negf", "word"], "_rn").select(
        "word", (F.col("_rn") + 1).cast("int").alias("idx"), "freq")
    spark = tokens.sparkSession
    special = spark.createDataFrame([("<PAD>", PAD, 0), ("<UNK>", UNK, 0)], "word string, idx int, freq bigint")
    return special.unionByName(idx)


def encode_sequences(docs: DataFrame, index: DataFrame, tokens_col: str = "tokens", id_col: str = "id",
                     max_len: int = 128) -> DataFrame:
    """(id, ids array<int> of length max_len, length): UNK for unknown words,
    truncated, right-padded with PAD; length = min(tokens, max_len)."""
    # a document without tokens keeps a row of nulls, so the documents are read, and cleaned, once
    ex = docs.select(id_col, F.posexplode_outer(F.slice(tokens_col, 1, max_len)).alias("pos", "word"))
    ix = broadcast_if_small(index.select("word", "idx"))
    j = ex.join(ix, "word", "left").select(id_col, "pos", F.coalesce("idx", F.lit(UNK)).alias("idx"))
    g = j.groupBy(id_col).agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "idx")))).alias("_s"))
    g = g.select(id_col, F.transform("_s", lambda s: s["idx"]).alias("ids"))
    return g.select(id_col, F.concat("ids", F.array_repeat(F.lit(PAD), F.lit(max_len) - F.size("ids"))).alias("ids"), F.size("ids").alias("length"))


def embedding_coverage(index: DataFrame, vectors: DataFrame) -> DataFrame:
    """Words of the index with a vector / index size (PAD and UNK counted)."""
    j = index.join(vectors.select("word", F.lit(1).alias("_has")), "word", "left")
    return j.agg(F.count(F.lit(1)).alias("vocab_size"), F.count("_has").alias("found")) \
            .withColumn("coverage", F.col("found") / F.col("vocab_size"))


def sequence_vectors(docs: DataFrame, vectors: DataFrame, dim: int, tokens_col: str = "tokens", id_col: str = "id",
                     max_len: int = 100) -> DataFrame:
    """I4: (id, pos, vec) for every position < max_len: the word's vector, or
    zeros for unknown words and padding."""
    ex = (docs.select(id_col, F.posexplode_outer(tokens_col).alias("pos", "word"))
              .filter(F.col("pos").isNotNull() & (F.col("pos") < max_len)))
    vec = broadcast_if_small(vectors.select("word", "vec"))
    zeros = F.array_repeat(F.lit(0.0), dim)
    known = ex.join(vec, "word", "left").select(id_col, "pos", F.coalesce("vec", zeros).alias("vec"))
    n = docs.select(id_col, F.least(F.size(tokens_col), F.lit(max_len)).alias("_n"))
    pads = n.filter(F.col("_n") < max_len).select(
        id_col, F.explode(F.sequence(F.col("_n"), F.lit(max_len - 1))).alias("pos")).select(
        id_col, F.col("pos").cast("int").alias("pos"), zeros.alias("vec"))
    return known.unionByName(pads)


def encode_labels(df: DataFrame, label_col: str = "sentiment_label", mapping: dict[str, int] | None = None) -> DataFrame:
    """Alphabetical code of every distinct label (or a fixed map; null for a label outside it)."""
    if mapping:
        m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
        return df.withColumn("label_code", F.try_element_at(m, F.col(label_col)).cast("int"))
    codes = df.select(label_col).distinct()
    from pyspark.sql import Window as W
    codes = codes.withColumn("label_code", (F.dense_rank().over(W.orderBy(label_col)) - 1).cast("int"))  # ≤ K rows
    return df.join(F.broadcast(codes), label_col)
