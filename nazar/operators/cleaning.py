"""Cleaning and token pipelines (C15, C17–C24) over review tables.

The text work is a chain of built-in expressions inside one projection; the
only shuffles are the optional long-form (id, pos, token) joins against a
lexicon, which broadcast the (size-checked) lexicon side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nazar.functions import lexicons as LX
from nazar.functions import text as T
from nazar.operators.common import computed
from nazar.session import broadcast_lexicon


# ---------------------------------------------------------------- array form

def lemmatize_array(tokens, lemmas: Sequence[tuple[str, str]]) -> Column:
    """C19 (column form): dictionary lookup per token, identity when absent."""
    if not lemmas:
        return T._c(tokens)
    keys = [k for k, _ in lemmas]
    vals = [v for _, v in lemmas]
    m = F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[F.lit(v) for v in vals]))
    return F.transform(T._c(tokens), lambda t: F.coalesce(F.try_element_at(m, t), t))


def preprocess_tokens(text, level: str = "medium", stopwords: Sequence[str] | None = LX.DEFAULT_STOPWORDS,
                      stem_suffixes: Sequence[str] | None = None, lemmas: Sequence[tuple[str, str]] | None = None,
                      emoji_map: Sequence[tuple[str, str]] | None = LX.DEFAULT_EMOJI_MAP) -> Column:
    """C20: clean (C14) → tokenize (C16) → stopwords (C17) → lemma (C19) or stem.

    Lemmatisation and stemming are exclusive; lemmas win when both are given.
    """
    toks = T.tokenize(T.clean_text(text, level, emoji_map))
    if stopwords:
        toks = T.remove_stopwords(toks, stopwords)
    if lemmas:
        toks = lemmatize_array(toks, lemmas)
    elif stem_suffixes:
        toks = T.strip_suffixes(toks, stem_suffixes)
    return toks


def preprocess(df: DataFrame, text_col: str = "comment", as_string: bool = True, **kw) -> DataFrame:
    """C20 on a table: adds ``tokens`` (array) or ``processed`` (space-joined)."""
    toks = preprocess_tokens(F.col(text_col), **kw)
    if as_string:
        return df.withColumn("processed", F.array_join(toks, " "))
    return df.withColumn("tokens", toks)


def process_table(df: DataFrame, text_col: str = "comment", lo: int = 10, hi: int = 500, **kw) -> DataFrame:
    """``<col>_cleaned`` = processed text; rows outside lo..hi chars dropped."""
    out = computed(df, f"{text_col}_cleaned", F.array_join(preprocess_tokens(F.col(text_col), **kw), " "))
    return out.filter(T.valid_length(F.col(f"{text_col}_cleaned"), lo, hi))


def preprocess_comments(df: DataFrame, text_col: str = "comment", level: str = "medium", tokenize: bool = True,
                        min_len: int = 10, **kw) -> DataFrame:
    """Clean → drop empty → tokens → drop processed shorter than ``min_len``.

    Adds ``comment_cleaned`` and ``comment_processed`` (the text is cleaned
    once; the original cleaned it a second time, which is idempotent in intent).
    """
    emoji_map = kw.pop("emoji_map", LX.DEFAULT_EMOJI_MAP)
    cleaned = T.clean_text(F.col(text_col), level, emoji_map)
    out = computed(df, "comment_cleaned", cleaned).filter(F.length("comment_cleaned") > 0)
    if not tokenize:
        return out.withColumn("comment_processed", F.col("comment_cleaned"))
    toks = _tokens_from_cleaned(F.col("comment_cleaned"), **kw)
    out = computed(out, "comment_processed", F.array_join(toks, " "))
    return out.filter(F.length("comment_processed") >= min_len)


def _tokens_from_cleaned(cleaned: Column, stopwords=LX.DEFAULT_STOPWORDS, stem_suffixes=None, lemmas=None) -> Column:
    toks = T.tokenize(cleaned)
    if stopwords:
        toks = T.remove_stopwords(toks, stopwords)
    if lemmas:
        toks = lemmatize_array(toks, lemmas)
    elif stem_suffixes:
        toks = T.strip_suffixes(toks, stem_suffixes)
    return toks


VERSIONS = ("light", "medium", "heavy_stem", "heavy_lemma")


def versions(df: DataFrame, text_col: str = "comment", id_col: str = "id",
             stopwords: Sequence[str] = LX.DEFAULT_STOPWORDS, suffixes: Sequence[str] = LX.DEFAULT_SUFFIXES,
             lemmas: Sequence[tuple[str, str]] = LX.DEFAULT_LEMMAS,
             emoji_map: Sequence[tuple[str, str]] = LX.DEFAULT_EMOJI_MAP, min_len: int = 10,
             keep: Sequence[str] = ()) -> DataFrame:
    """The four preprocessing versions from one scan.

    One projection computes the three cleaning levels; ``inline`` stacks the
    four versions as rows (version, comment_cleaned, comment_processed, kept);
    no data is re-read per version.  ``kept`` applies each version's filter.
    """
    t = F.col(text_col)
    # shared prefix (whitespace → urls → emails → phones → mentions) materialised once
    pre = df.select(F.col(id_col), *[F.col(k) for k in keep], T.normalize_whitespace(t).alias("_w"))
    pre = pre.withColumn("_p", T.remove_mentions_hashtags(T.remove_phones(T.remove_emails(T.remove_urls(F.col("_w"))))))
    base = pre.select(F.col(id_col), *[F.col(k) for k in keep],
                      T.clean_finish(F.col("_w"), emoji_map).alias("_l"),
                      T.clean_finish(F.col("_p"), emoji_map).alias("_m"),
                      T.clean_finish(T.remove_english_runs(F.col("_p")), emoji_map).alias("_h"))
    # the heavy tokens are stemmed and lemmatised; each processed text is a column, as the rows read it twice
    toks = base.withColumn("_mp", F.array_join(_tokens_from_cleaned(F.col("_m"), stopwords), " ")) \
               .withColumn("_ht", _tokens_from_cleaned(F.col("_h"), stopwords))
    base = toks.withColumn("_sp", F.array_join(T.strip_suffixes("_ht", suffixes) if suffixes else F.col("_ht"), " ")) \
               .withColumn("_lp", F.array_join(lemmatize_array("_ht", lemmas), " ")).drop("_ht")
    med_p, stem_p, lem_p = F.col("_mp"), F.col("_sp"), F.col("_lp")

    def row(v, cleaned, processed, kept):
        return F.struct(F.lit(v).alias("version"), cleaned.alias("comment_cleaned"),
                        processed.alias("comment_processed"), kept.alias("kept"))

    def ok(cleaned, processed):
        return (F.length(cleaned) > 0) & (F.length(processed) >= min_len)

    rows = F.array(
        row("light", F.col("_l"), F.col("_l"), F.length("_l") > 0),
        row("medium", F.col("_m"), med_p, ok(F.col("_m"), med_p)),
        row("heavy_stem", F.col("_h"), stem_p, ok(F.col("_h"), stem_p)),
        row("heavy_lemma", F.col("_h"), lem_p, ok(F.col("_h"), lem_p)))
    return base.select(F.col(id_col), *[F.col(k) for k in keep], F.inline(rows))


def preprocessing_summary(stacked: DataFrame) -> DataFrame:
    """Per version input / output / filtered counts and success rate."""
    agg = stacked.groupBy("version").agg(F.count(F.lit(1)).alias("input_comments"),
                                         F.sum(F.col("kept").cast("int")).cast("bigint").alias("output_comments"))
    return agg.select("version", "input_comments", "output_comments",
                      (F.col("input_comments") - F.col("output_comments")).alias("filtered_comments"),
                      F.when(F.col("input_comments") > 0, F.col("output_comments") / F.col("input_comments"))
                       .otherwise(0.0).alias("success_rate"))


def cleaning_stats(df: DataFrame, text_col: str = "comment", level: str = "medium",
                   emoji_map=LX.DEFAULT_EMOJI_MAP, stopwords=LX.DEFAULT_STOPWORDS,
                   suffixes=LX.DEFAULT_SUFFIXES) -> DataFrame:
    """Per rule, how many texts it changed (and emoji/stopword/stem counts).

    One aggregate over the table; each rule is evaluated on the output of
    the previous one, as in the cleaning order.
    """
    t = F.col(text_col)
    # every stage is materialised as a column, so no rule runs twice
    st = df.select(t.alias("_t"), (t.isNull() | (F.length(T.py_strip(t)) == 0)).alias("_blank"),
                   T.normalize_whitespace(t).alias("_x0"))
    st = st.withColumn("_x1", T.remove_urls(F.col("_x0"))).withColumn("_x2", T.remove_emails(F.col("_x1"))) \
           .withColumn("_x3", T.remove_phones(F.col("_x2")))
    st = st.withColumn("_x4", T.remove_mentions_hashtags(F.col("_x3")) if level != "light" else F.col("_x0"))
    if level == "heavy":
        st = st.withColumn("_x4", T.remove_english(F.col("_x4")))
    st = st.withColumn("_conv", T.convert_emojis_counted(F.col("_x4"), emoji_map))
    st = st.withColumn("_clean", T.clean_finish(F.col("_x4"), emoji_map))
    st = st.withColumn("_toks", T.tokenize(F.col("_clean")))
    st = st.withColumn("_kept", T.remove_stopwords(F.col("_toks"), stopwords))
    st = st.withColumn("_stem", T.strip_suffixes(F.col("_kept"), suffixes))
    blank = F.col("_blank")
    n_changed = F.size(F.filter(F.arrays_zip(F.col("_kept").alias("a"), F.col("_stem").alias("b")),
                                lambda z: z["a"] != z["b"]))

    def changed(a, b):
        return F.sum(F.when(~blank & (F.length(a) != F.length(b)), 1).otherwise(0)).cast("bigint")

    aggs = [F.count(F.lit(1)).alias("n_texts")]
    if level in ("medium", "heavy"):
        aggs += [changed(F.col("_x0"), F.col("_x1")).alias("removed_urls"),
                 changed(F.col("_x1"), F.col("_x2")).alias("removed_emails"),
                 changed(F.col("_x2"), F.col("_x3")).alias("removed_phone_numbers")]
    else:
        aggs += [F.lit(0).cast("bigint").alias(c) for c in ("removed_urls", "removed_emails", "removed_phone_numbers")]
    aggs += [
        F.sum(F.when(~blank, F.col("_conv")["n_emoji"]).otherwise(0)).cast("bigint").alias("converted_emojis"),
        F.sum(F.when(~blank & (F.col("_clean") != F.col("_t")), 1).otherwise(0)).cast("bigint").alias("processed_texts"),
        F.sum(F.when(~blank, F.size("_toks") - F.size("_kept")).otherwise(0)).cast("bigint").alias("removed_stopwords"),
        F.sum(F.when(~blank, n_changed).otherwise(0)).cast("bigint").alias("stemmed_words"),
    ]
    return st.agg(*aggs)


# ---------------------------------------------------------------- long form

def explode_tokens(df: DataFrame, tokens_col: str = "tokens", id_col: str = "id") -> DataFrame:
    """(id, pos, token) — the inverted-index friendly layout."""
    out = df.select(F.col(id_col), F.posexplode_outer(tokens_col).alias("pos", "token"))
    return out.filter(F.col("pos").isNotNull())  # outer form: see tfidf.term_frequencies


def remove_stopwords_long(tokens: DataFrame, stopwords: DataFrame) -> DataFrame:
    """C17 (long form): anti join with a stopword table, case-folded; the
    lexicon side is broadcast after a size check."""
    sw = broadcast_lexicon(stopwords.select(F.lower(F.col("word")).alias("_w")).distinct())
    return tokens.join(sw, F.lower(tokens.token) == sw._w, "left_anti")


def lemmatize_tokens(tokens: DataFrame, lemma_table: DataFrame) -> DataFrame:
    """C19 (long form): left join to (form, lemma), identity when absent."""
    lt = broadcast_lexicon(lemma_table.select(F.col("form").alias("_f"), F.col("lemma").alias("_l")))
    j = tokens.join(lt, tokens.token == lt._f, "left")
    return j.select(*[c for c in tokens.columns if c != "token"], F.coalesce("_l", "token").alias("token"))


MAX_SUFFIXES = 10_000


def stem_tokens(tokens: DataFrame, suffix_table: DataFrame | Sequence[str], min_stem: int = 2) -> DataFrame:
    """C18 (long form): longest listed suffix stripped from every token.

    The suffix table is a parameter (a language's inflections): every row of it
    is read and compiled into a single regular expression; a table of more than
    MAX_SUFFIXES is refused, as it is no list of inflections.
    """
    if isinstance(suffix_table, DataFrame):
        rows = suffix_table.select("suffix").distinct().limit(MAX_SUFFIXES + 1).collect()
        if len(rows) > MAX_SUFFIXES:
            raise ValueError(f"more than {MAX_SUFFIXES} suffixes")
        suffixes = [r[0] for r in rows]
    else:
        suffixes = list(suffix_table)
    arr = T.strip_suffixes(F.array(F.col("token")), suffixes, min_stem)
    return tokens.withColumn("token", arr[0])


def tokens_to_arrays(tokens: DataFrame, id_col: str = "id") -> DataFrame:
    """Back to one ordered array per document (a shuffle on id)."""
    g = tokens.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_t"))
    return g.select(id_col, F.transform("_t", lambda s: s["token"]).alias("tokens"))
