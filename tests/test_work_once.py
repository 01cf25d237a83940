"""Texts are cleaned once and cross no network that they need not; the faster rules match as the plain ones."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from nazar.functions import patterns as P
from nazar.functions import text as T
from nazar.operators import cleaning as C
from nazar.operators import design as DS
from nazar.operators import tfidf as TF
from nazar.operators import vectors as V


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(3)
    signs = [*"ab9@#.: /-_%+0é٣كي٥👍😂  \t\n\x1c\x85!?A ", "http://", "@b.co", "0912345678901", "a@b.co_x@d.com", "  "]
    rows = [(i, "".join(r.choice(signs) for _ in range(r.randint(0, 40)))) for i in range(3000)] + [(3000, None)]
    return spark.createDataFrame(rows, "id long, comment string").checkpoint()


def test_guarded_rules_match_as_the_plain_patterns(texts):
    c = F.col("comment")
    plain = {"ws": (T.normalize_whitespace(c), F.trim(F.regexp_replace(c, P.WS + "+", " "))),
             "urls": (T.remove_urls(c), F.regexp_replace(c, P.URL, " ")),
             "emails": (T.remove_emails(c), F.regexp_replace(c, P.EMAIL, " ")),
             "phones": (T.remove_phones(c), F.regexp_replace(c, P.PHONE, " ")),
             "mentions": (T.remove_mentions_hashtags(c), F.regexp_replace(F.regexp_replace(c, P.MENTION, " "), P.HASHTAG, " ")),
             "persian": (T.normalize_persian(c), T.remove_diacritics(T.normalize_digits(T.normalize_chars(c))))}
    same = texts.agg(*[F.min(a.eqNullSafe(b)).alias(k) for k, (a, b) in plain.items()]).first().asDict()
    assert all(same.values()), same


def test_email_rule_is_not_quadratic(spark):
    """A run of name characters is read once, not from each of its letters."""
    assert P.EMAIL_JAVA.startswith(r"(?i)(?:\G|(?<!")
    long = spark.range(1).select(F.concat(F.repeat(F.lit("a"), 300_000), F.lit(" x@y.org")).alias("t"))
    assert long.select(F.length(T.remove_emails("t"))).first()[0] == 300_002


def test_texts_are_cleaned_once(spark, texts):
    df = texts.select("id", F.upper("comment").alias("comment"))
    cleaned = plan(C.preprocess_comments(df))
    assert cleaned.count("://") <= 2, cleaned  # the URL rule: its mark and its pattern
    tokens = df.select("id", C.preprocess_tokens(F.col("comment")).alias("tokens"))
    assert plan(V.sentences(tokens)).count("://") <= 2


def test_sentences_of_short_empty_and_null_arrays(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["z"]), (3, []), (4, None), (5, ["c", None])], "id int, tokens array<string>")
    assert tuple(V.sentences(docs).first()) == (4, 3, 2, 2.5)
    assert tuple(V.sentences(docs.filter("id = 2")).first()) == (0, 0, 0, None)


def test_a_vocabulary_alone_shuffles_no_documents(spark, texts):
    docs = texts.select("id", T.split_ws("comment").alias("terms"))
    vocab, weights = TF.fit_tfidf(docs, weigh=False)
    assert weights is None and "Repartition" not in plan(vocab)
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(vocab) == key(TF.fit_tfidf(docs)[0])


@pytest.mark.parametrize("how", ["average", "sum", "max"])
def test_document_vectors_by_matrix_and_by_join(spark, monkeypatch, how):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(20)]
    vecs = [(w, rng.normal(size=3).tolist()) for w in [*words, "w3"]] + [("none", None)]  # w3 has two vectors
    docs = [(i, [words[j] for j in rng.integers(0, 20, 5)] + ["other", None, "none"]) for i in range(30)]
    docs += [(7, ["w3", "w1"]), (None, ["w1"]), (40, []), (41, None), (42, ["other"])]  # ids may come twice or be null
    d = spark.createDataFrame(docs, "id long, tokens array<string>")
    v = spark.createDataFrame(vecs, "word string, vec array<double>")
    key = lambda df: sorted(((r.id is None, r.id or 0, None if r.doc_vec is None else np.round(r.doc_vec, 9).tolist()) for r in df.collect()), key=str)
    sent = V.doc_vector(d, v, how)
    assert "explode" not in plan(sent)
    got = key(sent)
    monkeypatch.setattr(V, "SHARED_NUMBERS", 0)
    assert got == key(V.doc_vector(d, v, how))
    monkeypatch.undo()
    assert all(x[2] is None for x in key(V.doc_vector(d, v.limit(0), how)))


def test_word_vectors_are_read_not_held(spark):
    docs = spark.createDataFrame([(["a", "b", "c", "a"],)] * 6, "tokens array<string>")
    model, vecs = V.train_word2vec(docs, dim=4, max_iter=1, min_count=1)
    assert "LocalRelation" not in plan(vecs)
    own = {r.word: r.vector.toArray() for r in model.getVectors().collect()}
    assert {r.word for r in vecs.collect()} == set(own) == {"a", "b", "c"}
    assert all(np.allclose(r.vec, own[r.word]) for r in vecs.collect())


def test_vocabulary_bounds_are_counts_and_terms_are_dropped(spark):
    rows = [(i, f"alpha beta{i % 3} gamma{i % 2}", float(i % 2), 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, text string, label_d double, weight double")
    model, seen = DS.fitted(DS.stages(("tfidf", "ngrams")), df)
    tf = next(s for s in model.stages if hasattr(s, "vocabulary"))
    assert tf.getMaxDF() == 16.0  # a share of 0.8 would keep all documents' terms in memory
    assert not set(DS.TERM_COLUMNS) & set(seen.columns) and "alpha" not in tf.vocabulary and "beta1" in tf.vocabulary
    again = {r.id: r.features for r in model.transform(df).collect()}
    assert all(again[r.id] == r.features for r in seen.collect())
    assert re.search("gamma", " ".join(tf.vocabulary))


def test_texts_are_cleaned_once_for_index_and_readers(spark, monkeypatch):
    """The word index and what is looked up in it read the same tokens."""
    from nazar.plans import q_vectors as QV

    calls, plain = [], QV.review_tokens
    monkeypatch.setattr(QV, "review_tokens", lambda s, d: calls.append(d) or plain(s, d))
    for q in (QV.q_embedding_coverage, QV.q_encode_sequences, QV.q_lookup_vector, QV.q_vocab_coverage):
        calls.clear()
        q(spark, "/root/testdata/sf0.001")
        assert len(calls) == 1, q.__name__


def test_whitespace_and_tokens_as_python_has_them(spark):
    """Every white space character, alone, in runs and beside punctuation, as ``str.split`` has it."""
    import re

    from pyspark.sql import functions as F

    from nazar.functions import patterns as P
    from nazar.functions import text as T

    space = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000 and chr(i).isspace()]
    rows = [f"{c}ab{c}{c}cd {c}ef,{c}gh؟ij{c}" for c in [*space, "​", "᠎", "﻿", "\n\n", " ", "  "]] + ["", " ", None, "\n", "..", "a"]
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, c string")
    q = d.select("id", T.normalize_whitespace(F.col("c")).alias("w"), T.tokenize(F.col("c")).alias("t"))
    cut = P.PUNCTUATION[:-1] + P.PERSIAN_PUNCTUATION[1:-1] + "]"
    for i, w, t in q.collect():
        r = rows[i]
        assert w == (r if r is None else " ".join(r.split()))
        assert t == (r if r is None else [x for x in re.sub(cut, " ", r).split() if 2 <= len(x) <= 50])
    # line feeds, the common case, are no work for a regular expression
    plan = d.select(T.normalize_whitespace(F.col("c")))._jdf.queryExecution().optimizedPlan().toString()
    assert "replace(c" in plan and "regexp_replace(c" not in plan
