"""Every cleaning rule that a registered query checks has rows of its fixture to change."""

import pytest
from pyspark.sql import functions as F

from nazar.functions import lexicons as LX
from nazar.functions import text as T
from nazar.operators import errors as E
from nazar.plans import fixtures as X

from .conftest import SF001

RULES = {
    "convert_emojis": lambda c: T.convert_emojis(c, LX.DEFAULT_EMOJI_MAP),
    "remove_emojis": T.remove_emojis,
    "normalize_chars": T.normalize_chars,
    "normalize_digits": T.normalize_digits,
    "remove_diacritics": T.remove_diacritics,
}


@pytest.fixture(scope="module")
def persian(spark):
    return X.persian_reviews(spark, SF001).select("id", "comment").checkpoint()


@pytest.mark.parametrize("rule", RULES)
def test_each_rule_changes_rows(persian, rule):
    n = persian.count()
    changed = persian.where(~F.col("comment").eqNullSafe(RULES[rule](F.col("comment")))).count()
    assert changed > 0.01 * n


def test_stems_lemmas_and_emoji_rates(spark, persian):
    tokens = T.tokenize(T.clean_text(F.col("comment"), "heavy", LX.DEFAULT_EMOJI_MAP))
    t = persian.select(F.explode(tokens).alias("t"))
    words = t.select("t", T.strip_suffixes(F.array("t"), X.PERSIAN_SUFFIXES)[0].alias("s"))
    assert words.where("t <> s").count() > 0.01 * words.count()
    forms = [k for k, _ in X.PERSIAN_LEMMAS]
    assert {r.t for r in t.where(F.col("t").isin(forms)).distinct().collect()} == set(forms)
    p = X.predictions(spark, SF001, ["cnn"]).withColumn("text", X.persian(F.col("text")))
    assert all(r.with_emoji > 0 for r in E.emoji_rate_error_vs_correct(p).collect())
