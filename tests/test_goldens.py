"""Hand-computed goldens on Persian strings (the fixtures are Latin-script)."""

import datetime as dt

from pyspark.sql import functions as F

from nazar.functions import dates as D
from nazar.functions import lexicons as LX
from nazar.functions import text as T


def one(spark, text, expr_fn):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(expr_fn(F.col("t")).alias("o")).first()["o"]


def test_char_normalisation(spark):
    assert one(spark, "كيف", T.normalize_chars) == "کیف"
    assert one(spark, "مسئله", T.normalize_chars) == "مسیله"
    assert one(spark, "شيء", T.normalize_chars) == "شی"
    assert one(spark, "آب", T.normalize_chars) == "اب"
    assert one(spark, "۱۲۳", T.normalize_digits) == "123"
    assert one(spark, "123", lambda c: T.normalize_digits(c, "persian")) == "۱۲۳"
    assert one(spark, "سَلام", T.remove_diacritics) == "سلام"


def test_noise_rules(spark):
    assert one(spark, "تماس 09121234567 بگیرید", T.remove_phones) == "تماس   بگیرید"
    assert one(spark, "x 9۱۲۳۴۵۶۷۸۹ y", T.remove_phones) == "x   y"
    assert one(spark, "سلام @علی #بانک", T.remove_mentions_hashtags) == "سلام    "
    assert one(spark, "a http://x.ir/p?q=1 b", T.remove_urls) == "a   b"
    assert one(spark, "mail me a.b@c.com ok", T.remove_emails) == "mail me   ok"
    assert one(spark, "عالی!!!", T.clean_punctuation) == "عالی."
    assert one(spark, "\t سلام \n\n دنیا  ", T.normalize_whitespace) == "سلام دنیا"


def test_clean_levels(spark):
    assert one(spark, "  سلام   دنیا  ", lambda c: T.clean_text(c, "light")) == "سلام دنیا"
    assert one(spark, "عالی 😀", lambda c: T.clean_text(c, "light", LX.DEFAULT_EMOJI_MAP)) == "عالی خنده"
    assert one(spark, "app خوب است", lambda c: T.clean_text(c, "heavy")) == "خوب است"
    assert one(spark, "   ", lambda c: T.clean_text(c, "medium")) == ""
    assert one(spark, None, lambda c: T.clean_text(c, "medium")) == ""
    assert one(spark, "👍👍 😡", lambda c: T.remove_emojis(c)) == "   "


def test_tokens(spark):
    assert one(spark, "سلام، خوبی؟ آره!", T.tokenize) == ["سلام", "خوبی", "آره"]
    assert one(spark, "نمی‌تونم", T.words) == ["نمی", "تونم"]  # ZWNJ is not a word character
    toks = ["این", "برنامه", "خوب", "است"]
    df = spark.createDataFrame([(toks,)], "t array<string>")
    assert df.select(T.remove_stopwords(F.col("t"), LX.DEFAULT_STOPWORDS)).first()[0] == ["برنامه", "خوب"]
    df = spark.createDataFrame([(["کتابها", "بهترین", "خوب"],)], "t array<string>")
    assert df.select(T.strip_suffixes(F.col("t"), LX.DEFAULT_SUFFIXES)).first()[0] == ["کتاب", "به", "خوب"]


def test_emoji_count(spark):
    s = one(spark, "😀 😀 👍 x", lambda c: T.convert_emojis_counted(c, LX.DEFAULT_EMOJI_MAP))
    assert s["n_emoji"] == 2 and "خنده" in s["text"] and "خوب" in s["text"]


def test_jalali(spark):
    assert one(spark, "۱۴۰۴/۰۳/۳۰", D.jalali_to_date) == dt.date(2025, 6, 20)
    assert one(spark, "۱۳۵۷/۱۱/۲۲", D.jalali_to_date) == dt.date(1979, 2, 11)
    assert one(spark, "1403/01/01", D.jalali_to_date) == dt.date(2024, 3, 20)
    assert one(spark, "not a date", D.jalali_to_date) is None
    assert one(spark, "1403/12/30", D.jalali_to_date) == dt.date(2025, 3, 20)
    assert [one(spark, x, D.jalali_to_date) for x in ("1402/12/30", "1402/07/31", "1402/12/31")] == [None] * 3
