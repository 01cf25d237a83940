"""Text cleaning and tokenising as Spark ``Column`` builders.

Everything is a built-in expression (regexp_replace / translate / split /
filter), so a cleaning chain compiles into one whole-stage-codegen projection;
higher-order functions appear only for token arrays and the emoji map.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from nazar.functions import patterns as P


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _rx(c, pattern: str, repl: str) -> Column:
    return F.regexp_replace(_c(c), F.lit(pattern), F.lit(repl))


def let(c, then) -> Column:
    """``then(x)`` with the column's value as x, computed once however often ``then`` names it."""
    return F.transform(F.array(_c(c)), then)[0]


def _one_of(chars) -> str:
    """A class of the characters; those outside their range are ruled out by one comparison."""
    codes = sorted(map(ord, chars))
    return f"[\\x{{{codes[0]:X}}}-\\x{{{codes[-1]:X}}}&&[" + "".join(f"\\x{{{k:X}}}" for k in codes) + "]]"


def _rx_if(c, mark: str, pattern: str, repl: str = " ") -> Column:
    """``_rx`` on texts that hold ``mark``, which every match of the pattern holds; others stay."""
    return let(c, lambda x: F.when(F.contains(x, F.lit(mark)), _rx(x, pattern, repl)).otherwise(x))


# ---------------------------------------------------------------- C1–C12

def normalize_whitespace(c) -> Column:
    """Runs of whitespace → one space, then strip (only spaces remain at the ends).

    Every whitespace character becomes a space, line feeds without a regular expression, then
    runs of spaces are cut; each step runs only on texts that need it.
    """
    x = let(F.replace(_c(c), F.lit("\n"), F.lit(" ")),
            lambda x: F.when(x.rlike(P.WS_OTHER_JAVA), _rx(x, P.WS_OTHER_JAVA, " ")).otherwise(x))
    return F.trim(_rx_if(x, "  ", " {2,}"))


def py_strip(c) -> Column:
    """``str.strip()``: strip every whitespace character, not just spaces."""
    return _rx(c, f"^{P.WS_JAVA}+|{P.WS_JAVA}+$", "")


def remove_urls(c) -> Column:
    """C1."""
    return _rx_if(c, "://", P.URL)


def remove_emails(c) -> Column:
    """C2."""
    return _rx_if(c, "@", P.EMAIL_JAVA)


def remove_phones(c) -> Column:
    """C3."""
    return _rx_if(c, "9", P.PHONE)


def remove_mentions_hashtags(c) -> Column:
    """C4: mentions first, then hashtags."""
    return _rx_if(_rx_if(c, "@", P.MENTION), "#", P.HASHTAG)


def convert_emojis(c, emoji_map: Sequence[tuple[str, str]]) -> Column:
    """Every mapped emoji → `` text `` in map order.

    One ``aggregate`` over a literal array of (emoji, text) pairs; the replace
    only runs when the emoji is present, exactly like the sequential original.
    A single ``rlike`` over all mapped emoji lets rows without any skip the loop.
    """
    if not emoji_map:
        return _c(c)
    any_first = _one_of({e[0] for e, _ in emoji_map})  # every mapped emoji starts with one
    return let(c, lambda x: F.when(x.rlike(any_first), convert_emojis_counted(x, emoji_map).getField("text")).otherwise(x))


def convert_emojis_counted(c, emoji_map: Sequence[tuple[str, str]]) -> Column:
    """C5 with the number of distinct emoji converted: struct<text, n_emoji>."""
    if not emoji_map:
        return F.struct(_c(c).alias("text"), F.lit(0).alias("n_emoji"))
    pairs = F.array(*[F.struct(F.lit(e).alias("k"), F.lit(f" {t} ").alias("v")) for e, t in emoji_map])
    init = F.struct(_c(c).alias("text"), F.lit(0).alias("n_emoji"))

    def step(acc, x):
        hit = F.instr(acc["text"], x["k"]) > 0
        return F.when(hit, F.struct(F.replace(acc["text"], x["k"], x["v"]).alias("text"),
                                    (acc["n_emoji"] + 1).alias("n_emoji"))).otherwise(acc)

    return F.aggregate(pairs, init, step)


def remove_emojis(c) -> Column:
    """Six emoji code-point ranges → space."""
    return _rx(c, P.EMOJI_RANGES + "+", " ")


def normalize_chars(c) -> Column:
    """Arabic letter forms → Persian, bare hamza removed."""
    return F.translate(_c(c), P.CHAR_FROM, P.CHAR_TO)


def normalize_digits(c, to: str = "ascii") -> Column:
    """Persian digits → ASCII (``to='persian'`` for the opposite direction)."""
    if to == "persian":
        return F.translate(_c(c), P.ASCII_DIGITS, P.PERSIAN_DIGITS)
    return F.translate(_c(c), P.PERSIAN_DIGITS, P.ASCII_DIGITS)


def remove_diacritics(c) -> Column:
    """C9."""
    return F.translate(_c(c), P.DIACRITICS, "")


def remove_english(c) -> Column:
    """Latin letters → space."""
    return _rx(c, P.ENGLISH_CHAR, " ")


def remove_english_runs(c) -> Column:
    """C10 before a C12: a run of Latin letters → one space, of which C12 leaves as much as of many."""
    return _rx(c, P.ENGLISH_CHAR + "+", " ")


def clean_punctuation(c, strip: bool = False) -> Column:
    """C11: runs of . ! ? → one dot; optionally every ASCII punctuation mark → space."""
    out = _rx(c, P.REPEATED_PUNCT, ".")
    return _rx(out, P.PUNCTUATION, " ") if strip else out


def valid_length(c, lo: int = P.MIN_COMMENT_LEN, hi: int = P.MAX_COMMENT_LEN) -> Column:
    """Lo ≤ length ≤ hi (Unicode code points)."""
    return F.length(_c(c)).between(lo, hi)


def normalize_persian(c, digits: str = "ascii", diacritics: bool = True) -> Column:
    """C7 → C8 → C9 in one ``translate`` pass.

    The three maps touch disjoint characters and no target is a later source,
    so one combined map equals the sequence; deleted characters (bare hamza,
    diacritics) go last, beyond the replacement string.
    """
    dig_from, dig_to = ((P.ASCII_DIGITS, P.PERSIAN_DIGITS) if digits == "persian"
                        else (P.PERSIAN_DIGITS, P.ASCII_DIGITS))
    keep_from, drop = P.CHAR_FROM[:len(P.CHAR_TO)], P.CHAR_FROM[len(P.CHAR_TO):]
    matching = keep_from + dig_from + drop + (P.DIACRITICS if diacritics else "")
    held = _one_of(matching)
    return let(c, lambda x: F.when(x.rlike(held), F.translate(x, matching, P.CHAR_TO + dig_to)).otherwise(x))


LEVELS = ("light", "medium", "heavy")


def clean_prefix(c, level: str = "medium") -> Column:
    """C14, first part: whitespace, then (medium/heavy) urls, emails, phones, mentions/hashtags,
    then (heavy) English letters.  medium and heavy share everything but the last step."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    x = normalize_whitespace(c)
    if level in ("medium", "heavy"):
        x = remove_mentions_hashtags(remove_phones(remove_emails(remove_urls(x))))
    if level == "heavy":
        x = remove_english_runs(x)
    return x


def clean_finish(x, emoji_map: Sequence[tuple[str, str]] | None = None, drop_emojis: bool = False,
                 digits: str = "ascii") -> Column:
    """C14, second part: emoji (convert or remove), Persian normalisation,
    repeated punctuation, whitespace; null becomes ''."""
    if drop_emojis:
        x = remove_emojis(x)
    elif emoji_map:
        x = convert_emojis(x, emoji_map)
    x = normalize_whitespace(clean_punctuation(normalize_persian(x, digits)))
    return F.coalesce(x, F.lit(""))


def clean_text(c, level: str = "medium", emoji_map: Sequence[tuple[str, str]] | None = None,
               drop_emojis: bool = False, digits: str = "ascii") -> Column:
    """C14: ordered composition of C1–C12 for a cleaning level.

    Null or blank input gives '' (a whitespace-only text normalises to '' and
    stays empty through every later rule, so no separate blank test is needed,
    which keeps the chain free of conditionals for common-subexpression reuse).
    """
    return clean_finish(clean_prefix(c, level), emoji_map, drop_emojis, digits)


# ---------------------------------------------------------------- tokens

def split_ws(c) -> Column:
    """``str.split()``: split on whitespace runs, no empty pieces."""
    return F.filter(F.split(_c(c), P.WS_JAVA + "+"), lambda t: t != "")


def tokenize(c, min_len: int = P.MIN_WORD_LEN, max_len: int = P.MAX_WORD_LEN) -> Column:
    """Punctuation → space, split, keep min_len ≤ len ≤ max_len."""
    parts = F.split(_c(c), P.BETWEEN_TOKENS_JAVA)  # punctuation and whitespace, one pass
    return F.filter(parts, lambda t: (t != "") & F.length(t).between(min_len, max_len))


def words(c) -> Column:
    """Maximal runs of word characters (Python ``\\b\\w+\\b``)."""
    return F.regexp_extract_all(_c(c), F.lit(P.WORD), 0)


def remove_stopwords(tokens, stopwords: Sequence[str]) -> Column:
    """C17 on an array column: drop tokens whose lower case is a stopword.

    ``isin`` over a literal list is rewritten to a hash-set lookup (InSet) by
    the optimizer, so the cost per token does not grow with the lexicon.
    """
    sw = sorted(set(stopwords))
    if not sw:
        return _c(tokens)
    return F.filter(_c(tokens), lambda t: ~F.lower(t).isin(*sw))


def strip_suffixes(tokens, suffixes: Sequence[str], min_stem: int = 2) -> Column:
    """Remove the longest listed suffix when at least ``min_stem`` chars remain."""
    sfx = sorted(set(s for s in suffixes if s), key=lambda s: (-len(s), s))
    if not sfx:
        return _c(tokens)
    import re as _re
    alt = "|".join(_re.escape(s) for s in sfx)
    pat = f"^(.{{{min_stem},}}?)(?:{alt})$"
    return F.transform(_c(tokens), lambda t: F.regexp_replace(t, pat, "$1"))


def analyze(c, min_len: int = 2, max_len: int = 20) -> Column:
    """whitespace tokens with min_len ≤ len ≤ max_len."""
    return F.filter(split_ws(c), lambda t: F.length(t).between(min_len, max_len))


def word_ngrams(tokens, n: int) -> Column:
    """space-joined word n-grams of a token array column (a column
    reference: the lambda would re-evaluate a captured expression per gram)."""
    t = _c(tokens)
    grams = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1),
                        lambda i: F.array_join(F.slice(t, i, n), " "))
    return F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<string>"))


def normalize_for_char_ngrams(c) -> Column:
    """Lower-case, runs of 2+ whitespace → one space (character n-gram analyzer)."""
    return F.lower(_rx(c, P.WS_JAVA + "{2,}", " "))


def characters(s) -> Column:
    """The characters of a string as an array (none of an empty one)."""
    return F.filter(F.split(_c(s), ""), lambda x: x != "")


def char_ngrams(chars, n: int) -> Column:
    """character n-grams of ``characters`` of an already normalised string.

    ``chars`` must be a column reference (materialise it with a select first):
    a lambda re-evaluates any expression it captures once per position.  An
    array gives a character at once; ``substring`` counts from the string's start.
    """
    a = _c(chars)
    grams = F.transform(F.sequence(F.lit(1), F.size(a) - n + 1),
                        lambda i: F.concat(*[F.get(a, i + (k - 1)) for k in range(n)]))
    return F.when(F.size(a) >= n, grams).otherwise(F.array().cast("array<string>"))


def sentence_count(c) -> Column:
    """Number of . ! ? characters plus one."""
    return F.length(_c(c)) - F.length(F.translate(_c(c), ".!?", "")) + 1
