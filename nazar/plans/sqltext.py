"""DuckDB spellings of the text expressions, for the oracle SQL.

Built from the same pattern constants as ``nazar.functions.text`` so both
engines evaluate the same regular expressions; the oracle is an independent
evaluation of the semantics, not of our Spark plan.
"""

from __future__ import annotations

from nazar.functions import patterns as P


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(e: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({e}, {lit(pattern)}, {lit(repl)}, 'g')"


def ws(e: str) -> str:
    return f"trim({rx(e, P.WS + '+', ' ')})"


def py_strip(e: str) -> str:
    return rx(e, f"^{P.WS}+|{P.WS}+$", "")


def convert_emojis(e: str, emoji_map) -> str:
    for k, v in emoji_map:
        e = f"replace({e}, {lit(k)}, {lit(' ' + v + ' ')})"
    return e


def emoji_count(e: str, emoji_map) -> str:
    """Distinct mapped emoji present (valid when no emoji contains another)."""
    if not emoji_map:
        return "0"
    return "(" + " + ".join(f"CAST(contains({e}, {lit(k)}) AS INTEGER)" for k, _ in emoji_map) + ")"


def normalize_persian(e: str, digits: str = "ascii") -> str:
    e = f"translate({e}, {lit(P.CHAR_FROM)}, {lit(P.CHAR_TO)})"
    if digits == "persian":
        e = f"translate({e}, {lit(P.ASCII_DIGITS)}, {lit(P.PERSIAN_DIGITS)})"
    else:
        e = f"translate({e}, {lit(P.PERSIAN_DIGITS)}, {lit(P.ASCII_DIGITS)})"
    return f"translate({e}, {lit(P.DIACRITICS)}, '')"


def clean_text(e: str, level: str = "medium", emoji_map=None, drop_emojis: bool = False) -> str:
    x = ws(e)
    if level in ("medium", "heavy"):
        for pat in (P.URL, P.EMAIL, P.PHONE, P.MENTION, P.HASHTAG):
            x = rx(x, pat, " ")
    if level == "heavy":
        x = rx(x, P.ENGLISH_CHAR, " ")
    if drop_emojis:
        x = rx(x, P.EMOJI_RANGES + "+", " ")
    elif emoji_map:
        x = convert_emojis(x, emoji_map)
    x = normalize_persian(x)
    x = ws(rx(x, P.REPEATED_PUNCT, "."))
    return f"CASE WHEN {e} IS NULL OR length({py_strip(e)}) = 0 THEN '' ELSE {x} END"


def split_ws(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, {lit(P.WS + '+')}), lambda t: t <> '')"


def tokenize(e: str, lo: int = P.MIN_WORD_LEN, hi: int = P.MAX_WORD_LEN) -> str:
    x = rx(rx(e, P.PUNCTUATION, " "), P.PERSIAN_PUNCTUATION, " ")
    return f"list_filter({split_ws(x)}, lambda t: length(t) BETWEEN {lo} AND {hi})"


def words(e: str) -> str:
    return f"regexp_extract_all({e}, {lit(P.WORD)})"


def analyze(e: str, lo: int = 2, hi: int = 20) -> str:
    return f"list_filter({split_ws(e)}, lambda t: length(t) BETWEEN {lo} AND {hi})"


def remove_stopwords(e: str, stopwords) -> str:
    sw = sorted(set(stopwords))
    if not sw:
        return e
    arr = "[" + ", ".join(lit(w) for w in sw) + "]"
    return f"list_filter({e}, lambda t: NOT list_contains({arr}, lower(t)))"


def strip_suffixes(e: str, suffixes, min_stem: int = 2) -> str:
    import re as _re
    sfx = sorted(set(x for x in suffixes if x), key=lambda x: (-len(x), x))
    if not sfx:
        return e
    pat = f"^(.{{{min_stem},}}?)(?:{'|'.join(_re.escape(x) for x in sfx)})$"
    return f"list_transform({e}, lambda t: regexp_replace(t, {lit(pat)}, '\\1'))"


def lemmatize(e: str, lemmas) -> str:
    if not lemmas:
        return e
    case = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in lemmas)
    return f"list_transform({e}, lambda t: CASE t {case} ELSE t END)"


def tokens_from_cleaned(e: str, stopwords=(), stem_suffixes=None, lemmas=None) -> str:
    t = tokenize(e)
    if stopwords:
        t = remove_stopwords(t, stopwords)
    if lemmas:
        t = lemmatize(t, lemmas)
    elif stem_suffixes:
        t = strip_suffixes(t, stem_suffixes)
    return t


def join_tokens(e: str) -> str:
    return f"array_to_string({e}, ' ')"


def versions_sql(src: str, text: str, id_col: str, stopwords, suffixes, lemmas, emoji_map,
                 min_len: int = 10, keep=()) -> str:
    """The four stacked preprocessing versions (mirror of operators.cleaning.versions)."""
    k = "".join(f"{c}, " for c in keep)
    base = (f"SELECT {id_col}, {k}{clean_text(text, 'light', emoji_map)} AS _l, "
            f"{clean_text(text, 'medium', emoji_map)} AS _m, {clean_text(text, 'heavy', emoji_map)} AS _h FROM {src}")
    med = join_tokens(tokens_from_cleaned("_m", stopwords))
    stem = join_tokens(tokens_from_cleaned("_h", stopwords, stem_suffixes=suffixes))
    lem = join_tokens(tokens_from_cleaned("_h", stopwords, lemmas=lemmas))
    parts = [f"SELECT {id_col}, {k}'light' AS version, _l AS comment_cleaned, _l AS comment_processed, "
             f"length(_l) > 0 AS kept FROM b"]
    for v, cl, pr in (("medium", "_m", med), ("heavy_stem", "_h", stem), ("heavy_lemma", "_h", lem)):
        parts.append(f"SELECT {id_col}, {k}'{v}' AS version, {cl} AS comment_cleaned, p AS comment_processed, "
                     f"length({cl}) > 0 AND length(p) >= {min_len} AS kept FROM (SELECT *, {pr} AS p FROM b)")
    return f"WITH b AS ({base}) " + " UNION ALL ".join(parts)
