"""Fixed values shared by the Spark expressions and the DuckDB oracle.

Patterns are written in the subset of regex syntax on which Java
(``java.util.regex``, used by Spark) and RE2 (used by DuckDB) agree, and chosen
to reproduce Python ``re`` semantics on Unicode text:

* Python ``\\w`` = letters, numbers, underscore  → ``[\\p{L}\\p{N}_]``
  (Java's ``(?U)\\w`` would also match ZWNJ and combining marks; plain ``\\w``
  is ASCII in both engines).
* Python ``\\d`` = any decimal digit, Persian included → ``\\p{Nd}``.
* Python ``\\s`` / ``str.split()`` / ``str.strip()`` = ``str.isspace`` → WS below
  (RE2's ``\\s`` lacks ``\\v``; Java's lacks the Unicode spaces).
"""

# ---------------------------------------------------------------- fixed values
# Whitespace as Python's str.isspace() defines it.
WS = r"[\t\n\x0B\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# The same 29 code points in Java's faster spelling (Unicode White_Space plus
# U+001C–U+001F); checked equal over every code point.  Spark side only.
# Visible ASCII is ruled out first, by one comparison.
WS_JAVA = r"(?U:[[^!-~]&&[\s\x{1C}-\x{1F}]])"
# White space other than the blank; a mark of texts that hold any besides line feeds.
WS_OTHER_JAVA = r"(?U:[[^ -~]&&[\s\x{1C}-\x{1F}]])"
WORD = r"[\p{L}\p{N}_]+"

# Noise patterns of the cleaner (fixed values, Java/RE2 spelling of the original).
URL = r"(?i)http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
EMAIL = r"(?i)[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
# The same matches in Java: only the start of a run of name characters, or the end of the match
# before, can begin one, so a word is not read again from each of its letters.
EMAIL_JAVA = r"(?i)(?:\G|(?<![a-zA-Z0-9._%+-]))[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"(\+98|0)?9\p{Nd}{9}"
MENTION = r"@[\p{L}\p{N}_]+"
HASHTAG = r"#[\p{L}\p{N}_]+"
ENGLISH_CHAR = r"[a-zA-Z]"
REPEATED_PUNCT = r"[.!?]{2,}"
PUNCTUATION = r"""[!@#$%^&*()_+\-=\[\]{};':"\\|,.<>?]"""
PERSIAN_PUNCTUATION = r"[؟،؛]"
# Runs of white space and of both kinds of punctuation, in Java.
BETWEEN_TOKENS_JAVA = rf"(?U:[{PUNCTUATION[1:-1]}{PERSIAN_PUNCTUATION[1:-1]}[[^!-~]&&[\s\x{{1C}}-\x{{1F}}]]]+)"
PERSIAN_CHAR = r"[آ-ی]"
PERSIAN_DIGIT_CHAR = r"[۰-۹]"
# Six emoji code-point ranges removed when emoji are not converted.
EMOJI_RANGES = (r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}"
                r"\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]")

# Character normalisation: Arabic forms → Persian; the last source (bare hamza)
# has no target and is deleted (translate semantics).
# ك→ک ي→ی ئ→ی أ→ا إ→ا آ→ا ة→ه ء→''
CHAR_FROM = "كيئأإآةء"
CHAR_TO = "کییاااه"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
ASCII_DIGITS = "0123456789"
# Eight Arabic diacritics (fathatan … sukun), removed.
DIACRITICS = "ًٌٍَُِّْ"
# Characters counted by the punctuation-density error analysis.
DENSITY_PUNCT = "!@#$%^&*().,;:?"

# Length limits of the cleaner and tokenizer.
MIN_COMMENT_LEN, MAX_COMMENT_LEN = 10, 500
MIN_WORD_LEN, MAX_WORD_LEN = 2, 50
