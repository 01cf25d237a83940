"""Jalali (Solar Hijri) date strings → Gregorian dates.

Arithmetic conversion: with Y = y + 1595 the day number is
  -355668 + 365·Y + 8·(Y div 33) + ((Y mod 33) + 3) div 4 + d + month offset,
month offset = 31·(m−1) for m < 7 else 30·(m−7) + 186; subtracting 719528
gives days since 1970-01-01.  Persian or ASCII digits, '/' or '-' separators.
A day its month does not have is no date: months 7-11 have 30 days, and month 12 ends before
the next year's first day.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nazar.functions import patterns as P

EPOCH_OFFSET = 719528


def jalali_to_date(c: Column) -> Column:
    s = F.regexp_replace(F.translate(c, P.PERSIAN_DIGITS, P.ASCII_DIGITS), "-", "/")
    parts = F.split(s, "/")
    y = F.get(parts, 0).try_cast("int")
    m = F.get(parts, 1).try_cast("int")
    d = F.get(parts, 2).try_cast("int")
    yy = y + 1595
    mo = F.when(m < 7, (m - 1) * 31).otherwise((m - 7) * 30 + 186)
    days = (F.lit(-355668) + yy * 365 + F.floor(yy / 33).cast("int") * 8
            + F.floor(((yy % 33) + 3) / 4).cast("int") + d + mo)
    new_year = F.lit(-355667) + (yy + 1) * 365 + F.floor((yy + 1) / 33).cast("int") * 8 + F.floor((((yy + 1) % 33) + 3) / 4).cast("int")
    ok = (F.size(parts) == 3) & m.between(1, 12) & d.between(1, 31) & ((m < 7) | (d <= 30)) & (days < new_year)
    return F.when(ok, F.date_from_unix_date((days - EPOCH_OFFSET).cast("int")))


def jalali_to_date_sql(e: str) -> str:
    s = f"replace(translate({e}, '{P.PERSIAN_DIGITS}', '{P.ASCII_DIGITS}'), '-', '/')"
    y = f"TRY_CAST(split_part({s}, '/', 1) AS INTEGER)"
    m = f"TRY_CAST(split_part({s}, '/', 2) AS INTEGER)"
    d = f"TRY_CAST(split_part({s}, '/', 3) AS INTEGER)"
    yy = f"({y} + 1595)"
    mo = f"(CASE WHEN {m} < 7 THEN ({m} - 1) * 31 ELSE ({m} - 7) * 30 + 186 END)"
    days = f"(-355668 + {yy} * 365 + ({yy} // 33) * 8 + (({yy} % 33) + 3) // 4 + {d} + {mo})"
    ok = (f"(len(string_split({s}, '/')) = 3 AND {m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND 31 "
          f"AND ({m} < 7 OR {d} <= 30) AND {days} < -355667 + ({yy} + 1) * 365 + (({yy} + 1) // 33) * 8 + ((({yy} + 1) % 33) + 3) // 4)")
    return f"CASE WHEN {ok} THEN DATE '1970-01-01' + CAST({days} - {EPOCH_OFFSET} AS INTEGER) END"


def jalali_fixture(doc_id: Column) -> Column:
    """Jalali date strings in Persian digits derived from an id (test input)."""
    y = (F.lit(1380) + doc_id % 25).cast("string")
    m = F.lpad((F.lit(1) + (doc_id * 7) % 12).cast("string"), 2, "0")
    d = F.lpad((F.lit(1) + (doc_id * 13) % 29).cast("string"), 2, "0")
    return F.translate(F.concat_ws("/", y, m, d), P.ASCII_DIGITS, P.PERSIAN_DIGITS)


JALALI_FIXTURE_SQL = (f"translate(CAST(1380 + doc_id % 25 AS VARCHAR) || '/' || lpad(CAST(1 + (doc_id * 7) % 12 AS VARCHAR), 2, '0')"
                      f" || '/' || lpad(CAST(1 + (doc_id * 13) % 29 AS VARCHAR), 2, '0'), '{P.ASCII_DIGITS}', '{P.PERSIAN_DIGITS}')")
