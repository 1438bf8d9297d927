"""Scalar column builders for catalogue normalisation (all JVM-side, no UDFs).

Every function takes and returns ``pyspark.sql.Column`` objects so that the
whole normalisation stays inside one whole-stage-codegen projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must match the catalogue's own conventions.
# ---------------------------------------------------------------------------
# A rating text is numeric only when it looks like a plain decimal number
# (optional sign, digits, optional fraction, optional exponent, blanks around).
RATING_PATTERN = r"^\s*[-+]?[0-9]*\.?[0-9]*([eE][-+]?[0-9]+)?\s*$"
YEAR_PATTERN = r"(\d{4})"
RUNTIME_PATTERN = r"(\d+)"
# Profession words that mark a person as a director (director, screenwriter).
DIRECTOR_WORDS = ("导演", "编剧")
# Image-URL rewrites: celebrity pictures go to the raw size, personage pictures
# to the large size.
CELEBRITY_PATH = "/celebrity/"
CELEBRITY_SIZES = r"/celebrity/[ms]/"
CELEBRITY_RAW = "/celebrity/raw/"
PERSONAGE_SIZES = r"/personage/[sm]/"
PERSONAGE_LARGE = "/personage/l/"
BIO_MIN_CHARS = 50
BIO_MAX_CHARS = 2000


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ustrip(c) -> Column:
    """Strip Unicode blanks at both ends (``trim`` only removes U+0020)."""
    return F.regexp_replace(col_(c), r"(?U)^\s+|\s+$", "")


def text_or_empty(c) -> Column:
    """Null text counts as the empty string."""
    return F.coalesce(col_(c).cast("string"), F.lit(""))


def split_multi(c) -> Column:
    """'/' or ',' separated list -> array; blanks stripped, empties dropped,
    order and repeats kept."""
    parts = F.split(F.translate(text_or_empty(c), "/", ","), ",")
    return F.filter(F.transform(parts, lambda x: ustrip(x)), lambda x: x != F.lit(""))


def parse_rating(c) -> Column:
    """Text/number -> double; anything not a plain number -> 0.0 (= unrated)."""
    s = text_or_empty(c)
    return F.when(s.rlike(RATING_PATTERN),
                  F.coalesce(s.try_cast("double"), F.lit(0.0))).otherwise(F.lit(0.0))


def rating_hundredths(rating) -> Column:
    """Rating in integer hundredths: exact sums, one division for means."""
    return F.round(col_(rating) * 100).cast("bigint")


def parse_year(c) -> Column:
    y = F.nullif(F.regexp_extract(text_or_empty(c), YEAR_PATTERN, 1), F.lit(""))
    return y.cast("int")


def parse_runtime(c) -> Column:
    digits = F.nullif(F.regexp_extract(text_or_empty(c), RUNTIME_PATTERN, 1), F.lit(""))
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def decade(year) -> Column:
    return (F.floor(col_(year) / 10) * 10).cast("int")


def first_or_empty(arr) -> Column:
    return F.coalesce(F.try_element_at(col_(arr), F.lit(1)), F.lit(""))


def icontains(c, q) -> Column:
    """Case-insensitive substring test; '%' and '_' stay literal."""
    qc = q if isinstance(q, Column) else F.lit(q)
    return F.contains(F.lower(text_or_empty(c)), F.lower(qc))


def primary_type(profession) -> Column:
    """First tag of a '/'-separated profession: director words -> director."""
    first = F.element_at(F.split(text_or_empty(profession), "/"), 1)
    is_dir = F.lit(False)
    for w in DIRECTOR_WORDS:
        is_dir = is_dir | F.contains(first, F.lit(w))
    return F.when(is_dir, F.lit("director")).otherwise(F.lit("actor"))


def split_cjk_latin(full) -> tuple[Column, Column]:
    """Name before the first ASCII letter, and the rest; no split when the
    text starts with a letter or has none."""
    s = text_or_empty(full)
    pat = r"^([^A-Za-z]+)([A-Za-z].*)$"
    has = s.rlike(pat)
    name = F.when(has, ustrip(F.regexp_extract(s, pat, 1))).otherwise(ustrip(s))
    name_en = F.when(has, ustrip(F.regexp_extract(s, pat, 2))).otherwise(F.lit(""))
    return name, name_en


def normalize_image_url(url) -> Column:
    u = text_or_empty(url)
    return (F.when(F.contains(u, F.lit(CELEBRITY_PATH)),
                   F.regexp_replace(u, CELEBRITY_SIZES, CELEBRITY_RAW))
            .otherwise(F.regexp_replace(u, PERSONAGE_SIZES, PERSONAGE_LARGE)))


def bio_trim(bio) -> Column:
    b = ustrip(text_or_empty(bio))
    return F.when(F.length(b) > BIO_MIN_CHARS, F.substring(b, 1, BIO_MAX_CHARS))


def file_ext_choice(url) -> Column:
    return F.when(F.contains(text_or_empty(url), F.lit(".webp")), F.lit(".webp")).otherwise(F.lit(".jpg"))


def round_half_up(x, places: int) -> Column:
    """Deterministic rounding used identically by the SQL oracle:
    floor(x * 10^n + 0.5) / 10^n (double)."""
    scale = float(10 ** places)
    return F.floor(col_(x) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def hash_order(seed, key) -> Column:
    """Repeatable pseudo-random order key: md5 of '<seed>-<key>'."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit("-"), col_(key).cast("string")))
