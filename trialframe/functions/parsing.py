"""Column expressions that read names, labels and loosely typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CLASSES, REGION_ALIASES_B

# Trial-number patterns of the two catalogs.
TRIAL_PATTERN = r"(?i)trial[_-]?0*(\d+)"
TRIAL_PATTERN_STRICT = r"(?i)trial[_-]?(\d+)\.npz$"
MISSING_WORDS = ("", "nan", "n/a", "none")


def first_int(text: Column, pattern: str) -> Column:
    """First capture of `pattern` as an integer, NULL without a match."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("int")


def trial_number(stem: Column, pattern: str = TRIAL_PATTERN) -> Column:
    return first_int(stem, pattern)


def trial_number_strict(name: Column, pattern: str = TRIAL_PATTERN_STRICT) -> Column:
    return first_int(name, pattern)


def class_folder(name: Column, classes: tuple[str, ...] = CLASSES) -> Column:
    """Canonical class name of a folder, NULL for any other folder."""
    canon = F.initcap(F.lower(name))
    return F.when(canon.isin(*classes), canon)


def class_in_path(path: Column, classes: tuple[str, ...] = CLASSES) -> Column:
    """First class (in class order) that is a whole part of the path."""
    parts = F.split(F.lower(path), "/")
    return F.coalesce(*[F.when(F.array_contains(parts, c.lower()), F.lit(c)) for c in classes])


def region_canon_a(raw: Column) -> Column:
    """Area by substring, side by whole word; separators `-` and `_` read as spaces."""
    s = F.translate(F.lower(F.trim(raw)), "-_", "  ")
    area = F.when(s.contains("alm"), "ALM").when(s.contains("str"), "STR")
    side = F.when(s.rlike(r"\b(left|l)\b"), "L").when(s.rlike(r"\b(right|r)\b"), "R")
    return F.concat(area, F.lit("_"), side)


def region_canon_b(raw: Column) -> Column:
    """Alias in any case, then `unknown` -> NULL, then substrings with the full side word."""
    s = F.lower(F.trim(raw))
    by_alias = F.coalesce(
        *[F.when(s == alias.lower(), F.lit(key)) for alias, key in REGION_ALIASES_B.items()]
    )
    side = F.when(s.contains("left"), "left").when(s.contains("right"), "right")
    loose = F.when(s.contains("alm") & side.isNotNull(), F.concat(side, F.lit("_ALM"))).when(
        s.contains("str"), F.concat(side, F.lit("_Striatum"))
    )
    return F.coalesce(by_alias, F.when(~s.contains("unknown"), loose))


def finite(x: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def scalar(values: Column, default: float | None = None) -> Column:
    """First array element as a double; default when absent, empty or not a number."""
    first = F.get(values, F.lit(0)).try_cast("double")
    return F.coalesce(F.nanvl(first, F.lit(None).cast("double")), F.lit(default).cast("double"))


def times(values: Column) -> Column:
    """Array of doubles; elements that do not parse are left out."""
    cast = F.transform(values, lambda x: x.try_cast("double"))
    return F.coalesce(F.filter(cast, lambda x: x.isNotNull()), F.array().cast("array<double>"))


def lick_list(text: Column, strict: bool = False) -> Column:
    """`"1.2; 1.3,,"` -> [1.2, 1.3]; missing words give an empty list; strict raises on a bad token."""
    clean = F.trim(text)
    parts = F.split(F.translate(clean, ";", ","), ",")
    tokens = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    numbers = F.transform(tokens, lambda x: x.cast("double") if strict else x.try_cast("double"))
    if not strict:
        numbers = F.filter(numbers, lambda x: x.isNotNull())
    empty = F.array().cast("array<double>")
    return F.when(text.isNull() | F.lower(clean).isin(*MISSING_WORDS), empty).otherwise(numbers)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def session_keys(session_dir: Column, parent_dir: Column, trial: Column) -> Column:
    """Lookup keys of a session folder, best first; keys that do not apply are left out."""
    is_subject = parent_dir.startswith("sub-")
    subject = F.when(is_subject, parent_dir).otherwise(session_dir)
    d = digits(parent_dir)
    keys = F.array(
        session_dir,
        F.when(is_subject, parent_dir),
        F.when(is_subject & (d != ""), d),
        F.concat(digits(subject), F.lit(":"), trial.cast("string")),
    )
    return F.filter(keys, lambda k: k.isNotNull())


def behavior_keys(session_dir: Column, session_path: Column, subject: Column, trial: Column) -> Column:
    """Keys a behaviour-log row answers to."""

    def present(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    name = F.element_at(F.split(session_path, "/"), -1)
    stem = F.replace(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit(".nwb"), F.lit(""))
    keys = F.array(
        present(session_dir),
        F.when(present(session_path).isNotNull(), stem),
        present(session_path),
        F.concat(present(subject), F.lit(":"), trial.cast("string")),
    )
    return F.filter(keys, lambda k: k.isNotNull())
