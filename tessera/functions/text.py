"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens: runs of letters and digits; each Han character is a token of its own.
_HAN = r"(\p{IsHan})"
_HAN_RE2 = r"(\p{Han})"
_TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased tokens of ``text`` in order; null gives an empty array."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _HAN, " $1 ")
    return F.regexp_extract_all(spaced, F.lit(_TOKEN), 0)


def tokens_sql(text: str) -> str:
    """DuckDB form of :func:`tokens`."""
    return f"regexp_extract_all(regexp_replace(lower(coalesce({text}, '')), '{_HAN_RE2}', ' \\1 ', 'g'), '{_TOKEN}')"


def hash32(text: Column, part: int = 0) -> Column:
    """Unsigned 32 bits of an MD5 digest as a long; ``part`` 0 to 3 chooses which."""
    return F.conv(F.substring(F.md5(text), 8 * part + 1, 8), 16, 10).cast("long")


def hash32_sql(text: str, part: int = 0) -> str:
    return f"('0x' || substr(md5({text}), {8 * part + 1}, 8))::bigint"


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance, case ignored."""
    return F.levenshtein(F.lower(a), F.lower(b))


def split_nonempty(text: Column, delimiter: str) -> Column:
    """Parts between a literal delimiter, empty ones dropped."""
    return F.filter(F.split(text, F.lit("\\Q" + delimiter + "\\E")), lambda x: x != "")


def trim_left(text: Column, chars: str) -> Column:
    return F.regexp_replace(text, "^[" + "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in chars) + "]+", "")


def trim_right(text: Column, chars: str) -> Column:
    return F.regexp_replace(text, "[" + "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in chars) + "]+$", "")


def first_letters(terms: Column) -> Column:
    return F.transform(terms, lambda t: F.substring(t, 1, 1))


def duplicate_label(a: Column, b: Column, limit: int = 4) -> Column:
    """Whether two Latin labels name the same thing: as many terms, the same first letters, distance below ``limit``."""
    ta, tb = tokens(a), tokens(b)
    return (F.size(ta) == F.size(tb)) & (first_letters(ta) == first_letters(tb)) & (edit_distance(a, b) < limit)


def duplicate_label_han(a: Column, b: Column) -> Column:
    """The test for Chinese labels: one holds the other, distance below 2, or the same terms in any order."""
    held = F.contains(a, b) | F.contains(b, a)
    return held | (edit_distance(a, b) < 2) | (F.sort_array(tokens(a)) == F.sort_array(tokens(b)))


def join_terms(terms: Column) -> Column:
    """Terms joined with one blank, but none between two Han neighbours."""
    spaced = F.array_join(terms, " ")
    return F.regexp_replace(spaced, r"(?<=\p{IsHan}) (?=\p{IsHan})", "")


def input_kind(text: Column) -> Column:
    """1 for Latin letters only (pinyin), -1 for Han only, 0 for a mixture or neither."""
    return F.when(F.rlike(text, F.lit("^[A-Za-z' ]+$")), 1).when(F.rlike(text, F.lit(r"^\p{IsHan}+$")), -1).otherwise(0)


def to_half_width(text: Column) -> Column:
    """Full-width ASCII forms and the ideographic blank as plain ASCII."""
    return F.translate(text, "".join(map(chr, range(0xFF01, 0xFF5F))) + "　", "".join(map(chr, range(0x21, 0x7F))) + " ")


def map_characters(text: Column, pairs: dict[str, str]) -> Column:
    """Each character of ``pairs`` replaced, such as traditional by simplified ones."""
    return F.translate(text, "".join(pairs), "".join(pairs.values()))
