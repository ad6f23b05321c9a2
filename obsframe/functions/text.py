"""Text predicates and small text helpers, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\p{Z}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _quoted(term: str) -> str:
    return r"\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E"


def has(column: Column | str, term: str) -> Column:
    """Whole-term match without regard to case.

    A term edge that is a letter or digit must not touch another one; other edges,
    such as the bar of ``outbound|``, match anywhere. The cheap substring test in
    front spares most rows the regular expression.
    """
    text = _col(column)
    left = r"(^|[^0-9A-Za-z])" if _alnum(term[:1]) else ""
    right = r"($|[^0-9A-Za-z])" if _alnum(term[-1:]) else ""
    matched = text.rlike(f"(?i){left}{_quoted(term)}{right}")
    return contains_ci(text, term) & matched if term.isascii() else matched


def _alnum(char: str) -> bool:
    return char.isascii() and char.isalnum()


def contains_ci(column: Column | str, part: str) -> Column:
    """Substring match without regard to case."""
    return F.lower(_col(column)).contains(part.lower())


def full_match(column: Column | str, pattern: str) -> Column:
    """Regular expression match of the whole text, a trailing line end included."""
    return _col(column).rlike(rf"\A(?:{pattern})\z")


def strip(column: Column | str) -> Column:
    """Remove white space, of any kind Unicode knows, from both ends."""
    return F.regexp_replace(_col(column), f"^{SPACE}+|{SPACE}+$", "")


def fill_template(column: Column | str, values: dict[str, Column | str]) -> Column:
    """Replace each placeholder by its value, in the given order."""
    out = _col(column)
    for placeholder, value in values.items():
        out = F.replace(out, F.lit(placeholder), value if isinstance(value, Column) else F.lit(value))
    return out


def url_join(base: Column | str, path: str) -> Column:
    """Base without trailing slashes, one slash, path."""
    return F.concat(F.rtrim(_col(base), F.lit("/")), F.lit("/" + path.lstrip("/")))


def iso_utc(column: Column | str) -> Column:
    """Timestamp as ISO 8601 text with offset (the session zone is UTC)."""
    return F.date_format(_col(column).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssxxx")


def preview(column: Column | str, size: int = 100) -> Column:
    return F.substring(_col(column), 1, size)


def round3(column: Column | str) -> Column:
    return F.round(_col(column), 3)


def get_or(column: Column | str, default) -> Column:
    """Value, or the default when there is none."""
    return F.coalesce(_col(column), F.lit(default))


def json_field(column: Column | str, path: str) -> Column:
    return F.get_json_object(_col(column), path if path.startswith("$") else f"$.{path}")


def pad_to(ids: Column | str, size: int, pad: int) -> Column:
    """Cut or right-pad an array of ids to a fixed length."""
    cut = F.slice(_col(ids), 1, size)
    return F.concat(cut, F.array_repeat(F.lit(pad), F.lit(size) - F.size(cut)))


def mask_for(ids: Column | str, size: int) -> Column:
    """1 for each id kept, 0 for each pad position."""
    kept = F.least(F.size(_col(ids)), F.lit(size))
    return F.concat(F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), F.lit(size) - kept))
