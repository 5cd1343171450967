"""Cell clean-up, address and password expressions."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import INTERNAL_SUFFIXES


def blank_to_null(column: Column, tokens) -> Column:
    """NULL where the whole cell is one of ``tokens``."""
    return F.when(~column.isin(list(tokens)), column)


def default_if_empty(column: Column, value) -> Column:
    """The cell, or ``value`` where it is NULL or the empty string."""
    return F.coalesce(F.nullif(column, F.lit("")), value if isinstance(value, Column) else F.lit(value))


def match_key(column: Column) -> Column:
    """What case-insensitive comparisons compare."""
    return F.upper(column)


def strip(column: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(column, F.lit(" \t\n\r\x0b\x0c"))


def domain_of(email: Column) -> Column:
    """Text after the last ``@``; the whole text where there is none."""
    return F.substring_index(email, "@", -1)


def is_internal(email: Column, suffixes=None) -> Column:
    """Does the address (or bare domain) end with a suffix of the organisation? Case does not matter."""
    lowered = F.lower(email)
    tests = [lowered.endswith(suffix) for suffix in (INTERNAL_SUFFIXES if suffixes is None else suffixes)]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def is_external(email: Column, suffixes=None) -> Column:
    return ~is_internal(email, suffixes)


def mask(secret: Column) -> Column:
    """First and the last two characters with ``*`` between; shorter than four stays as it is."""
    length = F.char_length(secret)
    starred = F.concat(F.substring(secret, 1, 1), F.repeat(F.lit("*"), length - 3), F.substring(secret, -2, 2))
    return F.when(length >= 4, starred).otherwise(secret)


# A practical subset of the address grammar: dot-atom local part (other scripts allowed), dotted host name
# whose last character is an ASCII letter.
_ATOM = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~\x{80}-\x{10FFFF}-]+"
_LABEL = r"[A-Za-z0-9\x{80}-\x{10FFFF}](?:[A-Za-z0-9\x{80}-\x{10FFFF}-]*[A-Za-z0-9\x{80}-\x{10FFFF}])?"
EMAIL_PATTERN = rf"^{_ATOM}(?:\.{_ATOM})*@(?:{_LABEL}\.)+(?:[A-Za-z0-9][A-Za-z0-9-]*)?[A-Za-z]$"


def email_is_valid(email: Column) -> Column:
    """Syntax check only; NULL counts as not valid."""
    local = F.substring_index(email, "@", 1)
    fits = (F.char_length(email) <= 254) & (F.char_length(local) <= 64)
    return F.coalesce(email.rlike(EMAIL_PATTERN) & fits, F.lit(False))


def normalize_email(email: Column) -> Column:
    """The stored form: no outer white space, no ``Name <...>`` wrapping, lower-case host."""
    unwrapped = F.when(F.contains(email, F.lit("<")), F.regexp_replace(email, r"^[\w ]*? *<(.*)> *$", "$1"))
    bare = strip(F.coalesce(unwrapped, email))
    local = F.substring_index(bare, "@", 1)
    return F.concat(local, F.lower(F.substring(bare, F.char_length(local) + 1, F.char_length(bare))))


_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_H = r"[0-9A-Fa-f]{1,4}"


def _ipv6_pattern() -> str:
    # 8 groups; or `::` standing for the missing ones; the last two groups may be dotted.
    tail = rf"(?:{_H}:{_H}|{_V4})"
    shapes = [rf"(?:{_H}:){{6}}{tail}"]
    for before in range(0, 8):
        head = rf"(?:{_H}(?::{_H}){{0,{before - 1}}})?" if before else ""
        after = 6 - before
        ends = [rf"(?:{_H}:){{{n}}}{tail}" for n in range(0, after)] + ([_H, ""] if before < 7 else [""])
        shapes.append(rf"{head}::(?:{'|'.join(ends)})")
    return "|".join(shapes)


IP_PATTERN = rf"^(?:{_V4}|{_ipv6_pattern()})$"


def ip_is_valid(ip: Column) -> Column:
    """Both address families; text without a colon need only be tried against the short pattern."""
    return F.when(F.contains(ip, F.lit(":")), ip.rlike(IP_PATTERN)).otherwise(ip.rlike(f"^{_V4}$"))


def flag(column: Column) -> Column:
    """``t``/``f`` and the other boolean spellings; other text gives NULL."""
    return column.try_cast("boolean")


def unequal_null_key(value: Column, is_null: Column, unique: Column) -> Column:
    """A text that equals another row's only if ``value`` does and ``is_null`` holds for neither.

    SQL ``=`` never matches NULL but grouping does. With this as the last key column, rows whose key
    holds a NULL get a text of their own (``unique`` tells rows apart), so one grouping serves all rows
    and no NULL group can grow without bound.
    """
    return F.when(is_null, F.concat(F.lit("\u0000"), unique.cast("string"))).otherwise(F.concat(F.lit("="), value))
