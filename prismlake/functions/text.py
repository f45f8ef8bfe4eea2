"""Text expressions with the folding and matching rules of the media library: A-Z fold, nothing else does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A control character that no pattern uses: % and _ act as wildcards, nothing escapes them.
NO_ESCAPE = "\x01"


def fold(c: Column) -> Column:
    """ASCII lower case."""
    return F.translate(c, UPPER, LOWER)


def contains_like(c: Column, term: str) -> Column:
    """`c LIKE %term%` under ASCII folding; a null is no match."""
    pattern = "%" + term.translate(str.maketrans(UPPER, LOWER)) + "%"
    return F.coalesce(F.like(fold(c), F.lit(pattern), F.lit(NO_ESCAPE)), F.lit(False))


def extension(name: Column) -> Column:
    """The lower-cased extension of a file name without its dot; '' for none and for a name that only starts with a dot."""
    return fold(F.regexp_extract(name, r"^.+\.([^./\\]*)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def stem(name: Column) -> Column:
    return F.when(F.regexp_extract(name, r"^.+\.([^./\\]*)$", 1) != "", F.regexp_extract(name, r"^(.+)\.[^./\\]*$", 1)).otherwise(name)


def within(path: Column, root: Column) -> Column:
    """Whether a path is a folder or lies in it: the prefix ends at a separator or at the end."""
    rest = F.substring(path, F.length(root) + 1, F.lit(1))
    return F.startswith(path, root) & (rest.isin("", "/", "\\") | root.endswith("/"))


def clean_path(path: Column) -> Column:
    """Without blanks and quotes around it, the verbatim prefix and trailing separators; a bare root stays."""
    trimmed = F.regexp_replace(F.btrim(path, F.lit(" \t\r\n\"'")), r"^\\\\\?\\", "")
    return F.when(trimmed.rlike(r"^[/\\]+$"), F.substring(trimmed, 1, 1)).otherwise(F.regexp_replace(trimmed, r"[/\\]+$", ""))


def byte_label(n: Column) -> Column:
    """Bytes as MB with one digit, or GB or TB with two."""
    gb, tb = float(1 << 30), float(1 << 40)
    number = lambda x, d: F.regexp_replace(F.format_number(x, d), ",", "")
    return F.when(n >= tb, F.concat(number(n / tb, 2), F.lit(" TB"))).when(n >= gb, F.concat(number(n / gb, 2), F.lit(" GB"))).otherwise(F.concat(number(n / float(1 << 20), 1), F.lit(" MB")))


def log_level(level: Column) -> Column:
    known = fold(level)
    return F.when(known == "fatal", "FATAL").when(known == "error", "ERROR").otherwise("WARN")


def log_source(source: Column) -> Column:
    """The first 48 of the letters, digits, dashes, underscores, dots and colons of a source; `frontend` if none is left."""
    kept = F.substring(F.regexp_replace(source, r"[^A-Za-z0-9_.:-]", ""), 1, 48)
    return F.when(kept == "", "frontend").otherwise(kept)


def log_message(message: Column) -> Column:
    """At most 2,000 characters, control characters as blanks."""
    return F.substring(F.regexp_replace(message, r"[\x00-\x1F\x7F]", " "), 1, 2000)


def is_alert(line: Column) -> Column:
    return line.contains("[WARN ") | line.contains("[ERROR") | line.contains("[FATAL")
