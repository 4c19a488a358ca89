"""Text functions as native columns, with one meaning of white space, letters and lines throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space of Unicode text processing, U+001C to U+001F included, as a character class.
SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def without_space(text: Column) -> Column:
    """The text without any white space."""
    return F.regexp_replace(text, f"[{SPACE}]+", "")


def strip(text: Column) -> Column:
    """The text without white space at either end."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+\\z", "")


def normalise(text: Column) -> Column:
    """What is compared between corpora: no white space, no letter case."""
    return without_space(F.lower(text))


def word_count(text: Column) -> Column:
    """Number of runs without white space."""
    return F.size(F.regexp_extract_all(text, F.lit(f"([^{SPACE}]+)"), 1))


def path_extension(path: Column) -> Column:
    """What follows the last point, in lower case, with a point before it; all of a path without a point."""
    return F.concat(F.lit("."), F.lower(F.regexp_replace(path, r"(?s)^.*\.", "")))


def base_name(path: Column) -> Column:
    return F.regexp_replace(path, r"(?s)^.*/", "")


def base_stem(path: Column) -> Column:
    """The base name without its last extension; a leading point is part of the name."""
    name = base_name(path)
    return F.when(name.rlike(r"(?s)^.+\.[^.]*\z") & ~name.rlike(r"(?s)^\.+[^.]*\z"), F.regexp_replace(name, r"(?s)\.[^.]*\z", "")).otherwise(name)


def repo_folder(full_name: Column) -> Column:
    """Folder of a checked-out repository: points and slashes become underscores."""
    return F.translate(full_name, "./", "__")


def lines_of(text: Column) -> Column:
    """Lines, cut at line feeds only, without those that are blank."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))


def line_stats(text: Column) -> dict[str, Column]:
    """Statistics of the non-blank lines; averages are null where there is none."""
    lines = lines_of(text)
    n = F.size(lines)
    whole = F.aggregate(lines, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    inner = F.aggregate(lines, F.lit(0).cast("bigint"), lambda a, x: a + F.length(strip(x)))
    alnum = F.aggregate(lines, F.lit(0).cast("bigint"), lambda a, x: a + F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]+", "")))
    return {
        "total_lines": n.cast("bigint"),
        "avg_line_length": F.when(n > 0, inner.cast("double") / n),
        "max_line_length": F.coalesce(F.array_max(F.transform(lines, F.length)), F.lit(0)).cast("bigint"),
        "alphanum_fraction": F.when(whole > 0, alnum.cast("double") / whole),
    }


def hash_64(text: Column) -> Column:
    """The first 8 bytes of a text's SHA-256 as a number, the least byte first, in 16 hexadecimal digits, so that it compares as the number does."""
    hexed = F.sha2(text, 256)
    return F.concat(*[F.substring(hexed, k, 2) for k in range(15, 0, -2)])
