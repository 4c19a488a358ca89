"""Comment removal by language, as columns.

Each family of languages has patterns that are removed one after the other.  The
default keeps the patterns' known peculiarities (some ordinary comments stay);
``strict=True`` removes what the languages really call comments.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import SPACE

#: Patterns of each family, in order, with what replaces a match.
PATTERNS: dict[str, tuple[tuple[str, str], ...]] = {
    "c_like": ((r"/\*[\S\s]*?\*/", ""), (r"\\{2}.*.*", "")),
    "python": ((r"#.*\\n", ""), (r'"{3}([\S\s]*?)"{3}', "")),
    "erlang": ((r"%.*", ""),),
    "julia": ((r"#=([\S\s]*?)=#", ""), (r"#.*", "")),
    "lisp": ((r";.*", ""),),
    "fortran": ((r"!.*", ""),),
    "cobol": ((r"(^|\n).{6}(\*|/).*", "\n"), (r"\*>.*", "")),
    "html": ((r"<!--([\S\s]*?)-->", ""),),
    "matlab": ((r"%\{([\S\s]*?)%\}", ""), (r"%.*", "")),
    "webassembly": ((r"\(;([\S\s]*?);\)", ""), (r";;.*", "")),
    "assembly": ((r";.*", ""),),
    "ruby": ((r"#.*", ""), (r"=begin([\S\s]*?)=end", "")),
    "ada": ((r"--.*", ""),),
    "d": ((r"/\*\*[\S\s]*?\*/", ""), (r"/\+\+[\S\s]*?\+/", ""), (r"///.*", "")),
    "forth": ((rf"\\[{SPACE}].*", ""), (rf"\([{SPACE}][\s\S]*?[{SPACE}]\)", "")),
    "lua": ((r"--\[\[[\s\S]*?\]\]", ""), (r"--.*", "")),
    "perl": ((r"=[\s\S]*?=cut", ""), (r"#.*", "")),
    "prolog": ((r"%.*", ""), (r"/\*[\s\S]*?\*/", "")),
    "raku": ((r"#'\([\s\S]*?\)", ""), (r"#'\{[\s\S]*?\}", ""), (r"#'\[[\s\S]*?\]", ""), (r"#'\<[\s\S]*?\>", ""), (r"#.*", "")),
    "sql": ((r"/\*[\s\S]*?\*/", ""), (r"--.*", "")),
}
#: Families with nested comments: opening, closing, and patterns that follow.
NESTED: dict[str, tuple[str, str, tuple[tuple[str, str], ...]]] = {
    "mathematica": ("(*", "*)", ()),
    "agda": ("{-", "-}", ((r"--.*", ""),)),
    "coq": ("(*", "*)", ()),
    "f_sharp": ("(*", "*)", ((r"//.*", ""),)),
}
#: What the languages of some families really call comments.
STRICT: dict[str, tuple[tuple[str, str], ...]] = {
    "c_like": ((r"/\*[\S\s]*?\*/", ""), (r"//.*", "")),
    "python": ((r"#.*", ""), (r'"{3}([\S\s]*?)"{3}', "")),
}
#: The languages of each family, in lower case.
LANGUAGES: dict[str, tuple[str, ...]] = {
    "c_like": ("java", "c", "cpp", "c++", "c#", "csharp", "c-sharp", "javascript", "typescript", "objective-c", "go", "kotlin", "vue", "scala", "dart", "rust", "hack", "less", "groovy", "processing", "apex", "cuda", "scilab", "antlr", "swift", "php"),
    "python": ("python", "r", "elixir", "nix", "starlark", "graphql", "crystal"),
    "ada": ("ada",),
    "agda": ("agda", "elm"),
    "assembly": ("assembly", "netlogo", "scheme"),
    "cobol": ("cobol",),
    "coq": ("coq", "ocaml"),
    "d": ("d",),
    "erlang": ("erlang",),
    "f_sharp": ("f#",),
    "forth": ("forth",),
    "fortran": ("fortran",),
    "julia": ("julia",),
    "lua": ("lua",),
    "mathematica": ("mathematica",),
    "matlab": ("matlab",),
    "perl": ("perl",),
    "prolog": ("prolog",),
    "raku": ("raku",),
    "ruby": ("ruby",),
    "sql": ("sql",),
    "webassembly": ("webassembly",),
}
FAMILIES = (*PATTERNS, *NESTED)
#: Nested delimiters up to which a text's are followed by an expression.
MOST_MARKS = 1000


def _unix_lines(pattern: str) -> str:
    """A point must stop at line feeds only."""
    return "(?d)" + pattern


def outside_nested(text: str, opening: str, closing: str) -> str:
    """Text outside nested delimiters, read from left to right.

    An opening delimiter deepens before it is judged, a closing one is never
    kept, and what stands at depth 0 or above ground is kept, so that after a
    stray closing the next opening delimiter stays.
    """
    depth, kept, at = 0, [], 0
    for m in re.finditer(f"{re.escape(opening)}|{re.escape(closing)}", text):
        if depth <= 0:
            kept.append(text[at : m.start()])
        at = m.end()
        if m.group() == opening:
            depth += 1
            if depth <= 0:
                kept.append(opening)
        else:
            depth -= 1
    if depth <= 0:
        kept.append(text[at:])
    return "".join(kept)


def _walked(text: Column, opening: str, closing: str) -> Column:
    """``outside_nested`` as an expression: the pieces between delimiters in turn, with the depth before each."""
    marks = f"{re.escape(opening)}|{re.escape(closing)}"
    pieces, found = F.split(text, marks, -1), F.regexp_extract_all(text, F.lit(marks), 0)

    def walk(acc: Column, x: Column) -> Column:
        depth = acc["depth"] + F.when(x["mark"] == opening, 1).when(x["mark"] == closing, -1).otherwise(0)
        kept = F.concat(acc["kept"], F.when(acc["depth"] <= 0, x["piece"]).otherwise(""), F.when((x["mark"] == opening) & (depth <= 0), opening).otherwise(""))
        return F.struct(depth.alias("depth"), kept.alias("kept"))

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("kept"))
    # one piece more than delimiters: the last has none
    steps = F.zip_with(pieces, found, lambda piece, mark: F.struct(piece.alias("piece"), F.coalesce(mark, F.lit("")).alias("mark")))
    return F.aggregate(steps, start, walk, lambda acc: acc["kept"])


def remove_nested(text: Column, opening: str, closing: str, where: Column | None = None) -> Column:
    """Text outside nested delimiters, where the condition ``where`` holds; elsewhere of no defined value.

    The expression copies what it keeps at each delimiter, so texts with more
    than ``MOST_MARKS`` go to Python, which takes time in proportion to their length.
    """

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: outside_nested(t, opening, closing) if isinstance(t, str) else None).astype(object)

    some = F.contains(text, F.lit(opening)) | F.contains(text, F.lit(closing))
    some = some if where is None else where & some
    many = some & (F.regexp_count(text, F.lit(f"{re.escape(opening)}|{re.escape(closing)}")) > MOST_MARKS)
    # Python sees the texts meant for it only: the condition stands within its argument
    return F.when(many, F.pandas_udf(run, StringType())(F.when(many, text))).when(some, _walked(text, opening, closing)).otherwise(text)


def strip_comments(text: Column, family: str, strict: bool = False, nested_last: bool = False, where: Column | None = None) -> Column:
    """The text without the comments of a family; ``nested_last`` removes line comments before nested ones, and ``where`` is a condition on which alone the result is used."""
    if family in NESTED:
        opening, closing, rest = NESTED[family]
        if nested_last:
            for pattern, to in rest:
                text = F.regexp_replace(text, _unix_lines(pattern), to)
            return remove_nested(text, opening, closing, where)
        text = remove_nested(text, opening, closing, where)
    else:
        rest = STRICT.get(family, PATTERNS[family]) if strict else PATTERNS[family]
    for pattern, to in rest:
        text = F.regexp_replace(text, _unix_lines(pattern), to)
    return text


def families_of(languages: list[str]) -> list[str]:
    """Families that apply to a file of several possible languages, in the languages' order."""
    of = {name: family for family, names in LANGUAGES.items() for name in names}
    return [of[n.lower()] for n in languages if n.lower() in of]


def strip_by_extension(text: Column, extension: Column, languages: dict[str, list[str]], strict: bool = False, nested_last: bool = False) -> Column:
    """Each text without the comments of all languages of its extension.

    ``languages`` maps an extension to its languages in order.  Extensions that
    need the same families share a branch, and a row evaluates one branch only.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for ending, names in languages.items():
        if families := tuple(families_of(names)):
            groups.setdefault(families, []).append(ending)
    out = None
    for families, endings in groups.items():
        stripped, condition = text, extension.isin(*endings)
        for family in families:
            stripped = strip_comments(stripped, family, strict, nested_last, condition)
        out = F.when(condition, stripped) if out is None else out.when(condition, stripped)
    return text if out is None else out.otherwise(text)
