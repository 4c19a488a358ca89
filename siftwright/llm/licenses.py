"""Problem 5: which licence each source file and each repository states.

A multi-pattern automaton finds, in one pass over a file's words, the clauses of
the known licences, their names in all spellings and the phrases that introduce
a statement.  Ordered rules then decide: the clauses of a full text, of a short
notice, an identifier or a sentence with a name (with versions, "or later",
several names joined by "or"/"and", and exceptions behind "with"), and last terms
that fit no known licence.  A name without such an introduction is a mere mention.

The known licences come from a reference table of checked size, which the driver
reads; everything else is one scan and, for repositories, one small aggregation.

Defined results: null, empty and blank contents state nothing.  A recorded
licence that is null, empty, blank or NOASSERTION compares as unknown, and so
does ``OTHER``.  Repeated rows are answered each; extra columns are ignored; a
reference row with null texts is found by its names only.  A file named as a
licence whose terms fit none consists of terms of its own, ``OTHER``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shares of a text's clauses that must be found: a file may be cut off after half of a full text.
BODY_SHARE, NOTICE_SHARE = 0.35, 0.7
OTHER = "OTHER"

#: The names of the licence families, to which versions are added.
FAMILIES = {
    "Apache": ("apache", "asl", "apache license", "apache software license"),
    "GPL": ("gpl", "gnu gpl", "gnu general public license", "general public license"),
    "LGPL": ("lgpl", "gnu lgpl", "gnu lesser general public license", "lesser general public license", "gnu library general public license"),
    "AGPL": ("agpl", "gnu agpl", "gnu affero general public license", "affero general public license"),
    "MPL": ("mpl", "mozilla public license"),
    "EPL": ("epl", "eclipse public license"),
    "EUPL": ("eupl", "european union public license"),
}
#: Names of licences without versions.
PLAIN_NAMES = {
    "MIT": ("mit", "mit license", "expat", "expat license", "mit expat license", "expat mit license", "mit expat"),
    "ISC": ("isc", "isc license"),
    "BSD-2-Clause": ("bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd license", "bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "two clause bsd license"),
    "BSD-3-Clause": ("bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "revised bsd license", "three clause bsd license"),
}
#: What introduces a statement; a licence's name must follow at once.
CUES = (
    "spdx license identifier", "@license", "pylicense", "jsonlicense", "license type", "terms url",
    "under", "under the terms of", "under the terms and conditions of", "is covered by", "covered by", "governed by", "subject to the terms of",
    "choose between", "dual licensed", "licensed as",
)
#: Cues after which an unknown name is a licence all the same.
STRICT_CUES = ("spdx license identifier", "@license", "pylicense", "jsonlicense", "terms url")
#: Terms that keep others out, in the words of such notices everywhere.
OWN_TERMS = (
    "proprietary and confidential", "no license is granted", "no license granted", "for internal use by", "for internal use only", "redistribution is not allowed", "redistribution is not permitted",
    "redistribution is prohibited", "redistribution prohibited", "distribution is prohibited", "jsonlicense unlicensed", "all rights reserved do not", "licenseref", "not licensed for redistribution", "not for redistribution",
)
#: A permission for some only.
_SOME_ONLY = re.compile(r" (?:may|can|must|shall) (?:not )?(?:only )?be (?:used|copied|shared|distributed|redistributed|modified) (?:by|within|inside|at|for)(?: \S+){1,12}? only ")
#: Exceptions that licences are joined with, by their SPDX names, as notices spell them.
EXCEPTIONS = {
    "Autoconf-exception-2.0": ("autoconf exception 2.0", "autoconf exception"),
    "Bison-exception-2.2": ("bison exception 2.2", "bison exception"),
    "Classpath-exception-2.0": ("classpath exception 2.0", "classpath exception", "the classpath exception"),
    "Font-exception-2.0": ("font exception 2.0", "font exception"),
    "GCC-exception-3.1": ("gcc exception 3.1", "gcc runtime library exception", "runtime library exception"),
    "LLVM-exception": ("llvm exception", "llvm exceptions"),
    "Linux-syscall-note": ("linux syscall note",),
    "OpenSSL-exception": ("openssl exception", "openssl linking exception"),
    "Qt-GPL-exception-1.0": ("qt gpl exception 1.0", "qt gpl exception"),
    "Linking-exception": ("linking exception", "static linking exception", "special linking exception"),
}
_FILLERS = {"the", "a", "an", "either", "both", "license", "of", "terms", "under"}
_JOINS = {"or", "and", "|", "with"}
#: A file that by its name is a licence.
_LICENSE_FILE = re.compile(r"(?i)^(?:un)?licen[cs]e(?:$|[-._ ])|^copying(?:$|[-._ ])")
#: Words from which on such a file has terms, and rows of references that the driver agrees to read.
LEAST_TERMS, MOST_REFERENCES = 20, 5000

_PY = re.compile(r"__licen[cs]e__")
_JSON = re.compile(r"[\"']licen[cs]e[\"']\s*[:=]>?")
_URL = re.compile(r"terms:?\s+https?://[^\s/]+(?:/[^\s/()]+)*/(?=[^\s/()]+)")
_TOKEN = re.compile(r"[a-z0-9@|][a-z0-9.+@]*")
_VERSION = re.compile(r"v?\d+(\.\d+)+")


def words_of(text: str) -> list[str]:
    """Lower-case words; marks of comments, wrapping and punctuation are gone, points and plus signs within words stay."""
    t = text.lower().replace("licence", "license")
    t = _PY.sub(" pylicense ", t)
    t = _JSON.sub(" jsonlicense ", t)
    t = _URL.sub(" terms url ", t)
    return [w.rstrip(".") for w in _TOKEN.findall(t)]


def version_spellings(family: str, version: str) -> Iterator[str]:
    """All spellings of a family's name with a version."""
    major = version.removesuffix(".0")
    for name in FAMILIES[family]:
        for v in dict.fromkeys((version, major)):
            for form in (v, "v" + v, "version " + v, "v " + v, "license " + v, "license v" + v, "license version " + v):
                yield f"{name} {form}"
            yield f"{name}v{v}"
            yield f"{name}{v}"


def names(spdx_id: str, extra: tuple[str, ...]) -> set[str]:
    found = {" ".join(words_of(x)) for x in (spdx_id, *extra) if x}
    found.update(PLAIN_NAMES.get(spdx_id, ()))
    family, _, version = spdx_id.partition("-")
    if family in FAMILIES and version:
        found.update(version_spellings(family, version))
    return {f"{n}{s}" for n in found for s in ("", "+", " only", " or later", " or any later version", " license", " license or later")}


def clauses(text: str | None) -> list[str]:
    return list(dict.fromkeys(c for part in re.split(r"[.,;:]\s", text or "") if len((c := " ".join(words_of(part))).split()) >= 5))


class Automaton:
    """All clauses, names and cues of the reference licences in one automaton over padded words."""

    def __init__(self, references: list[tuple[str, str | None, str | None, str | None, str | None]]):
        kinds: dict[str, list[tuple]] = {}
        self.sizes: dict[tuple[str, str], int] = {}
        for spdx, key, name, notice, body in references:
            for kind, text in (("notice", notice), ("body", body)):
                own = clauses(text)
                self.sizes[spdx, kind] = len(own)
                for c in own:
                    kinds.setdefault(c, []).append((kind, spdx))
            for n in names(spdx, (key or "", name or "")):
                kinds.setdefault(n, []).append(("name", spdx))
        for c in CUES:
            kinds.setdefault(c, []).append(("cue", c))
        for c in OWN_TERMS:
            kinds.setdefault(c, []).append(("own", c))
        for e, spellings in EXCEPTIONS.items():
            for c in spellings:
                kinds.setdefault(c, []).append(("exception", e))
        self.machine = ahocorasick.Automaton()
        for phrase, what in kinds.items():
            self.machine.add_word(f" {phrase} ", (len(phrase) + 2, tuple(what)))
        self.machine.make_automaton()

    def statements(self, content: str, file_name: str = "") -> tuple[dict[str, set[str]], bool]:
        """(licences the content states, each with its exceptions; whether it consists of a licence's text)."""
        words = words_of(content)
        text = f" {' '.join(words)} "
        found: dict[tuple[str, str], set[str]] = {}
        name_at: dict[int, tuple[int, str]] = {}
        exception_at: dict[int, tuple[int, str]] = {}
        cues: list[tuple[int, int, str]] = []
        own = False
        for last, (length, what) in self.machine.iter(text):
            start, end = last - length + 1, last
            for kind, value in what:
                if kind in ("name", "exception"):
                    at = name_at if kind == "name" else exception_at
                    if at.get(start, (0, ""))[0] < end:
                        at[start] = (end, value)
                elif kind == "cue":
                    cues.append((start, end, value))
                elif kind == "own":
                    own = True
                else:
                    found.setdefault((value, kind), set()).add(text[start:end])
        whole = {s for (s, kind), hits in found.items() if kind == "body" and len(hits) >= max(2, BODY_SHARE * self.sizes[s, kind])}
        held = {c for s in whole for c in found[s, "body"]}
        # a full text names other licences and its own clauses as it likes
        if whole and 2 * sum(len(c.split()) for c in held) >= len(words):
            return {s: set() for s in whole}, True
        stated: dict[str, set[str]] = {s: set() for s in whole}
        for (s, kind), hits in found.items():
            if kind == "notice" and len(hits) >= max(2, NOTICE_SHARE * self.sizes[s, kind]):
                stated.setdefault(s, set())
        own = own or bool(_SOME_ONLY.search(text))
        for _, end, cue in cues:
            got = self._names_from(text, end, name_at, exception_at)
            for spdx, exceptions in got.items():
                stated.setdefault(spdx, set()).update(exceptions)
            if not got and cue in STRICT_CUES and not own and self._names_unknown(text, end):
                stated.setdefault(OTHER, set())
        for spdx in self._piped(text, name_at):
            stated.setdefault(spdx, set())
        known = set(stated) - {OTHER}
        if known:
            stated.pop(OTHER, None)
        elif own:
            stated.setdefault(OTHER, set())
        if not known and _LICENSE_FILE.match(file_name or "") and len(words) >= LEAST_TERMS:
            return {OTHER: set()}, True
        return stated, False

    def _names_from(self, text: str, at: int, name_at: dict[int, tuple[int, str]], exception_at: dict[int, tuple[int, str]]) -> dict[str, set[str]]:
        """Names that follow a position, joined by or/and, each with the exceptions that follow it; ``at`` is a blank."""
        got: dict[str, set[str]] = {}
        now = ""
        while True:
            if at in name_at:
                at, now = name_at[at]
                got.setdefault(now, set())
            elif now and at in exception_at:
                at, exception = exception_at[at]
                got[now].add(exception)
            else:
                nxt = text.find(" ", at + 1)
                word = text[at + 1 : nxt] if nxt > 0 else ""
                if not got and word in _FILLERS or got and (word in _JOINS or word in _FILLERS):
                    at = nxt
                    continue
                return got

    @staticmethod
    def _names_unknown(text: str, at: int) -> bool:
        return bool(text[at + 1 : at + 40].split())

    @staticmethod
    def _piped(text: str, name_at: dict[int, tuple[int, str]]) -> set[str]:
        """A banner of the form: project 1.2 | licence | year."""
        got = set()
        for start, (_, spdx) in name_at.items():
            if text[max(0, start - 2) : start] == " |":
                before = text[max(0, start - 40) : start - 2].split()
                if before and _VERSION.fullmatch(before[-1]):
                    got.add(spdx)
        return got


_BUILT: dict[int, Automaton] = {}


def automaton(references: list[tuple]) -> Automaton:
    key = hash(tuple(references))
    if key not in _BUILT:
        _BUILT[key] = Automaton(references)
    return _BUILT[key]


def stated_licenses(files: DataFrame, references: DataFrame) -> DataFrame:
    """``id, repo_name, repo_license, spdx_id, exceptions, full`` for each licence a file of ``files`` states."""
    columns = ("spdx_id", "license_key", "name", "notice", "body")
    refs = [tuple(r) for r in references.where(F.col("spdx_id").isNotNull()).select(*columns).limit(MOST_REFERENCES + 1).collect()]
    if len(refs) > MOST_REFERENCES:
        raise ValueError(f"more than {MOST_REFERENCES} reference licences")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = automaton(refs)
        for pdf in batches:
            rows = []
            for i, repo, recorded, name, content in zip(pdf["id"], pdf["repo_name"], pdf["repo_license"], pdf["file_name"], pdf["content"]):
                stated, full = machine.statements(content, name)
                rows += [(i, repo, recorded, s, sorted(e), full) for s, e in sorted(stated.items())]
            yield pd.DataFrame(rows, columns=["id", "repo_name", "repo_license", "spdx_id", "exceptions", "full"])

    some = files.where(F.length("content") > 0).select("id", "repo_name", "repo_license", "file_name", "content")
    return some.mapInPandas(run, "id bigint, repo_name string, repo_license string, spdx_id string, exceptions array<string>, full boolean")


def _verdict(spdx, recorded, agrees):
    blank = F.coalesce(F.trim(F.lower(recorded)), F.lit("")).isin("", "noassertion")
    return F.when((spdx == OTHER) | blank, "unknown").when(agrees, "agree").otherwise("conflict")


def license_verdicts(files: DataFrame, references: DataFrame) -> DataFrame:
    """``scope, subject, spdx_id, verdict`` for files and repositories.

    A file's statements are few and stand in adjacent rows, so they are compared
    in arrays; repositories aggregate only the rows of full licence texts, and
    partially before the shuffle, so that a hot repository costs nothing.
    """
    stated = stated_licenses(files, references)
    recorded = F.trim(F.lower(F.col("repo_license")))
    per_file = stated.groupBy("id", "repo_name", "repo_license").agg(F.collect_set("spdx_id").alias("ids"), F.max("full").alias("full"))
    compared = per_file.withColumn("agrees", F.exists("ids", lambda s: F.lower(s) == recorded)).withColumn("spdx_id", F.explode("ids"))
    rows = compared.select("id", "repo_name", "spdx_id", "full", _verdict(F.col("spdx_id"), F.col("repo_license"), F.col("agrees")).alias("verdict"))
    both = rows.select(F.explode(F.array(
        F.struct(F.lit("file").alias("scope"), F.col("id").cast("string").alias("subject"), "spdx_id", "verdict", F.lit(True).alias("keep")),
        F.struct(F.lit("repo").alias("scope"), F.col("repo_name").alias("subject"), "spdx_id", "verdict", F.col("full").alias("keep")),
    )).alias("r")).select("r.*").where("keep")
    # of several verdicts on one repository and licence the firmest holds: agree, conflict, unknown
    return both.groupBy("scope", "subject", "spdx_id").agg(F.min("verdict").alias("verdict"))
