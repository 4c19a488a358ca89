"""Problem 4: credentials embedded in source code.

Candidates are values that stand where credentials do: after a name, in the
user part of a URL, in a connection string, after an authorisation scheme, in a
key block, or with an issuer's prefix.  A logistic regression scores each on the
likelihood of its characters under a Markov model of the corpus' own words, on
its shape, the identifiers around it and the file's path.  Its labels are weak:
unmistakable patterns of values, and plain words, placeholders, references and
digests on the other side; where patterns do not tell they abstain, and the
model alone decides.  Scores are calibrated on labelled candidates held out from
the fit, and the threshold is set there.  High scores are reported and can be
redacted in place.

The Markov model counts all files.  The regression is fitted on the candidates
of a bounded sample of files (``SAMPLE_FILES``, by a hash of the id, and
``SAMPLE_CANDIDATES``); scoring covers every file whole.

Defined results: null, empty and blank contents hold none; a value that stands
several times in a file is one row; repeated files are answered each; extra
columns are ignored; a table without any candidate gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: Files, and candidates in them, that the regression is fitted on at most, or little more; documented bounds, as the driver holds the candidates.
SAMPLE_FILES, SAMPLE_CANDIDATES = 6000, 50_000
#: Of the labelled candidates every so many is held out for calibration.
HELD_OUT = 4
ROUNDS, RIDGE = 40, 1e-2

_STEMS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "jwt", "cred", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "npm_", "glpat-", "_live_", "xox", "eyj", "basic", "://", "aiza", "sg.", "pw", "login", " -u ", "--user")

_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----.*?-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----", re.S)
_URL = re.compile(r"\b[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@\"'<>]*:([^\s@\"'/<>]+)@")
_USER = re.compile(r"(?<![\w-])(?:-u|--user)[ =]+[\"']?[\w.@+-]+:([^\s\"'`]+)")
_CONNECTION = re.compile(r"(?i)(?<=[;\"' ])(?:pwd|password)=([^;\"'\s]+)(?=;)")
_SCHEME = re.compile(r"(?i)\b(basic|bearer|token)\s+([A-Za-z0-9+/._~-]{8,}={0,2})(?![A-Za-z0-9+/._~-])")
#: Prefixes by which issuers mark their tokens.
_ISSUED = re.compile(
    r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|npm_[A-Za-z0-9]{20,}|glpat-[A-Za-z0-9_-]{18,}"
    r"|[srp]k_(?:live|test)_[A-Za-z0-9]{16,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|SG\.[A-Za-z0-9_.-]{20,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)"
)
_PUBLIC = re.compile(r"-----BEGIN (?![A-Z0-9 ]*PRIVATE)[A-Z0-9 ]+-----.*?(?:-----END [A-Z0-9 ]+-----|\Z)", re.S)
_PREFIXES = ("akia", "asia", "gh", "npm_", "glpat-", "k_live_", "k_test_", "xox", "aiza", "eyj", "sg.")
_HIT = re.compile(r"pass|pwd|pw\b|login|secret|token|key|auth|bearer|jwt|cred|sign|hdr|header|basic|_pat\b|credential")
#: A line on which a bare value may stand: a comment, a command line, an export.
_SAID = re.compile(r"\s*(?:#|//|--|;|\*|/\*|<!--|%|export\b|set\b|env\b|machine\b|REM\b)|.*\s--[\w-]+[= ]")
_NAME = r"(?P<name>[A-Za-z_][\w.-]*)"
_QUOTED = re.compile(_NAME + r"""(?P<q0>["'])?\]?\s*(?::=|=>|==?|:|,|\s)\s*(?:[ubrf]{1,2})?(?P<q>["'`])(?P<v>(?:\\.|(?!(?P=q))[^\\\n])*)(?P=q)""")
_BARE = re.compile(r"(?P<name>[A-Za-z_][\w.-]*)(?:[ \t]*(?::=|=>|=|:)[ \t]*|[ \t]+is[ \t]+)(?P<v>[^\s\"'`<>(){}\[\],;][^\s\"'`,;]*)")
#: A sentence that says what something is, after whatever stands before it on its line.
_IS = re.compile(r"(?P<name>[A-Za-z_][\w.-]*)[ \t]+is[ \t]+(?P<v>[^\s\"'`<>(){}\[\],;][^\s\"'`,;]*)")
_NETRC = re.compile(r"(?i)\b(?P<name>password|passwd|secret|account)\s+(?P<v>[^\s\"'`,;:=]{6,})\s*(?:\*/|-->)?$", re.M)

_STRONG = re.compile(r"(?i)passw|passwd|pwd\b|_pwd|pwd$|(?:^|[_.-])pw$|(?-i:[a-z]Pw$)|(?:^|[_.-])pass$|(?-i:[a-z]Pass$)|passphrase|secret|api_?-?key|apikey|auth_?-?token|access_?-?key|private_?-?key|bearer|jwt|cred(?:s|ential)|(?:^|[_.-])token$|(?-i:[a-z]Token$)|^TOKEN$|_TOKEN$|(?-i:[a-z]Pwd$)")
_WEAK = re.compile(r"(?i)key(?:_?-?id)?$|login$|_pat$|auth|token|(?:^|[_.-])pass(?:$|[_.-])|signing|sign(?:er)?$|hdr|header")
_UNLIKE = re.compile(r"(?i)sha\d*|hash|digest|commit|checksum|etag|uuid|guid|integrity|nonce|public|verify|fingerprint|revision|version|license|file|path|name$|label|title|color|row_?key|primary|foreign")
_PLACEHOLDER = re.compile(
    r"(?i)^(?:x{3,}|\*{2,}|\.{2,}|-+|#+|0+|1234\w*|<.*>|\[.*\]|\$\{.*\}|\$\(.*\)|\{\{.*\}\}|\{.*\}|%\(?[A-Z_]+\)?s?%?|\$[A-Z_][A-Z0-9_]*|@@.*@@|your\b.*|your[-_].*|my[-_]?(?:password|secret|token|key)"
    r"|change[-_ ]?(?:me|it|this)\w*|replace[-_ ]?\w*|insert\b.*|enter\b.*|put\b.*|dummy\w*|example\w*|sample\w*|placeholder\w*|fake\w*|foo|bar|foobar|todo\w*|tbd|none|null|nil|undefined|true|false|redacted|hidden|removed|masked|n/?a|test(?:ing)?|secret|password|passwd|token|api[-_]?key|.*[-_]here|not[-_]?set|unset|default|admin|root|user|guest)$"
)
_REFERENCE = re.compile(r"(?i)os\.environ|os\.getenv|process\.env|\bENV\b|getenv|config[.\[]|settings[.\[]|vault|secrets?[./:]|\$\{|\{\{|%\(|env:|ssm:|arn:|kms:|file:|self\.|this\.|^[a-z_]\w*(?:\.[a-z_]\w*)+$|^[A-Za-z_][\w.]*\([^()]*\)?;?$|[:({]$|\(\)?$")
#: Names of assets, whose long values are encoded pictures and the like.
_ASSET = re.compile(r"(?i)font|logo|image|icon|sprite|svg|png|jpe?g|gif|thumb|avatar|glyph|picture|audio|wasm")
_UUID = re.compile(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
_DIGEST = re.compile(r"(?i)^(?:sha\d+|md5)[-:]|^[0-9a-f]{56,}$")
_HEX = re.compile(r"^[0-9a-f]{24,}$|^[0-9A-F]{24,}$")
_WORDS = re.compile(r"^[A-Za-z]*(?:[ _./-]+[A-Za-z]+)*[.!?]?$")
#: Words and numbers joined by slashes: a path, a route or a resource.
_PATH = re.compile(r"^/?(?:[A-Za-z_.-]+|\d+)(?:/(?:[A-Za-z_.-]+|\d+))+/?$")
_TESTS = re.compile(r"(?i)(?:^|/)(?:tests?|specs?|fixtures?|examples?|docs?|samples?)(?:/|$)")
_CONFIG = re.compile(r"(?i)\.(?:json|ya?ml|ini|properties|env|toml|conf|cfg)\s*$")

#: Characters from which on a value is as long as it may tell: keys and tokens are shorter, and so much longer ones mostly data.
LONG, LONGEST = 200, 1024
KINDS = ("pem", "url", "connection", "scheme", "issued", "quoted", "bare", "netrc")
#: Kinds that the regression tells apart.  Those whose values patterns know, it does not, so that it learns from them what credentials look like and are called.
PLACES = ("pem", "scheme")


@dataclass(frozen=True)
class Candidate:
    kind: str
    name: str
    value: str
    start: int


def candidates(content: str, config: bool = False) -> list[Candidate]:
    """Values that stand where credentials do; a stretch is taken once, by its most telling pattern.

    ``config``: the file is a list of settings, so that a value needs no quotes.
    """
    low = content.lower()
    if len(low) != len(content) or not any(s in low for s in _STEMS):
        low = content if len(low) != len(content) else low
        if not any(s in low for s in _STEMS):
            return []
    out: list[Candidate] = []
    taken: list[tuple[int, int]] = []

    def add(kind: str, name: str, value: str, start: int) -> None:
        end = start + len(value)
        if value and not any(s < end and start < e for s, e in taken):
            taken.append((start, end))
            out.append(Candidate(kind, name, value, start))

    if "-----begin" in low:
        for m in _PEM.finditer(content):
            add("pem", "", m.group(), m.start())
        # public keys and certificates are blocks, too, and no values
        taken.extend(m.span() for m in _PUBLIC.finditer(content))
    if "://" in content:
        for m in _URL.finditer(content):
            # a URL's place for it names a password as well as a name would
            add("url", "password", m[1], m.start(1))
            taken.append(m.span())
    if any(s in low for s in _PREFIXES):
        for m in _ISSUED.finditer(content):
            add("issued", _name_before(content, m.start()), m.group(), m.start())
    if " -u" in low or "--user" in low:
        for m in _USER.finditer(content):
            add("url", "password", m[1], m.start(1))
    done = -1
    for hit in _HIT.finditer(low):
        if hit.start() < done:
            continue
        start = content.rfind("\n", 0, hit.start()) + 1
        done = content.find("\n", hit.end())
        done = len(content) if done < 0 else done
        line = content[start:done]
        for m in _CONNECTION.finditer(line):
            add("connection", "password", m[1], start + m.start(1))
        for m in _SCHEME.finditer(line):
            add("scheme", m[1].lower(), m[2], start + m.start(2))
        for m in _QUOTED.finditer(line):
            if m["v"].strip():
                add("quoted", m["name"], m["v"], start + m.start("v"))
        if config or _SAID.match(line):
            for m in (*_IS.finditer(line), *_BARE.finditer(line)):
                if (_STRONG.search(m["name"]) or _WEAK.search(m["name"])):
                    add("bare", m["name"], m["v"].removesuffix("*/"), start + m.start("v"))
            for m in _NETRC.finditer(line):
                add("netrc", m["name"], m["v"], start + m.start("v"))
    return out


def _name_before(content: str, at: int) -> str:
    m = re.search(r"([A-Za-z_][\w.-]*)\W{0,6}(?:is\W+)?$", content[max(0, at - 60) : at])
    return m[1] if m else ""


class Markov:
    """Character bigrams of the corpus' words, with add-one smoothing."""

    ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 ?"
    #: Longer runs of letters are no words.
    LONGEST_WORD = 20

    def __init__(self, counts: np.ndarray):
        self.log = np.log((counts + 1) / (counts + 1).sum(axis=1, keepdims=True))
        self.at = {c: i for i, c in enumerate(self.ALPHABET)}

    @classmethod
    def count(cls, texts: list[str]) -> np.ndarray:
        """How often each character follows each other in words of ASCII letters, ends of words counted as blanks."""
        size, blank = len(cls.ALPHABET), cls.ALPHABET.index(" ")
        number = np.full(256, blank, dtype=np.int64)
        for c in range(26):
            number[ord("a") + c] = number[ord("A") + c] = c
        ids = number[np.frombuffer(" ".join(["", *texts, ""]).encode("utf-8", "replace"), dtype=np.uint8)]
        letters = ids != blank
        edges = np.flatnonzero(np.diff(letters.astype(np.int8)))
        starts, ends = edges[::2] + 1, edges[1::2] + 1
        for s, e in zip(starts[ends - starts > cls.LONGEST_WORD].tolist(), ends[ends - starts > cls.LONGEST_WORD].tolist()):
            ids[s:e] = blank
        pairs = ids[:-1] * size + ids[1:]
        counts = np.bincount(pairs, minlength=size * size)
        counts[blank * size + blank] = 0
        return counts

    def mean(self, value: str) -> float:
        """Mean log likelihood of a value's characters: low for random ones."""
        other = self.at["?"]
        ids = [self.at.get(c, other) for c in f" {value.lower()} "]
        return float(sum(self.log[a, b] for a, b in zip(ids, ids[1:])) / (len(ids) - 1))


def _plain(value: str) -> bool:
    """Words only, in any script."""
    return bool(_WORDS.match(value)) or not value.isascii() and all(ch.isalpha() or ch in " _./-,!?:" for ch in value)


def placeholder(value: str) -> bool:
    return bool(_PLACEHOLDER.match(value)) or len(set(value)) <= 2


def _asset(c: Candidate) -> bool:
    return len(c.value) > 64 and c.kind not in ("pem", "issued") and bool(_ASSET.search(c.name))


def _blob(c: Candidate) -> bool:
    """Longer than the longest keys are written: encoded data."""
    return len(c.value) > LONGEST and c.kind not in ("pem", "issued")


def features(c: Candidate, path: str, markov: Markov) -> list[float]:
    v, n = c.value, len(c.value)
    upper, lower, digit = sum(map(str.isupper, v)), sum(map(str.islower, v)), sum(map(str.isdigit, v))
    classes = (upper > 0) + (lower > 0) + (digit > 0) + (upper + lower + digit < n)
    words = c.kind not in ("pem", "url", "connection", "issued") and (_plain(v) or " " in v.strip())
    hexed = bool(_HEX.match(v))
    hollow = placeholder(v) or c.kind not in ("pem", "issued") and bool(_REFERENCE.search(v)) or bool(_PATH.match(v))
    strong, weak = bool(_STRONG.search(c.name)), bool(_WEAK.search(c.name))
    unlike = bool(_UNLIKE.search(c.name)) and not strong
    rare = min(0.0, markov.mean(v) + 3.0)
    mixed = not hollow and not words and digit + (n - upper - lower - digit) > 0
    return [
        1.0, rare, math.log(min(n, LONG)), float(n > LONG and c.kind != "pem"), float(_blob(c)), float(not v.isascii()), digit / n, upper / n, (n - upper - lower - digit) / n, float(classes),
        float(hollow), float(words), float(hexed), float(bool(_UUID.match(v))), float(bool(_DIGEST.match(v)) and c.kind != "pem"),
        float(strong), float(weak and not strong), float(unlike), float(strong and mixed), float(weak and mixed and not strong and not unlike), float(weak and hexed and not unlike), float((strong or weak) and hollow), float((strong or weak) and words),
        float(bool(_TESTS.search(path))), float(bool(_CONFIG.search(path))), float(_asset(c)),
        *[float(c.kind == k) for k in PLACES], float(c.kind in KINDS[:5] and hollow),
    ]


def weak_label(c: Candidate) -> int | None:
    """1 for an unmistakable pattern, 0 for what cannot be one, None where patterns do not tell."""
    v = c.value
    if c.kind == "pem":
        return 1
    if placeholder(v) or c.kind != "issued" and _REFERENCE.search(v) or _PATH.match(v) or _UUID.match(v) or _DIGEST.match(v) or _asset(c) or _blob(c):
        return 0
    if c.kind in ("url", "connection", "issued"):
        return 1
    strong, weak = _STRONG.search(c.name), _WEAK.search(c.name)
    if _plain(v) or " " in v or v.endswith((":", "(", "{", ".")):
        return 0
    if not strong and (_UNLIKE.search(c.name) or not weak and c.kind != "scheme"):
        return 0
    # long values of many kinds of characters after a telling name, and short ones of one kind after a weak one
    kinds = any(map(str.isdigit, v)) + any(map(str.isupper, v)) + any(map(str.islower, v)) + any(not ch.isalnum() for ch in v)
    if strong and len(v) >= 12 and kinds >= 3 or weak and len(v) >= 20 and (kinds >= 3 or _HEX.match(v)):
        return 1
    if kinds == 1 and len(v) < 8:
        return 0
    return None


def _newton(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of the largest penalised likelihood; ``y`` may be shares."""
    w = np.zeros(x.shape[1])
    for _ in range(ROUNDS if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (p - y) / len(y) + ridge / len(y) * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(y) + (ridge / len(y) + 1e-6) * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """Where cutting calibrated scores agrees best with the labels (by F1); of equals the cut nearest to one half, which also holds without labels of both kinds."""
    if not len(labels) or labels.min() == labels.max():
        return 0.5
    order = np.sort(np.unique(scores))
    cuts = np.append((order[1:] + order[:-1]) / 2, 0.5)
    f1 = np.array([2 * np.sum(labels[scores >= t]) / max(1, np.sum(scores >= t) + labels.sum()) for t in cuts])
    good = cuts[f1 >= f1.max() - 1e-9]
    return float(good[np.argmin(np.abs(good - 0.5))])


@dataclass
class Model:
    markov: Markov
    weights: np.ndarray
    #: Slope and offset of the calibration.
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5

    def score(self, c: Candidate, path: str) -> float:
        """Calibrated probability."""
        z = self.slope * float(np.dot(self.weights, features(c, path, self.markov))) + self.offset
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def fit(found: list[tuple[str, Candidate]], markov: Markov) -> Model:
    """The model from ``(path, candidate)``: Newton steps on labelled ones, calibration and threshold on labelled ones held out."""
    rows = [(features(c, path, markov), y, zlib.crc32(f"{c.name} {c.value}".encode("utf-8", "replace")) % HELD_OUT == 0) for path, c in found if (y := weak_label(c)) is not None]
    width = len(features(Candidate("quoted", "a", "abcd", 0), "", markov))
    x, y = np.array([r[0] for r in rows], dtype=float).reshape(-1, width), np.array([r[1] for r in rows], dtype=float)
    held = np.array([r[2] for r in rows], dtype=bool)
    w = _newton(x[~held], y[~held], RIDGE)
    z, t = x[held] @ w, y[held]
    if not len(t) or t.min() == t.max():
        return Model(markov, w)
    # targets drawn in from 0 and 1 by the numbers of cases, so that a clean separation does not make scores extreme
    few, many = 1 / ((t == 0).sum() + 2), 1 - 1 / (t.sum() + 2)
    slope, offset = _newton(np.stack([z, np.ones(len(z))], axis=1), np.where(t > 0, many, few), 1e-3)
    slope = max(float(slope), 1e-3)
    return Model(markov, w, slope, float(offset), best_threshold(1 / (1 + np.exp(-np.clip(slope * z + offset, -40, 40))), t))


def _path() -> Column:
    return F.coalesce("file_path", "file_name", F.lit("")).alias("path")


def train(files: DataFrame, sample_files: int = SAMPLE_FILES, most: int = SAMPLE_CANDIDATES) -> Model:
    """The model of ``files(id, file_path, file_name, content)``: one scan, which counts bigrams in all files and finds the candidates of the sampled ones."""
    every = max(1, -(-files.count() // sample_files))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(Markov.ALPHABET) ** 2, dtype=np.int64)
        for pdf in batches:
            total += Markov.count(pdf["content"].tolist())
            chosen = pdf[pdf["chosen"]]
            rows = [(None, None, path, c.kind, c.name, c.value) for path, content in zip(chosen["path"], chosen["content"]) for c in candidates(content, bool(_CONFIG.search(path)))]
            yield pd.DataFrame(rows, columns=["cell", "n", "path", "kind", "name", "value"])
        cells = np.flatnonzero(total)
        yield pd.DataFrame({"cell": cells, "n": total[cells], "path": None, "kind": None, "name": None, "value": None})

    chosen = (F.pmod(F.xxhash64("id"), F.lit(every)) == 0).alias("chosen")
    seen = checkpointed(files.where(F.length("content") > 0).select(_path(), "content", chosen).mapInPandas(run, "cell int, n bigint, path string, kind string, name string, value string"))
    counts = np.zeros(len(Markov.ALPHABET) ** 2)
    # as many rows as there are pairs of characters
    for cell, n in seen.where(F.col("cell").isNotNull()).groupBy("cell").agg(F.sum("n")).collect():
        counts[cell] = n
    picked = seen.where(F.col("cell").isNull()).select("path", "kind", "name", "value").orderBy(F.xxhash64("path", "name", "value")).limit(most).collect()
    return fit([(r.path, Candidate(r.kind, r.name, r.value, 0)) for r in picked], Markov(counts.reshape(len(Markov.ALPHABET), -1)))


def secrets_of(content: str, path: str, model: Model) -> list[tuple[Candidate, float]]:
    """Credentials of a content with their scores."""
    scored = [(c, model.score(c, path)) for c in candidates(content, bool(_CONFIG.search(path)))]
    return [(c, p) for c, p in scored if p >= model.threshold]


def redact(content: str, found: list[Candidate], mark: str = "[redacted]") -> str:
    """The content with each credential's text replaced, everything else as it was."""
    for c in sorted(found, key=lambda c: -c.start):
        content = content[: c.start] + mark + content[c.start + len(c.value) :]
    return content


def _with_model(files: DataFrame, model: Model | None, rows_of: Callable[[int, str, list[tuple[Candidate, float]]], list[tuple]], schema: str) -> DataFrame:
    """``rows_of(id, content, credentials)`` of each file that has any: narrow, no shuffle."""
    model = train(files) if model is None else model
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [row for i, path, content in zip(pdf["id"], pdf["path"], pdf["content"]) if (found := secrets_of(content, path, model)) for row in rows_of(i, content, found)]
            yield pd.DataFrame(rows, columns=names)

    return files.where(F.length("content") > 0).select("id", _path(), "content").mapInPandas(run, schema)


def find_credentials(files: DataFrame, model: Model | None = None) -> DataFrame:
    """``id, secret`` of each distinct credential in each of ``files(id, file_path, file_name, content)``."""
    return _with_model(files, model, lambda i, content, found: [(i, v) for v in dict.fromkeys(c.value for c, _ in found)], "id bigint, secret string")


def scored_credentials(files: DataFrame, model: Model | None = None) -> DataFrame:
    """``id, first, end, kind, score, labelled`` of each place of a credential; ``labelled`` tells whether a pattern alone would have known it."""
    rows_of = lambda i, content, found: [(i, c.start, c.start + len(c.value), c.kind, p, weak_label(c) is not None) for c, p in found]
    return _with_model(files, model, rows_of, "id bigint, first int, end int, kind string, score double, labelled boolean")


def redacted_files(files: DataFrame, model: Model | None = None, mark: str = "[redacted]") -> DataFrame:
    """``id, redacted, content`` of each file with credentials: how many stretches were replaced, and the content with ``mark`` in their place."""
    return _with_model(files, model, lambda i, content, found: [(i, len(found), redact(content, [c for c, _ in found], mark))], "id bigint, redacted int, content string")
