"""Problem 1: generated, minified, vendored files and data blobs among source files.

Vendored code: Merkle hashes are computed bottom-up over each repository's
directory tree.  A leaf is the hash of a file without its leading comment (the
banner), white space, marks and letter case, so that layout and notices do not
matter.  A directory's hash is the sum over its entries of the entry's hash,
a vector, times a matrix that follows from the entry's name.  Matrices do not
commute, so the order of names on a path counts; the recursion is linear, so a
file's share in each directory above it follows from the names on its path,
bottom-up within its row, and one sum gives all directories at once, partially
added before the shuffle: neither a deep tree nor a hot directory costs a round
or a task of its own.

A subtree that repositories of unrelated owners share, under whatever name, is
vendored wherever it lies: a directory of several files where it is no more than half of its
repository (else it is a fork or the project itself); a single file, under any
name, if one of its copies lies among other people's code or is called after a
component.  Components are learned, too: directories right below those that
hold other people's code, in repositories of unrelated owners.  A file whose
path and leading comment both name a component, which its repository's name
does not, is another version of it.

Generated, minified and data files: rules on header, layout and path.  The
generators' names are learned from unmistakable headers; a leading comment that
names one as the source of the file is enough then.

No file has two kinds; of several the first of minified, data, generated,
vendored holds.

Defined results: null and blank contents are no cases, whatever their path; a
null path counts as one without directories; repeated rows are answered each;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

#: Directories that hold other people's code.
VENDOR_DIRS = "vendor|vendors|vendored|third_party|third-party|thirdparty|3rdparty|3rd_party|external|externals|extern|node_modules|bower_components|_workspace/src|contrib|deps|site-packages|jspm_packages"
#: Directories and name endings of generated files.
GENERATED_DIRS = "gen-src|generated|autogen|build/gen|src-gen|generated-sources|_generated|gen"
GENERATED_NAMES = r"(?:[._-](?:generated|gen|g|autogen|designer)|_pb2?(?:_grpc)?|\.pb(?:-c|\.gw)?|\.tab|\.d\.gen|\.yy)\.[A-Za-z0-9]+$"
MINIFIED_NAMES = r"(?:[.-](?:min|bundle|prod|packed|pack))\.[A-Za-z0-9]+$"
#: Header rules: a line that is a comment and says that a program wrote the file.
_SAYS = "|".join([
    r"Code generated by \S+.*DO NOT EDIT",
    r"@generated\b",
    r"<auto-?generated",
    r"AUTO-?GENERATED (?:FILE|CODE|BY)",
    r"(?:This file (?:was|is)|File) (?:automatically|auto-?|machine )?-?\s?(?:generated|produced|created|written) (?:automatically |mechanically )?(?:by|from)\b",
    r"(?:This file (?:was|is) )?(?:auto-?matically |machine-)generated\b",
    r"Generated (?:from|by) (?:the )?[\w./-]+(?: (?:on|at|v?\d|using|with)\b|\.|$)",
    r"Do not (?:modify|edit|change)(?: this file)?(?: by hand)?\s?[:;-].*(?:rebuilt|generated|overwritten|regenerated)",
    r"machine[- ](?:written|generated|made)\b",
])
HEADER = rf"(?im)^[ \t]*(?:(?:[#/*;%!-]+|\"\"\"|'''|<!--|REM\b|=begin)[ \t]*)?(?:{_SAYS})"

#: Modulus of the hashes: the sum of two products of residues fits a bigint.
PRIME = 2147483647

_HEADER = re.compile(HEADER)
_VENDOR = re.compile(rf"(?i)(?:^|/)(?:{VENDOR_DIRS})/(?:@[^/]+/|(?:src|lib)/)?([^/]+)/")
_GENERATED_PATH = re.compile(rf"(?i)(?:^|/)(?:{GENERATED_DIRS})/|{GENERATED_NAMES}")
_MINIFIED_PATH = re.compile(rf"(?i){MINIFIED_NAMES}")
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"\w+")
_MARKS = bytes(c for c in range(128) if not chr(c).isalnum())
_LEAD = re.compile(r"\s*(?:/\*.*?\*/|//[^\n]*\n|#[^\n]*\n|--[^\n]*\n)\s*", re.S)
_NUMBERS = re.compile(r"(?:\b(?:0[xX][0-9A-Fa-f]{1,16}|\d{1,6}(?:\.\d+)?)[uUlL]{0,2}(?:[\])} ]{0,6}[,;][\[({ -]{0,6}| -?)){24,}")
_ENCODED = re.compile(r"[A-Za-z0-9+/=_-]{200,}|(?:[\"'][A-Za-z0-9+/=_-]{40,}[\"'][\s+,\\.]*){4,}|(?:\\x[0-9A-Fa-f]{2}){40,}")
#: Lines of one shape in which a number counts upwards, one after the other: the layout of a generated table.
LEAST_COUNTED = 8
_TWO_NUMBERS = re.compile(r"\d[^\d\n]+\d")
_FIRST_NUMBER = re.compile(r"\d{1,9}")
_LETTERS = re.compile(r"[^\W_]+")
#: A statement that begins right where another ends.
_JOINED = re.compile(r"[;}](?=[A-Za-z_$(])")
#: Every header has one of these words.
_HEADER_HINTS = ("generated", "do not", "machine", "file ")
#: The comments that a file begins with.
_LEADING = re.compile(r"(?:\s*(?:/\*.*?\*/|\"\"\".*?\"\"\"|'''.*?'''|<!--.*?-->|=begin\b.*?\n=end\b[^\n]*|(?://|#|--|;|%)[^\n]*(?:\n|\Z)))+", re.S)
#: What a header says made the file, and what a comment may name as its source in other words.
_MADE_BY = re.compile(r"(?i)(?:generated|produced|created|written|compiled|emitted|built)\s+(?:automatically\s+|mechanically\s+)?(?:by|with|using)\s+(?:the\s+)?[`'\"]?([a-z][\w.+-]{2,40})")
_SOURCE = re.compile(r"(?i)(?:\b(?:by|from|of|with|using)\s+(?:the\s+)?[`'\"]?([a-z][\w.+-]{2,40})|^[ \t]*(?:[#/*;%!-]+[ \t]*)?([a-z][\w.+-]{2,40})[ \t]*:)", re.M)
_NAME = re.compile(r"[a-z][a-z0-9]{2,}")


def is_minified(content: str, path: str) -> bool:
    """Long lines with next to no white space and much punctuation, or with statement upon statement, apart from a leading comment."""
    n = len(content)
    if n < 150 or n < 40 * (content.count("\n") + 1):
        return False
    if content.lstrip()[:2] in ("/*", "//", "--") or content.lstrip()[:1] == "#":
        content = _LEAD.sub("", content, count=1)
        n = len(content)
    per_line = n / (content.count("\n") + 1)
    if n < 150 or per_line < 40:
        return False
    if per_line < (55 if _MINIFIED_PATH.search(path) else 100):
        # minified code may be wrapped: statement upon statement, and next to no white space
        return len(_JOINED.findall(content)) > n / 150 and n - len(_SPACE.sub("", content)) < 0.08 * n
    if per_line > 200 and len(_JOINED.findall(content)) > n / 150:
        return True
    blank = n - len(_SPACE.sub("", content))
    if blank > 0.15 * n:
        return False
    return n - blank - len("".join(_WORDS.findall(content))) > 0.15 * n


def is_data(content: str) -> bool:
    """More than half of the content is tables of numbers or encoded strings."""
    # laid out one number a line or all in one, a table is as large
    content = " ".join(content.split())
    n = len(content)
    if n < 350:
        return False
    blob = 0
    if sum(map(content.count, "0123456789abcdefABCDEF")) > 0.25 * n and sum(map(content.count, "0123456789")) > 0.1 * n:
        blob = sum(m.end() - m.start() for m in _NUMBERS.finditer(content))
    if 2 * blob <= n and ("\\x" in content or max(map(len, content.split()), default=0) >= 40):
        blob += sum(m.end() - m.start() for m in _ENCODED.finditer(content))
    return 2 * blob > n


def counts_up(content: str) -> bool:
    """A run of lines that are alike but for letters and digits, the first number one more from each to the next, and texts that repeat it."""
    if len(_TWO_NUMBERS.findall(content)) < LEAST_COUNTED:
        return False
    run, before, shape = 0, 0, ""
    for line in content.split("\n"):
        m = _FIRST_NUMBER.search(line)
        if not m or line.count(m.group()) < 2:
            run = 0
            continue
        now, own = int(m.group()), _LETTERS.sub("a", line)
        run = run + 1 if run and own == shape and now == before + 1 else 1
        if run >= LEAST_COUNTED:
            return True
        before, shape = now, own
    return False


def is_generated(content: str, path: str) -> bool:
    if _GENERATED_PATH.search(path):
        return True
    low = content.lower()
    return any(hint in low for hint in _HEADER_HINTS) and bool(_HEADER.search(content)) or counts_up(content)


def own_kind(content: str, path: str) -> str | None:
    """The kind that a file shows by itself."""
    if is_minified(content, path):
        return "minified"
    if is_data(content):
        return "data"
    return "generated" if is_generated(content, path) else None


def _canonical(text: str) -> bytes:
    """The text without letter case and the white space and marks of ASCII."""
    return text.lower().encode("utf-8", "surrogatepass").translate(None, _MARKS)


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for i, repo, path, content in zip(pdf["id"], pdf["repo_name"], pdf["path"], pdf["content"]):
            lead = m.group() if (m := _LEADING.match(content)) else ""
            # a file of comments only is its comments
            body = _canonical(content[len(lead) :]) or _canonical(lead)
            leaf = int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "big", signed=True)
            below = _VENDOR.search(path)
            said = set(_NAME.findall(lead.lower()))
            own = set(_NAME.findall((repo or "").lower()))
            named = sorted(said & set(_NAME.findall(path.lower())) - own) if lead else []
            made = [x.lower().rstrip(".") for x in _MADE_BY.findall(lead)] if lead else []
            sources = sorted({x.lower().rstrip(".") for pair in _SOURCE.findall(lead) for x in pair if x}) if lead else []
            out.append((i, repo, path, leaf, own_kind(content, path), below is not None, below[1].lower() if below else None, named, made, sources))
        yield pd.DataFrame(out, columns=["id", "repo_name", "path", "hash", "kind", "below", "component", "named", "made_by", "sources"])


_JUDGED = "id bigint, repo_name string, path string, hash bigint, kind string, below boolean, component string, named array<string>, made_by array<string>, sources array<string>"


def judged(files: DataFrame) -> DataFrame:
    """What each file with content shows by itself: its kind, whether it lies below other people's code and in which component, the names that its path and leading comment share, what made it, and its leaf."""
    path = F.coalesce("file_path", "file_name", F.lit(""))
    # the first part of a path is the repository's own folder
    inner = F.when(path.contains("/"), F.regexp_replace(path, r"^[^/]*/", "")).otherwise(path)
    rows = files.where(F.col("content").rlike(r"\S")).select("id", "repo_name", inner.alias("path"), "content")
    return rows.mapInPandas(_batches, _JUDGED)


def _owner() -> Column:
    return F.lower(F.substring_index("repo_name", "/", 1))


def _of_unrelated(rows: DataFrame, name: str) -> DataFrame:
    """Values of a column that repositories of unrelated owners have."""
    found = rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(_owner()).alias("a"), F.max(_owner()).alias("b"))
    return found.where(F.col("a") != F.col("b")).select(name)


def _residue(x: Column) -> Column:
    return F.pmod(x, F.lit(PRIME))


def shares(path: Column, leaf: Column) -> Column:
    """A file's own hash, then its share in the hash of its entry (by name) and of each directory above it, bottom-up."""
    parts = F.split(path, "/")
    start = F.struct(F.lit(0).alias("up"), _residue(leaf).alias("h0"), _residue(F.xxhash64(leaf)).alias("h1"))

    def climb(acc: Column, up: Column) -> Column:
        name, last = F.element_at(parts, -up), F.element_at(acc, -1)
        m = [_residue(F.xxhash64(name, F.lit(k))) for k in range(4)]
        step = F.struct(up.alias("up"), _residue(m[0] * last["h0"] + m[1] * last["h1"]).alias("h0"), _residue(m[2] * last["h0"] + m[3] * last["h1"]).alias("h1"))
        return F.concat(acc, F.array(step))

    return F.aggregate(F.sequence(F.lit(1), F.size(parts)), F.array(start), climb)


def merkle_nodes(leaves: DataFrame) -> DataFrame:
    """``repo_name, dir, h0, h1, leaves, foreign``: the hash of every file (under any name) and directory of each repository.

    ``leaves`` has ``repo_name, path, hash, foreign``; a path extracted twice with one content counts once.
    A file's own node has its path as ``dir``.
    """
    once = leaves.groupBy("repo_name", "path", "hash").agg(F.max("foreign").alias("foreign"))
    # a node's own name does not count: a file's hash is its leaf, and a directory's holds the names below it; the root is left out
    ways = F.filter(shares(F.col("path"), F.col("hash")), lambda s: s["up"] < F.size(F.split("path", "/")))
    climbed = once.select("repo_name", "path", "foreign", F.explode(ways).alias("s"))
    # the node above `up` names: the path without its last `up` parts
    parts = F.split("path", "/")
    node = F.array_join(F.slice(parts, 1, F.size(parts) - F.col("s.up")), "/")
    nodes = climbed.select("repo_name", node.alias("dir"), "s.h0", "s.h1", "foreign")
    sums = nodes.groupBy("repo_name", "dir").agg(F.sum("h0").alias("h0"), F.sum("h1").alias("h1"), F.count(F.lit(1)).alias("leaves"), F.max("foreign").alias("foreign"))
    return sums.select("repo_name", "dir", _residue(F.col("h0")).alias("h0"), _residue(F.col("h1")).alias("h1"), "leaves", "foreign")


def shared_subtrees(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """``repo_name, dir`` of the nodes that unrelated owners share and that are another project's: one of them shows it, or it is a directory of several files and no more than half of ``sizes(repo_name, files)``."""
    same = nodes.groupBy("h0", "h1", "leaves").agg(F.min(_owner()).alias("a"), F.max(_owner()).alias("b"), F.max("foreign").alias("v"))
    shared = nodes.select("repo_name", "dir", "h0", "h1", "leaves").join(same.where((F.col("a") != F.col("b")) & (F.col("v") | (F.col("leaves") > 1))).select("h0", "h1", "leaves", "v"), ["h0", "h1", "leaves"])
    return shared.join(sizes, "repo_name").where(F.col("v") | (2 * F.col("leaves") <= F.col("files"))).select("repo_name", "dir")


def with_evidence(files: DataFrame) -> DataFrame:
    """``id, kind, evidence`` of each file that is not hand-written source: ``rules``, a learned ``generator``, a shared ``subtree``, a learned ``component`` or a ``directory`` of other people's code."""
    # what the rules say, without the contents, is used several times below
    rows = checkpointed(judged(files))
    shown = rows.where(F.col("kind").isNotNull()).select("id", "kind", F.lit("rules").alias("evidence"))
    open_ = rows.where(F.col("kind").isNull())
    # names that join: only those of unrelated owners, and few a file
    makers = _of_unrelated(rows.where(F.col("kind") == "generated").select("repo_name", F.explode("made_by").alias("source")), "source")
    made = open_.select("id", F.explode("sources").alias("source")).join(makers, "source", "left_semi").select("id").distinct()
    components = _of_unrelated(open_.select("repo_name", "component"), "component")
    versions = open_.select("id", F.explode("named").alias("component")).join(components, "component", "left_semi").select("id").distinct()
    marks = made.select("id", F.lit(1).alias("m")).unionByName(versions.select("id", F.lit(2).alias("m"))).groupBy("id").agg(F.min("m").alias("mark"))
    marked = checkpointed(open_.select("id", "repo_name", "path", "hash", "below").join(marks, "id", "left"))
    generated = marked.where(F.col("mark") == 1).select("id", F.lit("generated").alias("kind"), F.lit("generator").alias("evidence"))
    # the tree is that of the files without another kind
    tree = marked.where(F.coalesce("mark", F.lit(0)) != 1).select("id", "repo_name", "path", "hash", "below", F.coalesce(F.col("mark") == 2, F.lit(False)).alias("version"))
    tree = tree.withColumn("foreign", F.col("below") | F.col("version"))
    sizes = tree.select("repo_name", "path", "hash").distinct().groupBy("repo_name").agg(F.count(F.lit(1)).alias("files"))
    # nodes are compared with each other, so they are read twice
    subtrees = shared_subtrees(checkpointed(merkle_nodes(tree)), sizes)
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    held = tree.select("id", "repo_name", F.explode(above).alias("dir")).join(subtrees, ["repo_name", "dir"], "left_semi").select("id", F.lit("subtree").alias("evidence"))
    told = tree.where("foreign").select("id", F.when(F.col("version"), "component").otherwise("directory").alias("evidence"))
    # of several the firmest: subtree, component, directory
    vendored = held.unionByName(told).groupBy("id").agg(F.max("evidence").alias("e"), F.min("evidence").alias("f"))
    vendored = vendored.select("id", F.lit("vendored").alias("kind"), F.when(F.col("e") == "subtree", "subtree").otherwise(F.col("f")).alias("evidence"))
    return shown.unionByName(generated).unionByName(vendored)


def not_handwritten(files: DataFrame) -> DataFrame:
    """``id, kind`` of each file that is not hand-written source."""
    return with_evidence(files).select("id", "kind")
