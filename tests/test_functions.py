import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from siftwright.functions import comments, literals, text


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("r")).first()[0]


@pytest.mark.parametrize(
    "given, wanted",
    [("a(*b*)c", "ac"), ("a(*b(*c*)d*)e", "ae"), ("(*)x", ""), ("a(*b", "a"), ("a*)b(*c*)d", "ab(*cd"), ("*)*) (* x *) y", " (* x  y"), ("", ""), ("plain", "plain")],
)
def test_nested(spark, given, wanted):
    assert one(spark, comments.remove_nested(F.col("t"), "(*", "*)"), t=given) == wanted
    assert comments.outside_nested(given, "(*", "*)") == wanted


@pytest.mark.parametrize(
    "family, given, wanted",
    [
        ("python", "x = 1 # c\ny", "x = 1 # c\ny"),
        ("python", "print('#a\\n')", "print('')"),
        ("python", 'a """doc\nx""" b', "a  b"),
        ("c_like", "a // b \\\\ c\nz", "a // b \nz"),
        ("c_like", "a /* b\nc */ d", "a  d"),
        ("cobol", "000001* comment\n000002 MOVE\n000003/ pg", "\n\n000002 MOVE\n"),
        ("matlab", "a%{b\n%}c", "ac"),
        ("ruby", "a #x\ry\x85w\nq", "a \nq"),
        ("ruby", "a\n=begin\nb\n=end\nc", "a\n\nc"),
        ("erlang", "a % b\nc", "a \nc"),
        ("julia", "a #= b\n=# c # d", "a  c "),
        ("lisp", "(a) ; b", "(a) "),
        ("fortran", "x ! y", "x "),
        ("html", "a<!-- b -->c", "ac"),
        ("webassembly", "(; a ;) b ;; c", " b "),
        ("assembly", "mov ; x", "mov "),
        ("ada", "a -- b", "a "),
        ("agda", "a {- b {- c -} -} d -- e", "a  d "),
        ("f_sharp", "a (* b *) c // d", "a  c "),
        ("d", "a /** b */ c /// d", "a  c "),
        ("forth", "a \\ b\nc ( d ) e", "a \nc  e"),
        ("lua", "a --[[ b\nc ]] d -- e", "a  d "),
        ("perl", "a # b\n=pod\nx\n=cut\nc", "a \n\nc"),
        ("prolog", "a % b\n/* c */ d", "a \n d"),
        ("raku", "a #'(b) c # d", "a  c "),
        ("sql", "a -- b\n/* c */ d", "a \n d"),
    ],
)
def test_families(spark, family, given, wanted):
    assert one(spark, comments.strip_comments(F.col("t"), family), t=given) == wanted


def test_strict(spark):
    assert one(spark, comments.strip_comments(F.col("t"), "c_like", strict=True), t="a // b\nc") == "a \nc"
    assert one(spark, comments.strip_comments(F.col("t"), "python", strict=True), t="a # b\nc") == "a \nc"


def test_order_of_nested_and_line_comments(spark):
    given = "a -- {- b\nc -} d"
    assert one(spark, comments.strip_comments(F.col("t"), "agda"), t=given) == "a "
    assert one(spark, comments.strip_comments(F.col("t"), "agda", nested_last=True), t=given) == "a \nc  d"


def test_every_language_has_one_family():
    names = [n for v in comments.LANGUAGES.values() for n in v]
    assert len(names) == len(set(names))
    assert comments.families_of(["Python", "C++", "Unknown"]) == ["python", "c_like"]


def test_white_space_is_that_of_unicode(spark):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isspace()]
    assert len(points) == 29
    joined = "a" + "".join(map(chr, points)) + "​b"
    assert one(spark, text.without_space(F.col("t")), t=joined) == "a​b"
    assert one(spark, text.normalise(F.col("t")), t="A B c") == "abc"


def test_line_stats(spark):
    given = "  ab \n\n\t\nc1 d\r\n"
    row = spark.createDataFrame([(given,), ("",), (" \n ",)], "t string").select(*[c.alias(n) for n, c in text.line_stats(F.col("t")).items()]).collect()
    assert tuple(row[0]) == (2, 3.0, 5, 5 / 10)
    assert tuple(row[1]) == tuple(row[2]) == (0, None, 0, None)


@pytest.mark.parametrize("path, ext, base, stem", [("a/b.C.Py", ".py", "b.C.Py", "b.C"), ("Make", ".make", "Make", "Make"), ("x/.bashrc", ".bashrc", ".bashrc", ".bashrc"), ("a.b/c", ".b/c", "c", "c")])
def test_paths(spark, path, ext, base, stem):
    p = F.col("t")
    assert [one(spark, f(p), t=path) for f in (text.path_extension, text.base_name, text.base_stem)] == [ext, base, stem]


@pytest.mark.parametrize("given, wanted", [("{'path': 'a/b.py', 'n': 1}", "a/b.py"), ("{'path': \"it's\"}", "it's"), ("{'x': {'path': 'no'}}", None), ("not a dict", None), (None, None), ("{'path': None}", None), ("{'a': True, 'path': 'p'}", "p")])
def test_literals(spark, given, wanted):
    assert one(spark, literals.literal_value(F.col("t"), "path"), t=given) == wanted


def test_hash_64_is_the_first_eight_bytes(spark):
    for t in ("abcdefg", "", "é€"):
        assert int(one(spark, text.hash_64(F.col("t")), t=t), 16) == struct.unpack("<QQ", hashlib.sha256(t.encode()).digest()[:16])[0]
