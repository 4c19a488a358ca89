import datetime
import glob
import hashlib
import itertools
import json
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwright import session
from siftwright.functions import comments, text
from siftwright.operators import exact, extensions, extract, masks, near, repos
from siftwright.plans import pipeline, registry
from siftwright.sources import pages, tables, trees
from siftwright.streaming import incremental

EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


@pytest.fixture
def languages(spark):
    return spark.createDataFrame([(0, "Python", [".py"]), (1, "C", [".c", ".h"]), (2, "C++", [".h", ".cc"]), (3, "None", None)], "ordinal int, name string, extensions array<string>")


def test_keep_first_then_language(spark):
    rows = [(1, "CSV", 0), (2, None, 1), (1, "csv", 2), (3, "X", 3), (3, "CSV", 4), (4, "cSv", 5)]
    frame = spark.createDataFrame(rows, "id long, language string, _pos int")
    assert sorted((r.id, r.language) for r in repos.clean(frame, "csv", [F.col("_pos")]).collect()) == [(1, "CSV"), (4, "cSv")]
    assert {(r.id, r.n) for r in repos.repeated_ids(frame).collect()} == {(1, 2), (3, 2)}
    assert repos.clean(frame.limit(0), "csv", [F.col("_pos")]).count() == 0


def test_buckets_and_windows(spark):
    buckets, windows = repos.star_buckets(), repos.date_windows()
    assert len(buckets) == 36 and len(windows) == 199
    d = datetime.date
    assert windows[:2] == [(d(2008, 1, 1), d(2008, 2, 1)), (d(2008, 2, 2), d(2008, 3, 1))] and windows[-1] == (d(2024, 7, 2), d(2024, 8, 1))
    days = [d(2008, 1, 1) + datetime.timedelta(days=k) for k in range(-3, 800)] + [d(2024, 8, 1), d(2024, 8, 2)]
    got = spark.createDataFrame([(x,) for x in days], "d date").select("d", repos.window_of(F.col("d")).alias("w")).collect()
    for r in got:
        assert r.w == next((b for a, b in windows if a <= r.d <= b), None), r
    stars = spark.range(0, 1200).select("id", repos.star_bucket(F.col("id")).alias("b")).collect()
    for r in stars:
        assert r.b == next(a for a, b in buckets if r.id >= a and (b is None or r.id <= b))
    assert repos.buckets_frame(spark).count() == 36 and repos.windows_frame(spark).count() == 199


def test_retrieval_dates(spark):
    raw = "9/2/2024, 12:00:00 AM (Europe/Amsterdam)"
    row = spark.createDataFrame([(raw,), ("rubbish",), (None,)], "t string").select(repos.retrieved_at(F.col("t")).alias("r")).select("r", repos.format_retrieved(F.col("r")).alias("back")).collect()
    assert row[0].r == datetime.datetime(2024, 9, 1, 22, 0) and row[0].back == raw
    assert row[1].r is None and row[2].r is None


def test_numbers_are_dense(spark):
    frame = spark.range(0, 1000).select((F.col("id") * 37 % 1000).alias("k"))
    got = {r.k: r.n for r in repos.numbered(frame, [F.col("k")], "n").collect()}
    assert got == {k: k for k in range(1000)}


def test_endings(spark, languages):
    files = spark.createDataFrame([(1, "a.h"), (2, "xpyx.c"), (3, None)], "id int, file_name string")
    assert {(r.id, r.matched) for r in extensions.matching_endings(files, [".py", ".c", ".h"]).collect()} == {(1, ".h"), (2, ".py"), (2, ".c")}
    assert {(r.id, r.matched) for r in extensions.matching_endings(files, [".py", ".c"], strict=True).collect()} == {(2, ".c")}
    ext = files.select("id", text.path_extension(F.col("file_name")).alias("ext"))
    assert {r.id: r.langs for r in extensions.with_languages(ext, languages).collect()} == {1: ["C", "C++"], 2: ["C"], 3: []}
    assert extensions.endings_to_languages(languages)[".h"] == ["C", "C++"]


def test_exact_masks(spark, languages):
    own = spark.createDataFrame([(1, "a.py", "x = 1"), (2, "a.py", "X=1"), (3, "b.py", None), (4, None, "q"), (5, "c.c", "int /* z */ x;")], "id int, path string, content string")
    other = spark.createDataFrame([("INT X;", "{'path': 'd.c'}"), (None, None), (None, None)], "text string, meta string")
    endings = extensions.endings_to_languages(languages)
    hashed, theirs = exact.with_sha(own, endings), exact.with_sha(other, endings)
    assert {r.id: r.sha for r in hashed.collect()}[3] == EMPTY_SHA
    masked = {r.id: r.exact_duplicates_x for r in exact.exact_mask(hashed, theirs, "x").collect()}
    assert masked == {1: False, 2: False, 3: True, 4: True, 5: True}
    assert {r.id for r in exact.keep_first(hashed, "id").collect()} == {1, 3, 5}
    assert exact.exact_mask(hashed, theirs.limit(0), "x").where("exact_duplicates_x").count() == 0
    assert exact.content_column(spark.createDataFrame([("a",)], "code string"))._jc.toString() == "code"


def test_band_shape():
    assert near.band_shape() == (16, 8)


def test_shingles_and_signatures(spark):
    rows = spark.createDataFrame([("1", "abcdefgh"), ("2", "abc"), ("3", ""), ("4", "abcdefgabcdefg")], "key string, text string")
    assert {r.key: r.s for r in rows.select("key", near.shingles(F.col("text")).alias("s")).collect()} == {"1": ["abcdefg", "bcdefgh"], "2": [], "3": [], "4": ["abcdefg", "bcdefga", "cdefgab", "defgabc", "efgabcd", "fgabcde", "gabcdef"]}
    got = {r.key: r.signature for r in near.signatures(rows).collect()}
    a, b = near.permutations()[0]
    x = [int(hashlib.sha256(s.encode()).hexdigest()[:8], 16) for s in ("abcdefg", "bcdefgh")]
    assert got["1"][0] == min((a * v + b) % near.PRIME for v in x)
    assert got["2"] == got["3"] == [near.PRIME - 1] * near.PERMUTATIONS


def test_near_pairs_against_brute_force(spark):
    rng = np.random.RandomState(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    base = ["".join(rng.choice(words, 60)) for _ in range(12)]
    texts = base + [t[:-20] + "x" * 20 for t in base] + [base[0]]
    frame = spark.createDataFrame([(t,) for t in texts], "normal string")
    rows, signed = near.keyed(frame), near.classes(frame)
    found = near.verified(near.candidates(signed, signed), rows, rows, 0.8).collect()
    sets = {hashlib.sha256(t.encode()).hexdigest(): {t[k : k + 7] for k in range(len(t) - 6)} for t in texts}
    wanted = {(a, b) for a, b in itertools.product(sets, sets) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert {(r.key, r.other_key) for r in found} == wanted
    assert len(sets) == 24


def test_masks_keep_all_rows(spark, languages):
    own = spark.createDataFrame([(1, "a.py", "def f(x):\n    return x + 1\n" * 9), (2, "b.py", "something else entirely here " * 9), (3, "c.py", "ab")], "id int, path string, content string")
    other = spark.createDataFrame([("a.py", "def f(x):\n    return x + 1\n" * 9 + "#"), ("s.py", "zz")], "path string, content string")
    masked = pipeline.masked(own, {"o": other}, languages).select("id", "exact_duplicates_o", "near_duplicates_o").collect()
    # texts too short for a shingle are alike
    assert {r.id: (r.exact_duplicates_o, r.near_duplicates_o) for r in masked} == {1: (False, True), 2: (False, False), 3: (False, True)}
    assert [r.id for r in pipeline.uncontaminated(own, {"o": other}, languages).collect()] == [2]
    assert masks.summary(pipeline.masked(own, {"o": other}, languages)).first().near_duplicates_o == 2


def test_extraction(spark, languages, tmp_path):
    folder = tmp_path / "me_re_po"
    folder.mkdir()
    (folder / "a.py").write_bytes(("# é\n" + "x = 1\n" * 12).encode("cp1252"))
    (folder / "short.py").write_text("x")
    (folder / "b.txt").write_text("no " * 20)
    meta = [(1, "me/re.po", "http://x", 5, 2, 5, 0, "Python", None, None, ("mit", "MIT", "MIT", None, None), "d")]
    from siftwright import schemas

    repo = spark.createDataFrame(meta, schemas.REPO)
    got = extract.extract(tables.read_tree(spark, str(tmp_path)), repo, languages, str(tmp_path), "Python").collect()
    assert [(r.file_path, r.repo_license, r.total_lines, r.content[:3]) for r in got] == [("me_re_po/a.py", "MIT", 13, "# é")]
    assert tables.list_tree(spark, str(tmp_path)).count() == 3
    assert extract.decode(b"\xff\xfea\x00") == "a" and extract.decode("é".encode()) == "é"


def test_sources(spark, tmp_path):
    (tmp_path / "l.json").write_text('[{"id": 7, "full_name": "a/b", "language": null, "license": {"key": "mit"}}, {"id": 7, "full_name": "a/b"}]')
    rows = tables.read_repos(spark, str(tmp_path / "l.json")).orderBy("_pos").collect()
    assert [(r._pos, r.id, r.license and r.license.key) for r in rows] == [(0, 7, "mit"), (1, 7, None)]
    shas = spark.createDataFrame([("aa",), ("bb",)], "sha string")
    tables.write_hashes(shas, str(tmp_path / "h"))
    tables.write_hashes(shas, str(tmp_path / "h"))
    assert sorted(r.sha for r in tables.read_hashes(spark, str(tmp_path / "h")).collect()) == ["aa", "aa", "bb", "bb"]
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "1.json").write_text('{"items": [{"id": 3, "full_name": "x/y", "license": null}]}')
    spark.dataSource.register(pages.RepositoryPages)
    assert [r.full_name for r in spark.read.format("repository_pages").load(str(tmp_path / "pages")).collect()] == ["x/y"]
    assert pages.pause(100, 40) == 67.5 and pages.pause(1, 40) == 7.5


def test_hidden_files_are_walked(spark, tmp_path):
    for name, body in ((".top", b"t"), ("a/.hidden/x.py", b"12"), ("a/_u.py", b"123"), ("a/.git/config", b"no"), ("b/big", b"0" * 50), ("b/empty", b"")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body)
    spark.dataSource.register(trees.RepositoryTrees)
    rows = spark.read.format("repository_trees").option("most_bytes", 50).load(str(tmp_path)).collect()
    assert {(os.path.relpath(r.path, tmp_path), r.length, bytes(r.content)) for r in rows} == {(".top", 1, b"t"), ("a/.hidden/x.py", 2, b"12"), ("a/_u.py", 3, b"123"), ("b/empty", 0, b"")}
    listed = spark.read.format("repository_trees").schema("path string, length bigint").load(str(tmp_path))
    assert listed.count() == 5 and listed.columns == ["path", "length"]


def test_walks_are_few_tasks(spark, languages, tmp_path):
    for k in range(40):
        (tmp_path / f"_r{k}" / ".d").mkdir(parents=True)
        (tmp_path / f"_r{k}" / ".d" / "a.py").write_bytes(f"é {k} ".encode("utf-16") + ("x = 1\n" * 12).encode("utf-16-le"))
        (tmp_path / f"_r{k}" / "b.txt").write_text("no " * 20)
    from siftwright import schemas

    repo = spark.createDataFrame([(k, f".r{k}", "http://x", 5, 2, 5, 0, "Python", None, None, ("mit", "MIT", "MIT", None, None), "d") for k in range(39)], schemas.REPO)
    listed = tables.walk_tree(spark, str(tmp_path))
    # the root and as many lots of folders as a shuffle has partitions
    assert listed.count() == 80 and listed.rdd.getNumPartitions() == 5
    got = extract.extract(listed, repo, languages, str(tmp_path), "Python").collect()
    assert {(r.file_path, r.repo_name, r.content) for r in got} == {(f"_r{k}/.d/a.py", f".r{k}", f"é {k} " + "x = 1\n" * 12) for k in range(39)}
    extract.remove_tree(spark, str(tmp_path))
    assert not tmp_path.exists()


def test_trees_in_lots(spark, monkeypatch):
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    from siftwright.plans import stored

    whole = stored.extract_tree(spark, DATA)
    monkeypatch.setattr(stored, "LOT_FILES", 100)
    monkeypatch.setattr(stored, "MOST_LOTS", 2)
    monkeypatch.setattr(session, "_WRITTEN", [])
    lots = stored.extract_tree(spark, DATA)
    assert sorted(map(str, lots.collect())) == sorted(map(str, whole.collect()))
    left = [p.rsplit("/", 1)[1].split("-")[0] for p in session._WRITTEN if os.path.exists(p.removeprefix("file:"))]
    assert len(session._WRITTEN) == 3 and left == ["extracted"]


def test_corpus_by_language(spark, tmp_path):
    tables.write_corpus(spark.createDataFrame([(1, "Go"), (2, "C")], "id int, language string"), str(tmp_path / "c"))
    assert tables.languages_in(spark, str(tmp_path / "c")) == ["C", "Go"]


def test_stream(spark, tmp_path):
    files = spark.createDataFrame([(1, "a.c", "x"), (2, "b.c", "y")], "id int, path string, content string")
    files.write.parquet(str(tmp_path / "in"))
    known = exact.with_sha(files.where("id = 1"), {}).select("sha")
    stream = spark.readStream.schema(files.schema).parquet(str(tmp_path / "in"))
    incremental.flag_exact(stream, known, {}, "k", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r.id: r.exact_duplicates_k for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: True, 2: False}


DATA = "/root/testdata/sf0.001"
NAMES = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def tables_in_sql():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def test_every_query_has_sql():
    assert set(registry.queries()) == set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_queries_against_sql(spark, tables_in_sql, name):
    frame = registry.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    sql = tables_in_sql.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in sql.description].index(c) for c in columns]
    assert Counter(map(tuple, frame.select(columns).collect())) == Counter(tuple(r[i] for i in at) for r in sql.fetchall())


@pytest.mark.parametrize("partitions", [1, 4, 8, 64, 200])
def test_numbers_do_not_depend_on_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        # two columns of which one is pruned, and repeated first ones
        frame = spark.range(0, 20000, 1, 7).select((F.col("id") * 7919 % 20000).alias("k"), (F.col("id") % 5).alias("g"))
        got = repos.numbered(frame, [F.col("g"), F.col("k")], "n").select("k", "n").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(((k * pow(7919, -1, 20000)) % 20000 % 5, k) for k in range(20000))
    assert {r.k: r.n for r in got} == {k: n for n, (_, k) in enumerate(order)} and len(got) == 20000
    assert repos.numbered(frame.limit(0), [F.col("k")], "n").count() == 0


def test_pages_have_no_end_but_the_limit(spark, tmp_path):
    for k in range(13):
        (tmp_path / f"s{k % 2}").mkdir(exist_ok=True)
        (tmp_path / f"s{k % 2}" / f"{k:02}.json").write_text(json.dumps({"items": [{"id": 200 * k + i, "license": {"key": "mit"}} for i in range(150)]}))
    spark.dataSource.register(pages.RepositoryPages)
    read = lambda **o: spark.read.format("repository_pages").options(**o).load(str(tmp_path))
    assert read().select("id").distinct().count() == 13 * 150
    assert read(limit=310).count() == 310 and read(limit=0).count() == 0


def test_many_nested_comments_are_followed_alike(spark, monkeypatch):
    texts = ["(*" * k + "x" + "*)" * m + "y(*)z" for k in range(4) for m in range(5)] + [None, "", "plain (x*y)"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    wanted = [None if t is None else comments.outside_nested(t, "(*", "*)") for t in texts]
    for most in (1000, 2):
        monkeypatch.setattr(comments, "MOST_MARKS", most)
        assert [r.x for r in frame.select(comments.remove_nested(F.col("t"), "(*", "*)").alias("x")).collect()] == wanted


def test_index_takes_the_other_column(spark):
    frame = spark.createDataFrame([("a.x", "one text that is long enough", "quite another code of some length")], "path string, text string, code string")
    row = pipeline.for_index(pipeline.normal_corpus(frame, {}), {}).first()
    assert row.normal == "onetextthatislongenough" and row.near_normal == "quiteanothercodeofsomelength" and row.near_key != row.sha


def test_bytes_are_decoded_alike_by_columns(spark):
    raws = ["é x".encode(), "é".encode("cp1252"), b"\xef\xbb\xbfmark", "ab".encode("utf-16"), "ab".encode("utf-32"), b"\xfe\xff\x00a", b"", None, b"\x81\x8d", b"plain"]
    got = spark.createDataFrame([(b,) for b in raws], "b binary").select(extract.decoded(F.col("b")).alias("t")).collect()
    assert [r.t for r in got] == [None if b is None else extract.decode(b) for b in raws]


def test_full_buckets_are_cut_by_date(spark):
    rows = [(k, 950, f"2010-0{1 + k % 3}-10T00:00:00Z") for k in range(6)] + [(10, 950, "1999-01-01T00:00:00Z"), (11, 3, None), (12, None, None)]
    frame = spark.createDataFrame(rows, "id long, stargazers_count long, created_at string")
    got = {(r.bucket, r.last_day and str(r.last_day), r.n) for r in repos.requeried(frame, 5).collect()}
    assert got == {(3, None, 1), *((900, f"2010-0{m + 1}-01", 2) for m in (1, 2, 3))}


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_rows_without_text_are_spread(spark):
    rows = spark.range(0, 2000).select("id", F.lit(masks.EMPTY).alias("sha"))
    flags = spark.createDataFrame([(masks.EMPTY, 3)], "sha string, f int")
    got = masks.flagged(rows, "sha", flags, "f")
    assert got.count() == 2000 and got.where("f = 3").count() == 2000 and got.columns == ["id", "sha", "f"]
    assert masks.flagged(rows, "sha", flags.limit(0), "f").where("f = 0").count() == 2000


def test_masks_of_several_corpora(spark, languages):
    base = "def f(x):\n    return x + 1\n" * 9
    own = spark.createDataFrame([(k, "a.py", t) for k, t in enumerate([base, base, None, "", "q" * 40])] + [(9, None, None)], "id int, path string, content string")
    others = {"p": spark.createDataFrame([("a.py", base)], "path string, content string"), "q": spark.createDataFrame([("b.py", None)], "path string, content string"), "none": own.select("path", "content").limit(0)}
    got = {r.id: [r[f"{kind}_duplicates_{n}"] for n in others for kind in ("exact", "near")] for r in pipeline.masked(own, others, languages).collect()}
    both, empty = [True, True, False, False, False, False], [False, False, True, True, False, False]
    assert got == {0: both, 1: both, 2: empty, 3: empty, 4: [False] * 6, 9: empty}
    assert pipeline.masked(own, {}, languages).count() == 6


def test_no_text_is_shuffled_for_masks(spark, languages):
    own = spark.createDataFrame([(1, "a.py", "x" * 30)], "id int, path string, content string")
    plan = near.classes(own.withColumnRenamed("content", "normal"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "normal" not in next(line for line in plan.splitlines() if "Exchange" in line)
