from riskloom.llm import licences, queries

from ..conftest import SF_SMALL

SCHEMA = "path string, text string, licence string, dir string"
MIT, APACHE, GPL = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3."


def scan(spark, files, **kwargs):
    df = spark.createDataFrame([(p, t, "clash", "clash") for p, t in files], SCHEMA)
    return {r.path: (r.licence, r.found, r.source) for r in licences.scan(df, **kwargs).collect()}


def test_own_and_nearest_ancestor(spark):
    body = "def f(x): return x and many other words of code that say nothing of terms\n" * 5
    got = scan(spark, [("LICENSE", MIT), ("a/LICENSE.txt", "Some title\n" + APACHE), ("a/b/code.py", body), ("a/b/own.py", "# " + GPL + "\n" + body), ("c/d/e/code.py", body),
                       ("top.py", body), ("a/b/c/COPYING", GPL), ("a/b/c/x.py", body), ("ab/x.py", body)])
    assert got["LICENSE"] == ("MIT", "own", None) and got["a/LICENSE.txt"][:2] == ("Apache-2.0", "own")
    assert got["a/b/code.py"] == ("Apache-2.0", "inherited", "a") and got["a/b/own.py"][:2] == ("GPL-3.0", "own")
    assert got["c/d/e/code.py"] == ("MIT", "inherited", "") and got["top.py"] == ("MIT", "inherited", "")
    assert got["a/b/c/x.py"] == ("GPL-3.0", "inherited", "a/b/c") and got["ab/x.py"] == ("MIT", "inherited", "")


def test_a_notice_inside_prose_is_no_licence_file(spark):
    got = scan(spark, [("x/readme", "words " * 50 + "\n" + MIT), ("x/other", "nothing")])
    assert got["x/readme"][:2] == ("MIT", "own") and got["x/other"] == (None, None, None)


def test_odd_rows(spark):
    files = [(None, MIT), ("a", None), ("b", ""), ("d/LICENSE", MIT), ("d/LICENSE", MIT), ("d/long", "word " * 60000)]
    df = spark.createDataFrame([(p, t, "", "") for p, t in files], SCHEMA)
    rows = licences.scan(df).collect()
    assert len(rows) == len(files)
    assert {r.licence for r in rows if r.path in ("d/LICENSE", "d/long", "", "a", "b")} == {"MIT"}
    assert licences.scan(df.where("false")).collect() == []


def test_query_runs_no_python_and_finds_the_notices(spark):
    df = queries.op4_licences(spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    marks = {"MIT": "the MIT License", "Apache-2.0": "Apache License, Version 2.0", "GPL-3.0": "General Public License, version 3", "CC-BY-NC-4.0": "CC BY-NC 4.0"}
    rows = df.collect()
    assert len(rows) == len(texts)
    for r in rows:
        named = {k for k, m in marks.items() if m in texts[r.doc_id]}
        assert (r.licence in named) if r.found == "own" else not named
