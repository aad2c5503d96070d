import shutil

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from relinker import redirect
from relinker.functions.address import move_prefix
from relinker.plans import links
from relinker.streaming import start_redirect

SF = "/root/testdata/sf0.01"
H = "https://h.example"
#: url, new_url (None: the same), status
EDGES = [
    (f"{H}/old-app/a/b?x=1#/r", f"{H}/new-app/a/b?x=1#/r", "moved"),
    (f"{H}/OLD-APP", f"{H}/new-app", "moved"),
    (f"{H}/old-app/", f"{H}/new-app/", "moved"),
    (f"{H}/old-apple/x", None, "kept"),
    (f"{H}/z/old-app/x", None, "kept"),
    (f"{H}/old-app?", f"{H}/new-app", "moved"),
    (f"{H}/old-app#", f"{H}/new-app", "moved"),
    (f"{H}/old-app?#", f"{H}/new-app", "moved"),
    (f"{H}/old-app?#x", f"{H}/new-app#x", "moved"),
    (f"{H}/old-app??", f"{H}/new-app??", "moved"),
    (f"{H}/old-app#/r?", f"{H}/new-app#/r?", "moved"),
    (f"{H}/old-app##", f"{H}/new-app##", "moved"),
    (H, f"{H}/", "kept"),
    (f"{H}?old-app=1", f"{H}/?old-app=1", "kept"),
    (f"{H}#/old-app", f"{H}/#/old-app", "kept"),
    (f"{H}/old-app/a b", f"{H}/new-app/a b", "moved"),
    (f"{H}/old-app/[x]", f"{H}/new-app/[x]", "moved"),
    (f"{H}:8443/old-app/%E9", f"{H}:8443/new-app/%E9", "moved"),
    ("http://u:p@h.example/old-app/x", "http://u:p@h.example/new-app/x", "moved"),
    (f"{H}/old-app/old-app/x", f"{H}/new-app/old-app/x", "moved"),
    (f"{H}/old-app%2Fx", None, "kept"),
    (f"{H}//old-app/x", None, "kept"),
    ("not a url", None, "unparsed"),
    ("", None, "unparsed"),
    (None, None, None),
    (f"{H}/old-app\n", None, "kept"),
]


def run(spark, urls, *args, **kw):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id int, url string")
    return [(r.new_url, r.status) for r in redirect(df, "url", *args, **kw).orderBy("id").collect()]


def test_edges(spark):
    want = [(u if n is None else n, s) for u, n, s in EDGES]
    assert run(spark, [u for u, _, _ in EDGES], "/old-app", "/new-app") == want


@pytest.mark.parametrize(
    ("old", "new", "url", "new_url"),
    [
        ("/o.d+(x)", r"/n$1w\2", "https://h/o.d+(x)/A", r"https://h/n$1w\2/A"),
        ("/o.d+(x)", r"/n$1w\2", "https://h/oXd+(x)/A", None),
        ("/kite", "/n", "https://h/Kite/x", None),
        ("/site", "/n", "https://h/ſite/x", None),
    ],
)
def test_literal_prefixes(spark, old, new, url, new_url):
    assert run(spark, [url], old, new) == [(new_url or url, "moved" if new_url else "kept")]


def test_host_scope(spark):
    urls = ["https://u@H.Example:81/old", "https://x.h.example/old?", "nope"]
    want = [("https://u@H.Example:81/new", "moved"), ("https://x.h.example/old?", "kept"), ("nope", "unparsed")]
    assert run(spark, urls, "/old", "/new", host="h.example") == want
    assert run(spark, urls[:1], "/old", "/new", host="H.EXAMPLE") == want[:1]
    kelvin = "https://\u212aite.example/old"
    assert run(spark, [kelvin], "/old", "/new", host="kite.example") == [(kelvin, "kept")]
    assert run(spark, [kelvin], "/old", "/new", host="\u212aITE.example") == [("https://\u212aite.example/new", "moved")]


@pytest.mark.parametrize(
    ("old", "new"),
    [
        ("", "/n"), ("old", "/n"), ("/old/", "/n"), (r"/a\Eb", "/n"), ("/a", "/A/b"), ("/a", "n"),
        ("/a", ""), ("/a", "/"), ("/a", "/n/"), ("/a", "/b?x"), ("/a", "/b#x"),
    ],
)
def test_rejected_arguments(spark, old, new):
    with pytest.raises(ValueError):
        run(spark, ["https://h/"], old, new)


@pytest.mark.parametrize("new", ["n", "/", "/n/", "/a?b", "/a#b", r"/a\Eb", ""])
def test_prefix_column_function_rejects(spark, new):
    with pytest.raises(ValueError):
        move_prefix(F.col("path"), "/old", new)


def test_edges_against_sql(spark, same_as_sql, tmp_path):
    """The edge table, moved to the queries' prefixes, under the same SQL as the driver's table."""
    urls = [u and u.replace("old-app", "en").replace("OLD-APP", "EN") for u, _, _ in EDGES if u is None or "\n" not in u]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string")
    df.coalesce(1).write.parquet(f"{tmp_path}/tables/pages.parquet")
    (part,) = (tmp_path / "tables/pages.parquet").glob("part-*.parquet")
    (tmp_path / "sql").mkdir()
    shutil.copy(part, tmp_path / "sql/pages.parquet")
    for name, query in links.QUERIES.items():
        same_as_sql(query(spark, str(tmp_path / "tables")), links.ORACLE[name], str(tmp_path / "sql"))


@pytest.mark.parametrize("name", list(links.QUERIES))
def test_oracle(spark, same_as_sql, name):
    same_as_sql(links.QUERIES[name](spark, SF), links.ORACLE[name], SF)


def test_second_pass_changes_nothing(spark):
    once = redirect(spark.read.parquet(f"{SF}/pages.parquet"), "url", "/en", "/english")
    twice = redirect(once.select(F.col("new_url").alias("url")), "url", "/en", "/english")
    assert twice.filter("url <> new_url OR status <> 'kept'").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(f"{SF}/pages.parquet", tmp_path / "in")
    batch = spark.read.parquet(f"{tmp_path}/in")
    start_redirect(
        spark, f"{tmp_path}/in", batch.schema, f"{tmp_path}/out", f"{tmp_path}/check", url_col="url", old="/en", new="/english"
    ).awaitTermination()
    got, want = spark.read.parquet(f"{tmp_path}/out"), redirect(batch, "url", "/en", "/english")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_no_shuffle_and_pruned_scan(spark):
    plan = links.redirect_query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "html" not in plan and "*(1) Project" in plan


def test_entry(spark):
    assert __spark_entry__.entry(spark).groupBy("status").count().orderBy("status").collect() == [("kept", 19), ("moved", 31)]


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
