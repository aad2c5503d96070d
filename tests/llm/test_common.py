import os
import subprocess
import sys
import textwrap

from relinker.llm.common import lots

SF = "/root/testdata/sf0.001"


def test_operators_on_frames_that_the_user_read(tmp_path):
    """A session whose workers cannot import the package by themselves: each operator sends it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
        import sys
        sys.path.insert(0, {root!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        from relinker.llm import decontaminate, langid, media, urls
        pages, docs = (spark.read.parquet(f"{SF}/{{t}}.parquet") for t in ("pages", "documents"))
        assert urls.filter_urls(pages).count() == pages.count()
        assert media.text_media(docs.limit(3)).count() == 3 and len(langid.language_id(docs).collect()) == docs.count()
        assert decontaminate.drop_contaminated(docs, spark.read.parquet("{SF}/benchmark.parquet")).count() < docs.count()
        print("sent")
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "sent" in done.stdout, done.stderr[-2000:]


def test_lots():
    assert list(lots([], 5)) == [] and list(lots([9], 5)) == [(0, 1)]
    assert list(lots([1, 4, 1, 9, 0, 5, 1], 5)) == [(0, 2), (2, 3), (3, 4), (4, 6), (6, 7)]
