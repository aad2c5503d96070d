"""One query for each operator, over ``pages``, moving ``/en`` to ``/english``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relinker.functions.address import is_under, join_address, move_prefix
from relinker.operators import redirect as ops
from relinker.sources import table

OLD, NEW = "/en", "/english"
_RX = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url")


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.split_address(_pages(spark, sf_dir))


def split_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("page_id", "address.*")


def is_under_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).filter(is_under(F.col("address.path"), OLD)).select("page_id")


def move_prefix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("address.path")
    return _split(spark, sf_dir).select("page_id", path.alias("path"), move_prefix(path, OLD, NEW).alias("new_path"))


def join_address_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("page_id", join_address(F.col("address")).alias("new_url"))


def redirect_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.redirect(_pages(spark, sf_dir), "url", OLD, NEW).select("page_id", "new_url", "status")


QUERIES = {
    "split_address": split_address,
    "is_under": is_under_query,
    "move_prefix": move_prefix_query,
    "join_address": join_address_query,
    "redirect": redirect_query,
}

_PARTS = f"""WITH p AS (
  SELECT page_id, url, regexp_matches(url, '{_RX}') AS ok,
         regexp_extract(url, '{_RX}', 1) AS o, regexp_extract(url, '{_RX}', 2) AS pa,
         regexp_extract(url, '{_RX}', 3) AS s, regexp_extract(url, '{_RX}', 4) AS h
  FROM pages),
a AS (
  SELECT page_id, url, ok, CASE WHEN ok THEN o END AS origin,
         CASE WHEN ok THEN CASE WHEN pa = '' THEN '/' ELSE pa END END AS path,
         CASE WHEN ok THEN CASE WHEN s = '?' THEN '' ELSE s END END AS search,
         CASE WHEN ok THEN CASE WHEN h = '#' THEN '' ELSE h END END AS hash
  FROM p)
"""
_MOVED = rf"regexp_replace(path, '^{OLD}(/|$)', '{NEW}\1', 'i')"
_UNDER = f"regexp_matches(path, '^{OLD}(/|$)', 'i')"

ORACLE = {
    "split_address": _PARTS + "SELECT page_id, origin, path, search, hash FROM a",
    "is_under": _PARTS + f"SELECT page_id FROM a WHERE {_UNDER}",
    "move_prefix": _PARTS + f"SELECT page_id, path, {_MOVED} AS new_path FROM a",
    "join_address": _PARTS + "SELECT page_id, origin || path || search || hash AS new_url FROM a",
    "redirect": _PARTS
    + f"""SELECT page_id, CASE WHEN ok THEN origin || {_MOVED} || search || hash ELSE url END AS new_url,
       CASE WHEN url IS NULL THEN NULL WHEN NOT ok THEN 'unparsed' WHEN {_UNDER} THEN 'moved' ELSE 'kept' END AS status
FROM a""",
}
