"""Column functions on addresses, all built-in expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: groups are origin, path, search and hash.
ADDRESS = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?\z"
#: Fixed value: the host within an origin, without user info and port.
HOST = r"(?s)^[^:]*://(?:.*@)?(\[[^\]]*\]|[^:]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def address_of(url: Column) -> Column:
    """Take a URL apart into ``struct<origin, path, search, hash>``.

    A bare ``?`` or ``#`` reads as empty and an empty path as ``/``. NULL, and
    text without ``scheme://authority``, gives a NULL struct.
    """
    part = [F.regexp_extract(url, ADDRESS, i) for i in range(1, 5)]
    bare = lambda c, mark: F.when(c == mark, "").otherwise(c)
    return F.when(
        url.rlike(ADDRESS),
        F.struct(
            part[0].alias("origin"),
            F.when(part[1] == "", "/").otherwise(part[1]).alias("path"),
            bare(part[2], "?").alias("search"),
            bare(part[3], "#").alias("hash"),
        ),
    )


def host_of(origin: Column) -> Column:
    """Host of an origin, ASCII letters lower-cased."""
    return F.translate(F.regexp_extract(origin, HOST, 1), _UPPER, _LOWER)


def check_prefix(prefix: str) -> str:
    """A path prefix must be whole segments: ``/a`` or ``/a/b``."""
    if not prefix.startswith("/") or prefix.endswith("/") or "\\E" in prefix or set(prefix) & set("?#"):
        raise ValueError(rf"prefix must start with '/', not end with it and hold no '?', '#' or '\E': {prefix!r}")
    return prefix


def is_under(path: Column, old: str) -> Column:
    """True if the path starts with ``old`` in any ASCII letter case, up to a ``/`` or the path's end."""
    return path.rlike(rf"(?i)^\Q{check_prefix(old)}\E(?=/|\z)")


def move_prefix(path: Column, old: str, new: str) -> Column:
    """Replace the prefix ``old`` by ``new``; other paths stay as they are.

    Both are whole segments, as ``check_prefix`` has it. ``concat`` takes ``new``
    literally, so ``$`` and backslashes in it mean nothing.
    """
    check_prefix(new)
    rest = F.substring(path, len(old) + 1, 2**31 - 1)
    return F.when(is_under(path, old), F.concat(F.lit(new), rest)).otherwise(path)


def join_address(address: Column) -> Column:
    """Put origin, path, search and hash together again."""
    return F.concat(*(address[k] for k in ("origin", "path", "search", "hash")))
