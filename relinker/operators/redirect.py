"""The redirect job: every URL of a batch or a stream, moved, kept or marked."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relinker.functions.address import address_of, check_prefix, host_of, is_under, join_address, move_prefix

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_address(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``address: struct<origin, path, search, hash>`` of the column ``url_col``."""
    return df.withColumn("address", address_of(F.col(url_col)))


def redirect(df: DataFrame, url_col: str, old: str, new: str, host: str | None = None) -> DataFrame:
    """Add ``new_url`` and ``status`` (``moved``, ``kept``, ``unparsed``; NULL for a NULL URL).

    With ``host``, only URLs of that host (no user info, no port, ASCII case-blind)
    are touched; the others are ``kept`` as they are. One narrow projection: no
    shuffle and no state, so a streaming DataFrame works as well as a batch.
    Columns named ``new_url`` or ``status`` in the input are replaced. ``old`` and
    ``new`` are whole segments, as ``check_prefix`` has it.
    """
    check_prefix(old)
    check_prefix(new)
    if re.match(re.escape(old) + r"(?=/|\Z)", new, re.IGNORECASE | re.ASCII):
        raise ValueError(f"new must not lie under old, or a second run would move it again: {new!r}")
    url, address = F.col(url_col), address_of(F.col(url_col))
    ours = F.lit(True) if host is None else host_of(address["origin"]) == host.translate(_LOWER)
    moved = address.withField("path", move_prefix(address["path"], old, new))
    return df.withColumns(
        {
            "new_url": F.when(address.isNull() | ~ours, url).otherwise(join_address(moved)),
            "status": F.when(url.isNull(), F.lit(None).cast("string"))
            .when(address.isNull(), "unparsed")
            .when(ours & is_under(address["path"], old), "moved")
            .otherwise("kept"),
        }
    )
