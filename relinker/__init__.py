"""Link migration on Spark: move URLs from an old path prefix to a new one."""

from relinker.functions.address import address_of, host_of, is_under, join_address, move_prefix
from relinker.operators.redirect import redirect, split_address

__all__ = ["address_of", "host_of", "is_under", "join_address", "move_prefix", "redirect", "split_address"]
