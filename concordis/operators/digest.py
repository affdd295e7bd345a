"""Order-free digest of a set of ids.

Some record fields are made to list every member id in one array.  A set that spans a
whole run has no size bound, so such a field holds one entry, ``set_sha256:<hex>``, and
the ids stay rows of a table.  The digest adds up slices of each id's SHA-256, so it
combines on the map side and never gathers the ids.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SLICES = 12
_SLICE_DIGITS = 5  # 20 bits: sums stay in 64 bits for 2^43 ids


def set_digest(ids: Column) -> Column:
    """Aggregate digest of distinct ids; NULL ids do not count."""
    hashed = F.sha2(ids, 256)
    sums = [
        F.coalesce(
            F.sum(F.conv(F.substring(hashed, 1 + i * _SLICE_DIGITS, _SLICE_DIGITS), 16, 10).cast("bigint")),
            F.lit(0),
        ).cast("string")
        for i in range(_SLICES)
    ]
    return F.concat(F.lit("set_sha256:"), F.sha2(F.concat_ws(",", F.count(ids).cast("string"), *sums), 256))
