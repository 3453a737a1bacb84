"""Arguments of a request as they come, as text."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Larger numbers are no argument of any request.
MOST = 2**31 - 1


def count_argument(arguments: Mapping[str, str], name: str, default: int, most: int = MOST) -> int:
    """Figures only, and more than 0, else the default; `most` at most."""
    text = arguments.get(name) or ""
    n = int(text) if re.fullmatch(r"[0-9]{1,19}", text) else 0
    return min(n, most) if 0 < n <= MOST else default


def count_column(text: Column, default: int, most: int = MOST) -> Column:
    """The same for a column of arguments."""
    n = F.when(text.rlike(r"^[0-9]{1,18}\z"), text.cast("bigint"))
    return F.coalesce(F.when((n > 0) & (n <= MOST), F.least(n, F.lit(most))), F.lit(default)).cast("int")
