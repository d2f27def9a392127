"""Tables that cut lineage (see emberlog.sources.written), and numbers for rows.

Tables that a returned DataFrame still reads stay; clean() removes all that this process has written, once their readers are
done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.sources.written import clean, dropped, folder, saved

#: A column of row ids.
ROW = "__row"


def numbered(df: DataFrame) -> DataFrame:
    """df with ROW, an id of each row's own; it is written with the table, so all readers find the same."""
    return saved(df.withColumn(ROW, F.monotonically_increasing_id()))


__all__ = ["ROW", "clean", "dropped", "folder", "numbered", "saved"]
