"""What the operators of this subpackage share: words, stored tables, joins beside hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affectframe.constants import BROADCAST_BYTES
from affectframe.session import new_dir
from affectframe.tables import is_bounded

# A word is a run of anything but ASCII white space; bytes.split() cuts the same way.
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Keys with at least 1/HOT_SHARE of all rows are joined by broadcast; at most so many exist.
HOT_SHARE = 10_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of a frame, written to the shared folder and read again.

    This cuts the lineage: a lost executor costs the tasks of the step that runs, and
    nothing that was stored before is computed again.
    """
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_counted(rows: DataFrame, counted: DataFrame, key: str | list[str], count: str, total: int) -> DataFrame:
    """Inner join of rows with a table that has each key once, and how many rows have it.

    A small table is broadcast after it has been measured. Otherwise the partners of hot
    keys (at least 1/HOT_SHARE of all rows, so at most HOT_SHARE of them) are broadcast
    and the rows of hot keys stay where they are; all other rows meet in a shuffle in
    which no key is large. Both inputs should be stored, as each is read twice.
    """
    if is_bounded(counted, BROADCAST_BYTES):
        return rows.join(F.broadcast(counted), key)
    is_hot = F.col(count) * HOT_SHARE >= F.lit(total)
    hot, cold = counted.filter(is_hot), counted.filter(~is_hot)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(cold, key))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is.

    ``lower`` is the faster way, and gives the same where no other letter has a lower
    case; ``translate`` looks at each character.
    """
    others = r"[^\x00-\x7F&&[\p{Lu}\p{Lt}\p{Nl}\p{So}\p{Cn}]]"
    return F.when(text.rlike(others), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))
