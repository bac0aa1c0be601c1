"""Tables of which readers see whole versions only.

A table is a folder of parts, each written once and never changed, and small version files
that list the parts to read. Writing a run means: write its parts, then create the next
version file, which is one step. Until then, and after a write that fails, readers find
what they found before. Parts have a kind (posts, keys, counts and so on), and every row
the run that brought it; a run that is stored again replaces its own rows, also those that
compaction has put into a common part. Parts that no kept version lists are removed by
:meth:`Versions.forget`; who reads an old version must be done by then.

One writer at a time: of two that create the same version, the second one fails.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affectframe.sources.files import create, exists, names_in, read_text, remove

_VERSION = re.compile(r"(\d{10})\.json")


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def numbers(self) -> list[int]:
        """The versions that exist, the current one last."""
        return sorted(int(m[1]) for name in names_in(self.spark, f"{self.path}/versions") if (m := _VERSION.fullmatch(name)))

    def parts(self, number: int | None = None) -> list[dict]:
        """What a version lists: ``folder, kind, runs``, and values of columns whose rows it leaves out."""
        for found in reversed(self.numbers()) if number is None else [number]:
            try:
                return json.loads(read_text(self.spark, f"{self.path}/versions/{found:010}.json"))
            except json.JSONDecodeError:  # a version whose writer was stopped before its end
                if number is not None:
                    raise
        return []

    def kinds(self) -> set[str]:
        return {part["kind"] for part in self.parts()}

    def runs(self, kind: str) -> set[str]:
        return {run for part in self.parts() if part["kind"] == kind for run in part["runs"]}

    def read(self, kind: str, schema: T.StructType | str, *, besides: str | None = None, number: int | None = None) -> DataFrame:
        """The rows of a kind, with their ``run``; without those of a run to be replaced.

        The schema names the columns, those that the parts are partitioned by as well.
        """
        fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
        whole = T.StructType([*fields, T.StructField("run", T.StringType()), T.StructField("part", T.StringType())])
        listed = [p for p in self.parts(number) if p["kind"] == kind and set(p["runs"]) != {besides}]
        if not listed:
            return self.spark.createDataFrame([], whole).drop("part")
        base = f"{self.path}/{kind}"
        rows = self.spark.read.schema(whole).option("basePath", base).parquet(*[f"{base}/part={p['folder']}" for p in listed])
        for part in listed:
            for column, values in part.get("without", {}).items():
                rows = rows.filter((F.col("part") != part["folder"]) | ~F.col(column).isin(values))
        if besides is not None:
            rows = rows.filter(F.col("run") != besides)
        return rows.drop("part")

    def commit(
        self, rows: Mapping[str, DataFrame], run: str, *, by: Mapping[str, Sequence[str]] = {},
        instead: Mapping[str, tuple[str, Sequence]] = {}, whole: Sequence[str] = (),
    ) -> None:
        """Store rows by kind and show them all at once, in place of those that the run has stored before.

        ``by``: columns that a kind's folders are partitioned by. A kind with ``instead``
        (a column and values) replaces all rows with these values, one in ``whole`` all
        rows; a kind in ``whole`` without new rows is dropped.
        """
        start = self.numbers()
        listed = [self._left(p, run, instead, whole) if p["kind"] in rows or p["kind"] in whole else p for p in self.parts()]
        listed = [p for p in listed if p is not None]
        for kind, frame in rows.items():
            listed.append(self._write(kind, frame if "run" in frame.columns else frame.withColumn("run", F.lit(run)), [run], by.get(kind, ())))
        self._show(listed, start)

    @staticmethod
    def _left(part: dict, run: str, instead: Mapping[str, tuple[str, Sequence]], whole: Sequence[str]) -> dict | None:
        """What stays of a part beside new rows of its kind; None if nothing does."""
        kind, without = part["kind"], dict(part.get("without", {}))
        if kind in whole:
            return None
        if kind in instead:
            column, values = instead[kind]
            return part | {"without": without | {column: sorted({*without.get(column, []), *values})}}
        if run in part["runs"]:
            runs = [r for r in part["runs"] if r != run]
            return part | {"runs": runs, "without": without | {"run": sorted({*without.get("run", []), run})}} if runs else None
        return part

    def _write(self, kind: str, rows: DataFrame, runs: Sequence[str], by: Sequence[str]) -> dict:
        folder = uuid.uuid4().hex
        rows = rows.hint("rebalance", *[F.col(c) for c in by]) if by else rows
        rows.write.partitionBy(*by).parquet(f"{self.path}/{kind}/part={folder}")
        return {"kind": kind, "folder": folder, "runs": list(runs)}

    def _show(self, listed: list[dict], start: list[int]) -> None:
        """Create the version after those that the writer has started from: the one step that counts."""
        number = start[-1] + 1 if start else 1
        create(self.spark, f"{self.path}/versions/{number:010}.json", json.dumps(listed, indent=1))

    def compact(
        self, kind: str, schema: T.StructType | str, by: Sequence[str] = (), *,
        arranged: Callable[[DataFrame], DataFrame] | None = None,
    ) -> None:
        """Put all parts of a kind into one, with fewer files; rows keep their runs."""
        start = self.numbers()
        others = [p for p in self.parts() if p["kind"] != kind]
        runs = sorted(self.runs(kind))
        rows = self.read(kind, schema)
        rows = arranged(rows) if arranged else rows if by else rows.hint("rebalance")
        self._show([*others, self._write(kind, rows, runs, by)] if runs else others, start)

    def forget(self, keep: int = 2) -> None:
        """Remove all but the last versions, and the parts that none of those lists."""
        numbers = self.numbers()
        kept = {(p["kind"], p["folder"]) for number in numbers[-keep:] for p in self.parts(number)}
        for number in numbers[:-keep]:
            for part in self.parts(number):
                folder = f"{self.path}/{part['kind']}/part={part['folder']}"
                if (part["kind"], part["folder"]) not in kept and exists(self.spark, folder):
                    remove(self.spark, folder)
            remove(self.spark, f"{self.path}/versions/{number:010}.json")


_RESULT = "result"


def publish(rows: DataFrame, path: str) -> None:
    """Replace a result table in one step; readers of the one before are not disturbed."""
    Versions(rows.sparkSession, path).commit({_RESULT: rows}, uuid.uuid4().hex, whole=[_RESULT])


def published(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The result table as it was last published."""
    return Versions(spark, path).read(_RESULT, schema).drop("run")
