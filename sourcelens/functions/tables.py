"""Table functions for SQL: symbols and imports of a table of files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, DataType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators import symbols


def _analyzed(files: AnalyzeArgument, keep: AnalyzeArgument | None, out: tuple[tuple[str, DataType], ...]) -> AnalyzeResult:
    """The result's columns: those of files that keep names, then out. files: a table that has path and text."""
    if not files.isTable:
        raise ValueError("the first argument is a table: TABLE(files)")
    have = {f.name.lower(): f for f in files.dataType.fields}
    if missing := {"path", "text"} - {*have}:
        raise ValueError(f"the table lacks {', '.join(sorted(missing))}")
    schema = StructType()
    for name in _names(keep.value if keep is not None else None):
        if name not in have:
            raise ValueError(f"the table has no column {name}")
        schema.add(have[name].name, have[name].dataType)
    for name, kind in out:
        schema.add(name, kind)
    return AnalyzeResult(schema)


def _names(keep: str | None) -> list[str]:
    return [x.strip().lower() for x in (keep or "").split(",") if x.strip()]


_FACTS = (("path", StringType()), ("fact", StringType()), ("name", StringType()), ("kind", StringType()), ("line", IntegerType()), ("truncated", BooleanType()))


class FileFacts:
    """file_facts(TABLE(files) [, keep => 'a,b'] [, most => n]): path, fact ("symbol" or "reference"), name, kind,
    line, truncated, as `symbols.syntax_facts` gives them, after the columns of files that `keep` names."""

    @staticmethod
    def analyze(files: AnalyzeArgument, keep: AnalyzeArgument | None = None, most: AnalyzeArgument | None = None) -> AnalyzeResult:
        if most is not None and (not most.isConstantExpression or most.value is not None and most.value < 0):
            raise ValueError("most is a constant that isn't negative")
        return _analyzed(files, keep, _FACTS)

    def eval(self, files: Row, keep: str | None = None, most: int | None = None) -> Iterator[tuple]:
        have = {k.lower(): v for k, v in files.asDict().items()}
        kept = [have[name] for name in _names(keep)]
        for fact, found in zip(("symbol", "reference"), symbols.analyse(have["path"] or "", have["text"] or ""), strict=True):
            cut = most is not None and len(found) > most
            for name, kind, line in found[:most]:
                yield *kept, have["path"], fact, name, kind, line, cut


def register(spark: SparkSession) -> None:
    """Makes `file_facts` known to spark.sql."""
    spark.udtf.register("file_facts", udtf(FileFacts))
