"""Plans of named SQL steps over given tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from foliant.sources.scratch import written

#: A name and its SQL; on Spark, the SQL may be made from the number of rows of an earlier step.
Step = tuple[str, str | Callable[[Callable[[str], int]], str]]

_ENDS = "WHERE|JOIN|ON|USING|INNER|LEFT|RIGHT|FULL|CROSS|GROUP|ORDER|HAVING|UNION|LIMIT|LATERAL"
_READS = re.compile(rf"\b(FROM|JOIN)\s+([A-Za-z_]\w*)\b(\s+(?:AS\s+)?(?!(?:{_ENDS})\b)[A-Za-z_]\w*)?")


def chain(steps: list[Step], last: str) -> str:
    """One query over named steps."""
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in steps) + "\n" + last if steps else last


def run_steps(spark: SparkSession, steps: Iterable[Step], last: str, tables: Mapping[str, DataFrame], keep: Iterable[str] = ()) -> DataFrame:
    """The result of ``last`` after ``steps`` over ``tables``. Steps in ``keep`` are written once for all their readers.

    Steps are temporary views under names of this call only, dropped at its end: neither a
    user's views nor another call's are touched.
    """
    mark = uuid.uuid4().hex
    views: dict[str, str] = {}
    made: list[str] = []

    def own(sql: str) -> str:
        def named(m: re.Match) -> str:
            view = views.get(m[2])
            return m[0] if view is None else f"{m[1]} {view}{m[3] or f' AS {m[2]}'}"

        return _READS.sub(named, sql)

    def enter(name: str, df: DataFrame) -> None:
        made.append(f"{name}_{mark}_{len(made)}")
        df.createTempView(made[-1])
        views[name] = made[-1]

    try:
        for name, df in tables.items():
            enter(name, df)
        for name, body in steps:
            df = spark.sql(own(body if isinstance(body, str) else body(lambda of: spark.table(views[of]).count())))
            enter(name, written(df, name) if name in keep else df)
        return spark.sql(own(last))
    finally:
        for view in made:
            spark.catalog.dropTempView(view)
