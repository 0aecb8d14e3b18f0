"""Table functions for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


def register(spark: SparkSession) -> None:
    """Register ``find_spans(text, pattern)``, rows (first, end, value); DataFrame users take functions.spans, which is native."""

    class FindSpans:
        def eval(self, text: str, pattern: str):
            import re

            for m in re.finditer(pattern, text or ""):
                yield m.start(), m.end(), m.group()

    spark.udtf.register("find_spans", udtf(FindSpans, returnType="first int, end int, value string"))
