"""The normalizers as SQL functions, so SQL text uses the same JVM-side expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sievewatch.functions import geo, names, text

FUNCTIONS: dict[str, tuple[Callable[[Column], Column], str]] = {
    "name_tokens": (names.name_tokens, "ARRAY<STRING>"),
    "name_keys": (names.name_keys, "ARRAY<STRING>"),
    "metaphone": (names.metaphone, "STRING"),
    "name_skeleton": (names.skeleton, "STRING"),
    "core_name": (text.core_name, "STRING"),
    "sanctions_key": (text.sanctions_key, "STRING"),
    "iso2": (geo.iso2, "STRING"),
}
_QUOTED_OR_OPERATOR = re.compile(r"'(?:[^'\\]|\\.|'')*'|(?<![\w`])(<=>|<=|>=|!=|=|<|>|\+|-|\*|/|and|or|not|in|!)(?=\()")


def sql_text(build: Callable[[Column], Column], argument: str) -> str:
    """SQL text of a Column expression; operators print as functions, so they need back-ticks."""
    printed = build(F.col(argument))._jc.node().sql()
    return _QUOTED_OR_OPERATOR.sub(lambda m: f"`{m.group(1)}`" if m.group(1) else m.group(0), printed)


def register_functions(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions and the table function ``explode_name_keys(name)``."""
    for name, (build, kind) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {sql_text(build, 'x')}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION explode_name_keys(x STRING) RETURNS TABLE(key STRING) "
              f"RETURN SELECT explode({sql_text(names.name_keys, 'x')})")
    return [*FUNCTIONS, "explode_name_keys"]
