"""SQL over one table, the way a caller writes it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def alias_of(name: str) -> str:
    """The table's name with everything but letters and digits replaced by ``_``."""
    out = re.sub(r"[^0-9A-Za-z]", "_", name)
    return f"t_{out}" if not out or out[0].isdigit() else out


def table_sql(table: DataFrame, name: str, sql: str) -> DataFrame:
    """``{{table}}``, or the table's alias itself, stands for the table."""
    alias = alias_of(name)
    table.createOrReplaceTempView(alias)
    return table.sparkSession.sql(sql.replace("{{table}}", alias))


def columns_of(table: DataFrame) -> list[tuple[str, str, bool]]:
    """(name, type, nullable), by name."""
    return sorted((f.name, f.dataType.simpleString(), f.nullable) for f in table.schema.fields)
