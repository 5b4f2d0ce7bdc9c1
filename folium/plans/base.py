"""What the queries are made of: the registry, tables, and SQL of rules and lights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folium.functions import rules, validate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rule_sql(name: str, text: str = "text") -> str:
    """A field's rules as DuckDB SQL."""
    tries = ", ".join(f"nullif(regexp_extract(coalesce({text}, ''), {quoted('(?im)' + p.replace(chr(92) + 'u202c', chr(0x202C)))}, 1), '')" for p in rules.RULES[name])
    return f"trim(coalesce({tries}, NULL), {quoted(rules.STRIP)})"


def shape_sql(name: str, value: str) -> str:
    shape = validate.SHAPES[name].replace("(?dU)", "")
    return f"CASE WHEN coalesce({value}, '') = '' THEN 'yellow' WHEN NOT regexp_matches(trim({value}, ' \t\r\n'), {quoted(shape)}) THEN 'red' ELSE 'green' END"


def repeated_sql(value: str) -> str:
    ws = f"list_filter(regexp_split_to_array({value}, '\\s+'), lambda w: w <> '')"
    some = [f"list_max(list_transform(list_distinct(g{n}), lambda g: len(list_filter(g{n}, lambda h: h = g)))) >= 4" for n in (2, 3, 4)]
    grams = ", ".join(f"list_transform(range(1, len(ws) - {n} + 2), lambda i: array_to_string(ws[i : i + {n} - 1], ' ')) AS g{n}" for n in (2, 3, 4))
    return f"coalesce((SELECT len(ws) >= 8 AND ({' OR '.join(some)}) FROM (SELECT ws, {grams} FROM (SELECT {ws} AS ws))), false)"


def text_light_sql(value: str) -> str:
    return f"CASE WHEN coalesce({value}, '') = '' THEN 'yellow' WHEN {repeated_sql(value)} THEN 'red' WHEN length({value}) > 260 THEN 'yellow' ELSE 'green' END"
