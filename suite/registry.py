"""Registry of queries: a Spark callable (spark, sf_dir) and, where SQL can say the same, the DuckDB text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from maskline.session import materialize, shared_folder
from suite.fixtures import FIXTURES

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def chain(sql: str) -> str:
    """sql preceded by the fixtures it names, as WITH clauses, in dependency order."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bfx_\w+\b", text):
            if name in FIXTURES and name not in ordered:
                visit(FIXTURES[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    return with_clauses(ordered, sql)


def with_clauses(ordered: list[str], sql: str) -> str:
    if not ordered:
        return sql
    ctes = ",\n".join(f"{name} AS ({FIXTURES[name].strip()})" for name in ordered)
    body = sql.strip()
    # A query with its own WITH continues the list.
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def tagged(docs: str, pattern: str, options: str = "gi") -> str:
    """DuckDB: (doc_id, lang, text, start, "end", value) of all matches of one RE2 pattern over `docs`."""
    return f"""
select doc_id, lang, text, cast(before - (i - 2) as int) as start, cast(before - (i - 2) + length(value) as int) as "end", value
from (
  select *, string_split(piece, chr(2))[1] as value,
    coalesce(sum(length(piece)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as before
  from (
    select doc_id, lang, text, unnest(pieces) as piece, generate_subscripts(pieces, 1) as i
    from (select doc_id, lang, text, string_split(regexp_replace(text, '({pattern})', chr(1) || '\\1' || chr(2), '{options}'), chr(1)) as pieces from {docs})
  )
) where i > 1"""


# Derived tables that many queries share: written once per session and folder of tables, then read like the given ones.
SHARED = {"fx_parts", "fx_letters", "fx_gold", "fx_pred", "fx_spans", "fx_calls", "fx_priced", "fx_markers", "fx_conv_spans"}
_written: dict[tuple[str, ...], DataFrame] = {}
# A given file may hold a single row group, which is one task however long: the rows of slim tables that long texts and costly
# steps are derived from, and vectors, are dealt out by their key. Documents, pages and the like are read as they lie.
DEALT_BY = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "embeddings": "vec_id"}
# A vector meets every query, so that fewer of them are as much work.
ROWS_A_TASK, VECTORS_A_TASK, TASKS_A_CORE = 20_000, 500, 16


def parts_of(df: DataFrame, least: int = 1, rows: int = ROWS_A_TASK) -> int:
    """Tasks or files that the rows of df ask for. A given table is counted from the footers of its files."""
    most = TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism
    return max(least, min(-(-df.count() // rows), most))


def dealt(df: DataFrame, key: str, rows: int = ROWS_A_TASK) -> DataFrame:
    """df over as many tasks as its rows ask for; short tables as they are."""
    tasks = parts_of(df, rows=rows)
    return df.repartition(tasks, key) if tasks > 1 else df



class Tables:
    """t('customer') is a given table, t('fx_nir') a derived one; t.sql() runs SQL over both."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _shared(self, name: str) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, shared_folder(self.spark), self.sf_dir, name)
        if key not in _written:
            _written[key] = materialize(self.sql(FIXTURES[name]))
        return _written[key]

    def _given(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in DEALT_BY:
            return df
        return dealt(df, DEALT_BY[name], VECTORS_A_TASK if name == "embeddings" else ROWS_A_TASK)

    def _register(self, sql: str) -> str:
        """Temp views for the tables that sql names; its text with the derived tables that are not shared as WITH."""
        ordered: list[str] = []

        def visit(text: str) -> None:
            for name in dict.fromkeys(re.findall(r"\b\w+\b", text)):
                if name in BASE:
                    self._given(name).createOrReplaceTempView(name)
                elif name in SHARED:
                    self._shared(name).createOrReplaceTempView(name)
                elif name in FIXTURES and name not in ordered:
                    visit(FIXTURES[name])
                    ordered.append(name)

        visit(sql)
        return with_clauses(ordered, sql)

    def sql(self, sql: str) -> DataFrame:
        # "end" is a reserved word in DuckDB; Spark quotes with backticks.
        return self.spark.sql(self._register(sql).replace('"end"', "`end`"))

    def __call__(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}")


def query(name: str, oracle: str | None = None, **casts: str):
    """Registers a query; casts gives SQL types to columns of the SQL twin whose literals DuckDB types otherwise."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = chain(oracle)
            if casts:
                typed = ", ".join(f"CAST({column} AS {kind}) AS {column}" for column, kind in casts.items())
                ORACLES[name] = f"SELECT * REPLACE ({typed}) FROM (\n{ORACLES[name]}\n) typed"
        return build

    return register
