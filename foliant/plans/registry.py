"""The registry of queries, and the pieces of DuckDB SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import rounded

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query under ``name``, with the SQL that gives the same rows."""

    def add(build: Query) -> Query:
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return add


def on(table_name: str, name: str, sql: str | None = None) -> Callable:
    """Register a query that takes one table."""

    def add(build: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        register(name, sql)(lambda spark, sf_dir: build(table(spark, sf_dir, table_name)))
        return build

    return add


#: Tables whose scan is estimated at no more bytes than this are dealt over all cores.
SMALL_TABLE = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder. A small one that lies in few files, and so in few row groups, is dealt over the cores.

    What that shuffles is bounded; larger tables have row groups enough and are read as they lie.
    """
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    few = size <= SMALL_TABLE and len(found.inputFiles()) < cores
    return found.repartition(cores) if few else found


def n(value: Column) -> Column:
    return value.cast("long")


def r6(value: Column) -> Column:
    return rounded(value.cast("double"))


def joined(values: Column) -> Column:
    return F.array_join(values, "|")


# --- SQL ------------------------------------------------------------------------------------------------

BLANKS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def q(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("'", "''") + "'"


def pattern(p: str, ignore_case: bool = False) -> str:
    """A pattern literal; classes that are ASCII only in that dialect are spelled out."""
    inside = False
    out = []
    i = 0
    while i < len(p):
        two = p[i : i + 2]
        if two == "\\w":
            out.append(r"\p{L}\p{N}_" if inside else r"[\p{L}\p{N}_]")
            i += 2
        elif p[i] == "\\":
            out.append(two)
            i += 2
        else:
            inside = {"[": True, "]": False}.get(p[i], inside)
            out.append(p[i])
            i += 1
    return q(("(?i)" if ignore_case else "") + "".join(out))


def s_strip(t: str) -> str:
    return f"trim({t}, {BLANKS})"


def s_words(t: str) -> str:
    return f"list_filter(string_split_regex({t}, '\\s+'), lambda w: w <> '')"


def s_bare(t: str, punctuation: str) -> str:
    return s_words(f"translate({t}, {q(punctuation)}, '')")


def s_pieces(t: str, separator: str) -> str:
    return f"list_filter(list_transform(string_split_regex({t}, {q(separator)}), lambda p: {s_strip('p')}), lambda p: p <> '')"


def s_sentences(t: str) -> str:
    return s_pieces(t, r"[.!?؟]+\s*")


def s_count(t: str, p: str, ignore_case: bool = False) -> str:
    return f"len(regexp_extract_all({t}, {pattern(p, ignore_case)}))"


def s_literal(t: str, term: str) -> str:
    return f"((length({t}) - length(replace({t}, {q(term)}, ''))) // {len(term)})"


def s_first_best(scores: dict[str, str]) -> str:
    """The class of the largest score, the first one winning ties."""
    best = f"greatest({', '.join(scores.values())})"
    cases = " ".join(f"WHEN {score} = {best} THEN {q(name)}" for name, score in scores.items())
    return f"CASE {cases} END"


def s_long(t: str) -> str:
    return f"CAST({t} AS BIGINT)"


def s_r6(t: str) -> str:
    return f"round(CAST({t} AS DOUBLE), 6)"


def s_avg(t: str) -> str:
    """The mean of a list, 0 of an empty one."""
    return f"coalesce(list_avg({t}), 0)"
