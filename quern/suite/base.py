"""How queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.functions.vocab import CodepointVocabulary
from quern.sources.corpus import spread

Query = Callable[[SparkSession, str], DataFrame]


class Suite:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracle[f.__name__] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in HEAVY else df


#: Tables whose rows are long texts, so that work on a row outweighs moving it.
HEAVY = ("documents",)

CODEPOINTS = CodepointVocabulary(bos=1, eos=2)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def cp(text: str) -> str:
    """SQL of a text's code points."""
    return f"list_transform(string_split({text}, ''), lambda c: unicode(c))"


def digest_sql(x: str) -> str:
    return f"md5(array_to_string({x}, ' '))"


WORDS_SQL = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"
