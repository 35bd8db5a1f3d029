"""Functions for ``spark.sql``: SQL functions, which Catalyst inlines, and the chunkers that need Python as Arrow functions.

register(spark) makes them temporary functions of the session.  Each gives what the Column builder of its name gives.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from larkspine.operators import chunkers

_NORM = "sqrt(aggregate({}, 0D, (s, x) -> s + x * x))"
_WINDOWS = "transform(if(length(p) >= {k}, sequence(1, greatest(length(p) - {k} + 1, 1)), array()), i -> substring(p, i, {k}))"
_GRAMS = "concat(" + ", ".join(_WINDOWS.format(k=k) for k in (2, 3, 4)) + ")"
_HAN = r"[\x{4E00}-\x{9FA5}]"

#: Parameters, type and body of each SQL function.
SQL_FUNCTIONS = {
    "cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", f"""CASE WHEN size(a) <> size(b) OR coalesce({_NORM.format("a")} * {_NORM.format("b")}, 0) = 0 THEN 0D
        ELSE aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / ({_NORM.format("a")} * {_NORM.format("b")}) END"""),
    "bm25_term": (
        "tf DOUBLE, df DOUBLE, docs DOUBLE, len DOUBLE, avg_len DOUBLE",
        "DOUBLE",
        "ln(1 + (docs - df + 0.5D) / (df + 0.5D)) * tf * 2.5D / (tf + 1.5D * (0.25D + 0.75D * len / avg_len))",
    ),
    "tokens_basic": ("t STRING", "ARRAY<STRING>", r"filter(split(lower(regexp_replace(t, r'[^\w\s]', ' ')), r'\s+'), x -> length(x) > 1)"),
    "tokens_mixed": (
        "t STRING",
        "ARRAY<STRING>",
        rf"""array_distinct(filter(flatten(transform(split(t, r'\s+'), w -> CASE
            WHEN w RLIKE '^[a-zA-Z]+$' THEN array(lower(w))
            WHEN w RLIKE r'{_HAN}' THEN flatten(transform(array(regexp_replace(w, r'[^\w\s\x{{4E00}}-\x{{9FA5}}]', ' ')),
                p -> transform(filter({_GRAMS}, g -> g RLIKE r'{_HAN}' AND NOT g RLIKE r'^\s|\s$'), g -> lower(g))))
            ELSE CAST(array() AS ARRAY<STRING>) END)), x -> length(x) >= 2))""",
    ),
    "chunk_slices": (
        "t STRING, width INT, overlap INT",
        "ARRAY<STRING>",
        """CASE WHEN width <= 0 OR overlap < 0 OR overlap >= width THEN raise_error('overlap must be less than size')
            WHEN length(t) > 0 THEN transform(sequence(0, CAST(greatest(ceil((length(t) - width) / (width - overlap)), 0) AS INT)),
                i -> substring(t, i * (width - overlap) + 1, width))
            ELSE CAST(array() AS ARRAY<STRING>) END""",
    ),
}

#: Chunkers over whole texts, called as name(text, size, overlap).
PYTHON_FUNCTIONS = {"chunk_recursive": chunkers.recursive, "chunk_markdown": chunkers.markdown, "chunk_parents": chunkers.parent_slices}


class ChunkTexts:
    """Table function chunk_texts(TABLE(docs), strategy, size, overlap): the rows of a table with columns doc_id and text become doc_id,
    chunk_index, chunk.  Strategies: slices, recursive, code, markdown, parents.  ``PARTITION BY`` is not needed: rows are chunked where they are."""

    STRATEGIES = {
        "slices": lambda t, n, o: [t[i : i + n] for i in range(0, max(1, len(t) - o), n - o)] if t else [],
        "recursive": chunkers.recursive,
        "code": lambda t, n, o: chunkers.recursive(t, n, o, chunkers.CODE_SEPARATORS),
        "markdown": chunkers.markdown,
        "parents": chunkers.parent_slices,
    }

    @staticmethod
    def analyze(rows: AnalyzeArgument, strategy: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or {"doc_id", "text"} - set(rows.dataType.names):
            raise ValueError("the first argument must be a table with columns doc_id and text")
        if strategy.value not in ChunkTexts.STRATEGIES:
            raise ValueError(f"the strategy must be one of {', '.join(ChunkTexts.STRATEGIES)}")
        chunkers.check(size.value, overlap.value)
        return AnalyzeResult(StructType([StructField("doc_id", rows.dataType["doc_id"].dataType), StructField("chunk_index", IntegerType()), StructField("chunk", StringType())]))

    def eval(self, row, strategy, size, overlap):
        for i, c in enumerate(ChunkTexts.STRATEGIES[strategy](row["text"] or "", size, overlap)):
            yield row["doc_id"], i, c


def _arrow(function):
    @F.pandas_udf("array<string>")
    def run(t: pd.Series, size: pd.Series, overlap: pd.Series) -> pd.Series:
        return pd.Series([function(x or "", int(n), int(o)) for x, n, o in zip(t, size, overlap)], dtype=object)

    return run


def register(spark: SparkSession) -> list[str]:
    """The names that spark.sql can use from now on; a null text has null tokens and no chunks."""
    for name, (parameters, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, function in PYTHON_FUNCTIONS.items():
        spark.udf.register(name, _arrow(function))
    spark.udtf.register("chunk_texts", F.udtf(ChunkTexts, useArrow=True))
    return [*SQL_FUNCTIONS, *PYTHON_FUNCTIONS, "chunk_texts"]
