"""Registration of queries, and SQL pieces that several of them share."""

from __future__ import annotations

from collections.abc import Callable

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from larkspine.operators.index import KeywordIndex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of a table reader; ``sql`` is what DuckDB runs in comparison."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return f

    return register


_INDEXES: dict[tuple, KeywordIndex] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(where)))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where it is unset and all runs in one process, this machine's temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found or tempfile.gettempdir()


def _drop_indexes() -> None:
    for index in _INDEXES.values():
        with contextlib.suppress(Exception):  # the session may be gone, and its folder with it
            index.drop()


class Tables:
    """Tables of a folder as attributes, and keyword indexes of its documents."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def keywords(self, distinct: bool = False) -> KeywordIndex:
        """The index of the documents' texts: built by the first search of a session, anew where the files have changed."""
        key = (self.spark.sparkContext.applicationId, distinct, _state(self.spark, f"{self.sf_dir}/documents.parquet"))
        if key not in _INDEXES or not _INDEXES[key].exists():
            if not _INDEXES:
                atexit.register(_drop_indexes)
            _INDEXES[key] = KeywordIndex(self.spark, f"{shared_folder(self.spark)}/keywords-{uuid.uuid4().hex}", distinct).create(self.documents)
        return _INDEXES[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def tok_a(c: str) -> str:
    return rf"[x for x in string_split_regex(lower(regexp_replace({c}, '[^\w\s]', ' ', 'g')), '\s+') if length(x) > 1]"


def tok_b(c: str) -> str:
    """Without Han characters only ASCII words remain."""
    return rf"list_distinct([lower(x) for x in string_split_regex({c}, '\s+') if regexp_full_match(x, '[a-zA-Z]+') and length(x) > 1])"


def word_set(c: str) -> str:
    return rf"list_distinct([x for x in string_split_regex(lower({c}), '\s+') if x <> ''])"
