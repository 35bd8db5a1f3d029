"""Rows with metadata maps, stored so that predicates on metadata skip data.

The keys that most rows have become columns of their own, with the row groups' statistics and Bloom filters, and the rows are sorted by the first of
them; the rest stay in a map.  A ``MetadataFilter`` compiles to a condition on both: equality, IN and prefixes of a promoted key reach the scan.
Numbers are compared as the filter says, from strings; a promoted key that holds numbers only in its sample of statistics gets no other type, so
rows come back as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspine.operators import paths
from larkspine.operators.filters import MetadataFilter

#: Keys that become columns at most, and the share of rows that must have one.
MOST_KEYS, LEAST_SHARE = 16, 0.05
#: Bytes of a row group, small enough for statistics to tell groups apart.
GROUP_BYTES = 8 << 20
PREFIX = "m_"


class MetadataTable:
    """``rows`` (all columns but metadata, a column ``m_<n>`` for each promoted key, ``metadata`` with the rest) and ``keys`` (n, key)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def create(self, rows: DataFrame, files: int | None = None, most_keys: int = MOST_KEYS) -> MetadataTable:
        """Writes rows with a column metadata (map of strings); the keys, written last, say that the table is whole."""
        paths.delete(self.spark, self.path)
        n = rows.count()
        counted = rows.select(F.explode(F.map_keys("metadata")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
        top = counted.where(F.col("rows") >= max(1, LEAST_SHARE * n)).orderBy(F.desc("rows"), "key").limit(most_keys).collect()
        keys = [r["key"] for r in top]
        names = [f"{PREFIX}{i}" for i in range(len(keys))]
        own = [F.try_element_at("metadata", F.lit(k)).alias(c) for k, c in zip(keys, names)]
        # A key whose value is null is told from a missing one by its name, which stays in the map.
        rest = F.map_filter("metadata", lambda k, v: ~k.isin(*keys) | v.isNull()) if keys else F.col("metadata")
        wide = rows.select(*[c for c in rows.columns if c != "metadata"], *own, rest.alias("metadata"))
        if names:
            wide = (wide.repartitionByRange(files, *names[:2]) if files else wide.repartitionByRange(*names[:2])).sortWithinPartitions(*names)
        out = wide.write.option("parquet.block.size", GROUP_BYTES)
        for c in names:
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
        out.parquet(f"{self.path}/rows")
        self.spark.createDataFrame(list(zip(names, keys)), "name string, key string").coalesce(1).write.parquet(f"{self.path}/keys")
        return self

    def promoted(self) -> dict[str, str]:
        """Column names by key."""
        return {r["key"]: r["name"] for r in self.spark.read.parquet(f"{self.path}/keys").collect()}

    def _of(self, columns: dict[str, str]):
        return lambda key: F.col(columns[key]) if key in columns else F.try_element_at("metadata", F.lit(key))

    def where(self, condition: MetadataFilter) -> DataFrame:
        """The rows that meet a condition on their metadata, as they were written."""
        columns = self.promoted()
        found = self.spark.read.parquet(f"{self.path}/rows").where(condition.to_column(self._of(columns)) & pushed(condition, columns))
        own = F.map_filter(F.create_map(*[F.lit(x) if i == 0 else F.col(x) for kv in columns.items() for i, x in enumerate(kv)]), lambda k, v: v.isNotNull()) if columns else F.create_map().cast("map<string,string>")
        return found.select(*[c for c in found.columns if c != "metadata" and c not in columns.values()], F.map_concat(own, "metadata").alias("metadata"))


def pushed(condition: MetadataFilter, columns: dict[str, str]) -> Column:
    """A condition that every row that meets ``condition`` meets too, of plain comparisons of columns, which Spark hands to the scan."""

    def of(part) -> Column | None:
        if isinstance(part, MetadataFilter):
            some = [of(p) for p in part.parts]
            if part.logic == "AND":
                some = [c for c in some if c is not None]
            if not some or any(c is None for c in some):
                return None
            out = some[0]
            for c in some[1:]:
                out = out & c if part.logic == "AND" else out | c
            return out
        if part.key not in columns:
            return None
        c = F.col(columns[part.key])
        return {"EQUALS": lambda: c == part.value, "STARTS_WITH": lambda: c.startswith(part.value), "IN": lambda: c.isin(*part.values) if part.values else F.lit(False), "EXISTS": lambda: c.isNotNull()}.get(part.op, lambda: None)()

    found = of(condition)
    return F.lit(True) if found is None else found
