"""Tables in a relational database, as partitioned reads and idempotent batched writes."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.operators.paths import latest


@dataclass(frozen=True)
class Database:
    """A JDBC address with its options (driver, user, password), rows fetched and written at a time, and column types by name for tables
    that Spark makes."""

    url: str
    options: dict[str, str] = field(default_factory=dict)
    batch: int = 10_000
    types: str = ""

    def _source(self, spark: SparkSession, table: str):
        return spark.read.format("jdbc").options(url=self.url, dbtable=table, fetchsize=str(self.batch), **self.options)

    def read(self, spark: SparkSession, table: str, key: str | None = None, partitions: int = 8) -> DataFrame:
        """A table; with a numeric ``key`` in so many ranges of it, each read by a task of its own. Filters and columns that
        are asked of the result go to the database. Rows of a null key come with the first range."""
        if key is None:
            return self._source(spark, table).load()
        own = self._quoted(spark, key)
        low, high = self._source(spark, f"(select min({own}) as low_, max({own}) as high_ from {table}) ends_").load().first()
        if low is None:
            return self._source(spark, table).load()
        return self._source(spark, table).options(partitionColumn=key, lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(partitions)).load()

    def _quoted(self, spark: SparkSession, name: str) -> str:
        """A column's name as Spark's writer gives it to this kind of database."""
        return spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(self.url).quoteIdentifier(name)

    def _write(self, rows: DataFrame, table: str) -> None:
        more = {"createTableColumnTypes": self.types} if self.types else {}
        rows.write.format("jdbc").options(url=self.url, dbtable=table, batchsize=str(self.batch), **self.options, **more).mode("overwrite").save()

    def _run(self, spark: SparkSession, *statements: str) -> None:
        """Statements of one transaction, from the driver."""
        jvm = spark._jvm
        properties = jvm.java.util.Properties()
        for k, v in self.options.items():
            properties.setProperty(k, v)
        if "driver" in self.options:
            jvm.java.lang.Class.forName(self.options["driver"], True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
        with_ = jvm.java.sql.DriverManager.getConnection(self.url, properties)
        try:
            with_.setAutoCommit(False)
            statement = with_.createStatement()
            for s in statements:
                statement.execute(s)
            with_.commit()
        finally:
            with_.rollback()
            with_.close()

    def write(self, rows: DataFrame, table: str) -> None:
        """Replaces a table."""
        self._write(rows, table)

    def merge_latest(self, rows: DataFrame, table: str, key: str, order: str) -> None:
        """Upserts ``rows`` into a table that is there: of each key the row of the latest ``order`` stays, of equal ones the new.
        Tasks write in batches into a table beside it, which one statement then merges, so that a run that fails or is
        repeated changes nothing twice. Rows of a null key are left out."""
        beside = f"{table}_{uuid.uuid4().hex[:12]}"
        fresh = latest(rows.where(F.col(key).isNotNull()), key, F.desc(order))
        self._write(fresh, beside)
        others = [c for c in rows.columns if c != key]
        quoted = lambda c: self._quoted(rows.sparkSession, c)
        merge = (
            f"merge into {table} t using {beside} n on t.{quoted(key)} = n.{quoted(key)} when matched and n.{quoted(order)} >= t.{quoted(order)} then update set "
            + ", ".join(f"{quoted(c)} = n.{quoted(c)}" for c in others)
            + f" when not matched then insert ({', '.join(map(quoted, [key, *others]))}) values ({', '.join('n.' + quoted(c) for c in [key, *others])})"
        )
        self._run(rows.sparkSession, merge, f"drop table {beside}")
