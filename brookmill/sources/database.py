"""Result tables in a database over JDBC.

Tasks write a staging table in parallel, which a retry simply fills again.  Then one transaction
in the database applies it to the result table by keys and notes the epoch (or task) in a guard
table, so that what runs twice counts once and what fails leaves nothing half done.
The statements are plain SQL that common databases share.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

GUARD = "applied_epochs"


@dataclass(frozen=True)
class Database:
    """Where the tables are; ``text_length`` is the size of text columns that have to be made."""

    url: str
    options: dict[str, str] = field(default_factory=dict)
    text_length: int = 1000

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.format("jdbc").option("url", self.url).option("dbtable", self._dialect(spark).quoteIdentifier(table)).options(**self.options).load()

    def append(self, df: DataFrame, table: str, epoch: int) -> bool:
        """Adds the rows; returns whether the epoch was new."""
        return self._apply(df, table, epoch, [])

    def upsert_overwrite(self, df: DataFrame, table: str, keys: list[str], epoch: int) -> bool:
        """Rows replace those with the same keys, which ``df`` holds once."""
        return self._apply(df, table, epoch, ["DELETE FROM {t} WHERE EXISTS (SELECT 1 FROM {s} WHERE {same})"], keys)

    def replace_groups(self, df: DataFrame, table: str, keys: list[str], epoch: int) -> bool:
        """All rows of the groups that ``df`` names are replaced."""
        return self.upsert_overwrite(df, table, keys, epoch)

    def upsert_add(self, df: DataFrame, table: str, keys: list[str], value: str, epoch: int) -> bool:
        """The value is added to that of the same keys, which ``df`` holds once; new keys are added."""
        update = "UPDATE {t} SET {value} = {value} + (SELECT {s}.{value} FROM {s} WHERE {same}) WHERE EXISTS (SELECT 1 FROM {s} WHERE {same})"
        return self._apply(df, table, epoch, [update], keys, value, " WHERE NOT EXISTS (SELECT 1 FROM {t} WHERE {same})")

    # --- how ------------------------------------------------------------------------------

    def _dialect(self, spark: SparkSession):
        return spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(self.url)

    def _connection(self, spark: SparkSession):
        properties = spark._jvm.java.util.Properties()
        for name, value in self.options.items():
            properties.setProperty(name, value)
        if "driver" in self.options:
            spark._jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(self.options["driver"])
        return spark._jvm.java.sql.DriverManager.getConnection(self.url, properties)

    def _column_types(self, df: DataFrame) -> str:
        """Texts as VARCHAR, since long texts of unknown length can't be compared in every database."""
        return ", ".join(f"`{f.name}` VARCHAR({self.text_length})" for f in df.schema if isinstance(f.dataType, T.StringType))

    def _write(self, df: DataFrame, table: str, mode: str) -> None:
        writer = df.write.format("jdbc").option("url", self.url).option("dbtable", table).options(**self.options)
        if types := self._column_types(df):
            writer = writer.option("createTableColumnTypes", types)
        writer.mode(mode).save()

    def _exists(self, connection, table: str) -> bool:
        found = connection.getMetaData().getTables(None, None, None, None)
        try:
            while found.next():
                if found.getString("TABLE_NAME") == table:
                    return True
            return False
        finally:
            found.close()

    def _apply(self, df: DataFrame, table: str, epoch: int, changes: list[str], keys: list[str] | None = None, value: str = "", only: str = "") -> bool:
        spark = df.sparkSession
        quote = self._dialect(spark).quoteIdentifier
        t, s, g = (quote(n) for n in (table, f"{table}_staged", GUARD))
        connection = self._connection(spark)
        try:
            if not self._exists(connection, GUARD):
                self._write(spark.createDataFrame([], "table_name string, epoch long"), g, "ignore")
            if self._latest(connection, g, quote, table) >= epoch:
                return False
            if not self._exists(connection, table):
                self._write(df.limit(0), t, "ignore")
            self._write(df, s, "overwrite")
            same = " AND ".join(f"({t}.{quote(k)} = {s}.{quote(k)} OR ({t}.{quote(k)} IS NULL AND {s}.{quote(k)} IS NULL))" for k in keys or [])
            columns = ", ".join(quote(c) for c in df.columns)
            fill = {"t": t, "s": s, "same": same, "value": quote(value)}
            connection.setAutoCommit(False)
            try:
                if self._latest(connection, g, quote, table) >= epoch:
                    connection.rollback()
                    return False
                for statement in [*changes, f"INSERT INTO {{t}} ({columns}) SELECT {columns} FROM {{s}}{only}"]:
                    self._run(connection, statement.format(**fill))
                self._run(connection, f"DELETE FROM {g} WHERE {quote('table_name')} = ?", table)
                self._run(connection, f"INSERT INTO {g} ({quote('table_name')}, {quote('epoch')}) VALUES (?, {int(epoch)})", table)
                connection.commit()
                return True
            except BaseException:
                connection.rollback()
                raise
        finally:
            connection.close()

    @staticmethod
    def _run(connection, sql: str, *values: str) -> None:
        statement = connection.prepareStatement(sql)
        try:
            for i, value in enumerate(values, 1):
                statement.setString(i, value)
            statement.executeUpdate()
        finally:
            statement.close()

    @staticmethod
    def _latest(connection, guard: str, quote, table: str) -> int:
        """The epoch applied last; -1 before the first."""
        statement = connection.prepareStatement(f"SELECT MAX({quote('epoch')}) FROM {guard} WHERE {quote('table_name')} = ?")
        try:
            statement.setString(1, table)
            rows = statement.executeQuery()
            rows.next()
            epoch = rows.getLong(1)
            return -1 if rows.wasNull() else epoch
        finally:
            statement.close()
