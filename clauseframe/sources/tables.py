"""Readers and writers of documents, ids and results."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Each file a document: (law_id, text)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("law_id"), F.col("value").alias("text"))


def ids_from_csv(spark: SparkSession, path: str, column: str = "law_id") -> DataFrame:
    """Ids from a file with a header, stripped; blank ones go, repeated ones stay. A missing column gives no id."""
    rows = spark.read.csv(path, header=True)
    if column not in rows.columns:
        return spark.createDataFrame([], "law_id string")
    return rows.select(F.btrim(F.col(column)).alias("law_id")).where("law_id <> ''")


def ids_from_list(spark: SparkSession, ids: list[str]) -> DataFrame:
    return spark.createDataFrame([(str(i),) for i in ids], "law_id string")


def ids_with_text(source: DataFrame, id_col: str, text: str) -> DataFrame:
    """The ids whose text is there; the filter reaches the scan."""
    return source.where(F.col(text).isNotNull() & (F.col(text) != "")).select(id_col)


@dataclass
class JdbcConfig:
    """A database of documents. No credentials are kept in the code."""

    host: str
    port: int
    user: str
    password: str
    name: str

    @classmethod
    def from_env(cls) -> JdbcConfig:
        get = os.environ.get
        return cls(get("LEGAL_DB_HOST", "localhost"), int(get("LEGAL_DB_PORT", "3306")), get("LEGAL_DB_USER", "root"), get("LEGAL_DB_PASSWORD", ""), get("LEGAL_DB_NAME", "legal_db"))

    def configured(self) -> bool:
        return self.host != "localhost" and bool(self.password)

    def options(self) -> dict[str, str]:
        return {"url": f"jdbc:mysql://{self.host}:{self.port}/{self.name}", "user": self.user, "password": self.password}


def jdbc_documents(spark: SparkSession, config: JdbcConfig, name: str, id_col: str, text: str, parts: int = 1, bounds: tuple[int, int] | None = None) -> DataFrame:
    """(law_id, text) from a table; filters on ids are pushed to the database.

    With bounds, the least and greatest of numeric ids, the table is read in so many parts; otherwise by one task.
    """
    if not config.configured():
        raise ValueError("the database is not configured: set LEGAL_DB_HOST and LEGAL_DB_PASSWORD")
    cut = {"partitionColumn": id_col, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(parts)} if bounds else {}
    return spark.read.format("jdbc").options(dbtable=name, **cut, **config.options()).load().select(F.col(id_col).alias("law_id"), F.col(text).alias("text"))


def write_reports(split: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A table of documents and one of fragments."""
    from clauseframe.plans import api

    api.document_report(split).write.mode(mode).parquet(f"{path}/document_report")
    api.fragments_table(split).write.mode(mode).parquet(f"{path}/fragments")


def append_snapshot(split: DataFrame, path: str) -> None:
    """What was done, without the fragments: one JSON line for each document."""
    split.select("law_id", F.col("report").alias("analysis"), "split_types", F.size("fragments").alias("split_count"), "error").write.mode("append").json(path)
