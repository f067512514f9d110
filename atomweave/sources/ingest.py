"""Atom ingestion: rows from JSON payloads, comma lists and XML; deduplicated atoms with reference counts; sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATOM_JSON = "array<struct<atomicValue: string, canonicalText: string, modality: string, subtype: string>>"


def atoms_from_json(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """A row per element of each payload's JSON array; malformed payloads give none."""
    return payloads.select(F.inline(F.from_json(column, ATOM_JSON)))


def split_list(column: Column, separator: str = ",") -> Column:
    """Items of a separated list, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(column, separator), F.trim), lambda x: x != "")


def from_xml_path(column: str, path: str) -> Column:
    return F.expr(f"xpath_string({column}, '{path}')")


def atoms(values: DataFrame, value: str, tenant: str) -> DataFrame:
    """(tenant, content_hash, value, reference_count): one atom per tenant and content, references counted."""
    h = F.sha2(F.col(value).cast("binary"), 256).alias("content_hash")
    return values.where(F.col(value).isNotNull()).select(F.col(tenant).alias("tenant"), h, F.col(value).alias("value")).groupBy("tenant", "content_hash").agg(F.min("value").alias("value"), F.count("*").alias("reference_count"))


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Atoms of both, reference counts added."""
    return old.unionByName(new).groupBy("tenant", "content_hash").agg(F.min("value").alias("value"), F.sum("reference_count").alias("reference_count"))


def write_clustered(frame: DataFrame, path: str, key: str, partitions: int) -> None:
    """Parquet in key order (a curve code, say), so that row-group statistics skip what a range filter doesn't need."""
    frame.repartitionByRange(partitions, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)
