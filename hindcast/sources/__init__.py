"""Readers and writers. Storage locations are always passed in."""

from hindcast.sources.readers import (
    read_csv_parts,
    read_delimited,
    read_parquet,
    read_strings,
    read_table,
    sample_rows,
)
from hindcast.sources.schemas import click_log_schema, coverage_map_schema, province_dim_schema
from hindcast.sources.writers import overwrite_partitions, store_path, write_table

__all__ = [
    "click_log_schema",
    "coverage_map_schema",
    "overwrite_partitions",
    "province_dim_schema",
    "read_csv_parts",
    "read_delimited",
    "read_parquet",
    "read_strings",
    "read_table",
    "sample_rows",
    "store_path",
    "write_table",
]
