"""Fixed schemas of the delimited inputs."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(fields: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


def province_dim_schema() -> T.StructType:
    text = T.StringType()
    return _struct(
        {
            "province_dim_id": T.IntegerType(),
            "country_code": text,
            "province": text,
            "prov_code": text,
            "prov_abbrev": text,
            "region": text,
            "alternate_region": text,
        }
    )


def coverage_map_schema() -> T.StructType:
    text = T.StringType()
    return _struct(
        {
            "line_of_business": text,
            "line_type": T.IntegerType(),
            "line_type_desc": text,
            "cvg_type_cd": text,
            "modeling_id_cl": text,
        }
    )


def click_log_schema(numbers: int = 13, categories: int = 26) -> T.StructType:
    """A label, then float columns ``I1..``, then string columns ``C1..``; all but the label nullable."""
    fields: dict[str, T.DataType] = {"label": T.IntegerType()}
    fields |= {f"I{i}": T.FloatType() for i in range(1, numbers + 1)}
    fields |= {f"C{i}": T.StringType() for i in range(1, categories + 1)}
    return _struct(fields)
