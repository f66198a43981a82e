"""Column functions; ``register_functions`` makes the scalar ones callable from SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

# SQL bodies of the scalar functions for SQL users; each is plain Spark SQL, so
# a call is inlined into the caller's plan and optimised with it.
SQL_FUNCTIONS = {
    "gtfs_seconds(t STRING) RETURNS INT": (
        "CASE WHEN trim(t) RLIKE '^[0-9]+:[0-9]+:[0-9]+$' THEN try_cast(split_part(trim(t), ':', 1) AS INT) * 3600"
        " + try_cast(split_part(trim(t), ':', 2) AS INT) * 60 + try_cast(split_part(trim(t), ':', 3) AS INT) END"
    ),
    "route_norm(r STRING) RETURNS STRING": "upper(regexp_replace(regexp_replace(r, '-SBS', ''), '[^A-Za-z0-9]', ''))",
    "bbl(boro STRING, block STRING, lot STRING) RETURNS STRING": "concat(boro, lpad(block, 5, '0'), lpad(lot, 4, '0'))",
    "haversine_m(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE": (
        "12742000.0 * asin(least(1.0D, sqrt(pow(sin(radians(lat2 - lat1) / 2), 2)"
        " + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"
    ),
    "wrap_half_day(d BIGINT) RETURNS BIGINT": "43200 - pmod(43200 - d, 86400)",
}


def register_functions(spark: SparkSession) -> list[str]:
    """Register the scalar functions as temporary SQL functions; returns their names."""
    names = []
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
        names.append(signature.split("(", 1)[0])
    return names
