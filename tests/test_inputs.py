"""Inputs and ingestion take every row of their tables."""

from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kerbline.catalog import inputs


def test_ingest_csv_reads_every_ride(spark):
    rides = inputs.rides(spark, SMALL)
    assert rides.where(F.year("transit_timestamp") >= 1998).count() > 0
    got = entry.queries()["src02_ingest_csv"](spark, SMALL)
    assert sorted(r.ride_id for r in got.select("ride_id").collect()) == sorted(r.ride_id for r in rides.select("ride_id").collect())


def test_every_supplier_has_a_program(spark, tmp_path):
    spark.range(1, 61).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r.route: str(r.start_date) for r in inputs.programs(spark, str(tmp_path)).collect()}
    assert set(got) == {f"R{k}" for k in range(1, 61)}
    assert got["R1"] == "1996-03-01" and got["R40"] == "2002-07-28"
