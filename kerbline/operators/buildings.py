"""Buildings: open violations, filings, owners; and the cordon count series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions.codes import first_count, mode_bucket

OWNER_TYPES = ("HeadOfficer", "IndividualOwner", "CorporateOwner")


def effective_date(*cols: str) -> Column:
    """First known of several date texts."""
    return F.coalesce(*cols).try_cast("date")


def open_by_class(v: DataFrame) -> DataFrame:
    """Open violations per lot in class columns."""
    o = v.where((F.col("status") == "Open") & F.col("bbl").isNotNull() & (F.length("bbl") == 10))
    known = ("A", "B", "C")
    return o.groupBy("bbl").agg(
        F.count(F.lit(1)).alias("open_total"), *[F.count_if(F.col("class") == c).alias(f"open_class_{c.lower()}") for c in known],
        F.count_if(~F.col("class").isin(*known)).alias("open_class_i"))


def recent_filings(p: DataFrame, as_of: str, years: int = 5) -> DataFrame:
    """Filings per lot in the years before ``as_of``."""
    d = p.where(F.col("bbl").isNotNull() & (F.length("bbl") == 10)).select("bbl", effective_date("filing_date", "issuance_date", "pre_filing_date", "latest_action_date").alias("dt"))
    return d.where(F.col("dt") >= F.add_months(F.lit(as_of).cast("date"), -12 * years)).groupBy("bbl").agg(F.count(F.lit(1)).alias("permits_5y"), F.max("dt").alias("last_permit_date"))


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def pick_contact(contacts: DataFrame) -> DataFrame:
    """One owner contact per registration: named ones first, then by name and address."""
    person = F.trim(F.concat(_blank("firstname"), F.lit(" "), _blank("lastname")))
    name = F.nullif(F.upper(F.trim(F.coalesce(F.nullif(F.trim("corporationname"), F.lit("")), person))), F.lit(""))
    addr = F.upper(F.trim(F.concat(_blank("housenumber"), F.lit(" "), _blank("streetname"), F.lit(" "), _blank("zip"))))
    o = contacts.where(F.col("type").isin(*OWNER_TYPES)).select("registrationid", name.alias("owner_name"), addr.alias("owner_addr"))
    best = o.groupBy("registrationid").agg(F.min(F.struct(F.col("owner_name").isNull().alias("unnamed"), "owner_name", "owner_addr")).alias("b"))
    return best.where(F.col("b.owner_name").isNotNull()).select(
        "registrationid", "b.owner_name", F.concat("b.owner_name", F.lit("|"), F.coalesce("b.owner_addr", F.lit("?"))).alias("owner_key"))


def owner_portfolio(reg: DataFrame, contacts: DataFrame) -> DataFrame:
    """Owner of each lot and the number of buildings under the same owner key.

    (owner, building) pairs are made distinct first, so a very large owner is counted by many tasks.
    """
    r = reg.where(F.col("boroid").try_cast("int").between(1, 5) & F.col("bbl").isNotNull())
    j = r.join(pick_contact(contacts), "registrationid")
    size = j.select("owner_key", "buildingid").distinct().groupBy("owner_key").agg(F.count(F.lit(1)).alias("portfolio_buildings"))
    lot = j.groupBy("bbl", "owner_key").agg(F.min("owner_name").alias("owner_name"))
    return lot.join(size, "owner_key").groupBy("bbl").agg(F.min(F.struct("owner_key", "owner_name")).alias("o"), F.max("portfolio_buildings").alias("portfolio_buildings")).select(
        "bbl", "o.owner_key", "o.owner_name", "portfolio_buildings")


# ------------------------------------------------------------------ cordon counts
def cordon_series(rows: DataFrame) -> DataFrame:
    """Entering counts by year and mode from table rows (label, cells)."""
    m = rows.select("year", mode_bucket(F.col("label")).alias("mode"), first_count(F.col("cells")).alias("n")).where(F.col("mode").isNotNull())
    return m.groupBy("year", "mode").agg(F.sum("n").alias("entering"))


def cordon_wide(series: DataFrame, modes: Sequence[str]) -> DataFrame:
    w = series.groupBy("year").pivot("mode", list(modes)).agg(F.sum("entering"))
    w = w.select("year", *[F.coalesce(m, F.lit(0)).alias(m) for m in modes])
    return w.withColumn("total", sum((F.col(m) for m in modes), F.lit(0)))
