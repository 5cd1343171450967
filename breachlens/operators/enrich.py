"""Facts about the owner of an address, joined on for whole tables at once."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.rules import report_to
from ..functions.values import ACTIVE_STATUS, DEFAULT_CREDENTIAL_TYPE, UNKNOWN_DEPARTMENT
from .joins import BROADCAST_ROWS, fits_broadcast, lookup, mark_matching

PERSON = ["dept", "user_id", "status"]


def people(directory: DataFrame, order=None) -> DataFrame:
    """One row per address from a directory snapshot: the first value of the first matching entry.

    Attributes are arrays; an empty first value counts as missing. ``order`` says which entry is first (default: by ``uid``).
    """
    def head(name):
        return F.nullif(F.get(name, F.lit(0)), F.lit(""))

    entry = F.struct(head("dg").alias("dept"), head("ecMoniker").alias("user_id"), head("recordStatus").alias("status"))
    rank = F.struct(*(order or ["uid", "cn"]))
    keyed = directory.filter(F.col("mail").isNotNull()).withColumn("email_key", text.match_key(F.col("mail")))
    return keyed.groupBy("email_key").agg(F.min_by(entry, rank).alias("p")).select("email_key", "p.*")


def with_email_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("email_key", text.match_key(F.col("email")))


def directory_fits(directory, max_broadcast_rows=BROADCAST_ROWS) -> bool:
    return fits_broadcast(directory.select("mail", "dg", "ecMoniker", "recordStatus"), max_broadcast_rows)


def with_vip(rows, vips, *, unique: Column, max_broadcast_rows=BROADCAST_ROWS, small=None) -> DataFrame:
    """``is_vip``; a flag already true stays."""
    keyed = with_email_key(rows)
    had = F.col("is_vip") if "is_vip" in rows.columns else F.lit(False)
    marked = mark_matching(
        keyed, vips, "email_key", unique=unique, name="_vip", max_broadcast_rows=max_broadcast_rows, small=small
    )
    return marked.withColumn("is_vip", F.coalesce(had, F.lit(False)) | F.col("_vip")).drop("_vip", "email_key")


def with_person(
    rows, directory, *, unique: Column, order=None, max_broadcast_rows=BROADCAST_ROWS, small=None
) -> DataFrame:
    """J3, J4, J5 by one join: ``dept``, ``user_id`` and ``status`` of the address, NULL where unknown."""
    small = directory_fits(directory, max_broadcast_rows) if small is None else small
    return lookup(
        with_email_key(rows), people(directory, order), "email_key", unique=unique,
        max_broadcast_rows=max_broadcast_rows, small=small,
    ).drop("email_key")


def department() -> Column:
    return F.coalesce(F.col("dept"), F.lit(UNKNOWN_DEPARTMENT))


def is_active() -> Column:
    return F.coalesce(F.upper("status") == ACTIVE_STATUS, F.lit(False))


def enrich(
    rows: DataFrame,
    *,
    vips: DataFrame,
    directory: DataFrame,
    unique: Column,
    leak_id=None,
    rules=None,
    suffixes=None,
    credential_type: str = DEFAULT_CREDENTIAL_TYPE,
    max_broadcast_rows: int = BROADCAST_ROWS,
    small_vips: bool | None = None,
    small_directory: bool | None = None,
) -> DataFrame:
    """Fill what is missing -- false, empty and NULL all count as missing -- and set the outcome flags.

    A row that came with an ``error_msg`` keeps it; only good rows become "notify, no human needed". Rows of
    external addresses are not notified.
    """
    columns = rows.columns
    if leak_id is not None:
        rows = rows.withColumn("leak_id", F.lit(leak_id).cast("long"))
    bound = {"unique": unique, "max_broadcast_rows": max_broadcast_rows}
    flagged = with_vip(rows, vips, small=small_vips, **bound)
    known = with_person(flagged, directory, small=small_directory, **bound)
    email = F.col("email")
    good = F.col("error_msg").isNull()
    external = F.coalesce(F.col("external_user"), F.lit(False)) | text.is_external(email, suffixes)
    filled = known.withColumns(
        {
            "dg": text.default_if_empty(F.col("dg"), department()),
            "is_active_account": F.coalesce(F.col("is_active_account"), F.lit(False)) | is_active(),
            "external_user": external,
            "credential_type": F.when(F.size("credential_type") > 0, F.col("credential_type")).otherwise(
                F.array(F.lit(credential_type))
            ),
            "report_to": F.when(F.size("report_to") > 0, F.col("report_to")).otherwise(report_to(email, rules)),
            "notify": good & ~external,
            "needs_human_intervention": ~good,
        }
    )
    return filled.select(*columns)
