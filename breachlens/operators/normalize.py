"""From scanned text to typed internal rows, with a reason on every row that fails."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.values import COLUMN_SENTINELS, CREDENTIAL_TYPES, SENTINELS
from ..schemas import CANONICAL, LEAK_CSV_COLUMNS, LEAK_DATA_WRITABLE, LINEAGE, SPYCLOUD_COLUMNS, SPYCLOUD_REQUIRED
from ..sources.files import BAD_LINE, TOO_LONG

# Vendor column -> internal column. All the others are dropped.
FULL_MAPPING = {
    "email": "email",
    "password": "password",
    "target_domain": "target_domain",
    "password_plaintext": "password_plain",
    "password_type": "hash_algo",
    "infected_machine_id": "infected_machine",
    "email_domain": "domain",
    "user_browser": "browser",
    "ip_addresses": "ip",
}

# The narrower mapping by equal names; only ``domain`` comes from another column.
BY_NAME_MAPPING = {
    "email": "email",
    "password": "password",
    "target_domain": "target_domain",
    "email_domain": "domain",
}


def clear_sentinels(rows: DataFrame, columns=None) -> DataFrame:
    """``-`` and ``nan`` anywhere, and ``Unknown`` as a breach date, become NULL."""
    texts = [f.name for f in rows.schema.fields if f.dataType.simpleString() == "string"]
    columns = [c for c in texts if c not in (BAD_LINE, *LINEAGE)] if columns is None else columns
    tokens = {c: SENTINELS + COLUMN_SENTINELS.get(c, []) for c in columns}
    return rows.withColumns({c: text.blank_to_null(F.col(c), tokens[c]) for c in columns})


def clear_nan(rows: DataFrame) -> DataFrame:
    """NaN -> NULL. Text needs nothing; only floating columns can hold one."""
    floats = [f.name for f in rows.schema.fields if f.dataType.simpleString() in ("double", "float")]
    return rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else rows


def reasons(*tests) -> Column:
    """Texts of the (condition, text) pairs that hold, or NULL if none does; good rows build no text."""
    some = reduce(lambda a, b: a | b, [condition for condition, _ in tests])
    return F.when(some, F.concat_ws("; ", *[F.when(condition, F.lit(why)) for condition, why in tests]))


def check_input(rows: DataFrame) -> DataFrame:
    """Add ``error_msg``, ``notify``, ``needs_human_intervention`` and the original row of a bad one."""
    missing = [(F.col(c).isNull(), f"{c}: field required") for c in SPYCLOUD_REQUIRED]
    sighting = F.col("sighting")
    wrong = (sighting.isNotNull() & F.trim(sighting).try_cast("int").isNull(), "sighting: not an integer")
    checked = _judged(rows, reasons(*missing, wrong), SPYCLOUD_COLUMNS)
    bad = F.col("error_msg").isNotNull()
    return checked.withColumns({"notify": ~bad, "needs_human_intervention": bad})


def _judged(rows, problem, originals):
    """Add ``error_msg`` and ``original_line``. A line the scan could not use has no other problem than that."""
    line = F.col(BAD_LINE) if BAD_LINE in rows.columns else F.lit(None).cast("string")
    checked = rows.withColumn("error_msg", F.when(line.isNotNull(), F.lit(TOO_LONG)).otherwise(problem))
    original = F.coalesce(line, F.to_json(F.struct(*originals)))
    return checked.withColumn("original_line", F.when(F.col("error_msg").isNotNull(), original)).drop(BAD_LINE)


def to_internal(rows: DataFrame, mapping=None) -> DataFrame:
    """Vendor row -> internal row. Lineage and check results are carried along."""
    mapping = FULL_MAPPING if mapping is None else mapping
    source = {inner: outer for outer, inner in mapping.items()}
    have = set(rows.columns)
    carried = ["error_msg", "notify", "needs_human_intervention", "original_line"]

    def column(field):
        name = field.name
        if name in source:
            value = F.col(source[name])
            value = text.blank_to_null(value, ["-"]) if name == "ip" else value
        elif name in carried and name in have:
            value = F.col(name)
        elif name in ("email_verified", "password_verified_ok"):
            value = F.lit(False)
        elif name == "count_seen":
            value = F.lit(1)
        else:
            value = F.lit(None)
        return value.cast(field.dataType).alias(name)

    return rows.select(*[column(f) for f in CANONICAL], *[c for c in LINEAGE if c in have])


def parse_spycloud(rows: DataFrame, mapping=None) -> DataFrame:
    """The vendor parser: scan -> checked internal rows."""
    return to_internal(check_input(clear_sentinels(rows)), mapping)


def leak_csv_to_internal(rows: DataFrame) -> DataFrame:
    """Generic CSV -> internal row: text cells cast to the table's types, a bad flag or missing key noted."""
    flags = ("email_verified", "password_verified_ok")
    mandatory = [(F.col(c).isNull(), f"{c}: must not be empty") for c in ("email", "password", "dg")]
    wrong = [(F.col(c).isNotNull() & text.flag(F.col(c)).isNull(), f"{c}: not a boolean") for c in flags]
    ip = (F.col("ip").isNotNull() & ~text.ip_is_valid(F.col("ip")), "ip: not an address")
    checked = _judged(rows, reasons(*mandatory, *wrong, ip), LEAK_CSV_COLUMNS)
    return checked.withColumns({c: text.flag(F.col(c)) for c in flags})


def output_problems() -> Column:
    """Why an internal row with ``email_stored`` cannot be stored, or NULL."""
    kinds = F.col("credential_type")
    return reasons(
        (F.col("leak_id").isNull(), "leak_id: field required"),
        (~text.email_is_valid(F.col("email_stored")), "email: not a valid address"),
        (F.col("password").isNull(), "password: field required"),
        (F.col("ip").isNotNull() & ~text.ip_is_valid(F.col("ip")), "ip: not an address"),
        (
            kinds.isNotNull() & ~F.forall(kinds, lambda k: k.isin(CREDENTIAL_TYPES)),
            "credential_type: not a known type",
        ),
        (F.col("notify").isNull(), "notify: field required"),
        (F.col("needs_human_intervention").isNull(), "needs_human_intervention: field required"),
    )


def to_output(rows: DataFrame) -> DataFrame:
    """Internal -> output row; the address gets its stored spelling, a failing row its reasons.

    Rows that already carry an ``error_msg`` keep it.
    """
    checked = check_output(rows)
    bad = F.col("error_msg").isNotNull()
    return checked.withColumns(
        {
            "email": F.when(bad, F.col("email")).otherwise(F.col("email_stored")),
            "notify": F.col("notify") & ~bad,
            "needs_human_intervention": F.col("needs_human_intervention") | bad,
        }
    ).drop("external_user", "is_active_account", "email_stored")


def check_output(rows: DataFrame) -> DataFrame:
    """Add ``email_stored`` and complete ``error_msg``; a row that is found wrong gets its original noted."""
    stored = rows.withColumn("email_stored", text.normalize_email(F.col("email")))
    judged = stored.withColumn("error_msg", F.coalesce("error_msg", output_problems()))
    noted = F.coalesce("original_line", F.to_json(F.struct("email", "password", "domain", "ip")))
    return judged.withColumn("original_line", F.when(F.col("error_msg").isNotNull(), noted))


def split_valid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without an ``error_msg``, rows with one)."""
    return rows.filter("error_msg is null"), rows.filter("error_msg is not null")


def write_columns(rows: DataFrame) -> DataFrame:
    """P10: the fifteen columns an insert names."""
    return rows.select(*LEAK_DATA_WRITABLE)


def filter_rows(rows: DataFrame, predicate: Column | None = None) -> DataFrame:
    """the row filter hook; lets everything through unless given a predicate."""
    return rows if predicate is None else rows.filter(predicate)


#: Cells with a secret, by their names in any layout, the original line of a row included.
SECRETS = ("password", "password_plain", "password_hashed", "password_plaintext", "salt", "cc_number", "original_line")


def masked(rows: DataFrame, columns=SECRETS) -> DataFrame:
    """For anything shown to people. Of an original line only the cells that hold secrets are masked, where it can be told which they are."""
    cells = {c: text.mask(F.col(c)) for c in columns if c in rows.columns and c != "original_line"}
    if "original_line" in columns and "original_line" in rows.columns:
        cells["original_line"] = masked_line(F.col("original_line"))
    return rows.withColumns(cells)


def masked_line(line: Column) -> Column:
    """An original line without its secrets: a row written as JSON keeps its other cells, of any other line only the first and the last two characters stay."""
    cells = F.from_json(line, "map<string, string>")
    kept = F.transform_values(cells, lambda name, value: F.when(name.isin(list(SECRETS)), text.mask(value)).otherwise(value))
    return F.when(line.startswith("{") & cells.isNotNull(), F.to_json(kept)).otherwise(text.mask(line))
