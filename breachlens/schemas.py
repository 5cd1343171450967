"""Table schemas. Scans read text columns and cast later; nothing is ever inferred."""

from pyspark.sql import types as T

_S, _L, _B, _TS = T.StringType(), T.LongType(), T.BooleanType(), T.TimestampType()
_A = T.ArrayType(T.StringType())


def _struct(*fields):
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


# ---- Fixed values: table and file columns, which must equal the documented layout ----

LEAK = _struct(
    ("id", _L, False),
    ("breach_ts", _TS, True),
    ("source_publish_ts", _TS, True),
    ("ingestion_ts", _TS, False),
    ("summary", _S, False),
    ("ticket_id", _S, True),
    ("reporter_name", _S, True),
    ("source_name", _S, True),
)

# Columns an update of a leak replaces; ``ingestion_ts`` keeps its first value.
LEAK_UPDATABLE = ["summary", "ticket_id", "reporter_name", "source_name", "breach_ts", "source_publish_ts"]

LEAK_DATA = _struct(
    ("id", _L, False),
    ("leak_id", _L, False),
    ("email", _S, False),
    ("password", _S, False),
    ("password_plain", _S, True),
    ("password_hashed", _S, True),
    ("hash_algo", _S, True),
    ("ticket_id", _S, True),
    ("email_verified", _B, True),
    ("password_verified_ok", _B, True),
    ("ip", _S, True),
    ("domain", _S, True),
    ("target_domain", _S, True),
    ("browser", _S, True),
    ("malware_name", _S, True),
    ("infected_machine", _S, True),
    ("dg", _S, False),
    ("count_seen", _L, True),
)

# Columns an update of a credential replaces, which are also the columns an insert writes.
LEAK_DATA_WRITABLE = [
    "leak_id", "email", "password", "password_plain", "password_hashed", "hash_algo", "ticket_id",
    "email_verified", "password_verified_ok", "ip", "domain", "browser", "malware_name", "infected_machine", "dg",
]

# A stored credential is unique on these; a NULL in any of them never equals anything.
LEAK_DATA_KEY = ["leak_id", "email", "password", "domain"]

SPYCLOUD_COLUMNS = [
    "breach_title", "spycloud_publish_date", "breach_date", "email", "domain", "username", "password", "salt",
    "target_domain", "target_url", "password_plaintext", "sighting", "severity", "status", "password_type",
    "cc_number", "infected_path", "infected_machine_id", "email_domain", "cc_expiration", "cc_last_four",
    "email_username", "user_browser", "infected_time", "ip_addresses",
]
SPYCLOUD_REQUIRED = ["breach_title", "email", "domain", "password", "email_domain", "email_username"]

# Columns of the generic leak CSV (the import adds ``leak_id``).
LEAK_CSV_COLUMNS = [name for name in LEAK_DATA_WRITABLE if name != "leak_id"]

DIRECTORY = _struct(
    ("mail", _S, True),
    ("cn", _A, True),
    ("dg", _A, True),
    ("uid", _A, True),
    ("ecMoniker", _A, True),
    ("employeeType", _A, True),
    ("recordStatus", _A, True),
    ("sn", _A, True),
    ("givenName", _A, True),
)

# Internal row: the stored columns plus flags, notes and lineage.
CANONICAL = _struct(
    ("leak_id", _L, True),
    ("email", _S, True),
    ("password", _S, True),
    ("password_plain", _S, True),
    ("password_hashed", _S, True),
    ("hash_algo", _S, True),
    ("ticket_id", _S, True),
    ("email_verified", _B, True),
    ("password_verified_ok", _B, True),
    ("ip", _S, True),
    ("domain", _S, True),
    ("target_domain", _S, True),
    ("browser", _S, True),
    ("malware_name", _S, True),
    ("infected_machine", _S, True),
    ("dg", _S, True),
    ("external_user", _B, True),
    ("is_vip", _B, True),
    ("is_active_account", _B, True),
    ("credential_type", _A, True),
    ("report_to", _A, True),
    ("count_seen", _L, True),
    ("original_line", _S, True),
    ("error_msg", _S, True),
    ("notify", _B, True),
    ("needs_human_intervention", _B, True),
)

# ---- End of fixed values ----

# Position of a row in the files it came from; unique, and ordered as the lines are.
LINEAGE = ["src_file", "src_block", "src_ord"]


def all_text(columns):
    return T.StructType([T.StructField(name, _S) for name in columns])
