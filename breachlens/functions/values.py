"""Constants of the data model."""

# ---- Fixed values: these must equal the documented behaviour for right results ----

# Cell texts that mean "missing" in a SpyCloud file.
SPYCLOUD_NA = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "n/a", "null", "-",
]

# Cell texts that mean "missing" in any other CSV file (the pandas 1.2 default list).
GENERIC_NA = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "n/a", "nan", "null",
]

# Sentinels replaced while parsing: anywhere, and in one column only.
SENTINELS = ["-", "nan", "NaN"]
COLUMN_SENTINELS = {"breach_date": ["Unknown"]}

# An address is internal when its lower-cased text ends with one of these.
INTERNAL_SUFFIXES = ["europa.eu", "jrc.it"]

# Members of the credential type enumeration and the stand-in used when none is known.
CREDENTIAL_TYPES = ["External", "Proxy", "EU Login", "Domain", "SECEM"]
DEFAULT_CREDENTIAL_TYPE = "EU Login"

# Department of an address the directory does not know.
UNKNOWN_DEPARTMENT = "Unknown"

# Record status of an active account.
ACTIVE_STATUS = "A"

# Source name of a leak created by a SpyCloud import.
SPYCLOUD_SOURCE = "SpyCloud"

# ---- End of fixed values ----

# A contact rule's "tell the address itself".
DIRECT = "DIRECT"
