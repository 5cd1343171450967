"""The domain's tables as projections of the given ones.

Each projection is one text that both engines read, so the comparison is about the operators.
"""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedupe
from ..schemas import LEAK_DATA, SPYCLOUD_COLUMNS

CUTOFF = "2024-01-20 00:00:00"

_PW = "concat('pw', cast(cast(floor(value) as int) % 10 as string))"
_HOST = (
    "case when user_id % 5 = 0 then 'mail.europa.eu' when user_id % 7 = 0 then 'example.ec.europa.eu' "
    "else 'example.com' end"
)
_USER = "concat(case when event_id % 3 = 0 then 'User' else 'user' end, cast(user_id as string))"

# Stored and incoming credentials, from events.
CRED = {
    "id": "event_id",
    "leak_id": "cast(user_id % 10 + 1 as bigint)",
    "email": f"concat({_USER}, '@', {_HOST})",
    "password": f"case when event_type = 'error' then null else {_PW} end",
    "password_plain": f"case when event_type in ('click', 'purchase') then {_PW} end",
    "password_hashed": f"case when event_type = 'purchase' then md5({_PW}) end",
    "hash_algo": "case when event_type = 'purchase' then 'md5' end",
    "ticket_id": "concat('T-', cast(user_id % 7 as string))",
    "email_verified": "event_id % 2 = 0",
    "password_verified_ok": "event_id % 4 = 0",
    "ip": "concat('10.', cast(user_id % 200 as string), '.', cast(event_id % 250 as string), '.7')",
    "domain": "case when event_type = 'view' then null when user_id % 5 = 0 then 'europa.eu' else 'example.com' end",
    "target_domain": "case when event_type = 'signup' then concat('shop', cast(user_id % 9 as string), '.net') end",
    "browser": "case when event_id % 3 = 0 then 'Firefox 84' when event_id % 3 = 1 then 'Chrome 87' end",
    "malware_name": "case when event_type = 'signup' then concat('mal', cast(user_id % 5 as string)) end",
    "infected_machine": "concat('host ', cast(user_id % 50 as string))",
    "dg": "concat('DEPT', cast(user_id % 6 as string))",
    "count_seen": "cast(1 as bigint)",
    "ts": "ts",
}

# A vendor feed with gaps, tokens and broken rows, from the later events.
_RAW_HOST = f"case when event_id % 13 = 0 then upper({_HOST}) else {_HOST} end"
_RAW_EMAIL = f"case when event_id % 41 = 0 then 'not an address' else concat({_USER}, '@', {_RAW_HOST}) end"
_NA = "case when event_id % 3 = 0 then '-' when event_id % 3 = 1 then 'n/a' else 'NULL' end"
FEED = {name: "cast(null as string)" for name in SPYCLOUD_COLUMNS} | {
    "breach_title": "case when event_id % 37 = 0 then '-' else concat('Breach ', cast(user_id % 10 as string)) end",
    "spycloud_publish_date": "'2024-02-01'",
    "breach_date": "'Unknown'",
    "email": _RAW_EMAIL,
    "domain": "case when user_id % 5 = 0 then 'europa.eu' else 'example.com' end",
    "username": _NA,
    "password": f"case when event_type = 'error' then {_NA} else {_PW} end",
    "target_domain": f"case when event_type = 'signup' then 'shop.example.net' else {_NA} end",
    "target_url": _NA,
    "password_plaintext": f"case when event_type = 'click' then {_PW} else {_NA} end",
    "sighting": "case when event_id % 47 = 0 then 'x' else cast(event_id % 5 as string) end",
    "severity": "'high'",
    "password_type": "case when event_type = 'click' then 'plaintext' else 'sha256' end",
    "infected_machine_id": "concat('host ', cast(user_id % 50 as string))",
    "email_domain": f"case when event_id % 29 = 0 then {_NA} else {_HOST} end",
    "email_username": _USER,
    "user_browser": f"case when event_id % 2 = 0 then 'Firefox 84' else {_NA} end",
    "infected_time": _NA,
    "ip_addresses": (
        "case when event_id % 43 = 0 then '300.1.1.1' when event_id % 3 = 0 then '-' "
        "when event_id % 3 = 1 then concat('2001:db8::', cast(user_id % 9 as string)) else '10.0.0.7' end"
    ),
}
FEED_LINEAGE = {"src_file": "'events'", "src_block": "cast(0 as bigint)", "src_ord": "event_id"}

# Leaks, from supplier with nation and region.
LEAK = {
    "id": "s_suppkey + 1",
    "breach_ts": "timestamp '2024-01-01 00:00:00' + interval '1' day * (s_suppkey % 28)",
    "source_publish_ts": "timestamp '2024-02-01 00:00:00' + interval '1' day * (s_suppkey % 14)",
    "ingestion_ts": "timestamp '2024-03-01 00:00:00'",
    "summary": "s_name",
    "ticket_id": "concat('T-', cast(s_suppkey % 7 as string))",
    "reporter_name": "case when s_nationkey % 4 = 0 then null else n_name end",
    "source_name": "case when s_suppkey % 2 = 0 then lower(r_name) else r_name end",
}

# Directory entries, from customer; some first values are empty. Suppliers give second entries for some addresses.
DIRECTORY = {
    "mail": "concat('User', cast(c_custkey as string), '@example.com')",
    "dg": "case when c_custkey % 17 = 3 then '' else c_mktsegment end",
    "ecMoniker": "c_name",
    "recordStatus": "case when c_acctbal >= 0 then 'a' else 'I' end",
    "uid": "concat('a', cast(c_custkey as string))",
}
SECOND_ENTRY = {
    "mail": "concat('USER', cast(s_suppkey as string), '@EXAMPLE.com')",
    "dg": "'FORMER'",
    "ecMoniker": "s_name",
    "recordStatus": "'I'",
    "uid": "concat('b', cast(s_suppkey as string))",
}
VIP = "concat('USER', cast(c_custkey as string), '@example.com')"

# Question tables.
ASKED_EMAIL = "concat('uSeR', cast(c_custkey as string), '@Example.com')"
ASKED_PASSWORD = "concat('pw', cast(p_size as string))"
ASKED_DOMAIN = (
    "case when c_nationkey % 3 = 0 then 'Example.com' when c_nationkey % 3 = 1 then 'europa.EU' "
    "else concat('none', cast(c_nationkey as string), '.org') end"
)

# Volume: a store from line items. Whole rows are distinct, so all columns together break ties.
LINES = {
    "email": "concat('user', cast(l_suppkey % 97 as string), '.', cast(l_partkey as string), '@example.com')",
    "password": "concat('pw', cast(cast(l_quantity as int) as string))",
    "domain": "case when l_linenumber % 3 = 0 then 'europa.eu' else 'example.com' end",
    "leak_id": "cast(l_linenumber as bigint)",
    "l_orderkey": "l_orderkey",
    "l_linenumber": "l_linenumber",
    "l_extendedprice": "l_extendedprice",
    "l_shipdate": "l_shipdate",
    "l_rest": "concat_ws('|', l_returnflag, l_linestatus, cast(l_discount as string), cast(l_tax as string), "
    "cast(l_partkey as string), cast(l_suppkey as string), cast(l_quantity as string))",
}


def projection(columns: dict) -> list[str]:
    return [f"{text} as {name}" for name, text in columns.items()]


def select_list(columns: dict) -> str:
    return ", ".join(projection(columns))


def _ctes() -> dict:
    key = "leak_id, email, password, domain"
    return {
        "cred": f"select {select_list(CRED)} from events",
        "store": f"select * from cred where ts < timestamp '{CUTOFF}' and password is not null",
        "incoming": f"select * from cred where ts >= timestamp '{CUTOFF}'",
        "leak": f"select {select_list(LEAK)} from supplier join nation on s_nationkey = n_nationkey "
        "join region on n_regionkey = r_regionkey",
        "entries": f"select {select_list(DIRECTORY)} from customer union all "
        f"select {select_list(SECOND_ENTRY)} from supplier",
        "people": "select upper(mail) as email_key, nullif(arg_min(dg, uid), '') as dept, "
        "arg_min(ecMoniker, uid) as user_id, arg_min(recordStatus, uid) as status from entries group by 1",
        "vips": f"select distinct upper({VIP}) as email_key from customer where c_acctbal > 9000",
        "ranked": f"select *, row_number() over (partition by {key} order by id) as rn, "
        f"count(*) over (partition by {key}) as copies from store where domain is not null",
        "target": "select * exclude (rn, copies, count_seen), "
        "case when id % 53 = 0 then null else copies end as count_seen from ranked where rn = 1 "
        "union all by name select * from store where domain is null",
        "batch": "select * from incoming where password is not null",
        "feed": f"select {select_list(FEED | FEED_LINEAGE)} from events where ts >= timestamp '{CUTOFF}'",
        "lines": f"select {select_list(LINES)} from lineitem",
    }


_NEEDS = {
    "store": ["cred"], "incoming": ["cred"], "people": ["entries"], "ranked": ["store"],
    "target": ["ranked", "store"], "batch": ["incoming"],
}


def oracle(body: str, *tables: str, also: str = "") -> str:
    """``body`` with the derived tables it names in front."""
    texts, chosen = _ctes(), []

    def choose(name):
        for needed in _NEEDS.get(name, []):
            choose(needed)
        if name not in chosen:
            chosen.append(name)

    for name in tables:
        choose(name)
    parts = [f"{name} as ({texts[name]})" for name in chosen] + ([also] if also else [])
    return f"with {', '.join(parts)} {body}" if parts else body


class Tables:
    """The derived tables as lazy DataFrames over one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def given(self, name) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def cred(self):
        return self.given("events").selectExpr(*projection(CRED))

    @cached_property
    def store(self):
        return self.cred.filter(f"ts < timestamp_ntz '{CUTOFF}' and password is not null")

    @cached_property
    def incoming(self):
        return self.cred.filter(f"ts >= timestamp_ntz '{CUTOFF}'")

    @cached_property
    def batch(self):
        return self.incoming.filter("password is not null")

    @cached_property
    def target(self):
        """A table with unique keys: the store with its copies counted; some counters are NULL."""
        firsts = dedupe.first_per_key(self.store.drop("count_seen"), KEY, ["id"], F.col("id"))
        counted = firsts.select("_row.*", F.col("_copies").alias("count_seen"))
        lost = (F.col("id") % 53 == 0) & F.col("domain").isNotNull()
        counted = counted.withColumn("count_seen", F.when(~lost, F.col("count_seen")))
        return counted.select(*[f.name for f in LEAK_DATA])

    @cached_property
    def leak(self):
        suppliers = self.given("supplier")
        nations = self.given("nation").join(self.given("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(*projection(LEAK))

    @cached_property
    def directory(self):
        second = self.given("supplier").selectExpr(*projection(SECOND_ENTRY))
        entries = self.given("customer").selectExpr(*projection(DIRECTORY)).unionByName(second)
        arrays = ["dg", "ecMoniker", "recordStatus", "uid"]
        return entries.select("mail", *[F.array(c).alias(c) for c in arrays], F.array("uid").alias("cn"))

    @cached_property
    def vips(self):
        vip = self.given("customer").filter("c_acctbal > 9000").selectExpr(f"{VIP} as email")
        return vip.select(F.upper("email").alias("email_key")).distinct()

    @cached_property
    def feed(self):
        later = self.given("events").filter(f"ts >= timestamp_ntz '{CUTOFF}'")
        return later.selectExpr(*projection(FEED | FEED_LINEAGE))

    @cached_property
    def asked_emails(self):
        return self.given("customer").selectExpr(f"{ASKED_EMAIL} as email")

    @cached_property
    def asked_passwords(self):
        return self.given("part").selectExpr(f"{ASKED_PASSWORD} as password")

    @cached_property
    def asked_domains(self):
        return self.given("customer").selectExpr(f"{ASKED_DOMAIN} as domain")

    @cached_property
    def lines(self):
        return self.given("lineitem").selectExpr(*projection(LINES))


KEY = ["leak_id", "email", "password", "domain"]
