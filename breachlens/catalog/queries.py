"""``QUERIES``: name -> function of ``Tables``. ``ORACLES``: name -> the SQL with the same answer."""

from pyspark.sql import functions as F

from ..functions import text
from ..functions.rules import report_to
from ..functions.values import CREDENTIAL_TYPES, GENERIC_NA, SPYCLOUD_NA
from ..operators import changes, dedupe, enrich, lookups, normalize, stats
from ..operators.joins import keep_matching
from ..plans import imports
from ..plans.store import ConflictingWrite, Store
from ..schemas import LEAK, LEAK_CSV_COLUMNS, LEAK_DATA, LEAK_UPDATABLE, SPYCLOUD_COLUMNS
from ..session import scratch_path
from ..sources import files
from ..streaming.folder import stream_import
from . import derived
from .derived import KEY, Tables, oracle

QUERIES, ORACLES = {}, {}


def run_ts():
    return F.to_timestamp(F.lit("2024-03-02 00:00:00"))


def query(sql=None, name=None):
    def register(function):
        key = name or function.__name__
        QUERIES[key] = function
        if sql is not None:
            ORACLES[key] = sql
        return function

    return register


def quoted(values):
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def texts(df, *columns):
    """Times as text: both engines print them alike."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


LEAK_TIMES = ("breach_ts", "source_publish_ts", "ingestion_ts")
LEAK_TEXT = "select * replace (" + ", ".join(f"cast({c} as string) as {c}" for c in LEAK_TIMES) + ") from "

# ---- flagship ------------------------------------------------------------------------------------

_INTERNAL = "(ends_with(lower(email), 'europa.eu') or ends_with(lower(email), 'jrc.it'))"
_CONTACT = (
    "case when regexp_matches(split_part(email, '@', -1), '^(?:example\\.ec\\.europa\\.eu)') "
    "then 'abuse-desk@example.ec.europa.eu' else email end"
)
_FRESH = (
    "fresh as (select * from (select *, row_number() over (partition by email, password order by id) as rn from batch b "
    "where not exists (select 1 from store s where s.email = b.email and s.password = b.password)) where rn = 1)"
)


@query(
    oracle(
        f"select f.id, f.leak_id, f.email, f.password, v.email_key is not null as is_vip, "
        f"coalesce(p.dept, 'Unknown') as dept, not {_INTERNAL} as external_user, {_CONTACT} as report_to "
        "from fresh f left join people p on upper(f.email) = p.email_key left join vips v on upper(f.email) = v.email_key",
        "store", "batch", "people", "vips", also=_FRESH,
    )
)
def new_exposures(t: Tables):
    """The whole question in one plan: which incoming credentials are new, and whom do they concern?"""
    fresh = dedupe.drop_known(t.batch, t.store, order=["id"], unique=F.col("id"))
    marked = enrich.with_vip(fresh, t.vips, unique=F.col("id"))
    known = enrich.with_person(marked, t.directory, unique=F.col("id"))
    email = F.col("email")
    return known.select(
        "id", "leak_id", "email", "password", "is_vip", enrich.department().alias("dept"),
        text.is_external(email).alias("external_user"), F.array_join(report_to(email), ",").alias("report_to"),
    )


# ---- scans ---------------------------------------------------------------------------------------

_CELLS = [c for c in SPYCLOUD_COLUMNS if c in ("email", "username", "password", "target_url", "ip_addresses")]


def _write_feed(t, rows, name, columns=SPYCLOUD_COLUMNS, split=1):
    folder = scratch_path(t.spark, name)
    rows.select(*columns).coalesce(split).write.option("header", True).option("nullValue", "").csv(folder)
    return folder


@query(
    oracle(
        "select "
        + ", ".join(
            f"case when {c} not in ({quoted(SPYCLOUD_NA)}) then {c} end as {c}" for c in _CELLS
        )
        + " from feed",
        "feed",
    )
)
def scan_na_tokens(t):
    rows = files.scan_spycloud(t.spark, _write_feed(t, t.feed, "feed-csv", split=8))
    return rows.select(*_CELLS)


@query(
    oracle(
        "select "
        + ", ".join(
            f"case when {c} not in ({quoted(SPYCLOUD_NA)}){' and event_id % 3 <> 2' if c == 'target_url' else ''} then {c} end as {c}" for c in _CELLS
        )
        + " from raw",
        also=f"raw as (select event_id, {derived.select_list(derived.FEED)} from events where ts >= timestamp '{derived.CUTOFF}')",
    )
)
def scan_mixed_headers(t):
    """Files of one folder with all columns, with some of them backwards, and with a column nobody knows."""
    folder = scratch_path(t.spark, "mixed-csv")
    some = [c for c in SPYCLOUD_COLUMNS if c != "target_url"]
    fed = t.feed.withColumn("unheard_of", F.lit("x"))
    for place, columns in enumerate((SPYCLOUD_COLUMNS, SPYCLOUD_COLUMNS[::-1][:-1], ["unheard_of", *some])):
        part = fed.filter(F.col("src_ord") % 3 == place).select(*columns).coalesce(2)
        part.write.mode("append").option("header", True).option("nullValue", "").csv(folder)
    return files.scan_spycloud(t.spark, folder).select(*_CELLS)


@query(
    oracle(
        "select cast(7 as bigint) as leak_id, email, password, password_plain, domain, ip, "
        "cast(email_verified as string) as email_verified, infected_machine from batch",
        "batch",
    )
)
def scan_tag_leak(t):
    written = t.batch.withColumns({c: F.col(c).cast("string") for c in LEAK_CSV_COLUMNS})
    folder = _write_feed(t, written, "leak-csv", LEAK_CSV_COLUMNS, split=8)
    rows = files.scan_leak_csv(t.spark, folder, leak_id=7)
    return rows.select(
        "leak_id", "email", "password", "password_plain", "domain", "ip", "email_verified", "infected_machine"
    )


_LINES = {
    "line": f"concat(concat('u', cast(user_id as string), '@example.com'), "
    "case when event_type = 'view' then '' else concat(',', event_type) end, "
    "case when event_type = 'purchase' then ',extra,\"q,uoted\"' else '' end)"
}


@query(
    f"select line as original_line, 'too many fields' as error_msg from (select {derived.select_list(_LINES)} from events) "
    "where line like '%,extra,%'"
)
def scan_quarantine(t):
    """Lines with too many fields, out of a two-column file."""
    lines = t.given("events").selectExpr(*derived.projection(_LINES))
    folder = scratch_path(t.spark, "lines")
    lines.write.text(folder)
    scan = files.scan_csv(t.spark, folder, ["email", "password"], header=["email", "password"], has_header=False)
    return files.split_bad_lines(scan)[1].select("original_line", "error_msg")


@query(
    "select concat('u', cast(user_id as string), '@example.com') as email, "
    "case when event_type <> 'view' then event_type end as password from events where event_type <> 'purchase'"
)
def scan_short_lines(t):
    """The same file's good lines: those with a field too few are kept and padded."""
    lines = t.given("events").selectExpr(*derived.projection(_LINES))
    folder = scratch_path(t.spark, "lines")
    lines.write.text(folder)
    scan = files.scan_csv(t.spark, folder, ["email", "password"], header=["email", "password"], has_header=False)
    return files.split_bad_lines(scan)[0].select("email", "password")


@query(oracle("select 'OK' as status, email, password from batch", "batch"))
def scan_status(t):
    """The rows and how the scan went."""
    written = t.batch.withColumns({c: F.col(c).cast("string") for c in LEAK_CSV_COLUMNS})
    status, rows = files.collect_csv(t.spark, _write_feed(t, written, "status-csv", LEAK_CSV_COLUMNS), LEAK_CSV_COLUMNS)
    return rows.select(F.lit(status).alias("status"), "email", "password")


@query(
    "select distinct upper(concat('Vip', cast(c_custkey % 100 as string), '@Example.com')) as email_key from customer"
)
def scan_vip_list(t):
    """One address a line, in any case, with white space of all kinds around it."""
    line = "concat(' \t', case when c_custkey % 2 = 0 then 'Vip' else 'vIP' end, cast(c_custkey % 100 as string), '@Example.com \t')"
    folder = scratch_path(t.spark, "vips")
    t.given("customer").select(F.expr(line)).write.text(folder)
    return files.scan_vips(t.spark, folder)


@query(oracle("select email_key, dept, user_id, status from people", "people"))
def scan_directory_snapshot(t):
    """Directory entries as JSON lines, then one row per address."""
    folder = scratch_path(t.spark, "directory")
    t.directory.write.json(folder)
    return enrich.people(files.scan_directory(t.spark, folder)).select("email_key", "dept", "user_id", "status")


@query(oracle(LEAK_TEXT + "leak", "leak"))
def leak_all(t):
    return texts(t.leak, *LEAK_TIMES)


_COMBO = {
    "value": "concat(concat('user', cast(user_id as string), '@example.com'), "
    "case when event_type = 'view' then '' when event_type = 'click' then concat(':http://', props, ':x ') "
    "else concat(':', event_type) end)"
}


@query(
    f"with c as (select {derived.select_list(_COMBO)} from events) "
    "select case when strpos(value, ':') > 0 then substr(value, 1, strpos(value, ':') - 1) else value end as email, "
    "case when strpos(value, ':') > 0 then substr(value, strpos(value, ':') + 1) end as password from c"
)
def combo_parse(t):
    """Text files in nested folders, one ``email:password`` per line."""
    lines = t.given("events").select(F.expr(_COMBO["value"]).alias("value"), F.col("event_type").alias("kind"))
    folder = scratch_path(t.spark, "combo")
    lines.write.partitionBy("kind").text(folder)
    return files.scan_combo(t.spark, folder, "*.txt").select("email", "password")


# ---- normalization -------------------------------------------------------------------------------


def _cleared(column, extra=()):
    return f"case when {column} not in ({quoted(['-', 'nan', 'NaN', *extra])}) then {column} end"


_CLEARED = "cleared as (select * replace (" + ", ".join(
    f"{_cleared(c, ['Unknown'] if c == 'breach_date' else [])} as {c}" for c in SPYCLOUD_COLUMNS
) + ") from feed)"


@query(oracle("select * exclude (src_file, src_block) from cleared", "feed", also=_CLEARED))
def normalize_sentinels(t):
    return normalize.clear_sentinels(t.feed).drop("src_file", "src_block")


_REQUIRED = ["breach_title", "email", "domain", "password", "email_domain", "email_username"]
_ERROR = (
    "nullif(concat_ws('; ', "
    + ", ".join(f"case when {c} is null then '{c}: field required' end" for c in _REQUIRED)
    + ", case when sighting is not null and try_cast(sighting as integer) is null "
    "then 'sighting: not an integer' end), '')"
)


@query(
    "select l_orderkey, l_linenumber, case when l_linenumber <> 3 then l_extendedprice end as price, l_returnflag from lineitem"
)
def normalize_nan(t):
    """NaN becomes NULL in floating columns."""
    price = F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).otherwise(F.col("l_extendedprice")).alias("price")
    return normalize.clear_nan(t.given("lineitem").select("l_orderkey", "l_linenumber", price, "l_returnflag"))


_ORIGINAL = "concat('{', concat_ws(',', " + ", ".join(
    f"case when {c} is not null then concat('\"{c}\":\"', {c}, '\"') end" for c in SPYCLOUD_COLUMNS
) + "), '}')"


@query(oracle(f"select src_ord, {_ORIGINAL} as original_line from cleared where {_ERROR} is not null", "feed", also=_CLEARED))
def original_lines(t):
    """The text a rejected row is kept as."""
    checked = normalize.check_input(normalize.clear_sentinels(t.feed))
    return normalize.split_valid(checked)[1].select("src_ord", "original_line")


@query(
    oracle(
        f"select src_ord, {_ERROR} as error_msg, {_ERROR} is null as notify, "
        f"{_ERROR} is not null as needs_human_intervention, {_ERROR} is not null as has_original from cleared",
        "feed", also=_CLEARED,
    )
)
def validate_rows(t):
    checked = normalize.check_input(normalize.clear_sentinels(t.feed))
    original = F.col("original_line").isNotNull().alias("has_original")
    return checked.select("src_ord", "error_msg", "notify", "needs_human_intervention", original)


@query(oracle("select src_ord, email, password, target_domain, email_domain as domain from cleared", "feed", also=_CLEARED))
def map_current(t):
    rows = normalize.to_internal(normalize.clear_sentinels(t.feed), normalize.BY_NAME_MAPPING)
    return rows.select("src_ord", "email", "password", "target_domain", "domain")


@query(
    oracle(
        "select src_ord, email, password, target_domain, password_plaintext as password_plain, password_type as hash_algo, "
        "infected_machine_id as infected_machine, email_domain as domain, user_browser as browser, ip_addresses as ip "
        "from cleared", "feed", also=_CLEARED,
    )
)
def map_legacy(t):
    rows = normalize.to_internal(normalize.clear_sentinels(t.feed), normalize.FULL_MAPPING)
    return rows.select(
        "src_ord", "email", "password", "target_domain", "password_plain", "hash_algo", "infected_machine", "domain",
        "browser", "ip",
    )


# The pattern's text is the same in both engines: it uses nothing Java's and RE2's dialects disagree on.
_PATTERN = text.EMAIL_PATTERN.replace("'", "''")
_IP = f"regexp_matches(ip, '{text.IP_PATTERN}')"
_STORED = "concat(split_part(email, '@', 1), lower(substr(email, length(split_part(email, '@', 1)) + 1)))"
_VALID = f"regexp_matches({_STORED}, '{_PATTERN}')"
_BAD_OUT = (
    "nullif(concat_ws('; ', "
    f"case when email is null or not {_VALID} then 'email: not a valid address' end, "
    "case when password is null then 'password: field required' end, "
    f"case when ip is not null and not {_IP} then 'ip: not an address' end), '')"
)
_MAPPED = (
    "mapped as (select src_ord, cast(1 as bigint) as leak_id, email, password, password_plaintext as password_plain, "
    "password_type as hash_algo, infected_machine_id as infected_machine, email_domain as domain, user_browser as browser, "
    f"target_domain, ip_addresses as ip, {_ERROR} as input_error from cleared)"
)
_JUDGED = f"judged as (select *, coalesce(input_error, {_BAD_OUT}) as error_msg, {_STORED} as email_stored from mapped)"


@query(
    oracle(
        "select src_ord, leak_id, case when error_msg is null then email_stored else email end as email, password, domain, "
        "ip, error_msg, error_msg is null as notify, error_msg is not null as needs_human_intervention from judged",
        "feed", also=f"{_CLEARED}, {_MAPPED}, {_JUDGED}",
    )
)
def to_output(t):
    checked = normalize.check_input(normalize.clear_sentinels(t.feed))
    internal = normalize.to_internal(checked).withColumn("leak_id", F.lit(1).cast("long"))
    return normalize.to_output(internal).select(
        "src_ord", "leak_id", "email", "password", "domain", "ip", "error_msg", "notify", "needs_human_intervention"
    )


@query(oracle("select leak_id, email, password, password_plain, password_hashed, hash_algo, ticket_id, email_verified, "
              "password_verified_ok, ip, domain, browser, malware_name, infected_machine, dg from batch", "batch"))
def write_columns(t):
    return normalize.write_columns(t.batch)


@query(
    oracle(
        "select id, case when length(password) >= 4 then concat(left(password, 1), repeat('*', length(password) - 3), "
        "right(password, 2)) else password end as password, case when length(infected_machine) >= 4 then "
        "concat(left(infected_machine, 1), repeat('*', length(infected_machine) - 3), right(infected_machine, 2)) "
        "else infected_machine end as infected_machine from cred", "cred",
    )
)
def mask_secret(t):
    return normalize.masked(t.cred, ["password", "infected_machine"]).select("id", "password", "infected_machine")


# ---- lookups: one question -----------------------------------------------------------------------

_CRED_OUT = [f.name for f in LEAK_DATA]
_CRED_SQL = f"select {', '.join(_CRED_OUT)} from cred "


def _cred_lookup(name, where, ask):
    query(oracle(_CRED_SQL + "where " + where, "cred"), name)(lambda t: ask(t.cred).select(*_CRED_OUT))


_cred_lookup(
    "user_by_email", "upper(email) = upper('uSer8@Example.com')", lambda c: lookups.by_email(c, "uSer8@Example.com")
)
_cred_lookup(
    "user_by_email_password", "upper(email) = upper('USER8@example.com') and password = 'pw3'",
    lambda c: lookups.by_email_and_password(c, "USER8@example.com", "pw3"),
)
_cred_lookup("cred_by_id", "id = 17", lambda c: lookups.by_value(c, "id", 17))
_cred_lookup("cred_by_ticket", "ticket_id = 'T-3'", lambda c: lookups.by_value(c, "ticket_id", "T-3"))


def _leak_lookup(name, where, ask):
    query(oracle(LEAK_TEXT + "leak where " + where, "leak"), name)(lambda t: texts(ask(t.leak), *LEAK_TIMES))


_leak_lookup("leak_by_ticket", "ticket_id = 'T-3'", lambda k: lookups.by_value(k, "ticket_id", "T-3"))
_leak_lookup(
    "leak_by_summary", "summary = 'Supplier#000000003'", lambda k: lookups.by_value(k, "summary", "Supplier#000000003")
)
_leak_lookup(
    "leak_by_reporter", "reporter_name = 'NATION_15'", lambda k: lookups.by_value(k, "reporter_name", "NATION_15")
)
_leak_lookup(
    "leak_by_source", "upper(source_name) = upper('africa')", lambda k: lookups.by_value_any_case(k, "source_name", "africa")
)
_leak_lookup("leak_by_id", "id = 4", lambda k: lookups.by_value(k, "id", 4))


@query(oracle("select count(*) as count from cred where upper(email) = upper('User8@EXAMPLE.com')", "cred"))
def exists_by_email(t):
    return lookups.count_by_email(t.cred, "User8@EXAMPLE.com")


@query(
    oracle(
        "select count(*) as count from cred where password = 'pw3' or password_plain = 'pw3' or password_hashed = 'pw3'",
        "cred",
    )
)
def exists_by_password(t):
    return lookups.count_by_password(t.cred, "pw3")


@query(oracle("select count(*) as count from cred where upper(domain) = upper('Example.COM')", "cred"))
def exists_by_domain(t):
    return lookups.count_by_domain(t.cred, "Example.COM")


@query(oracle("select distinct reporter_name from leak order by 1 nulls last", "leak"))
def reporters(t):
    return lookups.distinct_sorted(t.leak, "reporter_name")


@query(oracle("select distinct source_name from leak order by 1 nulls last", "leak"))
def sources(t):
    return lookups.distinct_sorted(t.leak, "source_name")


@query(oracle("select id, email from cred where password is not null and not " + _INTERNAL, "cred"))
def row_filter(t):
    kept = normalize.filter_rows(t.cred, F.col("password").isNotNull() & text.is_external(F.col("email")))
    return kept.select("id", "email")


# ---- lookups: a table of questions ---------------------------------------------------------------

_ASKED = {
    "emails": f"asked as (select upper({derived.ASKED_EMAIL}) as k from customer)",
    "passwords": f"asked as (select {derived.ASKED_PASSWORD} as k from part)",
    "domains": f"asked as (select upper({derived.ASKED_DOMAIN}) as k from customer)",
}


@query(oracle(_CRED_SQL + "where upper(email) in (select k from asked)", "cred", also=_ASKED["emails"]))
def users_by_emails(t):
    return lookups.rows_for_emails(t.cred, t.asked_emails).select(*_CRED_OUT)


@query(
    oracle(
        _CRED_SQL + "c where exists (select 1 from batch b where upper(b.email) = upper(c.email) and b.password = c.password)",
        "cred", "batch",
    )
)
def users_by_credentials(t):
    return lookups.rows_for_credentials(t.cred, t.batch.select("email", "password")).select(*_CRED_OUT)


@query(oracle(_CRED_SQL + "where ticket_id in (select ticket_id from leak)", "cred", "leak"))
def creds_by_tickets(t):
    return lookups.rows_for_values(t.cred, t.leak, "ticket_id").select(*_CRED_OUT)


@query(oracle(LEAK_TEXT + "leak where upper(source_name) in (select upper(r_name) from region)", "leak"))
def leaks_by_sources(t):
    asked = t.given("region").select(F.col("r_name").alias("source_name"))
    return texts(lookups.rows_for_values(t.leak, asked, "source_name", any_case=True), *LEAK_TIMES)


@query(
    oracle(
        "select k as email_key, count(c.id) as count from (select distinct k from asked) a "
        "left join cred c on upper(c.email) = a.k group by k", "cred", also=_ASKED["emails"],
    )
)
def exists_by_emails(t):
    return lookups.counts_by_email(t.cred, t.asked_emails)


@query(
    oracle(
        "select k as password, count(c.id) as count from (select distinct k from asked) a left join cred c "
        "on c.password = a.k or c.password_plain = a.k or c.password_hashed = a.k group by k",
        "cred", also=_ASKED["passwords"],
    )
)
def exists_by_passwords(t):
    return lookups.counts_by_password(t.cred, t.asked_passwords)


@query(
    oracle(
        "select k as domain_key, count(c.id) as count from (select distinct k from asked) a "
        "left join cred c on upper(c.domain) = a.k group by k", "cred", also=_ASKED["domains"],
    )
)
def exists_by_domains(t):
    return lookups.counts_by_domain(t.cred, t.asked_domains)


# ---- joins, dedupe -------------------------------------------------------------------------------


@query(
    oracle(
        "select id, email, password, domain from (select *, row_number() over (partition by email, password order by id) "
        "as rn from incoming i where not exists (select 1 from store s where s.email = i.email and s.password = i.password)) "
        "where rn = 1 or password is null", "incoming", "store",
    )
)
def dedupe_new(t):
    """J1 and W1; rows without a password match nothing and all stay."""
    fresh = dedupe.drop_known(t.incoming, t.store, order=["id"], unique=F.col("id"))
    return fresh.select("id", "email", "password", "domain")


@query(
    oracle(
        "select id, email, password, domain, leak_id from (select *, row_number() over (partition by leak_id, email, "
        "password, domain order by id) as rn from incoming i where not exists (select 1 from store s where s.email = i.email "
        "and s.password = i.password and s.leak_id = i.leak_id and s.domain = i.domain)) "
        "where rn = 1 or password is null or domain is null", "incoming", "store",
    )
)
def dedupe_same_leak(t):
    """The narrower documented rule: same leak, address, password and domain."""
    fresh = dedupe.drop_known(t.incoming, t.store, KEY, order=["id"], unique=F.col("id"))
    return fresh.select("id", "email", "password", "domain", "leak_id")


@query(
    oracle(
        "select id, email, password from (select *, row_number() over (partition by email, password order by id) as rn "
        "from incoming) where rn = 1 or password is null", "incoming",
    )
)
def dedupe_in_batch(t):
    return dedupe.keep_first(t.incoming, order=["id"], unique=F.col("id")).select("id", "email", "password")


@query(
    oracle(
        "select id, email, upper(email) in (select email_key from vips) as is_vip from cred", "cred", "vips"
    )
)
def enrich_vip(t):
    return enrich.with_vip(t.cred, t.vips, unique=F.col("id")).select("id", "email", "is_vip")


_PEOPLE = "from cred c left join people p on upper(c.email) = p.email_key"


@query(oracle(f"select id, email, coalesce(p.dept, 'Unknown') as dg {_PEOPLE}", "cred", "people"))
def enrich_dept(t):
    known = enrich.with_person(t.cred, t.directory, unique=F.col("id"))
    return known.select("id", "email", enrich.department().alias("dg"))


@query(oracle(f'select id, email, p.user_id as "ecMoniker" {_PEOPLE}', "cred", "people"))
def enrich_userid(t):
    return enrich.with_person(t.cred, t.directory, unique=F.col("id")).select("id", "email", F.col("user_id").alias("ecMoniker"))


@query(oracle(f"select id, email, coalesce(upper(p.status) = 'A', false) as is_active_account {_PEOPLE}", "cred", "people"))
def enrich_active(t):
    known = enrich.with_person(t.cred, t.directory, unique=F.col("id"))
    return known.select("id", "email", enrich.is_active().alias("is_active_account"))


@query(oracle(f"select id, not {_INTERNAL} as external_user, not (ends_with(domain, 'europa.eu') or ends_with(domain, "
              "'jrc.it')) as external_domain from cred", "cred"))
def enrich_external(t):
    return t.cred.select(
        "id", text.is_external(F.col("email")).alias("external_user"),
        text.is_external(F.col("domain")).alias("external_domain"),
    )


@query(oracle(f"select id, {_CONTACT} as report_to from cred", "cred"))
def enrich_report_to(t):
    return t.cred.select("id", F.array_join(report_to(F.col("email")), ",").alias("report_to"))


@query(
    oracle(
        f"select c.id, c.leak_id, v.email_key is not null or c.email_verified as is_vip, c.dg, "
        "coalesce(upper(p.status) = 'A', false) as is_active_account, "
        f"not {_INTERNAL} as external_user, 'EU Login' as credential_type, {_CONTACT} as report_to, {_INTERNAL} as notify, "
        "false as needs_human_intervention from (select * exclude (dg, leak_id), cast(3 as bigint) as leak_id, case when "
        "malware_name is not null then dg else 'Unknown' end as dg from store where upper(email) not in (select email_key "
        "from people) union all select * exclude (dg, leak_id), 3, case when malware_name is not null then dg else "
        "coalesce((select dept from people p2 where p2.email_key = upper(email)), 'Unknown') end from store where "
        "upper(email) in (select email_key from people)) c left join people p on upper(c.email) = p.email_key "
        "left join vips v on upper(c.email) = v.email_key", "store", "people", "vips",
    )
)
def enrich_chain(t):
    """E1, E3 on rows of which some already have values: those stay."""
    rows = t.store.withColumns(
        {
            "dg": F.when(F.col("malware_name").isNotNull(), F.col("dg")),
            "is_vip": F.col("email_verified"),
            "is_active_account": F.lit(None).cast("boolean"),
            "external_user": F.lit(None).cast("boolean"),
            "credential_type": F.array().cast("array<string>"),
            "report_to": F.lit(None).cast("array<string>"),
            "error_msg": F.lit(None).cast("string"),
            "notify": F.lit(False),
            "needs_human_intervention": F.lit(True),
        }
    )
    done = enrich.enrich(rows, vips=t.vips, directory=t.directory, unique=F.col("id"), leak_id=3)
    return done.select(
        "id", "leak_id", "is_vip", "dg", "is_active_account", "external_user",
        F.array_join("credential_type", ",").alias("credential_type"),
        F.array_join("report_to", ",").alias("report_to"), "notify", "needs_human_intervention",
    )


@query(
    oracle(
        "select id, user_leak, user_leak in (select id from leak) as known from (select event_id as id, user_id + 1 as "
        "user_leak from events)", "leak",
    )
)
def fk_check(t):
    rows = t.given("events").select(F.col("event_id").alias("id"), (F.col("user_id") + 1).alias("leak_id"))
    marked = changes.mark_known_leak(rows, t.leak, unique=F.col("id"))
    return marked.withColumnsRenamed({"leak_id": "user_leak", "leak_known": "known"})


# ---- table changes -------------------------------------------------------------------------------

# New leaks and updates come from orders by customer nation: some pairs exist, some do not.
_WANTED = (
    "wanted as (select distinct concat('Supplier#', lpad(cast(c_custkey as string), 9, '0')) as summary, "
    "concat('T-', cast(c_nationkey % 7 as string)) as ticket_id from customer)"
)


def _wanted(t):
    return t.given("customer").select(
        F.concat(F.lit("Supplier#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("summary"),
        F.concat(F.lit("T-"), (F.col("c_nationkey") % 7).cast("string")).alias("ticket_id"),
    )


@query(
    oracle(
        "select summary, ticket_id, coalesce(held, (select max(id) from leak) + row_number() over (partition by held is null "
        "order by summary, ticket_id)) as leak_id, held is null as created from (select w.summary, w.ticket_id, min(l.id) "
        "as held from wanted w left join leak l on l.summary = w.summary and l.ticket_id = w.ticket_id group by 1, 2)",
        "leak", also=_WANTED,
    )
)
def leak_find_or_create(t):
    return changes.find_or_create_leaks(t.leak, _wanted(t), run_ts=run_ts(), source_name="SpyCloud")[0]


_NEW_LEAK = {
    "summary": "c_name",
    "ticket_id": "concat('N-', cast(c_custkey as string))",
    "reporter_name": "case when c_acctbal < 0 then null else c_mktsegment end",
    "source_name": "'feed'",
}


@query(
    oracle(
        LEAK_TEXT + "(select * from leak union all by name select (select max(id) from leak) + row_number() over "
        f"(order by c_custkey) as id, timestamp '2024-03-02 00:00:00' as ingestion_ts, {derived.select_list(_NEW_LEAK)} "
        "from customer)", "leak",
    )
)
def leak_append(t):
    new = t.given("customer").selectExpr("c_custkey", *derived.projection(_NEW_LEAK))
    added = changes.append_leaks(t.leak, new, run_ts=run_ts(), order=["c_custkey"])
    return texts(t.leak.unionByName(added), *LEAK_TIMES)


_DAY = "concat('2024-05-', lpad(cast(c_custkey % 28 + 1 as string), 2, '0')"


@query(
    oracle(
        LEAK_TEXT + "(select * from leak union all by name select (select max(id) from leak) + row_number() over "
        f"(order by c_custkey) as id, timestamp '2024-03-02 00:00:00' as ingestion_ts, cast({_DAY}, ' 10:00:00') as timestamp) as breach_ts, "
        f"{derived.select_list(_NEW_LEAK)} from customer)", "leak",
    )
)
def leak_append_text(t):
    """K1 with times as text."""
    new = t.given("customer").selectExpr("c_custkey", f"{_DAY}, 'T10:00:00Z') as breach_ts", *derived.projection(_NEW_LEAK))
    added = changes.append_leaks(t.leak, new, run_ts=run_ts(), order=["c_custkey"])
    return texts(t.leak.unionByName(added), *LEAK_TIMES)


_LEAK_CHANGE = {
    "id": "p_partkey + 3",
    "summary": "p_name",
    "ticket_id": "p_brand",
    "reporter_name": "case when p_size > 25 then null else p_type end",
    "source_name": "'changed'",
    "breach_ts": "timestamp '2024-05-01 00:00:00'",
    "source_publish_ts": "cast(null as timestamp)",
}


@query(
    oracle(
        LEAK_TEXT + "(select l.id, l.ingestion_ts, "
        + ", ".join(f"case when c.id is null then l.{c} else c.{c} end as {c}" for c in LEAK_UPDATABLE)
        + " from leak l left join c on l.id = c.id)", "leak",
        also=f"c as (select {derived.select_list(_LEAK_CHANGE)} from part)",
    )
)
def leak_update(t):
    edits = t.given("part").selectExpr(*derived.projection(_LEAK_CHANGE))
    return texts(changes.update_leaks(t.leak, edits), *LEAK_TIMES)


@query(
    oracle(
        LEAK_TEXT + "(select l.id, l.ingestion_ts, "
        + ", ".join(f"case when c.id is null then l.{c} else c.{c} end as {c}" for c in LEAK_UPDATABLE)
        + " from leak l left join c on l.id = c.id)", "leak",
        also=f"every as (select {derived.select_list(_LEAK_CHANGE)} from part), c as (select * replace (place as id) from (select *, "
        "id % 40 as place, row_number() over (partition by id % 40 order by id desc) as rn from every) where rn = 1)",
    )
)
def leak_update_repeated(t):
    """K2 with many changes to one id: the last along the given order counts."""
    edits = t.given("part").selectExpr(*derived.projection(_LEAK_CHANGE)).withColumn("place", F.col("id"))
    return texts(changes.update_leaks(t.leak, edits.withColumn("id", F.col("id") % 40), order=["place"]), *LEAK_TIMES)


_COPIES = (
    "news as (select leak_id, email, password, domain, min(id) as first_id, count(*) as k from batch where domain is not null "
    "group by 1, 2, 3, 4)"
)
_NEW_ROWS = (
    "select b.* exclude (id, ts, count_seen), n.k as count_seen, true as is_new, b.id as first_id from batch b join news n "
    "on b.id = n.first_id where not exists (select 1 from target t where t.leak_id = b.leak_id and t.email = b.email "
    "and t.password = b.password and t.domain = b.domain) union all by name select * exclude (id, ts, count_seen), "
    "cast(1 as bigint) as count_seen, true as is_new, id as first_id from batch where domain is null"
)
_HELD = (
    "from target t {join} join news n on t.leak_id = n.leak_id and t.email = n.email and t.password = n.password "
    "and t.domain = n.domain"
)
_UPSERT_OUT = [c for c in _CRED_OUT if c != "id"]


@query(
    oracle(
        f"select {', '.join(_UPSERT_OUT)}, is_new from (select t.* exclude (id, ts, count_seen), "
        f"t.count_seen + coalesce(n.k, 0) as count_seen, false as is_new {_HELD.format(join='left')} "
        f"union all by name {_NEW_ROWS})", "target", "batch", also=_COPIES,
    )
)
def upsert_count(t):
    """K3 as the whole new table: counters raised, new keys with the number of their copies."""
    after = changes.upsert(t.target, t.batch.drop("count_seen"), order=["id"], unique=F.col("id"))
    return after.select(*_UPSERT_OUT, F.col("_is_new").alias("is_new"))


@query(
    oracle(
        f"select id, n from (select t.id, n.k as n {_HELD.format(join='')}) union all select (select max(id) from target) + "
        f"row_number() over (order by first_id), count_seen from ({_NEW_ROWS})", "target", "batch", also=_COPIES,
    )
)
def upsert_ids(t):
    """K3 as changes only: each touched id with what is added to its counter."""
    batch = t.batch.drop("count_seen").withColumnRenamed("id", "event_id")
    resolved = changes.resolve_batch(t.target, batch, order=["event_id"], unique=F.col("event_id"))
    new = changes.inserts(resolved, LEAK_DATA, first_id=changes.next_id(t.target), order=["event_id"])
    return changes.raises(resolved).select("id", "n").unionByName(new.select("id", F.col("count_seen").alias("n")))


@query(
    oracle(
        f"select {', '.join(_UPSERT_OUT)}, is_new from (select t.* exclude (id, ts, count_seen), "
        f"t.count_seen + n.k as count_seen, false as is_new {_HELD.format(join='')} union all by name {_NEW_ROWS})",
        "target", "batch", also=_COPIES,
    )
)
def touched_rows(t):
    after = changes.upsert(t.target, t.batch.drop("count_seen"), order=["id"], unique=F.col("id"))
    return changes.touched(after).select(*_UPSERT_OUT, "is_new")


@query(
    oracle(
        "select c.* exclude (ts) from cred c where c.id in (select o_orderkey from orders)", "cred",
    )
)
def rows_by_ids(t):
    asked = t.given("orders").select(F.col("o_orderkey").alias("id"))
    return lookups.by_ids(t.cred, asked).select(*_CRED_OUT)


@query(
    oracle(
        "select leak_id, email, password, domain, count(*) as count_seen from cred where password is not null and domain is "
        "not null group by 1, 2, 3, 4 union all select leak_id, email, password, domain, 1 from cred where password is null "
        "or domain is null", "cred",
    )
)
def count_seen(t):
    """Copies per key; a key with a NULL is never a copy."""
    return dedupe.copies_per_key(t.cred, KEY, F.col("id"))


@query(
    oracle(
        "select b.id as event_id, coalesce(t.id, (select max(id) from target) + r.rn) as id, t.id is null as inserted "
        "from batch b left join target t on t.leak_id = b.leak_id and t.email = b.email and t.password = b.password "
        "and t.domain = b.domain left join (select first_id, row_number() over (order by first_id) as rn from "
        f"({_NEW_ROWS})) r on r.first_id = case when b.domain is null then b.id else (select n.first_id from news n where "
        "n.leak_id = b.leak_id and n.email = b.email and n.password = b.password and n.domain = b.domain) end",
        "target", "batch", also=_COPIES,
    )
)
def cred_insert_or_get(t):
    batch = t.batch.drop("count_seen").withColumnRenamed("id", "event_id")
    _, answer = changes.insert_or_get(t.target, batch, order=["event_id"], unique=F.col("event_id"))
    return answer.select("event_id", "id", "inserted")


_CRED_CHANGE = [c for c in normalize.LEAK_DATA_WRITABLE]


@query(
    oracle(
        "select c.id, c.count_seen, c.target_domain, "
        + ", ".join(f"case when o.id is null then c.{x} else o.{x} end as {x}" for x in _CRED_CHANGE)
        + " from cred c left join o on c.id = o.id", "cred",
        also="o as (select o_orderkey as id, cast(9 as bigint) as leak_id, concat('c', cast(o_custkey as string), "
        "'@example.com') as email, o_orderstatus as password, case when o_totalprice > 100000 then o_orderstatus end as "
        "password_plain, cast(null as string) as password_hashed, cast(null as string) as hash_algo, o_orderpriority as "
        "ticket_id, true as email_verified, false as password_verified_ok, '10.1.1.1' as ip, 'example.com' as domain, "
        "cast(null as string) as browser, cast(null as string) as malware_name, 'host' as infected_machine, 'D' as dg "
        "from orders)",
    )
)
def cred_update(t):
    none = F.lit(None).cast("string")
    values = {
        "leak_id": F.lit(9).cast("long"),
        "email": F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@example.com")),
        "password": F.col("o_orderstatus"),
        "password_plain": F.when(F.col("o_totalprice") > 100000, F.col("o_orderstatus")),
        "password_hashed": none, "hash_algo": none,
        "ticket_id": F.col("o_orderpriority"),
        "email_verified": F.lit(True), "password_verified_ok": F.lit(False),
        "ip": F.lit("10.1.1.1"), "domain": F.lit("example.com"),
        "browser": none, "malware_name": none, "infected_machine": F.lit("host"), "dg": F.lit("D"),
    }
    edits = t.given("orders").select(F.col("o_orderkey").alias("id"), *[v.alias(k) for k, v in values.items()])
    return changes.update_credentials(t.cred, edits).select(*_CRED_OUT)


@query(
    oracle(
        "select leak_id, email, password, domain, count(*) as n from cred where password is not null and domain is not null "
        "group by 1, 2, 3, 4 having count(*) > 1", "cred",
    )
)
def key_clashes(t):
    return changes.duplicate_keys(t.cred)


# ---- imports -------------------------------------------------------------------------------------

# What an import keeps, in SQL: a row already in stored spelling goes if the pair is stored or an earlier kept row
# has the same stored spelling; a row in another spelling only goes if that very spelling is stored.
_KEPT = (
    "good as (select * from judged where error_msg is null), "
    "cand as (select * from good g where not exists (select 1 from store s where s.email = g.email "
    "and s.password = g.password)), "
    "kept as (select * from (select *, min(src_ord) over (partition by email_stored, password) as first_ord from cand) "
    "where email <> email_stored or src_ord = first_ord)"
)
_IMPORT = f"{_CLEARED}, {_MAPPED}, {_JUDGED}, {_KEPT}"


def _import(t, **options):
    reference = imports.Reference(vips=t.vips, directory=t.directory)
    return imports.import_feed(t.feed, stored=t.store, leak_id=1, reference=reference, **options)


_OWNER = _INTERNAL.replace("email", "k.email")


@query(
    oracle(
        "select k.src_ord, k.leak_id, email_stored as email, password, password_plain, hash_algo, k.domain, k.ip, "
        "v.email_key is not null as is_vip, coalesce(p.dept, 'Unknown') as dg, "
        f"coalesce(upper(p.status) = 'A', false) as is_active_account, not {_OWNER} as external_user, "
        f"{_OWNER} as notify, {_CONTACT.replace('email', 'k.email')} as report_to from kept k "
        "left join people p on upper(k.email) = p.email_key left join vips v on upper(k.email) = v.email_key",
        "feed", "store", "people", "vips", also=_IMPORT,
    )
)
def import_feed(t):
    """Entry A up to the store: checked, new, enriched."""
    return _import_out(_import(t))


def _import_out(done):
    return done.outcome.select(
        "src_ord", "leak_id", "email", "password", "password_plain", "hash_algo", "domain", "ip", "is_vip", "dg",
        "is_active_account", "external_user", "notify", F.array_join("report_to", ",").alias("report_to"),
    )


@query(oracle("select src_ord, error_msg from judged where error_msg is not null", "feed", also=f"{_CLEARED}, {_MAPPED}, {_JUDGED}"))
def import_rejected(t):
    return _import(t).rejected.select("src_ord", "error_msg")


@query(
    oracle(
        "select count(*) as count, (select count(*) from feed) as rows_in, (select count(*) from good) - count(*) as "
        "duplicates, cast(0 as bigint) as filtered, (select count(*) from judged where error_msg is not null) as rejected, "
        "count(distinct (email_stored, password, domain)) - (select count(*) from hits) as inserted, "
        "(select count(*) from hits) as raised, true as success from kept",
        "feed", "store",
        also=_IMPORT + ", hits as (select distinct s.id from kept k join store s on s.leak_id = k.leak_id and s.email = "
        "k.email_stored and s.password = k.password and s.domain = k.domain)",
    )
)
def import_report(t):
    """K6: the envelope's counts; rows_in = count + duplicates + filtered + rejected."""
    return _import(t).report.drop("version", "duration", "errormsg")


@query(
    oracle(
        f"select id, n from (select t.id, n.k as n {_HELD.format(join='')}) union all select (select max(id) from target) "
        f"+ row_number() over (order by first_id), count_seen from ({_NEW_ROWS.replace('from batch', 'from of_one')})",
        "target", "batch",
        also="of_one as (select * from batch where leak_id = 1), " + _COPIES.replace("from batch", "from of_one"),
    )
)
def import_by_leak(t):
    """Entry B over one leak's rows as text cells: ids touched and what their counters gain."""
    done = imports.import_rows_of_leak(_rows_of_one_leak(t), stored=t.target, leaks=t.leak, leak_id=1)
    return done.raises.select("id", "n").unionByName(done.inserts.select("id", F.col("count_seen").alias("n")))


def _rows_of_one_leak(t):
    flat = t.batch.filter("leak_id = 1").withColumns({c: F.col(c).cast("string") for c in ["leak_id", *LEAK_CSV_COLUMNS]})
    lineage = [F.lit("batch").alias("src_file"), F.lit(0).cast("long").alias("src_block"), F.col("id").alias("src_ord")]
    return flat.select(F.col("leak_id").cast("long").alias("leak_id"), *LEAK_CSV_COLUMNS, *lineage)


@query(
    oracle(
        f"select t.id, t.email, t.count_seen + n.k as count_seen, false as is_new {_HELD.format(join='')} union all "
        "select (select max(id) from target) + row_number() over (order by first_id), email, count_seen, true "
        f"from ({_NEW_ROWS.replace('from batch', 'from of_one')})", "target", "batch",
        also="of_one as (select * from batch where leak_id = 1), " + _COPIES.replace("from batch", "from of_one"),
    )
)
def import_touched_rows(t):
    """F11 after an import into a stored table: the rows it touched, with current counters."""
    store = _stored(t, t.target)
    done = imports.import_rows_of_leak(
        _rows_of_one_leak(t), stored=store.rows(), leaks=t.leak, leak_id=1, first_id=store.next_id()
    )
    store.commit("one", inserts=done.inserts, raises=done.raises)
    return imports.touched_rows(store, done).select("id", "email", "count_seen", "is_new")


_HOOKED = _IMPORT.replace("ip_addresses as ip", "cast(null as varchar) as ip").replace(
    "good as (select * from judged where error_msg is null)",
    f"good as (select * from judged where error_msg is null and not {_INTERNAL})",
)


@query(
    oracle(
        "select k.src_ord, email_stored as email, k.password, k.domain, hash_algo, k.ip from kept k", "feed", "store",
        also=_HOOKED.replace("password_type as hash_algo", "cast(null as varchar) as hash_algo"),
    )
)
def import_hooks(t):
    """A caller's collector, parser (the mapping by names) and row filter (outsiders only), in one import."""
    store = _stored(t, t.store)
    done = imports.import_spycloud_files(
        t.spark, store, "unused", ticket_id="T-1", summary="hooks", batch="hooks", run_ts=run_ts(),
        reference=imports.Reference(vips=t.vips, directory=t.directory),
        collector=lambda spark, paths: t.feed,
        parser=lambda rows: normalize.parse_spycloud(rows, normalize.BY_NAME_MAPPING),
        row_filter=text.is_external(F.col("email")),
    )
    return done.outcome.select("src_ord", "email", "password", "domain", "hash_algo", "ip")


# Landing files go through the scan first, which knows more spellings of "missing" than the parser.
_SCANNED = "cleared as (select * replace (" + ", ".join(
    f"case when {c} not in ({quoted([*SPYCLOUD_NA, 'nan', 'Unknown'] if c == 'breach_date' else [*SPYCLOUD_NA, 'nan'])}) "
    f"then {c} end as {c}" for c in SPYCLOUD_COLUMNS
) + ") from feed)"


@query(
    oracle(
        "select email_stored as email, password, domain, cast(1 as bigint) as rows, cast(count_if(email <> email_stored) + "
        "max(case when email = email_stored then 1 else 0 end) as bigint) as times_seen from judged "
        "where error_msg is null group by 1, 2, 3", "feed",
        also=f"{_SCANNED}, {_MAPPED}, {_JUDGED}",
    ),
    name="stream_import",
)
def stream_import_feed(t):
    """ST1: the feed lands as CSV files, a stream imports them in several micro-batches into an empty store.

    Rows in another spelling land after a restart of the stream: each raises the counter of its stored row.
    """
    landing = scratch_path(t.spark, "landing")
    usual = F.col("email").isNull() | (F.col("email") == text.normalize_email(F.col("email")))
    store = Store(t.spark, scratch_path(t.spark, "store"))
    reference = imports.Reference(vips=t.vips, directory=t.directory)
    checkpoint = scratch_path(t.spark, "stream")
    for part in (t.feed.filter(usual), t.feed.filter(~usual)):
        lines = part.select(*SPYCLOUD_COLUMNS).repartition(4)
        lines.write.mode("append").option("header", True).option("nullValue", "").csv(landing)
        running = stream_import(
            t.spark, store, landing, name="feed", checkpoint=checkpoint, ticket_id="T-1", summary="stream",
            reference=reference, run_ts=run_ts(), files_per_batch=2,
        )
        running.awaitTermination()
    kept = store.credentials().groupBy("email", "password", "domain")
    return kept.agg(F.count("*").alias("rows"), F.sum("count_seen").alias("times_seen"))


@query(
    oracle(
        "select leak_id, email, password, domain, sum(n) as count_seen from (select cast(1 as bigint) as leak_id, email, password, domain, 1 as n, "
        "case when domain is null then id else -1 end as own from store union all select 1, email, password, domain, 1, "
        "case when domain is null then id else -1 end from batch) group by leak_id, email, password, domain, own",
        "store", "batch",
    ).replace("sum(n)", "cast(sum(n) as bigint)")
)
def stored_counts(t):
    """Two imports into a stored table on disk, read back with current counters."""
    store = Store(t.spark, scratch_path(t.spark, "store"))
    store.commit("leaks", leaks=t.leak.select(*[F.col(f.name).cast(f.dataType) for f in LEAK]))
    for batch, df in (("first", t.store), ("second", t.batch)):
        flat = df.select(
            "leak_id", *[F.col(c).cast("string") for c in LEAK_CSV_COLUMNS], F.lit(batch).alias("src_file"),
            F.lit(0).cast("long").alias("src_block"), F.col("id").alias("src_ord"),
        )
        done = imports.import_rows_of_leak(
            flat, stored=store.rows(), leaks=store.leaks(), leak_id=1, first_id=store.next_id()
        )
        store.commit(batch, inserts=done.inserts, raises=done.raises)
    return store.credentials().select(*KEY, "count_seen")


_FAILS = "src_ord % 7 = 0"


@query(
    oracle(
        "select src_ord, false as flagged from kept union all select src_ord, true from good g where not exists "
        f"(select 1 from store s where s.email = g.email and s.password = g.password) and {_FAILS}",
        "feed", "store", also=_IMPORT.replace("cand as (select * from good g where ", f"cand as (select * from good g where not {_FAILS} and "),
    )
)
def import_enrich_failures(t):
    """Rows that an enricher fails are flagged and not stored, and don't hide later copies."""
    done = _import(t, enrichers=[lambda df: df.withColumn("error_msg", F.when(F.expr(_FAILS), F.lit("lookup failed")))])
    stored = done.outcome.select("src_ord", F.lit(False).alias("flagged"))
    return stored.unionByName(done.flagged.select("src_ord", F.col("needs_human_intervention").alias("flagged")))


@query(
    oracle(
        "select email_stored as email, password from (select *, row_number() over (partition by email, password order by src_ord) as rn, "
        "min(src_ord) over (partition by email_stored, password) as first_ord from judged where error_msg is null) "
        "where email <> email_stored or src_ord = first_ord",
        "feed", also=f"{_CLEARED}, {_MAPPED}, {_JUDGED}",
    )
)
def import_outputs(t):
    """K7: an output that dies after the commit gets the same rows when the batch is run again; so does one that comes in later."""
    store, got = Store(t.spark, scratch_path(t.spark, "store")), []
    options = {
        "ticket_id": "T-1", "summary": "outputs", "run_ts": run_ts(), "batch": "one",
        "reference": imports.Reference(vips=t.vips, directory=t.directory),
    }

    def dies(df):
        raise InterruptedError("lost")

    try:
        imports.import_scanned_feed(t.spark, store, t.feed, outputs=[dies], **options)
    except InterruptedError:
        imports.import_scanned_feed(t.spark, store, t.feed, outputs=[lambda df: None], **options)
    imports.import_scanned_feed(t.spark, store, t.feed, outputs={"late": got.append}, **options)
    return got[0].select("email", "password")


@query(
    oracle(
        "select false as success, 'the feed has rows that fail a check' as errormsg, cast(null as bigint) as count "
        "from (select count(*) as bad from judged where error_msg is not null) where bad > 0",
        "feed", also=f"{_CLEARED}, {_MAPPED}, {_JUDGED}",
    )
)
def import_failed(t):
    """K6: the envelope of an import that is not allowed to set rows aside."""
    envelope, _ = imports.answered(t.spark, lambda: _import(t, strict=True))
    return envelope.select("success", "errormsg", "count")


@query(
    oracle("select src_ord, error_msg, false as flagged from judged where error_msg is not null", "feed", also=f"{_CLEARED}, {_MAPPED}, {_JUDGED}")
)
def stored_rejected(t):
    """Rows set aside are kept with the batch, and there for whoever runs it again."""
    store = Store(t.spark, scratch_path(t.spark, "store"))
    options = {
        "ticket_id": "T-1", "summary": "aside", "run_ts": run_ts(), "batch": "one",
        "reference": imports.Reference(vips=t.vips, directory=t.directory),
    }
    imports.import_scanned_feed(t.spark, store, t.feed, **options).close()
    return imports.import_scanned_feed(t.spark, store, t.feed, **options).rejected.select("src_ord", "error_msg", "flagged")


def _stored(t, table, raised=None):
    """A store of ``table``, with counters raised."""
    store = Store(t.spark, scratch_path(t.spark, "store"))
    store.commit("rows", inserts=table.select(*LEAK_DATA.names))
    if raised is not None:
        store.commit("raises", raises=raised)
    return store


@query(oracle("select id, email, count_seen from store", "store"))
def store_batches(t):
    """Batches whose names look alike, or like the store's own, are all kept, also past a compaction, and past one that another writer gets ahead of."""
    store = Store(t.spark, scratch_path(t.spark, "store"))

    class Late(Store):
        def _write_all(self, log, label, tables):
            written = super()._write_all(log, label, tables)
            store.commit("base", inserts=t.store.filter(F.col("id") % 4 == 2).select(*LEAK_DATA.names))
            return written

    for place, (name, kind) in enumerate((("x/1", "batch"), ("x:1", "batch"), ("base", "batch"), ("x:1", "stream"))):
        if name == "base":  # committed by somebody else while the store is being compacted
            try:
                Late(t.spark, store.root).compact()
            except ConflictingWrite:
                store.compact()
        else:
            store.commit(name, kind=kind, inserts=t.store.filter(F.col("id") % 4 == place).select(*LEAK_DATA.names))
        if place == 2:
            store.commit("x/1", inserts=t.store.select(*LEAK_DATA.names))  # known, so not taken again
    return store.credentials().select("id", "email", "count_seen")


_RAISED = "case when id % 3 = 0 then 2 else 0 end"


@query(
    oracle(
        f"select id, email, count_seen + {_RAISED} as count_seen from store where upper(email) in (select upper(email) from batch)",
        "store", "batch",
    )
)
def stored_users_by_emails(t):
    """F1 in bulk over a stored table with counter raises."""
    raised = t.store.filter("id % 3 = 0").select("id", F.upper("email").alias("email_key"), F.lit(2).cast("long").alias("n"))
    asked = t.batch.select("email")
    found = lookups.rows_for_emails(_stored(t, t.store, raised).credentials(asked), asked)
    return found.select("id", "email", "count_seen")


_ASKED_PASSWORDS = "asked as (select distinct " + derived.ASKED_PASSWORD + " as password from part)"


@query(
    oracle(
        "select a.password, count(c.id) as count from asked a left join store c on a.password in "
        "(c.password, c.password_plain, c.password_hashed) group by 1", "store", also=_ASKED_PASSWORDS,
    )
)
def stored_exists_by_passwords(t):
    """A2 in bulk over a stored table."""
    return lookups.counts_by_password(_stored(t, t.store).rows(), t.asked_passwords)


@query(oracle("select count(*) as count from store where 'pw7' in (password, password_plain, password_hashed)", "store"))
def stored_exists_by_password(t):
    """A2, one question: the test on all three columns reaches the scan, whose bloom filters pass over files without the value."""
    return lookups.count_by_password(_stored(t, t.store).rows(), "pw7")


@query(oracle("select id, email, case when id % 5 = 0 then 'Edge' else browser end as browser, count_seen from target", "target"))
def stored_cred_update(t):
    """K5 on a stored table."""
    store = _stored(t, t.target)
    store.update_credentials(t.target.filter("id % 5 = 0").withColumn("browser", F.lit("Edge")))
    return store.credentials().select("id", "email", "browser", "count_seen")


_VOLUME = "count(*) as credentials, cast(sum(count_seen) as bigint) as times_seen"

#: What stands in the store of ``_counted_store``: three batches, raises before and after an update and a compaction.
_RECOUNTED = (
    "recounted as (select id, email, malware_name, case when id % 5 = 0 then 'Moved' else dg end as dg, "
    "count_seen + case when id % 3 = 0 then 2 else 0 end + case when id % 4 = 0 then 1 else 0 end as count_seen from target)"
)


def _counted_store(t):
    store = Store(t.spark, scratch_path(t.spark, "store"), statistics=True)
    for part in range(3):
        store.commit(f"rows-{part}", inserts=t.target.filter(F.col("id") % 3 == part).select(*LEAK_DATA.names))

    def raised(every, n):
        rows = t.target.filter(F.col("id") % every == 0)
        return rows.select("id", F.upper("email").alias("email_key"), F.lit(n).cast("long").alias("n"))

    store.commit("raises", raises=raised(3, 2))
    store.update_credentials(t.target.filter("id % 5 = 0").withColumn("dg", F.lit("Moved")))
    store.compact()
    store.commit("more raises", raises=raised(4, 1))
    return store


@query(oracle(f"select dg, {_VOLUME} from recounted group by 1", "target", also=_RECOUNTED))
def stored_stat_by_dept(t):
    """Volume per department from the counts kept with each batch; no credential is read for the answer."""
    return stats.merged_by_department(_counted_store(t).statistics()).drop("addresses")


@query(
    oracle(
        "select dg, malware_name, cast(grouping(dg, malware_name) as integer) as level, "
        f"{_VOLUME} from recounted group by rollup (dg, malware_name)", "target", also=_RECOUNTED,
    )
)
def stored_stat_rollup(t):
    """Departments by malware with subtotals, from the same counts."""
    return stats.merged_department_by_malware(_counted_store(t).statistics()).drop("addresses")


# ---- the same lookups beyond the broadcast bound -------------------------------------------------


@query(ORACLES["enrich_dept"])
def enrich_dept_large(t):
    """As if the directory were too big to broadcast."""
    known = enrich.with_person(t.cred, t.directory, unique=F.col("id"), max_broadcast_rows=0)
    return known.select("id", "email", enrich.department().alias("dg"))


@query(ORACLES["users_by_credentials"])
def users_by_credentials_large(t):
    asked = t.batch.select("email", "password")
    return lookups.rows_for_credentials(t.cred, asked, max_broadcast_rows=0).select(*_CRED_OUT)


@query(ORACLES["exists_by_passwords"])
def exists_by_passwords_large(t):
    return lookups.counts_by_password(t.cred, t.asked_passwords, max_broadcast_rows=0)


@query(ORACLES["import_feed"])
def import_feed_large(t):
    return _import_out(_import(t, max_broadcast_rows=0))


# ---- statistics (extensions) ---------------------------------------------------------------------

@query(oracle(f"select dg, {_VOLUME} from cred group by 1", "cred"))
def stat_by_dept(t):
    return stats.by_department(t.cred)


@query(oracle(f"select malware_name, {_VOLUME} from cred where malware_name is not null group by 1", "cred"))
def stat_by_malware(t):
    return stats.by_malware(t.cred)


@query(
    oracle(
        f"select dg, malware_name, cast(grouping(dg, malware_name) as integer) as level, {_VOLUME} from cred "
        "group by rollup (dg, malware_name)", "cred",
    )
)
def stat_dept_malware_rollup(t):
    return stats.department_by_malware(t.cred)


@query(
    oracle(
        f"select domain, {_VOLUME} from cred where domain is not null group by 1 order by credentials desc, domain limit 10",
        "cred",
    )
)
def top_domains(t):
    return stats.top_domains(t.cred)


@query(
    oracle(
        "select sha256(password) as password_sha256, count(distinct upper(email)) as addresses, count(*) as credentials "
        "from cred where password is not null group by 1 having count(distinct upper(email)) >= 2", "cred",
    )
)
def password_reuse(t):
    return stats.password_reuse(t.cred)


@query(
    oracle(
        "select leak_id, count(*) as addresses, cast(count_if(shared) as bigint) as shared_addresses from (select leak_id, k, "
        "count(*) over (partition by k) > 1 as shared from (select distinct leak_id, upper(email) as k from cred)) group by 1",
        "cred",
    )
)
def leak_overlap(t):
    return stats.leak_overlap(t.cred)


# ---- volume: the same operators over line items --------------------------------------------------

_SHIP = "timestamp '1997-01-01 00:00:00'"
_TIE = ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_rest"]


@query(
    oracle(
        "select email, password, l_orderkey, l_linenumber, l_extendedprice from (select *, row_number() over (partition by "
        f"email, password order by {', '.join(_TIE)}) as rn from lines i where l_shipdate >= {_SHIP} and not exists "
        f"(select 1 from lines s where s.l_shipdate < {_SHIP} and s.email = i.email and s.password = i.password)) where rn = 1",
        "lines",
    )
)
def volume_dedupe(t):
    cut = F.expr(_SHIP.replace("timestamp", "timestamp_ntz"))
    store, incoming = t.lines.filter(F.col("l_shipdate") < cut), t.lines.filter(F.col("l_shipdate") >= cut)
    fresh = dedupe.drop_known(incoming, store, order=_TIE, unique=F.struct(*_TIE).cast("string"))
    return fresh.select("email", "password", "l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    oracle(
        "select leak_id, email, password, domain, count(*) as count_seen from lines group by 1, 2, 3, 4", "lines"
    )
)
def volume_count_seen(t):
    return dedupe.copies_per_key(t.lines, KEY, F.struct(*_TIE).cast("string"))


@query(
    oracle(
        "select k as email_key, count(c.email) as count from (select distinct upper(concat('user', cast(s_suppkey % 97 as "
        "string), '.', cast(p_partkey as string), '@example.com')) as k from part, (select distinct l_partkey, l_suppkey from "
        "lineitem) x, supplier where x.l_partkey = p_partkey and x.l_suppkey = s_suppkey) a left join lines c on "
        "upper(c.email) = a.k group by k", "lines",
    )
)
def volume_exists_by_emails(t):
    pairs = t.given("lineitem").select("l_partkey", "l_suppkey").distinct()
    asked = (
        pairs.join(t.given("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t.given("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.concat(
                F.lit("user"), (F.col("s_suppkey") % 97).cast("string"), F.lit("."), F.col("p_partkey").cast("string"),
                F.lit("@example.com"),
            ).alias("email")
        )
    )
    return lookups.counts_by_email(t.lines, asked)
