"""The two imports. Each stages its input once and derives everything else from the staged tables."""

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..functions.values import CREDENTIAL_TYPES, DEFAULT_CREDENTIAL_TYPE, SPYCLOUD_SOURCE
from ..operators import changes, dedupe, normalize
from ..operators.enrich import directory_fits, enrich
from ..operators.buckets import BUCKET
from ..operators.ids import next_id
from ..operators.joins import BROADCAST_ROWS, fits_broadcast
from ..schemas import LEAK_DATA, LEAK_DATA_KEY, LINEAGE
from ..session import collected_scratch, remove_scratch, staged, staged_counted
from ..sources.files import lineage_id, scan_leak_csv, scan_spycloud
from .store import Store


class UnknownLeak(ValueError):
    """The leak a file is to be filed under does not exist (or not exactly once)."""


class BadRows(ValueError):
    """``strict`` was asked for and the feed has rows that fail a check."""


@dataclass(frozen=True)
class Reference:
    """What rows are enriched from."""

    vips: DataFrame
    directory: DataFrame
    rules: list | None = None
    suffixes: list | None = None
    credential_type: str = DEFAULT_CREDENTIAL_TYPE


class ImportResult:
    """What an import found. The staged feed and outcome exist; what goes to the store is worked out when asked for.

    ``close()`` (or the end of a ``with`` block) removes what was staged, secrets included; frames of the result can't be read afterwards.
    """

    already_applied = False

    def __init__(self, judged, outcome, *, stored, first_id, max_broadcast_rows, began, counts, scratch, failed=None):
        self._judged, self._stored, self._failed = judged, stored, failed
        self._first_id, self._max_broadcast_rows = first_id, max_broadcast_rows
        self._began, self._counts, self._scratch = began, counts, scratch
        #: rows that go on to the store, with their flags
        self.outcome = outcome

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def close(self) -> None:
        remove_scratch(self.outcome.sparkSession, self._scratch)

    @property
    def rejected(self) -> DataFrame:
        """Rows set aside, before or after enrichment: the original line, the reasons, the position."""
        found = normalize.split_valid(self._judged)[1].select(*_ASIDE)
        return found if self._failed is None else found.unionByName(self._failed.select(*_ASIDE))

    @property
    def flagged(self) -> DataFrame:
        """Rows that failed in or after enrichment: returned for a person to look at, not stored."""
        failed = self.outcome.limit(0) if self._failed is None else self._failed
        return failed.withColumns({"notify": F.lit(False), "needs_human_intervention": F.lit(True)})

    @cached_property
    def resolved(self) -> DataFrame:
        """One row per stored key, with the id of the credential it meets."""
        with collected_scratch(self._scratch):
            found = changes.resolve_batch(
                self._stored, self.outcome, order=LINEAGE, unique=lineage_id(), max_broadcast_rows=self._max_broadcast_rows
            )
            new = F.col("id").isNull()
            resolved, counted = staged_counted(found, "resolved", inserted=F.count_if(new), raised=F.count_if(~new))
        self._counts |= counted
        return resolved

    @cached_property
    def inserts(self) -> DataFrame:
        """New credentials with ids, as the table stores them."""
        first_id = self._first_id() if callable(self._first_id) else self._first_id
        with collected_scratch(self._scratch):
            return changes.inserts(self.resolved, LEAK_DATA, first_id=first_id, order=LINEAGE)

    @cached_property
    def raises(self) -> DataFrame:
        """Known credentials: ``id`` and by how much the counter goes up."""
        return changes.raises(self.resolved)

    @cached_property
    def report(self) -> DataFrame:
        """One row: the answer's envelope and the books (rows_in = count + duplicates + filtered + rejected), as counted while rows were written."""
        spark, _, counts = self.outcome.sparkSession, self.resolved, self._counts
        rejected = counts["rejected"] + counts.get("failed", 0)
        kept = counts["kept"] if "kept" in counts else counts["rows_in"] - counts["filtered"] - rejected
        books = {
            "count": kept, "rows_in": counts["rows_in"], "duplicates": counts["rows_in"] - kept - counts["filtered"] - rejected,
            "filtered": counts["filtered"], "rejected": rejected, "inserted": counts["inserted"], "raised": counts["raised"],
        }
        return _envelope(spark, self._began, success=True, **books)

    @property
    def set_aside(self) -> DataFrame:
        """``rejected`` as it is kept in the store: which rows were flagged for a person, and no secrets."""
        before = normalize.split_valid(self._judged)[1].select(*_ASIDE, F.lit(False).alias("flagged"))
        found = before if self._failed is None else before.unionByName(self._failed.select(*_ASIDE, F.lit(True).alias("flagged")))
        return normalize.masked(found)


class AlreadyApplied:
    """The answer to a batch that was committed before: nothing was done again. What was kept with the batch can be read."""

    already_applied = True

    def __init__(self, store, batch, kind):
        self._store, self._batch, self._kind = store, batch, kind

    @property
    def outcome(self) -> DataFrame | None:
        """What the batch's first run handed to its outputs; None if the batch was committed without."""
        return self._store.outcome(self._batch, self._kind)

    @property
    def rejected(self) -> DataFrame | None:
        """What the first run set aside, without secrets."""
        return self._store.rejected(self._batch, self._kind)

    @property
    def report(self) -> DataFrame | None:
        """The first run's envelope."""
        return self._store.report(self._batch, self._kind)

    def close(self) -> None:
        """Nothing was staged."""


_ENVELOPE = (
    "version string, duration double, count long, rows_in long, duplicates long, filtered long, rejected long, inserted long, raised long, "
    "success boolean, errormsg string"
)


def _envelope(spark, began, **values) -> DataFrame:
    known = {"version": __version__, "duration": round(time.monotonic() - began, 3)} | values
    names = [field.split(" ")[0] for field in _ENVELOPE.split(", ")]
    return spark.createDataFrame([tuple(known.get(name) for name in names)], _ENVELOPE)


def answered(spark: SparkSession, run: Callable) -> tuple[DataFrame, object]:
    """(the envelope, what ``run()`` returned or None): an import that fails gives an answer too, with ``success`` false and what went wrong (K6).

    Of an error that Spark raises only its name is told, since its text may quote cells.
    """
    began = time.monotonic()
    try:
        result = run()
        report = result.report
        return (_envelope(spark, began, success=True) if report is None else report), result
    except PySparkException as problem:
        return _envelope(spark, began, success=False, errormsg=problem.getCondition() or type(problem).__name__), None
    except (ValueError, RuntimeError, OSError) as problem:
        return _envelope(spark, began, success=False, errormsg=str(problem)), None


_ASIDE = ["original_line", "error_msg", *LINEAGE]


def import_feed(
    rows: DataFrame,
    *,
    stored: DataFrame,
    leak_id: int,
    reference: Reference,
    parser=None,
    row_filter: Column | None = None,
    enrichers=(),
    dedupe_key=dedupe.DEDUPE_KEY,
    strict: bool = False,
    first_id: int | None = None,
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> ImportResult:
    """Scanned SpyCloud rows -> checked, new, enriched credentials of one leak.

    Checks come before the dedupe, so a row that cannot be stored never hides a good copy of it. Enrichment comes
    after, so it runs on the new rows only. With ``enrichers``, which may set ``error_msg`` or spoil a column, every row that is not
    stored yet is enriched and checked once more; failed rows are set aside, and one row per key is taken from the rest. Open to the caller: ``parser`` (scan -> checked internal rows),
    ``row_filter`` (a predicate on internal rows), ``enrichers`` (DataFrame -> DataFrame, after the built-in
    ones) and ``dedupe_key`` (add ``leak_id`` and ``domain`` to look at copies within one leak only).
    """
    scratch: list = []
    with collected_scratch(scratch):
        return _import_feed(
            rows, stored, leak_id, reference, parser, row_filter, enrichers, dedupe_key, strict, first_id, max_broadcast_rows, scratch
        )


def _import_feed(rows, stored, leak_id, reference, parser, row_filter, enrichers, dedupe_key, strict, first_id, max_broadcast_rows, scratch):
    began = time.monotonic()
    parse = normalize.parse_spycloud if parser is None else parser
    internal = parse(rows).withColumn("leak_id", F.lit(leak_id).cast("long"))
    passes = F.lit(True) if row_filter is None else F.coalesce(row_filter, F.lit(False))
    judged = normalize.check_output(internal).withColumn("passes", passes)
    judged, counts = staged_counted(judged, "feed", **_books())
    good, _ = normalize.split_valid(judged)
    if strict and counts["rejected"]:
        raise BadRows("the feed has rows that fail a check")
    unique = lineage_id()
    kept = normalize.filter_rows(good, F.col("passes")).drop("passes")
    pinned = {"order": LINEAGE, "unique": unique, "max_broadcast_rows": max_broadcast_rows}
    if reference.credential_type not in CREDENTIAL_TYPES:
        raise ValueError(f"credential_type {reference.credential_type!r} is not a known type")
    whole, first_id = stored, first_id if first_id is not None else lambda: next_id(whole)
    # One scan of the store for all that the batch asks of it: rows it may repeat, and rows whose counters it may raise.
    spellings = F.explode(F.array_distinct(F.array("email", "email_stored"))).alias("email")
    asked = kept.select(spellings, "password")
    known = staged(
        dedupe.known_rows(stored, asked, ["id", *LEAK_DATA_KEY, *dedupe_key], max_broadcast_rows=max_broadcast_rows).drop(BUCKET), "known"
    )
    if enrichers:
        fresh = dedupe.drop_stored(kept, known, dedupe_key, unique=unique, max_broadcast_rows=max_broadcast_rows)
    else:
        fresh = dedupe.drop_known_in_feed(kept, known, dedupe_key, narrowed=True, **pinned)
        stored = known
    small_vips = fits_broadcast(reference.vips, max_broadcast_rows)
    small_directory = directory_fits(reference.directory, max_broadcast_rows)
    if not (small_vips and small_directory):
        fresh = staged(fresh, "fresh")
    outcome = enrich(
        fresh,
        vips=reference.vips,
        directory=reference.directory,
        rules=reference.rules,
        suffixes=reference.suffixes,
        credential_type=reference.credential_type,
        unique=unique,
        max_broadcast_rows=max_broadcast_rows,
        small_vips=small_vips,
        small_directory=small_directory,
    )
    failed = None
    if enrichers:
        for more in enrichers:
            outcome = outcome.transform(more)
        enriched, counted = staged_counted(normalize.check_output(outcome), "enriched", failed=F.count_if(F.col("error_msg").isNotNull()))
        counts |= counted
        good, failed = normalize.split_valid(enriched)
        outcome = dedupe.drop_known_in_feed(good, known.limit(0), dedupe_key, narrowed=True, **pinned)
    outcome, counted = staged_counted(outcome.withColumn("email", F.col("email_stored")).drop("email_stored"), "outcome", kept=F.count("*"))
    return ImportResult(
        judged, outcome, stored=stored, first_id=first_id, max_broadcast_rows=max_broadcast_rows, began=began, failed=failed,
        counts=counts | counted, scratch=scratch,
    )


def _books() -> dict:
    bad = F.col("error_msg").isNotNull()
    return {"rows_in": F.count("*"), "filtered": F.count_if(~bad & ~F.col("passes")), "rejected": F.count_if(bad)}


def import_rows_of_leak(
    rows: DataFrame,
    *,
    stored: DataFrame,
    leaks: DataFrame,
    leak_id: int,
    first_id: int | None = None,
    max_broadcast_rows: int = BROADCAST_ROWS,
) -> ImportResult:
    """Scanned generic rows -> upsert into a known leak, whatever leak the rows name. No dedupe and no enrichment."""
    began, scratch = time.monotonic(), []
    if len(leaks.filter(F.col("id") == leak_id).select("id").take(2)) != 1:
        raise UnknownLeak(f"leak {leak_id} not found")
    filed = rows.withColumn("leak_id", F.lit(leak_id).cast("long"))
    with collected_scratch(scratch):
        judged, counts = staged_counted(normalize.leak_csv_to_internal(filed).withColumn("passes", F.lit(True)), "feed", **_books())
        good, _ = normalize.split_valid(judged)
        # One scan of the store, cut to the batch's addresses.
        known = dedupe.known_rows(stored, good, ["id", *LEAK_DATA_KEY], max_broadcast_rows=max_broadcast_rows)
    return ImportResult(
        judged, good, stored=known, first_id=first_id if first_id is not None else lambda: next_id(stored),
        max_broadcast_rows=max_broadcast_rows, began=began, counts=counts, scratch=scratch,
    )


def touched_rows(stored: DataFrame | Store, result: ImportResult) -> DataFrame:
    """After the commit: the stored rows an import touched, with ``is_new``. Ids are unique, so a plain join.

    A store is only asked for the addresses of those rows, so its other buckets are not read and other counters not added up.
    """
    ids = result.inserts.select("id", "email", F.lit(True).alias("is_new"))
    ids = ids.unionByName(result.raises.select("id", F.col("email_key").alias("email"), F.lit(False).alias("is_new")))
    rows = stored.credentials(ids.select("email")) if isinstance(stored, Store) else stored
    ids = ids.drop("email")
    return rows.join(F.broadcast(ids) if fits_broadcast(ids) else ids, "id")


# ---- on a store ----------------------------------------------------------------------------------


def import_spycloud_files(
    spark: SparkSession,
    store: Store,
    paths,
    *,
    ticket_id: str,
    summary: str,
    reference: Reference,
    run_ts: Column,
    batch: str,
    collector=scan_spycloud,
    **options,
) -> ImportResult:
    """Files -> store. The leak is found by (summary, ticket) or created. ``collector(spark, paths)`` scans them."""
    return import_scanned_feed(
        spark, store, collector(spark, paths), ticket_id=ticket_id, summary=summary, reference=reference,
        run_ts=run_ts, batch=batch, **options,
    )


def import_scanned_feed(
    spark, store: Store, rows, *, ticket_id, summary, reference, run_ts, batch, kind="batch", outputs=(), set_aside=None, **options
) -> ImportResult | AlreadyApplied:
    """The same for rows already scanned.

    A batch that is already committed is not worked through again; the answer says so. Outcome, report and the rows set aside (and those of ``set_aside``,
    files that could not be scanned) are kept with the batch. ``outputs`` is a list of functions, or functions by name;
    each is called with the outcome that was committed with the batch and marked when it has returned. A run of the batch after a crash
    calls those without a mark, with the very same rows, so they should be able to take a batch twice; an output that comes in
    later gets it too. A batch committed without an outcome has nothing for them.
    """
    if not ticket_id or not summary:
        raise ValueError("an import needs a ticket id and a summary")
    if store.has(batch, kind):
        result = AlreadyApplied(store, batch, kind)
    else:
        seen = store.mark()
        wanted = spark.createDataFrame([(summary, ticket_id)], "summary string, ticket_id string")
        pairs, created = changes.find_or_create_leaks(store.leaks(), wanted, run_ts=run_ts, source_name=SPYCLOUD_SOURCE)
        leak_id = pairs.first()["leak_id"]
        result = import_feed(rows, stored=store.rows(), leak_id=leak_id, reference=reference, first_id=store.next_id(), **options)
        _commit(store, batch, result, kind=kind, since=seen, leaks=created, more=set_aside)
    _deliver(store, batch, kind, outputs)
    return result


def import_leak_files(spark, store: Store, paths, *, leak_id: int, batch: str, outputs=(), **options) -> ImportResult | AlreadyApplied:
    """Generic CSV files -> store, under a leak that must exist. ``outputs`` as above."""
    if store.has(batch):
        result = AlreadyApplied(store, batch, "batch")
    else:
        seen = store.mark()
        result = import_rows_of_leak(
            scan_leak_csv(spark, paths, leak_id), stored=store.rows(), leaks=store.leaks(), leak_id=leak_id,
            first_id=store.next_id(), **options,
        )
        _commit(store, batch, result, since=seen)
    _deliver(store, batch, "batch", outputs)
    return result


def _commit(store, batch, result, *, kind="batch", since, leaks=None, more=None):
    aside = result.set_aside
    if more is not None:
        aside = aside.unionByName(normalize.masked(more).withColumn("flagged", F.lit(False)))
    store.commit(
        batch, kind=kind, inserts=result.inserts, raises=result.raises, leaks=leaks, since=since,
        outcome=result.outcome, rejected=aside, report=result.report.coalesce(1),
    )


def _deliver(store, batch, kind, outputs):
    named = outputs if isinstance(outputs, Mapping) else {str(n): output for n, output in enumerate(outputs)}
    waiting = {name: output for name, output in named.items() if not store.delivered(batch, kind, name)}
    outcome = store.outcome(batch, kind) if waiting else None
    if outcome is not None:
        for name, output in waiting.items():
            output(outcome)
            store.mark_delivered(batch, kind, name)
