"""The stored tables as folders of parquet, written once and never changed in place.

An import appends: new credentials, and counter raises for known ones, each in a folder of its own batch. An entry in the log
(``plans.journal``) makes the batch visible, and is written last, under a number that only one writer can get. So the cost of an import
follows the batch and not the table; a job that dies leaves nothing visible; of two writers who have seen the
same log the second fails with ``ConflictingWrite``, be they imports, updates or compactions.

Credentials and raises are partitioned by ``key_bucket``, a hash of the address. Questions with addresses join on it, so only the
buckets asked for are read, and an update by id writes only the buckets it touches: its entry says which buckets of
earlier batches it takes the place of. ``compact`` lays everything out anew and begins a new folder of the log.

With ``statistics=True`` each batch also leaves its counts per bucket, department and malware, so summaries are put together from these and no
credential is read. They are hidden by bucket like the rows they count, which keeps them right under updates and compactions.

A batch is known by its kind and the caller's text as it is; folders are named by a hash of both and a random part, so no two attempts
share one, and the store's own entries can't be taken for a caller's batch.
"""

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import changes, stats
from ..operators.buckets import BUCKET, beside, bucket_of, buckets_of, marked
from ..operators.joins import keep_matching
from ..schemas import LEAK, LEAK_DATA
from ..session import staged
from .journal import ConflictingWrite, Journal, Log

__all__ = ["ConflictingWrite", "KeyClash", "Store"]

#: Buckets of a new store. A table of 100 TB wants some thousands; a bucket is the least that a question reads and an update writes.
BUCKETS = 16
_KEYED = [T.StructField("email_key", T.StringType()), T.StructField(BUCKET, T.IntegerType())]
_STORED = T.StructType(LEAK_DATA.fields + _KEYED)
_RAISES = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), *_KEYED])
#: What ``stats.partials`` gives. Few rows a batch, so the bucket is a plain column here.
_PARTIALS = T.StructType([
    T.StructField(BUCKET, T.IntegerType()), T.StructField("dg", T.StringType()), T.StructField("malware_name", T.StringType()),
    T.StructField("credentials", T.LongType()), T.StructField("times_seen", T.LongType()), T.StructField("addresses", T.BinaryType()),
])
_KINDS = {"credentials": _STORED, "raises": _RAISES, "leaks": LEAK, "partials": _PARTIALS}
#: Columns that questions and the dedupe compare: files and row groups without the value are passed over.
_BLOOMED = ("email_key", "email", "password", "password_plain", "password_hashed", "domain")
_KNOWN = "kind string, batch string, label string, kept string"
_OWN = ("base", "update")


class KeyClash(ValueError):
    """An update would leave two credentials with one key."""


@dataclass(frozen=True)
class Entry:
    """One row of the log."""

    kind: str
    batch: str
    label: str
    rows: dict
    max_id: int
    max_leak_id: int
    buckets: int
    kept: tuple = ()
    #: buckets whose earlier credentials and raises this entry takes the place of, and whether it does so with the leaks
    replaces: tuple = ()
    replaces_leaks: bool = False
    number: int = 0


class Store:
    def __init__(self, spark: SparkSession, root: str, *, buckets: int = BUCKETS, statistics: bool = False):
        """``buckets`` holds for a new store; an old one keeps its own. Once counts are kept with batches, every writer keeps them."""
        self.spark, self.root, self._buckets, self._statistics = spark, root.rstrip("/"), buckets, statistics
        self.journal = Journal(spark, f"{self.root}/log")

    # ---- what is visible

    def _log(self) -> Log:
        log = self.journal.read()
        return Log(log.folder, tuple(Entry(**{k: tuple(v) if isinstance(v, list) else v for k, v in e.items()}) for e in log.entries))

    def log(self) -> list:
        """Batches since the last ``compact``, and what that left: one small row per batch."""
        return list(self._log().entries)

    def mark(self) -> tuple:
        """What is committed now, for ``commit(since=...)``."""
        return self._log().mark

    @property
    def buckets(self) -> int:
        return self._buckets_of(self._log())

    def _buckets_of(self, log):
        return log.entries[0].buckets if log.entries else self._buckets

    def has(self, batch: str, kind: str = "batch") -> bool:
        """Is the batch committed, be it before the last ``compact``? ``kind`` keeps files, streams and others apart."""
        return self._find(self._log(), batch, kind) is not None

    def _find(self, log, batch, kind):
        """(label, what was kept) of a committed batch, or None."""
        for entry in log.entries:
            if (entry.kind, entry.batch) == (kind, batch):
                return entry.label, entry.kept
        known = self._known(log)
        row = None if known is None else known.filter((F.col("kind") == kind) & (F.col("batch") == batch)).first()
        return None if row is None else (row.label, tuple(filter(None, row.kept.split(","))))

    def _known(self, log) -> DataFrame | None:
        """Batches that an earlier ``compact`` has folded in."""
        base = next((e for e in log.entries if e.kind == "base" and e.rows.get("known")), None)
        return None if base is None else self.spark.read.schema(_KNOWN).parquet(f"{self.root}/known/batch={base.label}")

    def _read(self, log: Log, kind: str) -> DataFrame:
        """The visible rows: of each batch all buckets but those that a later entry has replaced. Partition filters, so nothing else is listed or read."""
        buckets = self._buckets_of(log)
        labels, hidden, gone = [], {}, frozenset()
        for entry in reversed(log.entries):
            if entry.rows.get(kind):
                labels.append(entry.label)
                if gone:
                    hidden.setdefault(gone, []).append(entry.label)
            if kind == "leaks":
                if entry.replaces_leaks:
                    break
            else:
                gone |= frozenset(entry.replaces)
        schema = _KINDS[kind]
        if not labels:
            return self._none(kind, buckets)
        found = (
            self.spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.StringType())]))
            .option("basePath", f"{self.root}/{kind}")
            .parquet(*[f"{self.root}/{kind}/batch={label}" for label in labels])
        )
        for replaced, older in hidden.items():
            found = found.filter(~(F.col("batch").isin(older) & F.col(BUCKET).isin(sorted(replaced))))
        found = found.select(*schema.names)
        return marked(found, buckets) if BUCKET in schema.names else found

    def rows(self) -> DataFrame:
        """Stored credentials as first written; ``count_seen`` is the first count. Enough for keys and dedupe."""
        return self._read(self._log(), "credentials")

    def credentials(self, asked: DataFrame | None = None) -> DataFrame:
        """Stored credentials with current counters. A filter on ``email_key`` or ``key_bucket`` reaches both scans.

        ``asked`` (a column ``email``, any case) limits both tables to its addresses before they are joined, so a table of questions
        does not make the whole store travel, and only their buckets are read.
        """
        return self._credentials(self._log(), asked)

    def _credentials(self, log, asked=None):
        stored, raised = self._read(log, "credentials"), self._read(log, "raises")
        if asked is not None:
            keys = asked.select(F.upper("email").alias("email_key")).filter("email_key is not null").distinct()
            keys, on = beside(stored, keys, ["email_key"], "email_key")
            stored = keep_matching(stored, keys, on, unique=F.col("id"))
            raised = keep_matching(raised, keys, on, unique=F.col("id"))
        on = [BUCKET, "email_key", "id"]
        raised = raised.groupBy(*on).agg(F.sum("n").alias("_n"))
        joined = stored.join(raised, on, "left")
        seen = F.col("count_seen") + F.coalesce("_n", F.lit(0))
        found = joined.select(*[seen.alias(c) if c == "count_seen" else F.col(c) for c in _STORED.names])
        return marked(found, self._buckets_of(log))

    def leaks(self) -> DataFrame:
        return self._read(self._log(), "leaks")

    def statistics(self) -> DataFrame:
        """Counts per bucket, department and malware, for ``stats.merged_...``: as kept with the batches, or, where one has
        come without (before the first ``compact`` of an older store), counted from the credentials.
        """
        log = self._log()
        if all("partials" in e.rows for e in log.entries if e.rows.get("credentials") or e.rows.get("raises")):
            return self._read(log, "partials")
        return stats.partials(self._credentials(log), BUCKET)

    # ---- what is kept with a batch

    def _kept(self, what, batch, kind):
        found = self._find(self._log(), batch, kind)
        if found is None or what not in found[1]:
            return None
        return self.spark.read.parquet(f"{self.root}/{what}/batch={found[0]}")

    def outcome(self, batch: str, kind: str = "batch") -> DataFrame | None:
        """The rows that went on to the store with a committed batch; None if none were kept."""
        return self._kept("outcome", batch, kind)

    def rejected(self, batch: str, kind: str = "batch") -> DataFrame | None:
        """The rows of a committed batch that were set aside, with their reasons; secrets in the original lines are masked."""
        return self._kept("rejected", batch, kind)

    def report(self, batch: str, kind: str = "batch") -> DataFrame | None:
        """The envelope of a committed batch."""
        return self._kept("report", batch, kind)

    def delivered(self, batch: str, kind: str = "batch", output: str = "0") -> bool:
        """Has the output had this batch?"""
        return self.journal.files.exists(self._delivery(batch, kind, output))

    def mark_delivered(self, batch: str, kind: str = "batch", output: str = "0") -> None:
        self.journal.files.write(self._delivery(batch, kind, output), "")

    def _delivery(self, batch, kind, output):
        return f"{self.root}/delivered/{_label(kind, batch)}/{hashlib.sha256(output.encode()).hexdigest()[:40]}"

    # ---- changes

    def next_id(self) -> int:
        """First unused credential id, from the log."""
        return max((e.max_id for e in self._log().entries), default=0) + 1

    def commit(
        self, batch: str, *, kind: str = "batch", inserts=None, raises=None, leaks=None, outcome=None, rejected=None, report=None, since: tuple | None = None
    ) -> bool:
        """Append one batch: new credentials, counter raises, new leaks. False if the batch is already there.

        ``outcome``, ``rejected`` and ``report`` are kept with the batch. ``since`` is the ``mark`` under which ids were taken; if anything
        has been committed since then (or, without it, since this call began), ``ConflictingWrite`` is raised and nothing becomes visible.
        """
        if kind in _OWN:
            raise ValueError(f"batches of kind {kind!r} are the store's own")
        log = self._log()
        if self._find(log, batch, kind) is not None:
            return False
        if since is not None and since != log.mark:
            raise ConflictingWrite(f"another batch was committed before {batch!r} was written")
        self._add(
            log, kind, batch, {"credentials": inserts, "raises": raises, "leaks": leaks}, {"outcome": outcome, "rejected": rejected, "report": report}
        )
        return True

    def update_credentials(self, edits: DataFrame, *, order=None) -> None:
        """K5 on the stored table: fifteen columns by id, counters kept. See ``changes.update_by_id`` for repeated ids.

        Only buckets with a row that changes, or that one moves into, are written; the others stay where they are.
        A key that two rows would hold raises ``KeyClash`` and leaves the store as it was; equal keys are in one bucket.
        """
        log = self._log()
        stored = self._credentials(log)
        edits = changes.with_ids(edits)
        found = keep_matching(self._read(log, "credentials").select("id", BUCKET), edits.select("id"), "id", unique=F.col("id"))
        known = edits.join(found.select("id"), "id", "left_semi")
        into = known.select(bucket_of(F.col("email"), self._buckets_of(log)).alias(BUCKET))
        # At most one row per bucket.
        touched = sorted(r[0] for r in found.select(BUCKET).unionByName(into).distinct().collect())
        part = stored.filter(F.col(BUCKET).isin(touched)).drop("email_key", BUCKET)
        updated = staged(changes.update_credentials(part, edits, order=order), "updated")
        if not changes.duplicate_keys(updated).isEmpty():
            raise KeyClash("the update leaves a key with more than one credential")
        if touched:
            self._add(log, "update", "", {"credentials": updated}, {}, replaces=touched)

    def update_leaks(self, edits: DataFrame, *, order=None) -> None:
        """K2 on the stored table."""
        log = self._log()
        updated = staged(changes.update_leaks(self._read(log, "leaks"), edits, order=order), "updated")
        self._add(log, "update", "", {"leaks": updated}, {}, replaces_leaks=True)

    def compact(self) -> None:
        """Fold raises and updates into the rows, lay the table out by address, and begin a new folder of the log with one entry.

        Batches folded in stay known, or a late replay would count twice; what was kept with them stays where it is.
        """
        log = self._log()
        label = f"{_label('base', '')}-{uuid.uuid4().hex[:12]}"
        here = [(e.kind, e.batch, e.label, ",".join(e.kept)) for e in log.entries if e.kind not in _OWN]
        known = self.spark.createDataFrame(here, _KNOWN)
        before = self._known(log)
        known = known if before is None else known.unionByName(before)
        try:
            written = self._write_all(log, label, {"credentials": self._credentials(log), "leaks": self._read(log, "leaks")})
            watched = Observation()
            known.observe(watched, F.count("*").alias("n")).coalesce(1).sortWithinPartitions("batch").write.parquet(f"{self.root}/known/batch={label}")
            written["rows"]["known"] = watched.get["n"]
            tops = {k: max(written[k], *[getattr(e, k) for e in log.entries], 0) for k in ("max_id", "max_leak_id")}
            self.journal.go_on(log, written | tops | {"kind": "base", "batch": "", "label": label, "buckets": self._buckets_of(log)})
        except BaseException:
            self._discard(label)
            raise

    def _none(self, kind, buckets):
        empty = self.spark.createDataFrame([], _KINDS[kind])
        return marked(empty, buckets) if BUCKET in empty.columns else empty

    def _add(self, log, kind, batch, tables, extras, **says):
        label = f"{_label(kind, batch)}-{uuid.uuid4().hex[:12]}"
        extras = {name: rows for name, rows in extras.items() if rows is not None}
        try:
            written = self._write_all(log, label, {name: rows for name, rows in tables.items() if rows is not None})
            for name, rows in extras.items():
                rows.write.parquet(f"{self.root}/{name}/batch={label}")
            entry = written | {"kind": kind, "batch": batch, "label": label, "buckets": self._buckets_of(log), "kept": list(extras)} | says
            self._publish(log, entry)
        except BaseException:
            self._discard(label)
            raise

    def _publish(self, log, entry):
        self.journal.append(log, entry)

    def _discard(self, label):
        """What an attempt that failed has written: nobody can see it."""
        for folder in (*_KINDS, "known", "outcome", "rejected", "report"):
            self.journal.files.delete(f"{self.root}/{folder}/batch={label}")

    def _write_all(self, log, label, tables):
        entry = {"rows": {}, "max_id": 0, "max_leak_id": 0}
        for kind, rows in tables.items():
            n, top = self._write(kind, label, rows, self._buckets_of(log))
            entry["rows"][kind] = n
            if kind != "raises":
                entry["max_leak_id" if kind == "leaks" else "max_id"] = max(0, top or 0)
        if self._statistics or any("partials" in e.rows for e in log.entries):
            entry["rows"]["partials"] = self._write_partials(log, label, entry["rows"])
        return entry

    def _write_partials(self, log, label, written):
        """Count what a batch adds, from the files it has just written; of the store only the buckets of raised addresses are read."""
        buckets, watched = self._buckets_of(log), Observation()

        def fresh(kind):
            return self.spark.read.schema(_KINDS[kind]).parquet(f"{self.root}/{kind}/batch={label}") if written.get(kind) else self._none(kind, buckets)

        added = fresh("credentials")
        parts = stats.partials(added, BUCKET)
        if written.get("raises"):
            on, counted = [BUCKET, "email_key", "id"], ["dg", "malware_name", "count_seen"]
            raised = fresh("raises").groupBy(*on).agg(F.sum("n").alias("n"))
            before = marked(self._read(log, "credentials").select(*on, *counted), buckets)
            keys, keyed = beside(before, raised.select("email_key").distinct(), ["email_key"], "email_key")
            met = keep_matching(before, keys, keyed, unique=F.col("id")).unionByName(added.select(*on, *counted))
            parts = parts.unionByName(stats.raised_partials(met.join(raised, on), BUCKET))
        parts.select(*_PARTIALS.names).observe(watched, F.count("*").alias("n")).write.parquet(f"{self.root}/partials/batch={label}")
        return watched.get["n"]

    def _write(self, kind, label, rows, buckets):
        """Write rows for a batch: (how many, the greatest id), counted on the way."""
        schema, watched = _KINDS[kind], Observation()
        if BUCKET in schema.names:
            key = F.upper("email") if kind == "credentials" else F.col("email_key")
            rows = rows.withColumn("email_key", key)
            rows = rows.withColumn(BUCKET, bucket_of(F.col("email_key"), buckets))
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema])
        counted = [F.count("*").alias("n"), F.max("id").alias("top")]
        path = f"{self.root}/{kind}/batch={label}"
        if BUCKET not in schema.names:
            rows.observe(watched, *counted).write.parquet(path)
        else:
            # Buckets of ordinary size get one file; a bucket with an address of very many rows is split among tasks.
            laid = rows.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, "email_key", "id").observe(watched, *counted)
            writer = laid.write.partitionBy(BUCKET)
            for column in _BLOOMED:
                if column in schema.names:
                    writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
            writer.option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)
        return watched.get["n"], watched.get["top"]


def _label(kind: str, batch: str) -> str:
    return f"{kind}-{hashlib.sha256(f'{kind}/{batch}'.encode()).hexdigest()[:40]}"
