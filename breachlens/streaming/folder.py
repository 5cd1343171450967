"""A landing folder that imports whatever arrives in it (ST1).

The state is the stored table itself, so there is no watermark and no state store. The stream hands over the names of new files;
each micro-batch is then the same import as for files, whatever headers they have. The store knows a batch by stream name and number and takes it once.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import Files
from ..functions.values import SPYCLOUD_NA
from ..plans.imports import Reference, import_scanned_feed
from ..plans.store import Store
from ..schemas import LINEAGE, SPYCLOUD_COLUMNS, SPYCLOUD_REQUIRED
from ..sources.files import by_header, empty_scan, scan_csv

#: What the stream reads of a file: its name. The content is not among the columns asked for.
_FILE = "path string, modificationTime timestamp, length long, content binary"
UNKNOWN_HEADER = "unknown header"


def scan_landed(spark: SparkSession, files: list[str], header=None) -> tuple[DataFrame, DataFrame]:
    """(rows of the files, files set aside): a file needs the mandatory columns in its header, or exactly ``header`` if that is given.

    A file that has not is set aside with its first line, so one such file does not stop the stream.
    """
    groups = by_header(spark, files, listed=True) if files else []
    wanted = (lambda names: names == list(header)) if header else (lambda names: set(SPYCLOUD_REQUIRED) <= set(names))
    scans = [scan_csv(spark, some, SPYCLOUD_COLUMNS, na=SPYCLOUD_NA, header=names) for names, some in groups if wanted(names)]
    taken = {name for names, some in groups if wanted(names) for name in some}
    reader = Files(spark, files[0]) if files else None
    aside = [(reader.first_line(name), UNKNOWN_HEADER, name, 0, 0) for name in files if name not in taken]
    rows = reduce(DataFrame.unionByName, scans) if scans else empty_scan(spark, SPYCLOUD_COLUMNS)
    lineage = ", ".join(f"{c} {'string' if c == 'src_file' else 'long'}" for c in LINEAGE)
    return rows, spark.createDataFrame(aside, f"original_line string, error_msg string, {lineage}")


def stream_import(
    spark: SparkSession,
    store: Store,
    landing: str,
    *,
    name: str,
    checkpoint: str,
    ticket_id: str,
    summary: str,
    reference: Reference,
    run_ts: Column | None = None,
    header=None,
    files_per_batch: int = 1000,
    compact_after: int = 500,
    trigger=None,
    **options,
):
    """Start the stream and return its query. With ``header`` only files that have exactly that one are taken.

    ``name`` identifies the stream in the store's log; give a new checkpoint folder a new name. When more than ``compact_after``
    batches have come in since the last time, the store is compacted, so its log and its files stay few.
    """
    arriving = spark.readStream.format("binaryFile").schema(_FILE).option("maxFilesPerTrigger", files_per_batch).load(landing)

    def take(batch_df, batch_id):
        session = batch_df.sparkSession
        files = sorted(row.path for row in batch_df.collect())  # names only, ``files_per_batch`` at most
        rows, aside = scan_landed(session, files, header)
        import_scanned_feed(
            session, store, rows, ticket_id=ticket_id, summary=summary, reference=reference,
            run_ts=F.current_timestamp() if run_ts is None else run_ts, batch=f"{name}-{batch_id}", kind="stream", set_aside=aside, **options,
        ).close()
        if len(store.log()) > compact_after:
            store.compact()

    writer = arriving.select("path").writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(take)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
