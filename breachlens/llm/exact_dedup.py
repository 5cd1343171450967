"""Exact duplicates by a tree merge of sorted digest runs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .common import GAP, attach

#: Rounds of the merge, and the least number of lanes as a power of two.
ROUNDS, LEAST_BITS = 3, 6


def normalized(text) -> Column:
    """The text with every run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), GAP, " ")


def lane_bits(spark) -> list[int]:
    """Bits of the lane number that each round settles: as many lanes as the session has shuffle partitions, to a power of two."""
    bits = max(LEAST_BITS, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    return [bits * (r + 1) // ROUNDS - bits * r // ROUNDS for r in range(ROUNDS)]


#: The order of a run, and what must be equal in all parts for two texts to count as one.
ENTRY = ["digest", "text_sha256", "n_bytes"]


def _merged(entries: DataFrame) -> DataFrame:
    """One sorted run per lane from the entries that have come together in it.

    The smallest id is held in a struct, which Spark can only aggregate over sorted input: each task sorts its entries by
    (lane, digest, SHA-256, length), reads them in that order, compares each with the one before and closes an entry where they differ.
    """
    least = F.min(F.when(F.col("keep_id").isNotNull(), F.struct("keep_id")))["keep_id"]
    return entries.groupBy("lane", *ENTRY).agg(least.alias("keep_id"), F.sum("group_size").alias("group_size"))


def merge_runs(runs: DataFrame, bits: list[int]) -> DataFrame:
    """(digest, text_sha256, n_bytes, keep_id, group_size) for the whole table, from one run per lane.

    ``runs`` has a row per (lane, digest) with the smallest id and the number of texts. In a round every lane trades with the
    ``2 ** bits`` lanes whose numbers differ from its own in those bits only: each takes the part of the others' runs whose
    digests have its own bits there, and merges what arrives with its own in one pass over sorted entries. After the last round a lane holds
    one run for its share of the digests, so no task ever sees more than its share, and a text that is copied
    a million times is one row of each run. The order key is a 64-bit digest; entries are only taken as
    equal when SHA-256 and length agree as well, in each merge.
    """
    settled = 0
    for width in bits:
        mask = ((1 << width) - 1) << settled
        theirs = F.col("digest").bitwiseAND(F.lit(mask))
        others = F.col("lane").bitwiseAND(F.lit(~mask & ((1 << sum(bits)) - 1)))
        traded = runs.withColumn("lane", others.bitwiseOR(theirs).cast("int")).repartitionById(1 << sum(bits), F.col("lane"))
        runs = _merged(traded)
        settled += width
    return runs.drop("lane")


def exact_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, n_bytes) per row; of equal texts the smallest id stays.

    Texts are equal when they are so after white space runs have become one space. A null text is an empty one.
    A null id counts in ``group_size`` and is kept only if its whole group has no id. Rows that repeat an id are returned as
    often as they stand there, all with the same verdict. Other columns are not looked at. An empty table gives no rows.
    """
    text = normalized(text_col)
    bits = lane_bits(documents.sparkSession)
    digests = staged(
        documents.select(F.col(id_col).alias("doc_id"), text.alias("_text")).select(
            "doc_id",
            F.xxhash64("_text").alias("digest"),
            F.sha2("_text", 256).alias("text_sha256"),
            F.octet_length("_text").cast("long").alias("n_bytes"),
            F.xxhash64("doc_id").bitwiseAND(F.lit((1 << sum(bits)) - 1)).cast("int").alias("lane"),
        ),
        "digests",
    )
    runs = _merged(digests.select("lane", *ENTRY, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")))
    merged = merge_runs(runs, bits).select(F.struct(*ENTRY).alias("_key"), "keep_id", "group_size")
    rows = digests.select("doc_id", F.struct(*ENTRY).alias("_key"))
    return attach(rows, merged, "_key", spread="doc_id").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("_key.text_sha256").alias("text_sha256"),
        F.col("_key.n_bytes").alias("n_bytes"),
    )


def drop_exact_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; a row repeated with the same id and text stays once."""
    kept = exact_duplicates(documents, id_col=id_col, text_col=text_col).filter("kept")
    kept = kept.select(F.struct("doc_id", "text_sha256").alias("_kept")).distinct()
    # One key for the join and for dropping repeats, so the texts are shuffled once. Structs are equal where both ids are null.
    row = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"))
    text = F.regexp_replace(F.coalesce(F.col("_row")[text_col], F.lit("")), GAP, " ")
    marked = row.select("_row", F.struct(F.col("_row")[id_col].alias("doc_id"), F.sha2(text, 256).alias("text_sha256")).alias("_kept"))
    return marked.join(kept, "_kept", "left_semi").dropDuplicates(["_kept"]).select("_row.*")
