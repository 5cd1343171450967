"""Preference records from chosen and rejected conversations."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turn markup; a turn is START role newline text END newline.
START, END = "<|im_start|>", "<|im_end|>"
#: The role whose text and end mark are trained on.
LEARNED = "assistant"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def preference_pairs(turns: DataFrame, *, pair: str = "pair_id", side: str = "side", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per pair: (pair_id, n_common, n_chosen, n_rejected, prompt, chosen, rejected, chosen_mask, rejected_mask,
    chosen_learned, rejected_learned, status).

    ``turns`` holds both conversations of every pair, ``side`` being ``chosen`` or ``rejected``. The prompt is the longest run of
    turns, from the first on, in which both have the same roles and texts, rendered once. What follows on each side is its
    completion. A mask lists the learned parts of a completion as ``begin-end`` character positions (from 0, end not included),
    joined by commas: the texts of assistant turns with their end marks; headers and other roles' turns are not learned.
    ``chosen_learned`` counts those characters. ``status`` is ``pair``, or ``identical`` (both completions empty), or
    ``one_sided`` (a side has no turns).

    Turns are placed by ``turn`` (null first). Turns of one side with equal numbers keep one place in the order (role, text).
    Null roles and texts count as empty. Rows without a pair id, or with another side, belong to no record.
    An empty table gives no rows. Turns are first matched place by place, so only the final record, which is one
    row by definition, brings a pair together.
    """
    clean = turns.filter(F.col(pair).isNotNull() & F.col(side).isin("chosen", "rejected")).select(
        F.col(pair).alias("pair_id"),
        F.col(side).alias("side"),
        F.col(turn).alias("turn"),
        F.struct(F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("said"),
    )
    sides = lambda name: F.sort_array(F.collect_list(F.when(F.col("side") == name, F.col("said"))))
    places = clean.groupBy("pair_id", "turn").agg(sides("chosen").alias("chosen"), sides("rejected").alias("rejected"))
    place = F.struct(F.col("turn"), F.col("chosen"), F.col("rejected"))
    joined = places.groupBy("pair_id").agg(F.sort_array(F.collect_list(place)).alias("_places"))
    both = joined.select("pair_id", F.flatten(F.col("_places.chosen")).alias("_c"), F.flatten(F.col("_places.rejected")).alias("_r"))
    shorter = F.least(F.size("_c"), F.size("_r"))
    differ = F.filter(F.sequence(F.lit(1), shorter), lambda i: F.element_at("_c", i) != F.element_at("_r", i))
    first = F.when(shorter == 0, F.lit(0)).when(F.size(differ) == 0, shorter).otherwise(F.array_min(differ) - 1)
    split = both.withColumn("n_common", first.cast("int"))
    rest = lambda c: F.slice(F.col(c), F.col("n_common") + 1, F.greatest(F.size(c) - F.col("n_common"), F.lit(0)))
    parts = split.select(
        "pair_id",
        "n_common",
        F.size("_c").alias("n_chosen"),
        F.size("_r").alias("n_rejected"),
        _render(F.slice("_c", F.lit(1), F.col("n_common"))).alias("prompt"),
        rest("_c").alias("_c"),
        rest("_r").alias("_r"),
    )
    status = F.when((F.col("n_chosen") == 0) | (F.col("n_rejected") == 0), "one_sided").when(
        (F.size("_c") == 0) & (F.size("_r") == 0), "identical"
    ).otherwise("pair")
    spans = parts.withColumn("_cm", _learned("_c")).withColumn("_rm", _learned("_r"))
    return spans.select(
        "pair_id",
        F.col("n_common").cast("long").alias("n_common"),
        F.col("n_chosen").cast("long").alias("n_chosen"),
        F.col("n_rejected").cast("long").alias("n_rejected"),
        "prompt",
        _render(F.col("_c")).alias("chosen"),
        _render(F.col("_r")).alias("rejected"),
        _mask("_cm").alias("chosen_mask"),
        _mask("_rm").alias("rejected_mask"),
        _total("_cm").alias("chosen_learned"),
        _total("_rm").alias("rejected_learned"),
        status.alias("status"),
    )


def _render(said):
    return F.array_join(F.transform(said, lambda t: rendered(t["role"], t["text"])), "")


def _learned(said):
    """The spans (begin, end) of learned characters of a completion."""
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("spans"))

    def step(state, t):
        header = F.length(t["role"]) + F.lit(len(START) + 1)
        begin = state["at"] + header
        end = begin + F.length(t["text"]) + F.lit(len(END))
        span = F.struct(begin.cast("long").alias("begin"), end.cast("long").alias("end"))
        more = F.when(t["role"] == LEARNED, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((end + 1).cast("long").alias("at"), more.alias("spans"))

    return F.aggregate(said, empty, step, lambda state: state["spans"])


def _mask(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat(s["begin"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")


def _total(spans):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["begin"])


def mismatched_answers(conversations: DataFrame) -> DataFrame:
    """Turns of pairs from plain conversations (conv_id, turn, role, text), for ``preference_pairs``.

    Chosen is a conversation as it stands. Rejected is the same conversation with its last answer exchanged for the last
    answer of the conversation whose id is one higher, so answers to another question, a usual kind of negative; where that
    has none, the answer is left out. Conversations without an answer have equal sides. Rows without a conversation id are left out.
    """
    known = conversations.filter("conv_id is not null").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    answers = known.filter(F.col("role") == LEARNED).groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("_last"))
    others = answers.select((F.col("pair_id") - 1).alias("pair_id"), F.struct(F.col("_last.text").alias("text")).alias("_other"))
    marked = known.join(answers, "pair_id", "left").join(others, "pair_id", "left")
    is_last = (F.col("role") == LEARNED) & F.col("turn").eqNullSafe(F.col("_last.turn")) & F.col("text").eqNullSafe(F.col("_last.text"))
    chosen = F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text"))
    other = F.when(F.col("_other").isNotNull(), F.struct(F.lit("rejected").alias("side"), F.col("_other.text").alias("text")))
    rejected = F.when(F.coalesce(is_last, F.lit(False)), other).otherwise(F.struct(F.lit("rejected").alias("side"), F.col("text").alias("text")))
    sides = F.filter(F.array(chosen, rejected), lambda x: x.isNotNull())
    return marked.select("pair_id", "turn", "role", F.explode(sides).alias("_s")).select("pair_id", "_s.side", "turn", "role", "_s.text")
