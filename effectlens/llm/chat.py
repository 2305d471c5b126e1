"""Operator 3: chat formatting with prefix-target expansion, DataFrame functions only.

Every assistant turn is an example of its own: all preceding turns are its
context and only its reply is trainable.  ``format_chat`` gives each turn's
formatted segment with its offset; ``examples`` joins every assistant turn with
its context and spells the example out, with the loss mask [loss_start,
loss_end) in it.  Turns after the last reply make one more text, of the whole
conversation, with nothing to train on.  The digest is read back from these
texts alone.  Their size is that of all prefixes together, as the method has
it; the turns of a long conversation are dealt to many tasks.

Template of a turn: ``### role: text</turn>\\n``.  Inside roles and texts
``\\``, ``#`` and ``<`` (in roles ``:`` too) become ``\\s``, ``\\h``, ``\\l``
(``\\c``), so no control string can occur there, and reading back is exact.

Cases: null text or role is empty; rows of one turn number (ties, repeats) are
ordered by role, then text; null turn numbers come first; a conversation
without an assistant, or with turns after its last one, has these rows as
context without an example; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from effectlens.llm import common

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
_TEXT = (("\\", "\\s"), ("#", "\\h"), ("<", "\\l"))
_ROLE = (*_TEXT, (":", "\\c"))
#: Turn numbers that share a block: within it offsets are summed in one task,
#: above it by block, so one long conversation spreads over many tasks.
BLOCK_TURNS = 32
#: The conversation that the contract adds.
ADDED_ID, ADDED_TEXT = -7, "\\### Assistant: </turn> ok"


def _escape(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for plain, code in pairs:  # the backslash first
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def _unescape(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for plain, code in reversed(pairs):  # the backslash last
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def format_chat(turns: DataFrame) -> DataFrame:
    """One row a turn: conv_id, block, shares (blocks of the conversation), start, segment, trainable, loss_start, loss_end, example_chars, last."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), _escape(role, _ROLE), F.lit(MIDDLE))
    rows = turns.select(
        "conv_id", "turn", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(2**62))).alias("block"),
        role.alias("role"), text.alias("text"), F.length(head).cast("long").alias("head"),
        F.concat(head, _escape(text, _TEXT), F.lit(CLOSE)).alias("segment"),
    )
    # offsets: running sums inside a block, then over the blocks of a conversation
    inner = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    size = F.length("segment").cast("long")
    rows = rows.withColumn("upto", F.sum(size).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = rows.groupBy("conv_id", "block").agg(F.max("upto").alias("size"))
    over = Window.partitionBy("conv_id").orderBy("block")
    blocks = blocks.select(
        "conv_id", "block",
        F.coalesce(F.sum("size").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.sum("size").over(Window.partitionBy("conv_id")).alias("whole"), F.count("*").over(Window.partitionBy("conv_id")).alias("shares"),
    )
    same = rows.conv_id.eqNullSafe(blocks.conv_id) & (rows.block == blocks.block)
    rows = rows.join(blocks, same).select(rows["*"], "base", "whole", "shares")
    end = F.col("base") + F.col("upto")
    start = end - size
    mine = F.col("role") == "assistant"
    return rows.select(
        "conv_id", "block", "shares", start.alias("start"), "segment", mine.alias("trainable"),
        F.when(mine, start + F.col("head")).alias("loss_start"), F.when(mine, end - len(CLOSE)).alias("loss_end"),
        F.when(mine, end).alias("example_chars"), (end == F.col("whole")).alias("last"),
    )


def examples(formatted: DataFrame) -> DataFrame:
    """conv_id, start (of the last turn), trainable, last, loss_start, loss_end, text: every example, and conversations that end without a reply."""
    ends = formatted.filter(F.col("trainable") | F.col("last")).select(
        F.col("conv_id").alias("c"), F.col("start").alias("s"), "trainable", "last", "loss_start", "loss_end",
        F.pmod(F.xxhash64("start"), F.col("shares")).alias("share"),
    )
    parts = formatted.select("conv_id", "start", "segment", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("of"))
    joined = ends.join(parts, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("share") == F.col("of")) & (F.col("start") <= F.col("s")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "segment"))), lambda x: x.segment), "")
    return joined.groupBy("conv_id", F.col("s").alias("start"), "trainable", "last", "loss_start", "loss_end").agg(whole.alias("text"))


def materialize(formatted: DataFrame) -> DataFrame:
    """conv_id, example_chars, text, loss_start, loss_end of the examples to train on."""
    return examples(formatted).filter("trainable").select("conv_id", F.length("text").cast("long").alias("example_chars"), "text", "loss_start", "loss_end")


def read_back(spelled: DataFrame) -> DataFrame:
    """The text under each example's loss mask; of whole conversations their number of turns and all that was said."""
    turns = F.split("text", CLOSE, -1)  # with an empty piece at the end
    n = F.size(turns) - 1

    def said(turn: Column) -> Column:
        body = F.substring(turn, F.lit(len(OPEN) + 1), F.length(turn))
        cut = F.instr(body, ":")  # a role has no colon of its own
        role, text = F.substring(body, F.lit(1), cut - 1), F.substring(body, cut + len(MIDDLE), F.length(body))
        return F.concat(_unescape(role, _ROLE), F.lit("\n"), _unescape(text, _TEXT), F.lit("\n"))

    masked = F.expr("substring(text, cast(loss_start as int) + 1, cast(loss_end - loss_start as int))")
    return spelled.select(
        "conv_id", "start", F.length("text").cast("long").alias("chars"), F.when(F.col("trainable"), _unescape(masked, _TEXT)).alias("loss"),
        F.when(F.col("last"), n.cast("long")).alias("n"), F.when(F.col("last"), F.array_join(F.transform(F.slice(turns, 1, n), said), "")).alias("said"),
    )


def digest(formatted: DataFrame) -> DataFrame:
    """The contract's row for each conversation, read back from the spelled-out examples."""
    loss = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "loss"))), lambda x: x.loss), "")
    rows = read_back(examples(formatted)).groupBy("conv_id").agg(
        F.max("n").alias("n_turns"), F.max("said").alias("said"), loss.alias("loss"), F.sum("chars").alias("formatted_chars"),
    )
    return rows.select(
        "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the contract's own one, formatted and read back."""
    given = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(ADDED_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ADDED_TEXT).alias("text"),
    )
    return digest(format_chat(given.unionByName(added)))


SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(role) + length(text) + 14
    + length(role) * 2 - length(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', '')) - length(role)
    + length(text) * 2 - length(replace(replace(replace(text, '\', ''), '#', ''), '<', '')) - length(text) AS chars
  FROM given
), placed AS (
  SELECT *, sum(chars) OVER w AS upto, row_number() OVER w AS nr, count(*) OVER (PARTITION BY conv_id) AS n
  FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nr)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nr) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR nr = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""
