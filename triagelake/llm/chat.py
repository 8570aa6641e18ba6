"""Chat formatting of reply trees: root-to-leaf paths, ranked by score, each formatted as one conversation.

Messages get gapless numbers by a range sort, so a reply and the message that it
answers are a pair of numbers. Paths come from iterative self-joins on those
numbers that double their reach each time: after k joins every message knows the
one 2**k above it and the score of all between, so a conversation of 400 turns
takes nine joins, and the chosen leaves' paths are laid out by going back
through the same tables. Only numbers and scores move in these joins. A text
moves twice: to meet its places in the chosen paths, and to its block of turns.

A conversation is written in blocks of ``BLOCK`` turns, so a very long one is
formatted by many tasks. The reader parses the written blocks; where they lie
if a conversation has one, and one after another in constant memory if it has
more.

The template is ``<|im_start|>role<|im_sep|>text<|im_end|>`` for each turn. A
control string inside a role or a text gets a backslash after its first
character and a backslash is doubled, which is undone by dropping each backslash
that stands before another character. The loss mask is a list of spans
(code points) over each block: the texts of assistant turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.shared import Scratch, framed, table
from triagelake.operators.ranking import placed

# The template's marks, and what else a tokenizer may read as control.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROLS = (START, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
LEARNED = "assistant"
#: Turns in a written row.
BLOCK = 32
#: A text that more chosen paths share meets them in several tasks.
CROWD = 4096

_SPECIAL = r"(\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS) + ")"
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _SPECIAL, r"$1\\")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


# ---- paths -----------------------------------------------------------------


def _numbers(rows: DataFrame, linear: bool, scratch: Scratch) -> DataFrame:
    """Each message's number ``at`` and that of the message it answers, ``up`` (null: it answers none that comes before it)."""
    small = rows.select("conv_id", "node", "parent", "score", "role", "key")
    order = [F.col(c).asc_nulls_first() for c in ("node", "role", "key")]
    known = placed(small, ["conv_id"], *order, collapse=True, scratch=scratch).select(
        "conv_id", "node", "parent", "score", "key", F.col("start").alias("tree"), (F.col("start") + F.col("place")).alias("at"), "place"
    )
    known = scratch.save(known)
    if linear:
        return known.withColumn("up", F.when(F.col("place") > 0, F.col("at") - 1))
    first = known.where("node is not null").groupBy("tree", F.col("node").alias("parent")).agg(F.min("at").alias("up"))
    return known.join(first, ["tree", "parent"], "left").withColumn("up", F.when(F.col("up") < F.col("at"), F.col("up")))


def _doubled(numbers: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Tables of (at, tree, up, total, n): ``up`` is the message 2**k above, ``total`` and ``n`` are score and count from ``at`` to below it.

    The first table has all messages; table k has those that have one 2**(k-1) above them, so messages leave the joins once their path is summed.
    """
    steps = [scratch.save(numbers.select("at", "tree", "up", F.col("score").alias("total"), F.lit(1).cast("long").alias("n")))]
    summed = steps[0].where("up is null")
    while (still := steps[-1].where("up is not null")).limit(1).count():
        above = still.unionByName(summed).select(F.col("at").alias("up"), F.col("up").alias("_up"), F.col("total").alias("_total"), F.col("n").alias("_n"))
        further = still.join(above, "up").select("at", "tree", F.col("_up").alias("up"), (F.col("total") + F.col("_total")).alias("total"), (F.col("n") + F.col("_n")).alias("n"))
        steps.append(scratch.save(further))
        summed = summed.unionByName(steps[-1].where("up is null"))
    return steps


def paths(numbers: DataFrame, keep: int | None, scratch: Scratch) -> DataFrame:
    """The chosen branches: (leaf, rank, score, turns, place, at), one row for each message on each.

    A branch ends at a message without replies. Branches of a conversation rank by
    the mean score of their messages, then the longer first, then by their leaf's order.
    """
    steps = _doubled(numbers, scratch)
    answered = steps[0].where("up is not null").select(F.col("up").alias("at")).distinct()
    summed = reduce(DataFrame.unionByName, [step.where("up is null") for step in steps])
    leaves = summed.join(answered, "at", "left_anti").withColumn("score", F.col("total") / F.col("n"))
    ranked = placed(leaves.select("tree", "at", "score", "n"), ["tree"], F.col("score").desc(), F.col("n").desc(), F.col("at"), scratch=scratch)
    if keep is not None:
        ranked = ranked.where(F.col("place") < keep)
    spread = ranked.select(F.col("at").alias("leaf"), (F.col("place") + 1).alias("rank"), "score", F.col("n").alias("turns"), "at", F.lit(0).cast("long").alias("above"))
    for k in reversed(range(len(steps) - 1)):
        jump = steps[k].where("up is not null").select("at", "up")
        two = F.array(F.struct("at", "above"), F.when(F.col("up").isNotNull(), F.struct(F.col("up").alias("at"), (F.col("above") + (1 << k)).alias("above"))))
        spread = spread.join(jump, "at", "left").select("leaf", "rank", "score", "turns", F.explode(F.filter(two, lambda x: x.isNotNull())).alias("x")).select("leaf", "rank", "score", "turns", "x.*")
    return spread.select("leaf", "rank", "score", "turns", (F.col("turns") - 1 - F.col("above")).alias("place"), "at")


# ---- writing ---------------------------------------------------------------


def format_trees(spark: SparkSession, messages: DataFrame, keep: int | None = 1, linear: bool = False) -> DataFrame:
    """The chosen branches of ``messages`` (conv_id, node, parent, role, text, score) as written blocks of formatted turns.

    ``keep`` best branches of a conversation (None: all). ``linear``: the messages of a
    conversation, in the order of ``node``, are one branch; ``parent`` is not read then.

    A reply to a message that is not there, or that does not come before it (itself, a later
    one, a cycle), begins a branch. Of messages that repeat a node, replies belong to the first
    (by role, then by checksum); each repeated row is a message of its own. A null conv_id is a
    conversation, null roles and texts are empty, null and NaN scores are 0; an empty table gives
    no rows. Extra columns play no part.

    Returns conv_id, leaf, rank, score, turns, blocks, block, text, loss_start and loss_length (arrays, one entry for each
    assistant turn of the block).
    """
    scratch = Scratch(spark)
    number = F.coalesce(F.nanvl(F.col("score").cast("double"), F.lit(0.0)), F.lit(0.0)) if "score" in messages.columns else F.lit(0.0)
    rows = messages.select(
        "conv_id", "node", (F.lit(None).cast(messages.schema["node"].dataType) if linear else F.col("parent")).alias("parent"), number.alias("score"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    names = ("conv_id", "node", "parent", "score", "role", "text")
    rows = rows.withColumn("key", F.unhex(F.md5(framed(*[F.col(c) for c in names]).cast("binary"))))
    numbers = scratch.save(_numbers(rows, linear, scratch))
    chosen = scratch.save(paths(numbers, keep, scratch).join(numbers.select("at", "conv_id", "key"), "at").drop("at"))
    # texts that very many chosen places share go to several tasks
    crowds = scratch.save(chosen.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("key", F.ceil(F.col("n") / CROWD).cast("int").alias("slices")))
    salted = chosen.join(crowds, "key", "left").withColumn("slice", F.pmod(F.xxhash64("leaf", "place"), F.coalesce("slices", F.lit(1))).cast("int")).drop("slices")
    turn = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))
    texts = (
        rows.join(crowds, "key", "left").select("key", "role", "text", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)).alias("slice"))
        .groupBy("key", "slice").agg(F.first("role").alias("role"), F.first("text").alias("text"))  # repeated rows are equal
        .select("key", "slice", (F.col("role") == LEARNED).alias("learned"), turn.alias("head"), escape(F.col("text")).alias("body"))
    )
    block = F.floor(F.col("place") / BLOCK).cast("int")
    met = salted.join(texts, ["key", "slice"]).withColumn("block", block)
    piece = F.struct("place", F.concat("head", "body", F.lit(END)).alias("piece"), "learned", F.length("head").alias("before"), F.length("body").alias("long"))
    same = ["leaf", "rank", "score", "turns", "conv_id"]
    packed = met.groupBy(*same, "block").agg(F.array_sort(F.collect_list(piece)).alias("p"))  # BLOCK turns at most
    length = lambda x: F.length(x["piece"])
    start = F.transform("p", lambda x, i: F.aggregate(F.slice("p", F.lit(1), i), F.lit(0), lambda s, y: s + length(y)) + x["before"])
    spans = F.filter(F.transform("p", lambda x, i: F.struct(x["learned"].alias("learned"), F.get(F.col("start"), i).alias("s"), x["long"].alias("l"))), lambda x: x["learned"])
    out = packed.withColumn("start", start).withColumn("loss", spans).select(
        "conv_id", "leaf", "rank", "score", "turns", F.ceil(F.col("turns") / BLOCK).cast("int").alias("blocks"), "block", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"),
        F.transform("loss", lambda x: x["s"]).alias("loss_start"), F.transform("loss", lambda x: x["l"]).alias("loss_length"),
    )
    return scratch.save(out)


# ---- reading ---------------------------------------------------------------

READ = "conv_id {conv_id}, leaf long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def parse(text: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a block."""
    turns = text.split(END)
    if turns.pop():
        raise ValueError("a block ends inside a turn")
    for turn in turns:
        role, mark, body = turn.partition(SEP)
        if not mark or not role.startswith(START):
            raise ValueError("a turn without its marks")
        yield unescape(role[len(START) :]), unescape(body)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks, those of a branch one after another, to a row for each branch; holds one block at a time."""
    now, done = None, []

    def close() -> None:
        if now:
            done.append((now["conv_id"], now["leaf"], now["n"], now["turns"].hexdigest(), now["loss_chars"], now["loss"].hexdigest(), now["chars"]))

    for batch in batches:
        for conv_id, leaf, block, blocks, text, starts, lengths in zip(*[batch[c] for c in ("conv_id", "leaf", "block", "blocks", "text", "loss_start", "loss_length")], strict=True):
            if not now or now["leaf"] != leaf:
                close()
                now = {"conv_id": conv_id, "leaf": leaf, "next": 0, "n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0}
            if block != now["next"]:
                raise ValueError(f"block {block} of branch {leaf} where {now['next']} should be")
            now["next"] += 1
            now["chars"] += len(text)
            for role, said in parse(text):
                now["n"] += 1
                now["turns"].update(f"{role}\n{said}\n".encode())
            for s, n in zip(starts, lengths, strict=True):
                said = unescape(text[s : s + n])
                now["loss_chars"] += len(said)
                now["loss"].update(said.encode())
        if done:
            yield pd.DataFrame(done, columns=["conv_id", "leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": object})
            done = []
    close()
    if done:
        yield pd.DataFrame(done, columns=["conv_id", "leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": object})


def read_trees(formatted: DataFrame) -> DataFrame:
    """A row for each written branch: its turns and what stands under the loss mask, as digests, parsed from the written text."""
    schema = READ.format(conv_id=formatted.schema["conv_id"].dataType.simpleString())
    short = formatted.where("blocks = 1").mapInPandas(_read, schema)
    long = formatted.where("blocks > 1").repartition("leaf").sortWithinPartitions("leaf", "block").mapInPandas(_read, schema)
    return short.unionByName(long)


SAID = "</s>[INST] ok [/INST]"


def op13_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``conversations`` and conversation -1, each a chain of replies by turn, written and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("node"), "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", SAID), (-1, 1, "assistant", SAID)], rows.schema)
    return read_trees(format_trees(spark, rows.unionByName(own), linear=True)).drop("leaf")


def _escaped_sql(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP13_SQL = f"""WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, n, r, '{SAID}' FROM (VALUES (0, 'user'), (1, 'assistant')) t(n, r))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = '{LEARNED}'), '')) AS loss_sha256,
 sum({len(START + SEP + END)} + length({_escaped_sql("role")}) + length({_escaped_sql("text")}))::BIGINT AS formatted_chars FROM said GROUP BY conv_id"""
