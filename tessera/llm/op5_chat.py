"""Chat formatting of reply trees.

Messages point to the message they answer. Pointer doubling by self-joins gives every
message its root and depth; the best-scored root-to-leaf branches of each tree are
chosen, and only those are unrolled, again by self-joins that halve the distance each
time. Each chosen path becomes one formatted conversation with a loss mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.staging import stage

TURN, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings of this and other common chat templates: none survives inside a text.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_MARK = "␛"
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROLS), re.IGNORECASE)
_BACK = re.compile(_MARK + "([01])")
FORMATTED = "formatted string, loss_spans array<struct<begin:bigint,end:bigint>>"


def escape(text: str) -> str:
    """``text`` with a mark put inside every control string; marks of its own are told apart, so it can be undone."""
    return _CONTROL.sub(lambda m: m[0][0] + _MARK + "1" + m[0][1:], text.replace(_MARK, _MARK + "0"))


def unescape(text: str) -> str:
    """Inverse of :func:`escape`."""
    return _BACK.sub(lambda m: _MARK if m[1] == "0" else "", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """One string for ``(role, text)`` turns, and the code-point spans of the assistants' texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = TURN + escape(role).replace("\n", _MARK + "2") + "\n"
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Turns read back from a formatted string."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        head, _, body = part.partition("\n")
        turns.append((unescape(head.replace(_MARK + "2", "\n")), unescape(body[: -len(END)])))
    return turns


def _doubling(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Depth and summed score up to its root for each node, and for each k the table of its 2^k-th ancestor.

    Messages on a cycle, or below one, never reach a root and are left out: rounds end
    once they outnumber what any tree of so many messages could need.
    """
    total = nodes.count()
    hops = F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long")
    reach = stage(nodes.select("node", F.col("parent").alias("top"), hops.alias("depth"), F.col("score").alias("sum")), "reach")
    jumps = [reach.where("top is not null").select("node", F.col("top").alias("up"))]
    while not reach.where("top is not null").isEmpty() and (1 << (len(jumps) - 1)) <= total:
        above = reach.select(F.col("node").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"), F.col("sum").alias("extra"))
        # Only nodes that are still under way are joined; the others stay as they are.
        joined = reach.where("top is not null").join(above, "top")
        moved = joined.select("node", F.col("next").alias("top"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("sum") + F.col("extra")).alias("sum"))
        reach = stage(reach.where("top is null").unionByName(moved), "reach")
        jumps.append(reach.where("top is not null").select("node", F.col("top").alias("up")))
    return reach.where("top is null").select("node", "depth", "sum"), jumps


def branches(messages: DataFrame, top: int = 1) -> DataFrame:
    """Rows ``(tree, leaf, position, node)`` of the ``top`` root-to-leaf paths of each tree with the highest mean score.

    ``messages`` has ``tree``, ``node`` (unique), ``parent`` and ``score``, and is cheap to
    read again. A missing or null parent makes a root; null scores count 0; ties go to the
    smaller leaf. A path's rows are emitted only for chosen branches, in
    log2(depth) joins; no path is ever collected here. An empty table gives no rows.
    """
    known = messages.select(F.col("node").alias("parent"), F.lit(True).alias("there"))
    score = F.coalesce("score", F.lit(0.0)).alias("score")
    # Roots, a message of every tree, look for no parent, so they do not meet on a null key.
    roots = messages.where("parent is null").select("tree", "node", "parent", score)
    replies = messages.where("parent is not null").join(known, "parent", "left").select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("parent"), score)
    nodes = stage(roots.unionByName(replies), "nodes")
    rooted, jumps = _doubling(nodes)
    leaves = nodes.join(nodes.where("parent is not null").select(F.col("parent").alias("node")).distinct(), "node", "left_anti")
    ends = leaves.select("tree", "node").join(rooted, "node")
    order = F.row_number().over(Window.partitionBy("tree").orderBy((F.col("sum") / (F.col("depth") + 1)).desc(), "node"))
    chosen = ends.withColumn("rank", order).where(F.col("rank") <= top)
    path = chosen.select("tree", F.col("node").alias("leaf"), "node", F.col("depth").alias("position"), (F.col("depth") + 1).alias("span"))
    for k in reversed(range(len(jumps))):
        half = F.lit(1 << k).cast("long")
        lower = F.struct("node", "position", F.least("span", half).alias("span"))
        upper = F.struct(F.col("up").alias("node"), (F.col("position") - half).alias("position"), (F.col("span") - half).alias("span"))
        parts = F.when(F.col("span") > half, F.array(lower, upper)).otherwise(F.array(lower))
        path = path.join(jumps[k], "node", "left").select("tree", "leaf", F.inline(parts))
    return path.select("tree", "leaf", "position", "node")


def format_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """``(tree, leaf, formatted, loss_spans)``: one conversation for each chosen path of ``messages``.

    ``messages`` has ``tree, node, parent, role, text, score``. Null roles and texts are
    empty. The turns of one path come together in one row, as the result demands.
    """
    path = branches(messages, top)
    turns = path.join(messages.select("node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), "node")
    paths = turns.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("position", "role", "text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in batch.column(2).to_pylist()]
            spans = pa.array([[{"begin": b, "end": e} for b, e in s] for _, s in out], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f for f, _ in out], pa.string()), spans], ["tree", "leaf", "formatted", "loss_spans"])

    kinds = dict(paths.dtypes)
    return paths.mapInArrow(run, f"tree {kinds['tree']}, leaf {kinds['leaf']}, {FORMATTED}")


def conversation_tree(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) as messages: each row answers the row before it by turn.

    Rows of one turn are ordered by role, then text; repeated rows all stay. A null turn
    comes first. Null conversation ids form one conversation.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    numbered = conversations.select(F.col("conv_id").cast("long"), "turn", "role", "text").withColumn("n", F.row_number().over(order))
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    node = F.concat_ws(":", name, F.col("n"))
    before = F.when(F.col("n") > 1, F.concat_ws(":", name, F.col("n") - 1))
    return numbered.select(F.col("conv_id").alias("tree"), node.alias("node"), before.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``, from the formatted text and its mask alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in batches:
            rows = []
            for conv, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                turns = parse_turns(text)
                whole = "".join(f"{role}\n{body}\n" for role, body in turns)
                loss = "".join(unescape(text[s["begin"] : s["end"]]) for s in spans)
                rows.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select(F.col("tree"), "formatted", "loss_spans").mapInArrow(run, schema)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Digests of every conversation, and of conversation -7, whose texts are control strings.

    Null roles and texts are empty, null ids one conversation; rows of one turn are ordered by role, then text, and repeated rows
    all stay. A text of any length is a turn. Other columns are ignored. An empty table gives conversation -7 alone.
    """
    spark = conversations.sparkSession
    text = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    plain = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    messages = stage(conversation_tree(plain.unionByName(planted)), "messages")
    return read_back(format_paths(messages))


def _escaped_chars(text: str) -> str:
    pattern = "|".join(re.escape(c).replace("'", "''").replace("\\<", "<").replace("\\>", ">") for c in CONTROLS)
    return f"(length({text}) + length({text}) - length(replace({text}, '{_MARK}', '')) + 2 * len(regexp_extract_all({text}, '(?i){pattern}')))"


_PLANTED = "</s>[INST] ok [/INST]"
ORACLE = f"""with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
union all values (-7, 0, 'user', '{_PLANTED}'), (-7, 1, 'assistant', '{_PLANTED}'))
select conv_id::bigint as conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
sum({len(TURN)} + {_escaped_chars("role")} + 1 + {_escaped_chars("text")} + {len(END)})::bigint as formatted_chars
from turns group by conv_id"""
