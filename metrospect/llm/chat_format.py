"""Chat formatting through a prefix tree.

A turn is written as OPEN role MIDDLE text CLOSE; control strings inside roles and texts are broken by a
backslash, and backslashes doubled, so parsing gives back what was put in. Conversations that share their
first turns share those turns' tokens: sorted by their paths (one hash per turn), neighbours share the
longest prefixes, and walking them in that order is a depth-first walk of the tree. Each node is emitted
once, into one long stream of code points, with

* its interval in the stream, and the part of it under the loss mask (an assistant's text),
* the position id of its first token (its distance from the conversation's start),
* the intervals of its ancestors, which its tokens may attend to; neighbouring intervals are one.

The walk runs in blocks of at most about BLOCK conversations, cut by range of (path, conversation), so a first
turn or a whole conversation that a third of the table shares is spread over many blocks. The first pass
reduces a block to its length and its last open path; the driver chains these (one row per block), and
the second pass emits the nodes with their places in the stream.

One conversation must fit into a task, as training consumes it whole. Defined cases: null text and null role
count as empty; rows of equal turn are ordered by role, then text, and all kept; a null conv_id is one
conversation; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrospect.session import staged

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
BLOCK = 2_000
NODES = (
    "block int, start long, stop long, position long, role string, piece string, loss_start long, loss_stop long, "
    "ancestors array<struct<start:long,stop:long>>"
)


def escape(text: str) -> str:
    """No control string is left, and unescape undoes it."""
    text = text.replace("\\", "\\\\")
    return CONTROL.sub(lambda control: f"{control[0][0]}\\{control[0][1:]}", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int]:
    """The formatted turn and the offset of its text."""
    head = f"{OPEN}{escape(role)}{MIDDLE}"
    return f"{head}{escape(text)}{CLOSE}", len(head)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        middle = formatted.index(MIDDLE, at)
        close = formatted.index(CLOSE, middle)
        turns.append((unescape(formatted[at + len(OPEN):middle]), unescape(formatted[middle + len(MIDDLE):close])))
        at = close + len(CLOSE)
    return turns


def paths(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, path (a hash per turn), turns and block: conversations in tree order, cut into blocks.

    The blocks are staged, so both passes see the same ones.
    """
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    turns = F.sort_array(F.collect_list(F.struct("turn", text("role"), text("text"))))
    convs = rows.groupBy(F.col("conv_id").cast("string").alias("conv_id")).agg(turns.alias("turns"))
    key = F.transform("turns", lambda t: F.unhex(F.sha2(F.concat(t["role"], F.lit("\n"), t["text"]), 256)))
    convs = staged(convs.withColumn("path", key), "chat-conversations")
    blocks = max(1, -(-convs.count() // block))
    dealt = convs.repartitionByRange(blocks, "path", F.col("conv_id"))
    return staged(dealt.withColumn("block", F.spark_partition_id()), "chat-blocks")


def walk(block: pd.DataFrame, inherited: list[tuple[bytes, int, int]], base: int) -> Iterator[tuple[int, list, list]]:
    """For each conversation of a block, in order: conv_id, the open path, and the nodes it adds.

    A path entry is (hash, start in the stream, length); inherited is the open path before the block
    and base the length of the stream before it.
    """
    order = sorted(range(len(block)), key=lambda i: (list(block["path"].iloc[i]), block["conv_id"].iloc[i] or ""))
    open_path, end = list(inherited), base
    for i in order:
        hashes = [bytes(h) for h in block["path"].iloc[i]]
        turns = block["turns"].iloc[i]
        shared = 0
        while shared < min(len(hashes), len(open_path)) and open_path[shared][0] == hashes[shared]:
            shared += 1
        del open_path[shared:]
        added = []
        for depth in range(shared, len(hashes)):
            piece, offset = format_turn(turns[depth]["role"], turns[depth]["text"])
            open_path.append((hashes[depth], end, len(piece)))
            added.append((depth, turns[depth]["role"], piece, offset))
            end += len(piece)
        yield i, open_path, added


def chained(summaries: list) -> dict[int, tuple[list[tuple[bytes, int, int]], int]]:
    """For each block, the open path and the length of the stream before it.

    A summary has a block's first path with lengths, its last open path and its length, as if nothing
    came before; what its first conversation shares with the open path was then counted too much.
    """
    out, open_path, end = {}, [], 0
    for row in sorted(summaries, key=lambda r: r["block"]):
        first = [(bytes(n["hash"]), n["length"]) for n in row["first"]]
        shared = 0
        while shared < min(len(first), len(open_path)) and open_path[shared][0] == first[shared][0]:
            shared += 1
        inherited = open_path[:shared]
        out[row["block"]] = inherited, end
        saved = sum(length for _, length in first[:shared])
        last = [(bytes(n["hash"]), n["start"], n["length"]) for n in row["last"]]
        kept = 0
        while kept < min(shared, len(last)) and last[kept][0] == inherited[kept][0] and last[kept][1] < saved:
            kept += 1
        open_path = inherited[:kept] + [(h, start - saved + end, length) for h, start, length in last[kept:]]
        end += row["length"] - saved
    return out


def merged(intervals: list[tuple[int, int]]) -> list[dict]:
    """Intervals in order, neighbours joined."""
    out: list[dict] = []
    for start, stop in intervals:
        if out and out[-1]["stop"] == start:
            out[-1]["stop"] = stop
        else:
            out.append({"start": start, "stop": stop})
    return out


def tree(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The emitted nodes (NODES) and, per conversation, the starts of its nodes and its merged intervals."""
    blocks = paths(rows, block)

    def summarise(part: pd.DataFrame) -> pd.DataFrame:
        first, length, last = None, 0, []
        for i, open_path, added in walk(part, [], 0):
            if first is None:
                first = [{"hash": h, "length": n} for h, _, n in open_path]
            length += sum(len(piece) for _, _, piece, _ in added)
            last = open_path
        return pd.DataFrame({"block": [part["block"].iloc[0]], "first": [first], "length": [length],
                             "last": [[{"hash": h, "start": s, "length": n} for h, s, n in last]]})

    summaries = blocks.groupBy("block").applyInPandas(
        summarise, "block int, first array<struct<hash:binary,length:long>>, length long, last array<struct<hash:binary,start:long,length:long>>")
    before = blocks.sparkSession.sparkContext.broadcast(chained(summaries.collect()))

    def emit(part: pd.DataFrame) -> pd.DataFrame:
        number = int(part["block"].iloc[0])
        inherited, base = before.value[number]
        out = []
        for i, open_path, added in walk(part, inherited, base):
            conv = part["conv_id"].iloc[i]
            covered = [(start, start + length) for _, start, length in open_path]
            spans = merged(covered)
            position = sum(length for _, _, length in open_path[:len(open_path) - len(added)])
            for depth, role, piece, offset in added:
                start = covered[depth][0]
                loss = (start + offset, start + len(piece) - len(CLOSE)) if role == "assistant" else (None, None)
                out.append({"block": number, "start": start, "stop": start + len(piece), "position": position, "role": role,
                            "piece": piece, "loss_start": loss[0], "loss_stop": loss[1], "ancestors": merged(covered[:depth])})
                position += len(piece)
            out.append({"conv_id": conv, "nodes": [start for start, _ in covered], "intervals": spans})
        names = ["block", "start", "stop", "position", "role", "piece", "loss_start", "loss_stop", "ancestors", "conv_id", "nodes", "intervals"]
        frame = pd.DataFrame(out, columns=names).astype(object)
        return frame.where(frame.notna(), None)

    both = staged(
        blocks.groupBy("block").applyInPandas(
            emit, f"{NODES}, conv_id string, nodes array<long>, intervals array<struct<start:long,stop:long>>"), "chat-tree")
    nodes = both.where("piece is not null").drop("conv_id", "nodes", "intervals")
    return nodes, both.where("nodes is not null").select("conv_id", "nodes", "intervals")


def read_back(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """The digests of every conversation, parsed from the emitted stream by its nodes.

    A shared node is joined to all its conversations; the planner may split a hot one, as only the parts of
    one conversation must meet afterwards.
    """
    wanted = members.select("conv_id", F.posexplode("nodes").alias("place", "of"))
    parts = wanted.join(nodes, F.col("of") == F.col("start"))
    from_piece = lambda name: F.coalesce(F.col(name) - F.col("start"), F.lit(0)).cast("int").alias(name)
    part = F.struct("place", "piece", from_piece("loss_start"), from_piece("loss_stop"))
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def digest(formatted: pd.Series) -> pd.DataFrame:
        out = []
        for pieces in formatted:
            turns = parse("".join(p["piece"] for p in pieces))
            masked = "".join(unescape(p["piece"][p["loss_start"]:p["loss_stop"]]) for p in pieces)
            told = "".join(f"{role}\n{text}\n" for role, text in turns)
            out.append((len(turns), sha256(told), len(masked), sha256(masked), sum(len(p["piece"]) for p in pieces)))
        return pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return whole.select(F.col("conv_id").cast("long").alias("conv_id"), digest("parts").alias("d")).select("conv_id", "d.*")


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
