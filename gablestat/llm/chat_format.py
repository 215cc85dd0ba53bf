"""Conversations as training windows of a token budget, cut between turns.

A turn becomes ``[INST]\\n..\\n[/INST]\\n`` (user), ``<s>\\n..\\n</s>\\n`` (assistant), ``<<SYS>>\\n..\\n<</SYS>>\\n`` (system) or
``[ROLE]\\nrole\\n[/ROLE]\\n[TURN]\\n..\\n[/TURN]\\n`` (any other role). A control string inside a text gets a backslash in front;
reading takes one away, so every text comes back as it was, backslashes of its own included.

Turns are put in order by a distributed sort and get the sum of the tokens before them: running sums inside the sorted
partitions, then one offset for each partition that continues a conversation of the one before, of which a partition
has one at most. By that sum a conversation falls into blocks of ``SPAN`` budgets, and a block is cut into windows in one pass.
However long a conversation is, no task sees more of it at once than a block; a cut at every block's border
adds one window in ``SPAN`` at most.

A window has the conversation's system turn (its first turn, if that is one of at most a quarter of the budget),
the last turns before the window up to ``history`` tokens, then new turns. Every turn is new in exactly one window. The
loss mask covers the texts of new assistant turns; those repeated as history are not in it. A turn is never
cut: one that doesn't fit with the system turn has a window to itself, marked ``over_budget``. Tokens are counted turn by turn.

Defined results: a null text or role counts as empty; a null conversation id is a conversation of its own; turns go by
turn number, null last, then a hash of role and text; repeated rows stay repeated turns; texts may be of any
length; an empty table gives no windows; only the four named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gablestat.llm.bpe import encoder
from gablestat.session import cut_lineage

#: Budgets of tokens that one block of a conversation holds, and parts into which the join of long conversations is dealt.
SPAN, SALTS = 64, 64
#: Bytes of text in one Arrow batch that a task returns, beyond the first row.
BATCH = 4 << 20
#: What a turn of each role begins and ends with.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
ROLE, TURN = ("[ROLE]", "[/ROLE]"), ("[TURN]", "[/TURN]")
_PAIRS = [*MARKS.values(), ROLE, TURN]
_CONTROL = "|".join(re.escape(x) for x in sorted((x for pair in _PAIRS for x in pair), key=len, reverse=True))
_ESCAPE, _UNESCAPE = re.compile(f"(?:{_CONTROL})"), re.compile(rf"\\({_CONTROL})")
_CLOSE = {opening: re.compile(rf"\n{re.escape(close)}\n") for opening, close in _PAIRS}
_ROLES = {opening: role for role, (opening, _) in MARKS.items()}


def escaped(text: str) -> str:
    return _ESCAPE.sub(r"\\\g<0>", text)


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def rendered(role: str, text: str) -> tuple[str, int, int]:
    """A turn with its marks, and where its text begins and ends in that."""
    head = ""
    opening, close = MARKS.get(role, TURN)
    if role not in MARKS:
        head = f"{ROLE[0]}\n{escaped(role)}\n{ROLE[1]}\n"
    head += f"{opening}\n"
    body = escaped(text)
    return f"{head}{body}\n{close}\n", len(head), len(head) + len(body)


def _field(text: str, at: int) -> tuple[str, int, int, int]:
    """The opening mark at a place, where its field begins and ends, and where what follows begins."""
    start = text.index("\n", at) + 1
    opening = text[at : start - 1]
    found = _CLOSE[opening].search(text, start)
    if found is None:
        raise ValueError("a turn without its closing mark")
    return opening, start, found.start(), found.end()


def turns_of(text: str, at: int = 0) -> Iterator[tuple[str, str, int]]:
    """Role, text and place of the text of each formatted turn from a place on."""
    while at < len(text):
        opening, start, stop, after = _field(text, at)
        if opening == ROLE[0]:
            role = unescaped(text[start:stop])
            opening, start, stop, after = _field(text, after)
        else:
            role = _ROLES[opening]
        yield role, unescaped(text[start:stop]), start
        at = after


class Turn(NamedTuple):
    """A formatted turn: its place in the conversation, tokens before it and in it, and its text's place if that is a target."""

    place: int
    before: int
    tokens: int
    body: str
    start: int
    stop: int


class _Windows:
    """Cuts the turns of one block, which come in order, into windows."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: Turn | None = None
        self.past: list[Turn] = []
        self.new: list[Turn] = []
        self.kept: list[Turn] = []
        self.size = 0

    def add(self, turn: Turn) -> dict | None:
        """Takes a new turn; gives the window that it closes, if any."""
        done = None
        if self.new and self.size + turn.tokens > self.budget:
            done = self.close()
        if not self.new:
            # a system turn that is new in this window is not put in front of it
            lead = self.system if self.system is not None and self.system.place != turn.place else None
            room = self.budget - turn.tokens - (lead.tokens if lead else 0)
            self.kept = []
            for old in reversed(self.past):
                if old.before < turn.before - self.history or old.tokens > room or (lead and old.place == lead.place):
                    break
                room -= old.tokens
                self.kept.insert(0, old)
            self.kept = [lead, *self.kept] if lead else self.kept
            self.size = sum(t.tokens for t in self.kept)
        self.new.append(turn)
        self.size += turn.tokens
        return done

    def close(self) -> dict | None:
        if not self.new:
            return None
        fresh = sum(len(t.body) for t in self.kept)
        spans, at = [], fresh
        for t in self.new:
            if t.start >= 0:
                spans.append({"start": at + t.start, "stop": at + t.stop})
            at += len(t.body)
        last = self.new[-1]
        out = {"first_turn": self.new[0].place, "n_turns": len(self.new), "n_tokens": self.size, "over_budget": self.size > self.budget,
               "fresh_from": fresh, "loss": spans, "text": "".join(t.body for t in [*self.kept, *self.new])}
        self.past = [t for t in [*self.past, *self.new] if t.before >= last.before + last.tokens - self.history]
        self.new, self.kept, self.size = [], [], 0
        return out


_TURN = pa.schema([("place", pa.int64()), ("before", pa.int64()), ("tokens", pa.int64()), ("body", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])
_WINDOW = "block long, window int, first_turn long, n_turns int, n_tokens long, over_budget boolean, fresh_from int, loss array<struct<start:int,stop:int>>, text string"
_LOSS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
_WINDOW_TYPES = [("block", pa.int64()), ("window", pa.int32()), ("first_turn", pa.int64()), ("n_turns", pa.int32()), ("n_tokens", pa.int64()),
                 ("over_budget", pa.bool_()), ("fresh_from", pa.int32()), ("loss", _LOSS), ("text", pa.string())]


def _batched(rows: Iterator[tuple[int, dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (with their size in bytes) as batches."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n
        if size >= BATCH:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            yield from batch.slice(start, 256).to_pylist()


def ordered_turns(turns: DataFrame, path: str, pattern: str, key: str = "conv_id") -> DataFrame:
    """``conv place before tokens body start stop is_system total``: formatted turns with the tokens before them in their conversation.

    ``total`` is unknown until all partitions are; the running sums of a partition are mended by an offset for those
    conversations that began in an earlier one. There is one such conversation for each partition at most.
    """
    rows = turns.select(
        F.col(key).cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumns({"hash": F.xxhash64("role", "text"), "id": F.monotonically_increasing_id()})
    # equal turns are told apart by their place in the input, so that any number of them can be dealt out
    order = [F.col(c).asc_nulls_last() for c in ("conv", "turn", "hash", "id")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "role", "text", F.spark_partition_id().alias("part"))
    schema = pa.schema([("conv", pa.int64()), ("part", pa.int32()), ("is_system", pa.bool_()), *_TURN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)

        def done():
            conv, place, before = object(), 0, 0
            for r in _rows(batches):
                if r["conv"] != conv:
                    conv, place, before = r["conv"], 0, 0
                body, start, stop = rendered(r["role"], r["text"])
                tokens = len(own.encode(body)) // 4
                if r["role"] != "assistant":
                    start = stop = -1
                yield len(body), {"conv": conv, "part": r["part"], "is_system": r["role"] == "system", "place": place, "before": before,
                                  "tokens": tokens, "body": body, "start": start, "stop": stop}
                place, before = place + 1, before + tokens

        yield from _batched(done(), schema)

    stored = cut_lineage(dealt.mapInArrow(run, "conv long, part int, is_system boolean, place long, before long, tokens long, body string, start int, stop int"))
    parts = stored.groupBy("conv", "part").agg(F.count("*").alias("_turns"), F.sum("tokens").alias("_tokens"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.select(F.col("conv").alias("_conv"), F.col("part").alias("_part"), F.sum("_turns").over(earlier).alias("_turns"), F.sum("_tokens").over(earlier).alias("_tokens"))
    shift = F.broadcast(shift.where("_turns is not null"))  # one row for each partition of the sort at most
    mended = stored.join(shift, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")), "left")
    return mended.withColumns({
        "place": F.col("place") + F.coalesce("_turns", F.lit(0)), "before": F.col("before") + F.coalesce("_tokens", F.lit(0)),
    }).drop("_conv", "_part", "_turns", "_tokens", "part")


def chat_windows(turns: DataFrame, path: str, pattern: str, budget: int = 2048, history: int = 512, key: str = "conv_id") -> DataFrame:
    """``key block window first_turn n_turns n_tokens over_budget fresh_from loss text``, windows in the order of (block, window).

    ``text`` from ``fresh_from`` on holds the new turns, ``loss`` the places of their assistant texts, all in code points.
    """
    rows = ordered_turns(turns, path, pattern, key)
    span = SPAN * budget
    block = F.floor(F.col("before") / F.lit(span)).cast("long")
    columns = ["conv", "block", "kind", *_TURN.names]
    rows = rows.withColumn("block", block)
    # the turns just before a block's border are history of the block behind it
    near = F.col("before") >= (F.col("block") + 1) * span - history
    places = F.array(F.struct("block", F.lit(2).alias("kind")), F.struct((F.col("block") + 1).alias("block"), F.lit(1).alias("kind")))
    spread = rows.withColumn("_to", F.explode(F.when(near, places).otherwise(F.slice(places, 1, 1)))).drop("block").select("*", "_to.block", "_to.kind").select(*columns)
    # conversations of more than one block: their system turn goes to every block, dealt out by parts
    later = rows.where("block > 0").select("conv", "block").distinct().withColumn("_salt", F.pmod("block", F.lit(SALTS)).cast("int"))
    system = rows.where((F.col("place") == 0) & F.col("is_system") & (F.col("tokens") * 4 <= budget)).drop("block", "is_system")
    long = later.select(F.col("conv").alias("_long")).distinct()
    system = system.join(long, F.col("conv").eqNullSafe(F.col("_long")), "left_semi").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    to = later.select(F.col("conv").alias("_conv"), "block", "_salt")
    copies = system.join(to, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("_part") == F.col("_salt"))).withColumn("kind", F.lit(0)).select(*columns)
    order = ["conv", "block", "kind", "place"]
    met = spread.unionByName(copies).repartition("conv", "block").sortWithinPartitions(*order)
    schema = pa.schema([("conv", pa.int64()), *_WINDOW_TYPES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done():
            at, own, n = None, None, 0
            for r in _rows(batches):
                if at != (r["conv"], r["block"]):
                    if own is not None and (out := own.close()):
                        yield len(out["text"]), {"conv": at[0], "block": at[1], "window": n, **out}
                    at, own, n = (r["conv"], r["block"]), _Windows(budget, history), 0
                turn = Turn(*(r[c] for c in Turn._fields))
                if r["kind"] == 0:
                    own.system = turn
                elif r["kind"] == 1:
                    own.past.append(turn)
                else:
                    if turn.place == 0 and turn.body.startswith(MARKS["system"][0]) and turn.tokens * 4 <= budget:
                        own.system = turn
                    if out := own.add(turn):
                        yield len(out["text"]), {"conv": at[0], "block": at[1], "window": n, **out}
                        n += 1
            if own is not None and (out := own.close()):
                yield len(out["text"]), {"conv": at[0], "block": at[1], "window": n, **out}

        yield from _batched(done(), schema)

    return met.mapInArrow(run, f"conv long, {_WINDOW}").withColumnRenamed("conv", key)


def read_back(windows: DataFrame, key: str = "conv_id") -> DataFrame:
    """``key n_turns turns_sha256 loss_chars loss_sha256 formatted_chars``: what the windows of each conversation say.

    New turns are parsed from the formatted text and hashed in order, each as role, line end, text, line end; loss texts are
    taken from the masks. A digest is a chain over its conversation, so one task streams one conversation, a window at a time.
    """
    schema = pa.schema([("conv", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done():
            own = None
            for r in _rows(batches):
                if own is None or own["conv"] != r["conv"]:
                    if own is not None:
                        yield 200, {**own, "turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()}
                    own = {"conv": r["conv"], "n_turns": 0, "loss_chars": 0, "formatted_chars": 0}
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                own["formatted_chars"] += len(r["text"])
                for role, text, _ in turns_of(r["text"], r["fresh_from"]):
                    own["n_turns"] += 1
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for s in r["loss"]:
                    text = unescaped(r["text"][s["start"] : s["stop"]])
                    own["loss_chars"] += len(text)
                    loss.update(text.encode("utf-8", "surrogatepass"))
            if own is not None:
                yield 200, {**own, "turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()}

        yield from _batched(done(), schema)

    rows = windows.select(F.col(key).alias("conv"), "block", "window", "fresh_from", "loss", "text")
    met = rows.repartition("conv").sortWithinPartitions("conv", "block", "window")
    return met.mapInArrow(run, "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("conv", key)
