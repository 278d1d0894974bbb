"""Chat formatting by prefix-target expansion.

Every assistant turn becomes one example: the formatted text of all turns before it is its context and only its own
text, between loss_start and loss_end, is trainable. An example is one string while its conversation has at most
`page_turns` turns. Whole strings of a longer one would grow with the square of its turns, so there each full page of
turns is written once, as a row without example, and an example's `text` begins after the `pages` pages before it;
`example_texts` joins both to whole strings. Nothing is cut. The turns after the last assistant turn train nothing; they
stand in a row without example that ends the conversation.

Template: `<<SYS>>text<</SYS>>` system, `[INST]text[/INST]` user, `<s>text</s>` assistant, and
`[ROLE]role[/ROLE]text[/ROLE]` any other. Inside texts a backslash is put before backslashes and into control
strings after their first character; dropping it restores the text.

Edge cases: null text is empty; a null role reads back as the empty role; rows of a conversation go by turn,
nulls first, ties by role then text, repeated rows stay; a conversation without assistant has no example, only its
last row; conversations of a null id form one group; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]")
CONTROL = re.compile(r"\\|(?<=<)(?=<SYS>>|</SYS>>|s>|/s>)|(?<=\[)(?=/?(?:INST|ROLE)\])")
ESCAPED = re.compile(r"\\(.)", re.S)
TURN = re.compile("|".join(f"{re.escape(a)}(?P<{role}>.*?){re.escape(b)}" for role, (a, b) in MARKS.items()) + rf"|{re.escape(OTHER[0])}(?P<role>.*?){re.escape(OTHER[1])}(?P<other>.*?){re.escape(OTHER[1])}", re.S)
EXAMPLES = "conv_id long, example long, target long, pages long, text string, loss_start long, loss_end long"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, example_chars long"
PAGE_TURNS, FLUSH_CHARS = 256, 1 << 22


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m.group(0), text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The segment of one turn, and where its escaped text lies in it."""
    start, end = MARKS.get(role, OTHER)
    head = start if role in MARKS else f"{start}{escape(role)}{end}"
    body = escape(text)
    return head + body + end, len(head), len(head) + len(body)


def parse_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of all turns of a formatted text; what is no turn is read as one of role `unreadable`."""
    at, turns = 0, []
    while at < len(text):
        m = TURN.match(text, at)
        if m is None:
            return [*turns, ("unreadable", text[at:])]
        role = m.lastgroup
        turns.append((unescape(m["role"]), unescape(m["other"])) if role == "other" else (role, unescape(m[role])))
        at = m.end()
    return turns


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, schema, strict=True)], [n for n, _ in schema])


def prefix_examples(conversations: DataFrame, page_turns: int = PAGE_TURNS) -> DataFrame:
    """EXAMPLES of all conversations (conv_id, turn, role, text), those of one together and in order."""
    i64 = pa.int64()
    schema = [("conv_id", i64), ("example", i64), ("target", i64), ("pages", i64), ("text", pa.string()), ("loss_start", i64), ("loss_end", i64)]

    def run(batches):
        conv, position, example, pages, written, now = None, 0, 0, 0, 0, ""  # now: the text of the open page; written: how much of it some row holds
        rows: list[tuple] = []
        held = 0

        def rest():
            return [(conv, None, None, pages, now, None, None)] if len(now) > written else []

        for batch in batches:
            for of, role, said in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if position and of != conv:
                    rows += rest()
                    position = 0
                if not position:
                    conv, example, pages, written, now = of, 0, 0, 0, ""
                elif position % page_turns == 0:
                    rows.append((conv, None, None, pages, now, None, None))
                    pages, written, now = pages + 1, 0, ""
                role = role or ""
                segment, a, b = format_turn(role, said or "")
                at, now = len(now), now + segment
                if role == "assistant":
                    rows.append((conv, example, position, pages, now, at + a, at + b))
                    example, written, held = example + 1, len(now), held + len(now)
                position += 1
                if held > FLUSH_CHARS:
                    yield _batch(rows, schema)
                    rows, held = [], 0
        yield _batch(rows + (rest() if position else []), schema)

    ordered = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, EXAMPLES)


def example_texts(examples: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end) with whole texts; their size is that of all prefixes."""
    full = examples.groupBy("conv_id", "pages").agg(F.max("target").alias("of"), F.max_by("text", F.char_length("text")).alias("page")).select(F.col("conv_id").alias("c"), F.col("pages").alias("p"), "page")
    joined = examples.where("example is not null").join(full, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("p") < F.col("pages")), "left")
    before = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("p", "page")))), lambda x: x["page"]), "")
    whole = joined.groupBy("conv_id", "example", "text", "loss_start", "loss_end").agg(before.alias("before"))
    shift = F.char_length("before")
    return whole.select("conv_id", "example", F.concat("before", "text").alias("text"), (F.col("loss_start") + shift).alias("loss_start"), (F.col("loss_end") + shift).alias("loss_end"))


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation, from the strings of prefix_examples alone: each is parsed whole, its turns beyond those of the row before join the digest, and what its mask covers the trained text."""
    i64, text = pa.int64(), pa.string()
    schema = [("conv_id", i64), ("n_turns", i64), ("turns_sha256", text), ("loss_chars", i64), ("loss_sha256", text), ("formatted_chars", i64), ("n_examples", i64), ("example_chars", i64)]

    class Conversation:
        def __init__(self, conv):
            self.conv, self.pages, self.turns, self.chars, self.trained, self.examples, self.total = conv, 0, 0, 0, 0, 0, 0
            self.page_turns, self.page_chars = 0, 0
            self.told, self.loss = hashlib.sha256(), hashlib.sha256()

        def read(self, example, pages, string, a, b):
            if pages != self.pages:
                self.pages, self.turns, self.chars, self.page_turns, self.page_chars = pages, self.turns + self.page_turns, self.chars + self.page_chars, 0, 0
            turns = parse_turns(string)
            for role, said in turns[self.page_turns :]:
                self.told.update(f"{role}\n{said}\n".encode())
            self.page_turns, self.page_chars = len(turns), len(string)
            if example is not None:
                said = unescape(string[a:b])
                self.loss.update(said.encode())
                self.trained, self.examples, self.total = self.trained + len(said), self.examples + 1, self.total + self.chars + len(string)

        def row(self):
            return (self.conv, self.turns + self.page_turns, self.told.hexdigest(), self.trained, self.loss.hexdigest(), self.chars + self.page_chars, self.examples, self.total)

    def run(batches):
        open_ = None
        for batch in batches:
            rows = []
            for conv, *of in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "example", "pages", "text", "loss_start", "loss_end")), strict=True):
                if open_ is None or conv != open_.conv:
                    rows += [open_.row()] if open_ else []
                    open_ = Conversation(conv)
                open_.read(*of)
            yield _batch(rows, schema)
        if open_:
            yield _batch([open_.row()], schema)

    return examples.mapInArrow(run, DIGEST)


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -1, whose two turns consist of control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = conversations.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)
