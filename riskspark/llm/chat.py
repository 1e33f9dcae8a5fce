"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as
context, and that reply as the only text to be learnt. Turns that no reply
follows come in one more example without a target, so that the output holds
every turn.

    <|im_start|>role\\ntext<|im_end|>\\n

Inside roles and texts a backslash becomes two, and `<|` becomes `<\\|`, so
that no text can hold a control string; a line break in a role becomes `\\n`.
"""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
#: Characters of an example in one row, and examples of a conversation that are dealt out together.
CHUNK, DEALT = 1 << 16, 256

_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m.group(1) == "n" else m.group(1), text)


def turn(role: str, text: str) -> tuple[str, int]:
    """A formatted turn, and where its text begins."""
    head = f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n"
    return f"{head}{escape(text)}{END}\n", len(head)


def turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn in a formatted example."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def arranged(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The rows of a key next to each other, in order."""
    return df.repartition(F.col(key)).sortWithinPartitions(key, *order)


def examples(rows: DataFrame) -> DataFrame:
    """Chunks of examples: conv_id, example, chunk, n_turns, text, loss_start, loss_end, last.

    Takes conv_id, turn, role, text; other columns are ignored. Turns are
    ordered by turn (nulls first), then role and text, so ties and repeated
    rows have one order. A null role or text is empty. Rows without a conv_id
    form one conversation. loss_start and loss_end are code points of the
    escaped reply in the whole example, null in an example without a target;
    last marks the last example of a conversation. An empty table gives no
    rows.

    An example is the beginning of its formatted conversation, in chunks of
    CHUNK characters, so most have one row. Turns are numbered and measured in
    one pass per conversation; the examples, whose size grows with the square
    of it, are dealt out by conversation, chunk and range of examples.
    """
    shown = F.concat(F.lit(START), F.replace(_escaped(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"), _escaped(F.col("text")), F.lit(END + "\n"))
    own = Window.partitionBy("conv_id")
    order = own.orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Texts are formatted behind the shuffle, which both uses of the turns share.
    turns_of = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).repartition(F.col("conv_id")).select(
        "conv_id", shown.alias("shown"), (F.col("role") == ASSISTANT).alias("reply"),
        F.length(shown).cast("long").alias("size"), F.length(_escaped(F.col("text"))).cast("long").alias("learnt"),
        F.row_number().over(order).cast("long").alias("n_turns"),
        F.sum(F.length(shown).cast("long")).over(upto).alias("end"),
        F.sum((F.col("role") == ASSISTANT).cast("long")).over(upto).alias("replies"),
        F.count(F.lit(1)).over(own).alias("turns"),
        F.sum((F.col("role") == ASSISTANT).cast("long")).over(own).alias("all_replies"),
    )
    # The example that a turn ends, or the first one that holds it.
    number = F.col("replies") - F.col("reply").cast("long")
    size, closed = F.lit(CHUNK), F.col("end") - len(END) - 1
    ends = turns_of.where(F.col("reply") | (F.col("n_turns") == F.col("turns"))).select(
        "conv_id", number.alias("example"), "n_turns", "end",
        F.when(F.col("reply"), closed - F.col("learnt")).alias("loss_start"), F.when(F.col("reply"), closed).alias("loss_end"),
        (F.col("n_turns") == F.col("turns")).alias("last_turn"), "all_replies",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("end") - 1) / size))).alias("chunk"),
    ).withColumn("dealt", F.floor(F.col("example") / DEALT))
    start = F.col("end") - F.col("size")
    pieces = turns_of.select(
        "conv_id", "shown", start.alias("start"), number.alias("example"), "all_replies",
        F.explode(F.sequence(F.floor(start / size), F.floor((F.col("end") - 1) / size))).alias("chunk"),
    ).select(
        "conv_id", "chunk", "example", "all_replies", "start",
        F.substring("shown", (F.greatest(F.col("chunk") * size - F.col("start"), F.lit(0)) + 1).cast("int"),
                    (F.least((F.col("chunk") + 1) * size - F.col("start"), F.lit(2**31 - 1)) - F.greatest(F.col("chunk") * size - F.col("start"), F.lit(0))).cast("int")).alias("piece"),
    )
    chunks = pieces.groupBy("conv_id", "chunk").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "piece"))), lambda p: p["piece"]), "").alias("all"),
        F.min("example").alias("first"), F.max("all_replies").alias("most"),
    ).select(
        F.col("conv_id").alias("of"), F.col("chunk").alias("nth"), "all",
        F.explode(F.sequence(F.floor(F.col("first") / DEALT), F.floor(F.col("most") / DEALT))).alias("part"),
    )
    # By sorting, not by a hash table: the chunks of a long conversation need not fit into memory.
    found = ends.join(chunks.hint("merge"), ends.conv_id.eqNullSafe(chunks.of) & (F.col("chunk") == F.col("nth")) & (F.col("dealt") == F.col("part")))
    held = F.least(F.col("end") - F.col("chunk") * size, size.cast("long")).cast("int")
    return found.select("conv_id", "example", "chunk", "n_turns", F.substring("all", F.lit(1), held).alias("text"), "loss_start", "loss_end", F.col("last_turn").alias("last"))


def _escaped(text):
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


class _Conversation:
    """What the chunks of a conversation hold, taken in one after the other."""

    def __init__(self, key):
        self.key, self.loss, self.whole = key, hashlib.sha256(), hashlib.sha256()
        self.loss_chars = self.chars = self.n = self.turns = 0
        self.learnt = self.rest = ""

    def learn(self, part: str, done: bool):
        """A part of a reply; an escape may be cut by the end of its chunk."""
        part = self.learnt + part
        cut = len(part) - (not done and (len(part) - len(part.rstrip("\\"))) % 2)
        plain, self.learnt = unescape(part[:cut]), part[cut:]
        self.loss.update(plain.encode())
        self.loss_chars += len(plain)

    def show(self, text: str):
        """A part of the last example; what follows its last whole turn waits."""
        mark, searched = f"{END}\n", max(len(self.rest) - len(END), 0)
        self.rest += text
        end = self.rest.rfind(mark, searched) + len(mark)
        if end >= len(mark):
            for role, said in turns(self.rest[:end]):
                self.whole.update(f"{role}\n{said}\n".encode())
                self.turns += 1
            self.rest = self.rest[end:]

    def row(self):
        return self.key, self.turns, self.whole.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.n


def digests(formatted: DataFrame, ordered: bool = True) -> DataFrame:
    """Per conversation, what its examples hold, read back from their texts.

    Of every chunk only its length, its part of the reply and, in the last
    example, its text go on; these are put in order and streamed. `ordered` is
    kept for callers and makes no difference.
    """
    at = F.col("chunk") * CHUNK
    first, stop = F.greatest(F.col("loss_start") - at, F.lit(0)), F.least(F.col("loss_end") - at, F.length("text").cast("long"))
    source = formatted.select(
        "conv_id", "example", "chunk", F.length("text").cast("long").alias("chars"),
        F.when(F.col("loss_start").isNotNull() & (stop > first), F.substring("text", (first + 1).cast("int"), (stop - first).cast("int"))).alias("learnt"),
        (F.col("loss_end") <= at + F.length("text")).alias("done"), F.when(F.col("last"), F.col("text")).alias("shown"),
    )
    kind = source.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]

    def read(batches):
        state, id_type = None, pa.int64()
        for batch in batches:
            id_type, closed = batch.schema.field(0).type, []
            for key, chunk, chars, learnt, done, shown in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6))):
                if state is None or state.key != key:
                    if state:
                        closed.append(state.row())
                    state = _Conversation(key)
                if learnt is not None:
                    state.learn(learnt, done)
                state.chars += chars
                state.n += chunk == 0
                if shown is not None:
                    state.show(shown)
            if closed:
                yield table(closed, id_type)
        if state:
            yield table([state.row()], id_type)

    def table(done, id_type):
        kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

    return arranged(source, "conv_id", "example", "chunk").mapInArrow(
        read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long",
    )
