"""Chat formatting by prefix-target expansion, kept linear in the input.

Every assistant turn is an example: the turns before it are context and only its reply is
trainable. Written out, the examples of a long conversation would repeat its
beginning over and over; here each turn is rendered once, with its place in the
conversation's formatted text, and an example is that text's prefix up to its
reply together with the span of the reply. ``expanded`` writes examples out in full.

Turns are marked by control strings. Inside texts and roles a backslash precedes
``\\ [ ] < > |``, so no text can hold a control string and reading back is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: What stands before and after the escaped text of a role's turn.
MARKS = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n")}
_OTHER = re.compile(r"<\|((?:\\.|[^\\\[\]<>|])*)\|>(.*)<\|end\|>", re.S)
_SPECIAL = re.compile(r"[\\\[\]<>|]")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's rendered form and the span of its escaped text."""
    before, after = MARKS.get(role) or (f"<|{escape(role)}|>", "<|end|>")
    body = escape(text)
    return before + body + after, len(before), len(before) + len(body)


def parse(rendered: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    for role in ("user", "system", "assistant"):
        before, after = MARKS[role]
        if rendered.startswith(before) and rendered.endswith(after) and len(rendered) >= len(before) + len(after):
            return role, unescape(rendered[len(before) : len(rendered) - len(after)])
    m = _OTHER.fullmatch(rendered)
    if not m:
        raise ValueError("not a rendered turn")
    return unescape(m[1]), unescape(m[2])


_FORMATTED = "seq long, rendered string, start long, stop long, example long, target_start long, target_stop long"


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: conv_id, seq (from 0), rendered, start and stop in the conversation's text and, for
    assistant turns, example (from 0) and the span target_start to target_stop of its trainable characters.

    Turns are ordered by turn, then role, then text; null turns come first, null roles and texts count as
    empty, and rows with a null conversation id form one conversation. Repeated rows are turns
    of their own. A conversation passes through one task in order, as a stream: memory holds one batch.
    """
    kind = dict(turns.select(conv_col).dtypes)[conv_col]
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, seq, at, example = object(), 0, 0, 0
        for b in batches:
            out = []
            for c, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if c != conv:
                    conv, seq, at, example = c, 0, 0, 0
                done, lo, hi = render(role, text)
                target = role == "assistant"
                out.append((seq, done, at, at + len(done), example if target else None, at + lo if target else None, at + hi if target else None))
                seq, at, example = seq + 1, at + len(done), example + target
            cols = list(zip(*out)) or [()] * 7
            kinds = [pa.int64(), pa.string()] + [pa.int64()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(v, k) for v, k in zip(cols, kinds))], names=["conv_id", *(x.split()[0] for x in _FORMATTED.split(", "))]
            )

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(tidy(run), f"conv_id {kind}, {_FORMATTED}")


def examples(formatted: DataFrame) -> DataFrame:
    """(conv_id, example, context_stop, target_start, target_stop): an example is its conversation's text up to target_stop."""
    return formatted.where("example is not null").select("conv_id", "example", F.col("start").alias("context_stop"), "target_start", "target_stop")


def expanded(formatted: DataFrame) -> DataFrame:
    """Examples written out: (conv_id, example, text, loss_start, loss_stop); their size grows with the square of a conversation's turns."""
    target = formatted.where("example is not null").select("conv_id", F.col("seq").alias("last"), "example", "target_start", "target_stop")
    met = target.withColumnRenamed("conv_id", "c").join(formatted.select("conv_id", "seq", "rendered"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seq") <= F.col("last")))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "rendered"))), lambda x: x["rendered"]), "")
    return met.groupBy("conv_id", "example", F.col("target_start").alias("loss_start"), F.col("target_stop").alias("loss_stop")).agg(whole.alias("text"))


def read_back(formatted: DataFrame, told: DataFrame) -> DataFrame:
    """Per conversation: turns parsed from the rendered text, and digests of turns and of the text under the loss spans of ``told`` (``examples``).

    A conversation's text is streamed in order with each example behind the turn that holds its target, so that its context is
    all that has passed; one whose context doesn't end where its target's turn begins, or that has none, fails.
    """
    kind = dict(formatted.dtypes)["conv_id"]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, start, turn = object(), None, 0, ""
        done: list[tuple] = []

        def close() -> None:
            if state:
                n, all_turns, chars, loss, size, _ = state
                done.append((conv, n, all_turns.hexdigest(), chars, loss.hexdigest(), size))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done)) or [()] * 6
            kinds = [first, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            got = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols, kinds)], names=names)
            done.clear()
            return got

        for b in batches:
            first = b.column(0).type
            for c, at, example, rendered, stop, context in zip(*(b.column(i).to_pylist() for i in range(6))):
                if c != conv or state is None:
                    close()
                    conv, state, start, turn = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0], 0, ""
                if example is None:
                    role, text = parse(rendered)
                    start, turn = at, rendered
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    state[4] += len(rendered)
                else:
                    if context != start or not start <= at <= stop <= start + len(turn) or example != state[5] or parse(turn)[0] != "assistant":
                        raise ValueError("an example doesn't fit its conversation")
                    masked = unescape(turn[at - start : stop - start])
                    state[2] += len(masked)
                    state[3].update(masked.encode("utf-8", "surrogatepass"))
                    state[5] += 1
            yield flush()
        if state:
            close()
            yield flush()

    none = lambda t: F.lit(None).cast(t)
    text = formatted.select("conv_id", F.col("start").alias("at"), none("long").alias("example"), "rendered", "stop", none("long").alias("context"))
    spans = told.select("conv_id", F.col("target_start").alias("at"), "example", none("string").alias("rendered"), F.col("target_stop").alias("stop"), F.col("context_stop").alias("context"))
    rows = text.unionByName(spans).repartition("conv_id").sortWithinPartitions("conv_id", "at", F.asc_nulls_first("example"))
    return rows.mapInArrow(tidy(run), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
