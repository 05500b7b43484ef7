"""Chat formatting with a black-box template, by incremental rendering.

A template is any function from a list of turns (role, text) to a string.  The prefixes of a conversation are rendered one turn longer each
time; where the longer output begins with the shorter one, the rest is the new turn's span, else the template rewrites history and the
conversation is marked.  Inside a span a probe text of one private-use character shows where the turn's own text begins and ends.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
#: One stands for a turn's text in a probe: the first private-use character that no turn holds.
PROBES = [chr(0xE000 + k) for k in range(0x1000)]
_TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n((?:[^\\<]|\\.|<(?!\|))*)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    """Breaks up control strings, reversibly."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def marked_turns(turns: Turns) -> str:
    """The shipped template."""
    return "".join(f"<|im_start|>{escape(r).replace(chr(10), chr(92) + 'n')}\n{escape(t)}<|im_end|>\n" for r, t in turns)


def read_back(formatted: str) -> Turns:
    """Turns of an output of ``marked_turns``."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def spans(turns: Turns, template: Callable[[Turns], str] = marked_turns) -> tuple[str, list[tuple[int, int]], int | None]:
    """The output, the place of each turn's text in it, and the first turn at which the template rewrote what it had said (then no places)."""
    said, found, held = template([]), [], set().union(*(r + t for r, t in turns))
    mark = next((p for p in PROBES if p not in held), chr(0x10FFFD))
    for k, (role, text) in enumerate(turns):
        longer = template(turns[: k + 1])
        if not longer.startswith(said):
            return template(turns), [], k
        probe = template([*turns[:k], (role, mark)])
        if not probe.startswith(said) or probe.count(mark, len(said)) != 1:
            return template(turns), [], k
        begin = probe.index(mark, len(said))
        after = len(probe) - begin - 1
        if longer[:begin] != probe[:begin] or longer[len(longer) - after :] != probe[begin + 1 :]:
            return template(turns), [], k
        found.append((begin, len(longer) - after))
        said = longer
    return said, found, None


def _format(template, learned: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for row in range(batch.num_rows):
                turns = [(t["role"] or "", t["text"] or "") for t in batch.column("turns")[row].as_py()]
                formatted, places, broken = spans(turns, template)
                mask = [{"start": a, "end": b} for (r, _), (a, b) in zip(turns, places) if r == learned]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("conv_id").slice(row, 1), pa.array([formatted]), pa.array([mask], kind), pa.array([broken], pa.int64())],
                    ["conv_id", "formatted", "loss_spans", "rewritten_at"],
                )

    return work


def chat_formatted(conversations: DataFrame, template: Callable[[Turns], str] = marked_turns, learned: str = "assistant") -> DataFrame:
    """``(conv_id, turn, role, text)`` to one row per conversation: conv_id, formatted, loss_spans (places of ``learned`` texts), rewritten_at.

    Turns go by turn number, null first; equal numbers by role and text.  Null roles and texts count as empty; repeated rows are turns of
    their own; rows without conv_id are one conversation; other columns are ignored; an empty table gives an empty result.
    """
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    whole = conversations.select("conv_id", F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = whole.groupBy("conv_id").agg(turns.alias("turns"))
    kind = "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>, rewritten_at long"
    return whole.mapInArrow(_format(template, learned), kind)
