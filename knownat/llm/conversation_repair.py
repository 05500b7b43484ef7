"""Repair of conversation structure by scalar big-integer weights.

A path of edits through a conversation weighs one integer: its high digits are the cost, the ``width`` octal digits below spell its audit
letters from the left, and unused digits at the end are zero, so of equal costs the least integer is the audit that is least in ASCII.  Nodes
are (row, state of the role grammar); a suffix's weight is the integer minimum over its first edits, each of which puts its letter before the
suffix's digits.  The grammar has one role for every state but the first, so the audit alone tells the repaired roles.

Conversations of any length: rows come sorted and one at a time, and leave a byte each.  Integers stay short because a long conversation is
cut into stretches of ``STRETCH`` rows.  The audits of a stretch end with the letter of a row and hold as many such letters, hence none is the
beginning of another, and the best path to a state needs only the rank of its audit among those of the other states, one digit above.

Two passes: the first one over rows without texts decides, the second one carries each audit before its rows and hashes what is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Audit letters by their octal digit, in ASCII order; 0 ends an audit.
LETTERS = "\0DIKR"
_D, _I, _K, _R = 1, 2, 3, 4
STRETCH = 256
START, SYSTEM, USER, ASSISTANT = range(4)
#: State a kept role leads to, by state and role initial; what is not here cannot be kept.
STEP = {
    (START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER,
}
#: The only role that can be inserted or given in a state, and the state it leads to.
TURN = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
FINAL = (START, ASSISTANT)
LEGAL = frozenset({"su", "ua", "au"})
BLANK, DUPLICATE, CUT = 1, 2, 3
_SPACES = " \t\n\u000b\f\r"
#: Role initials by their code; 0 stands for every other one.
INITIALS = ("", "s", "u", "a")
ROLES = {c: k for k, c in enumerate(INITIALS)}


class Weights:
    """Weights of the suffixes of a stretch of rows: cost above, audit letters below."""

    def __init__(self, rows: int):
        # a suffix costs at most DELETE a row and two inserts, so it holds at most so many inserts
        self.width = rows + (DELETE * rows + 2 * INSERT) // INSERT + 1
        self.bits = 3 * self.width
        self.low = (1 << self.bits) - 1

    def before(self, letter: int, cost: int, suffix: int) -> int:
        """The weight of a suffix after one more edit in front of it."""
        return (((suffix >> self.bits) + cost) << self.bits) | (letter << self.bits - 3) | ((suffix & self.low) >> 3)

    def audit(self, weight: int) -> str:
        digits = f"{weight & self.low:0{self.width}o}"
        return digits.rstrip("0").translate({48 + k: c for k, c in enumerate(LETTERS)})


def _least(*weights: int | None) -> int | None:
    return min((w for w in weights if w is not None), default=None)


def suffixes(codes: list[tuple[str, int]], end: dict[int, int], closing: bool, weigh: Weights) -> list[int | None]:
    """Least weight from every state over rows (role initial, fault) to the states in ``end``; only a closing stretch may insert after its last row."""

    def with_inserts(plain: list[int | None]) -> list[int | None]:
        def inserted(state: int, values: list[int | None]) -> int | None:
            value = values[TURN[state][1]]
            return None if value is None else weigh.before(_I, INSERT, value)

        # two inserts in a row lead from the later states back to themselves and are never best there
        late = [_least(plain[s], inserted(s, plain)) if s in (USER, ASSISTANT) else plain[s] for s in range(4)]
        return [late[s] if s in (USER, ASSISTANT) else _least(plain[s], inserted(s, late)) for s in range(4)]

    value = [end.get(s) for s in range(4)]
    if closing:
        value = with_inserts(value)
    for initial, fault in reversed(codes):
        extra, plain = TRUNCATED if fault == CUT else 0, []
        for state in range(4):
            choices = [] if value[state] is None else [weigh.before(_D, DELETE, value[state])]
            if fault not in (BLANK, DUPLICATE):
                kept, given = STEP.get((state, initial)), value[TURN[state][1]]
                if kept is not None and value[kept] is not None:
                    choices.append(weigh.before(_K, KEEP + extra, value[kept]))
                if given is not None:
                    choices.append(weigh.before(_R, REROLE + extra, given))
            plain.append(_least(*choices))
        value = with_inserts(plain)
    return value


def decide(codes: list[tuple[str, int]], stretch: int = STRETCH) -> tuple[int, str]:
    """Least cost and ASCII-least audit of the edits that turn rows (role initial, fault: 0 none, 1 blank, 2 duplicate, 3 truncated) into ``(s?(ua)+)?``."""
    #: by state: cost, rank of the audit so far among those of all states, and that audit
    paths: dict[int, tuple[int, int, list[str]]] = {START: (0, 0, [])}
    cuts = [*range(0, max(1, len(codes)), stretch), len(codes)]
    for lo, hi in zip(cuts, cuts[1:]):
        part, closing = codes[lo:hi], hi == len(codes)
        weigh = Weights(len(part))
        reached: dict[int, tuple[int, int]] = {}
        for out in range(1) if closing else range(4):
            end = {s: 0 for s in FINAL} if closing else {out: 0}
            value = suffixes(part, end, closing, weigh)
            totals = [((cost << 2 | rank) << weigh.bits) + ((v >> weigh.bits) << weigh.bits + 2) + (v & weigh.low) for s, (cost, rank, _) in paths.items() if (v := value[s]) is not None]
            if totals:
                reached[out] = min(totals)
        by_rank = {rank: audits for _, rank, audits in paths.values()}
        spelled = {s: t & ((1 << weigh.bits + 2) - 1) for s, t in reached.items()}
        ranks = {v: k for k, v in enumerate(sorted(set(spelled.values())))}
        paths = {s: (t >> weigh.bits + 2, ranks[spelled[s]], [*by_rank[spelled[s] >> weigh.bits], weigh.audit(t)]) for s, t in reached.items()}
    ((cost, _, audits),) = paths.values()
    return cost, "".join(audits)


def _places(rows: DataFrame) -> DataFrame:
    """Rows with the columns that order them: turns, null first, then role and text hash, so equal rows are next to each other."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    dropped = F.coalesce(F.col("dropped"), F.lit(False)) if "dropped" in rows.columns else F.lit(False)
    return rows.select("conv_id", dropped.alias("dropped"), "turn", role.alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))


_ORDER = ("conv_id", "turn", "role", "digest")
_DECIDED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def decisions(rows: DataFrame) -> DataFrame:
    """One row a conversation: gaps in its turns, its faults by kind, illegal neighbours, and the least cost and audit that repair it."""
    stripped = F.rtrim("text", F.lit(_SPACES))
    # equal texts of a role meet by their hash, whatever the size of their conversation
    seen = F.row_number().over(Window.partitionBy("conv_id", "dropped", "role", "digest").orderBy("turn")) > 1
    short = _places(rows).withColumn("blank", stripped == "").withColumn("open", ~F.substring(stripped, -1, 1).isin(".", "!", "?")).drop("text")
    fault = F.when(F.col("blank"), BLANK).when(F.col("late"), DUPLICATE).when(F.col("open"), CUT).otherwise(0)
    marked = short.withColumn("late", seen).select("conv_id", "dropped", "turn", "role", "digest", fault.alias("fault"))
    placed = marked.repartition("conv_id").sortWithinPartitions(*_ORDER, F.col("fault") == DUPLICATE)
    return placed.select("conv_id", "dropped", "turn", F.substring("role", 1, 1).alias("initial"), "fault").mapInArrow(_decide_all, _DECIDED)


class _Open:
    """What is kept of the conversation being read: a byte a row, and counts."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.codes, self.faults, self.illegal = conv_id, bytearray(), [0, 0, 0, 0], 0
        self.turns, self.first, self.last, self.initial = 0, 0, None, None

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.illegal += self.initial is not None and self.initial + initial not in LEGAL
        self.initial = initial
        self.faults[fault] += 1
        self.codes.append(ROLES.get(initial, 0) << 2 | fault)
        if turn is not None and turn != self.last:
            self.first = self.first if self.turns else turn
            self.last, self.turns = turn, self.turns + 1

    def closed(self) -> tuple:
        cost, audit = decide([(INITIALS[b >> 2], b & 3) for b in self.codes])
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.faults[1:], self.illegal, cost, audit)


def _decide_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows without texts to one decision a conversation."""
    now: _Open | None = None
    for batch in batches:
        done = []
        for conv, dropped, turn, initial, fault in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now.conv_id != conv:
                done += [now.closed()] if now else []
                now = _Open(conv)
            if not dropped:
                now.add(turn, initial, fault)
        yield from _batches(done)
    yield from _batches([now.closed()] if now else [])


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        kinds = [pa.int64()] * 7 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in _DECIDED.split(", ")])


_WALKED = "conv_id long, place long, role string, text string, decision struct<" + ", ".join(c.replace(" ", ": ", 1) for c in _DECIDED.split(", ")[1:]) + ">"


def repair(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` to the repaired rows: conv_id, place, role, text, decision.

    Every conversation has one row of place 0, without role and text, whose ``decision`` holds gaps, faults, cost and audit; its repaired rows
    follow from place 1 on, in order and in one partition.  A true ``dropped`` column marks rows that only name their conversation; other
    columns are ignored.  Rows stand by turn, null turns first, equal turns by role and text hash; null roles and texts count as one space;
    null conv_ids are one conversation; repeated rows are duplicates of each other; roles that do not begin with s, u or a cannot be kept.
    Gaps look at turns that are not null.  Texts and conversations may have any length; an empty table gives an empty result.
    """
    parts = _places(rows)
    said = parts.where(~F.col("dropped")).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "digest")
    names = [c.split()[0] for c in _DECIDED.split(", ")[1:]]
    first = decisions(rows).select("conv_id", F.lit(0).alias("kind"), F.struct(*names).alias("decision"))
    both = said.unionByName(first, allowMissingColumns=True)
    placed = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_ORDER[1:])
    return placed.select("conv_id", "kind", "role", "text", "decision").mapInArrow(_walk, _WALKED)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follows each audit, which comes before its rows."""
    audit, spot, state, place = "", 0, START, 0
    for batch in batches:
        out: list[tuple] = []
        decided = batch.column("decision")

        def given(conv: int | None, text: str) -> None:
            nonlocal state, place
            role, state = TURN[state]
            place += 1
            out.append((conv, place, role, text, None))

        def inserts(conv: int | None) -> None:
            nonlocal spot
            while spot < len(audit) and audit[spot] == "I":
                spot += 1
                given(conv, "")

        for k, (conv, kind, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text")))):
            if kind == 0:
                decision = decided[k].as_py()
                audit, spot, state, place = decision["audit"], 0, START, 0
                out.append((conv, 0, None, None, decision))
            else:
                letter = audit[spot]
                spot += 1
                if letter == "R":
                    given(conv, text)
                elif letter == "K":
                    state = STEP[state, role[:1]]
                    place += 1
                    out.append((conv, place, role, text, None))
            inserts(conv)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), decided.type)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds], ["conv_id", "place", "role", "text", "decision"])


def digests(repaired: DataFrame) -> DataFrame:
    """One row a conversation of :func:`repair`: its decision and the SHA-256 of its repaired ``role:text`` rows, joined by newlines."""
    kind = _DECIDED + ", repaired_sha256 string"
    return repaired.mapInArrow(_hash_all, kind)


def _hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _DECIDED.split(", ")]
    head, digest = None, None
    kinds = [pa.int64()] * 7 + [pa.string(), pa.string()]

    def batch_of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [*names, "repaired_sha256"])

    for batch in batches:
        done, decided = [], batch.column("decision")
        for k, (conv, place, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")))):
            if place == 0:
                done += [(*head, digest.hexdigest())] if head else []
                head, digest = (conv, *(decided[k].as_py()[n] for n in names[1:])), hashlib.sha256()
            else:
                digest.update(f"{chr(10) if place > 1 else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        yield from batch_of(done)
    yield from batch_of([(*head, digest.hexdigest())] if head else [])
