"""Chat formatting: a hidden Markov model recovers the roles of a transcript's lines, then turns are rendered.

States are (role, first line of a turn | later line). A line is seen through its speaker marker (the row's role column or a marker such as
"User:" in the text) and its features (length, question mark, list or code look). Start, transition and emission probabilities are counted
on the rows whose role is known (all of them, add-one smoothing): a few hundred sums.

Viterbi is a product of max-plus matrices and so may be cut anywhere: every partition of the table sorted by (conversation, turn) reduces
its piece of each conversation to one matrix, the pieces of conversations that cross partitions are chained by their boundary matrices (at
most two for each partition), and the partitions then decode their pieces from the boundary states. A conversation of any length is never
in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import NO_ID, partitions, ship, source_columns, written

ROLES = ("system", "user", "assistant")
# Names by which transcripts call the three speakers.
SPEAKERS = {
    "system": "system developer instruction instructions context",
    "user": "user human prompter customer client question q me person",
    "assistant": "assistant ai bot gpt model agent chatbot answer a response",
}
_ROLE_OF = {name: role for role, names in SPEAKERS.items() for name in names.split()}
_MARK = re.compile(r"^\s*(?:<\|(?:im_start\|>)?|\[|#{1,4}\s*|\*\*)?\s*([A-Za-z]{1,12})\s*(?:\|>|\]|\*\*)?\s*(?::\s*(?:\*\*)?|>|(?<=[\]>])|$)\s*")
_END = re.compile(r"\s*<\|(?:im_end|endoftext|eot_id)\|>\s*$")
N_STATES = 2 * len(ROLES)
N_MARKS, N_LOOKS = 1 + len(ROLES), 24
LOST = -1e18


def marked(line: str) -> tuple[int, str]:
    """(0 or 1 + role, the line without its marker). A bare name counts only with punctuation that marks a speaker."""
    m = _MARK.match(line)
    if m:
        role = _ROLE_OF.get(m[1].lower())
        if role and re.search(r"[:\]>|#*]", m[0]):
            return 1 + ROLES.index(role), line[m.end() :]
    return 0, line


def look(line: str, number: int) -> int:
    """One of N_LOOKS: four lengths, whether it asks, whether it looks like a list or code, first line of the row or not."""
    n = len(line)
    length = 0 if n < 40 else 1 if n < 160 else 2 if n < 640 else 3
    form = 2 if re.match(r"\s*(?:[-*+]\s|\d+[.)]\s|```|    )", line) else 1 if line.rstrip().endswith("?") else 0
    return (length * 3 + form) * 2 + (number > 0)


def column_mark(role: str | None) -> int:
    name = _ROLE_OF.get((role or "").strip().lower())
    return 1 + ROLES.index(name) if name else 0


@dataclass(frozen=True)
class Model:
    """Log probabilities: start (S), step (2, S, S) inside a row and to a new row, marks (S, N_MARKS), looks (S, N_LOOKS)."""

    start: np.ndarray
    step: np.ndarray
    marks: np.ndarray
    looks: np.ndarray

    def emit(self, mark: int, seen: int) -> np.ndarray:
        return self.marks[:, mark] + self.looks[:, seen]


def row_lines(role: str | None, text: str | None) -> list[tuple[int, int, str]]:
    """(mark, look, line) of each line. The role column marks the row's first line unless the text has its own marker there."""
    out = []
    for k, line in enumerate((text or "").split("\n")):
        mark, bare = marked(line)
        if k == 0 and not mark:
            mark = column_mark(role)
        out.append((mark, look(bare, k), _END.sub("", bare)))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Looks of rows with a known role: (kind, i, j, n)."""
    sums = np.zeros((N_STATES, N_LOOKS), np.int64)
    inside = np.zeros((len(ROLES), 2), np.int64)
    for batch in batches:
        for role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            r = column_mark(role) - 1
            if r < 0:
                continue
            found = row_lines(None, text)
            for k, (_, seen, _) in enumerate(found):
                sums[2 * r + (k > 0), seen] += 1
            inside[r, 0] += len(found) - 1
            inside[r, 1] += 1
    i, j = np.nonzero(sums)
    yield pa.record_batch([pa.array(np.concatenate([i, np.repeat(np.arange(3) + 100, 2)])), pa.array(np.concatenate([j, np.tile([0, 1], 3)])), pa.array(np.concatenate([sums[i, j], inside.ravel()]))], ["i", "j", "n"])


def fit(turns: DataFrame, right: float = 0.98) -> Model:
    """Counts on every row whose role is known. right: how far a marker, where there is one, is trusted; that isn't learnt, as rows carry no second opinion."""
    from pyspark.sql import Window

    looks = np.ones((N_STATES, N_LOOKS))
    more = np.ones((len(ROLES), 2))
    rows = turns.select("role", "text").mapInArrow(_count, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # at most N_STATES * N_LOOKS + 6 rows
    for i, j, n in rows:
        if i >= 100:
            more[i - 100, j] += n
        else:
            looks[i, j] += n
    known = F.lower(F.trim("role"))
    role = F.coalesce(*[F.when(known.isin(names.split()), F.lit(r)) for r, names in enumerate(SPEAKERS.values())])
    # pairs of neighbours by an equi-join on turn + 1: no window over a conversation of any length
    t = turns.select("cid", "turn", role.alias("r")).where("turn is not null and r is not null").distinct()
    pairs = t.join(t.select("cid", (F.col("turn") - 1).alias("turn"), F.col("r").alias("next")), ["cid", "turn"]).groupBy("r", "next").count().collect()
    first = t.where("turn = 0").groupBy("r").count().collect()
    start, follow = np.ones(len(ROLES)), np.ones((len(ROLES), len(ROLES)))
    for r, n in first:
        start[r] += n
    for a, b, n in pairs:
        follow[a, b] += n
    start, follow = start / start.sum(), follow / follow.sum(axis=1, keepdims=True)
    stay = more[:, 0] / more.sum(axis=1)
    step = np.full((2, N_STATES, N_STATES), LOST)
    for a in range(N_STATES):
        for b in range(N_STATES):
            x, y, later = a // 2, b // 2, b % 2
            if later and x == y:
                step[0, a, b] = np.log(stay[x])
            if not later:
                step[0, a, b] = np.log((1 - stay[x]) * follow[x, y] * 0.05)  # a turn that starts inside a row
                step[1, a, b] = np.log(follow[x, y])
    marks = np.zeros((N_STATES, N_MARKS))
    wrong = (1 - right) / (len(ROLES) - 1)
    for s in range(N_STATES):
        for m in range(1, N_MARKS):
            marks[s, m] = np.log(right if s // 2 == m - 1 else wrong) + (np.log(0.02) if s % 2 else 0)
    begin = np.full(N_STATES, LOST)
    begin[::2] = np.log(start)
    return Model(begin, step, marks, np.log(looks / looks.sum(axis=1, keepdims=True)))


def row_matrix(model: Model, lines: list[tuple[int, int, str]], first: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """Best scores from the state before the row (or, for a conversation's first row, from its start: all rows equal) to that after it, and back pointers (line, from, to)."""
    best, back = None, []
    for k, (mark, seen, _) in enumerate(lines):
        emit = model.emit(mark, seen)
        if best is None:
            best = np.repeat((model.start + emit)[None, :], N_STATES, 0) if first else model.step[1] + emit[None, :]
            back.append(np.repeat(np.arange(N_STATES)[:, None], N_STATES, 1))
        else:
            all_ways = best[:, :, None] + model.step[0][None, :, :]
            back.append(all_ways.argmax(axis=1))
            best = all_ways.max(axis=1) + emit[None, :]
    return best, back


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = (a[:, :, None] + b[None, :, :]).max(axis=1)
    return both - both.max()


def _pieces(model):
    """Rows (part, cid, turn, role, text) sorted by part and order to the first and last conversation of each part: its piece's matrix, as
    the conversation's start and as a continuation."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, now, cid, start, more, n = model.value, None, None, None, None, 0

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([now], pa.int32()), pa.array([cid], pa.int64()), pa.array([start.tobytes()], pa.binary()), pa.array([more.tobytes()], pa.binary())], ["part", "cid", "start", "more"])

        for batch in batches:
            for part, c, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                lines = row_lines(role, text)
                one = row_matrix(m, lines, False)[0]
                if (part, c) == (now, cid):
                    start, more = chain(start, one), chain(more, one)
                    continue
                if now is not None and (n == 0 or part != now):
                    yield out()
                n = 0 if part != now else n + 1
                now, cid, start, more = part, c, row_matrix(m, lines, True)[0], one
        if now is not None:
            yield out()

    return pieces


def ends(pieces: list[tuple[int, int, bytes, bytes]]) -> dict[tuple[int, int], tuple[int, int]]:
    """(state before, state after) of the pieces of conversations that cross parts, by (part, cid); before is -1 for the first piece."""
    out: dict[tuple[int, int], tuple[int, int]] = {}
    by_cid: dict[int, list[tuple]] = {}
    for part, cid, start, more in sorted(pieces):
        by_cid.setdefault(cid, []).append((part, *(np.frombuffer(x, float).reshape(N_STATES, N_STATES) for x in (start, more))))
    for cid, row in by_cid.items():
        if len(row) < 2:
            continue
        score, trail = row[0][1][0], []
        for _, _, matrix in row[1:]:
            ways = score[:, None] + matrix
            trail.append(ways.argmax(axis=0))
            score = ways.max(axis=0)
        state = int(score.argmax())
        for (part, _, _), before in zip(row[:0:-1], trail[::-1], strict=True):
            out[part, cid] = (int(before[state]), state)
            state = int(before[state])
        out[row[0][0], cid] = (-1, state)
    return out


def _decode(model, known, block: int = 256):
    """Rows (part, cid, turn, role, text) sorted by part and order to turns. A piece is decoded block by block: matrices forward, states backward, so that what is held is one block of
    back pointers and one matrix for each block."""

    def path(m: Model, rows: list, before: int, after: int) -> list[list[int]]:
        """before -1: the first row starts the conversation."""
        mats, backs = zip(*(row_matrix(m, r[3], before < 0 and k == 0) for k, r in enumerate(rows)), strict=True)
        score, trail = mats[0][max(before, 0)], [None]
        for x in mats[1:]:
            ways = score[:, None] + x
            trail.append(ways.argmax(axis=0))
            score = ways.max(axis=0)
        state, out = after, []
        for k in range(len(rows) - 1, -1, -1):
            start = max(before, 0) if k == 0 else int(trail[k][state])
            states = [state]
            for back in backs[k][:0:-1]:
                states.append(int(back[start, states[-1]]))
            out.append(states[::-1])
            state = start
        return out[::-1]

    def finish(m: Model, rows: list, before: int, after: int | None) -> pa.RecordBatch:
        cuts = [rows[i : i + block] for i in range(0, len(rows), block)]
        score, trail = None, []
        for cut in cuts:
            whole = None
            for k, r in enumerate(cut):
                one = row_matrix(m, r[3], score is None and before < 0 and k == 0)[0]
                whole = one if whole is None else chain(whole, one)
            if score is None:
                score = whole[max(before, 0)]
                continue
            ways = score[:, None] + whole
            trail.append(ways.argmax(axis=0))
            score = ways.max(axis=0)
        limits = [int(score.argmax()) if after is None else after]
        for back in trail[::-1]:
            limits.append(int(back[limits[-1]]))
        limits, table = limits[::-1], []
        for k, cut in enumerate(cuts):
            for row, states in zip(cut, path(m, cut, before if k == 0 else limits[k - 1], limits[k]), strict=True):
                table.extend(turns_of(row, states))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string())
        cols = zip(zip(*table, strict=True), kinds, strict=True)
        return pa.record_batch([pa.array(c, t) for c, t in cols], ["cid", "turn", "part_no", "given", "role", "n_lines", "rendered"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, ways, at, held = model.value, known.value, None, []
        for batch in batches:
            for part, c, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held and at != (part, c):
                    yield finish(m, held, *ways.get(at, (-1, None)))
                    held = []
                at = part, c
                held.append((c, turn, role, row_lines(role, text)))
        if held:
            yield finish(m, held, *ways.get(at, (-1, None)))

    return decode


def turns_of(row: tuple, states: list[int]) -> list[tuple]:
    """A row's turns: a new one at each first-line state, rendered canonically."""
    cid, turn, given, lines = row
    out: list[list] = []
    for (_, _, line), s in zip(lines, states, strict=True):
        if not out or s % 2 == 0:
            out.append([s // 2, []])
        out[-1][1].append(line)
    return [(cid, turn, k, given, ROLES[r], len(body), render(ROLES[r], "\n".join(body))) for k, (r, body) in enumerate(out)]


def render(role: str, body: str) -> str:
    """The canonical turn. Marker strings inside the body are broken up, so that a body can't end its turn."""
    clean = body.strip().replace("<|im_", "<| im_")
    return f"<|im_start|>{role}\n{clean}<|im_end|>\n"


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, part_no, given (the role column), role (recovered), n_lines and rendered: a row for each turn found.

    Rows are ordered by (conv_id, turn, text); a row is at least one turn (null or empty text: one empty line), more where markers or the
    model start a turn inside it. A null conv_id is a conversation of its own, null turns come last, repeated rows stay as turns of their
    own, unknown or null roles are recovered from markers, features and neighbours. Empty table: empty result. Other columns aren't read.
    """
    spark = conversations.sparkSession
    ship(spark)
    rows = source_columns(conversations, "conv_id", "turn", "role", "text").select(F.coalesce("conv_id", F.lit(NO_ID)).alias("cid"), "turn", "role", "text")
    order = ["cid", F.col("turn").asc_nulls_last(), "text", "role"]
    ranged = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    # the part is a column of a written table, so every later pass sees the same parts, a lost executor or not
    ranged = written(ranged.select(F.spark_partition_id().alias("part"), "cid", "turn", "role", "text"), "chat")
    model = spark.sparkContext.broadcast(fit(rows))
    parts = ranged.repartition(partitions(spark), "part").sortWithinPartitions("part", *order)
    pieces = parts.mapInArrow(_pieces(model), "part int, cid long, start binary, more binary").collect()  # two for each part, 0.6 kB each
    known = spark.sparkContext.broadcast(ends([(p[0], p[1], bytes(p[2]), bytes(p[3])) for p in pieces]))
    out = parts.mapInArrow(_decode(model, known), "cid long, turn long, part_no int, given string, role string, n_lines int, rendered string")
    return out.select(F.when(F.col("cid") != NO_ID, F.col("cid")).alias("conv_id"), "turn", "part_no", "given", "role", "n_lines", "rendered")
