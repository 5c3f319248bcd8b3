"""Repair of a conversation's structure: an optional system turn, then user and assistant in turn.

Rows of a conversation are kept, given another role, deleted, or new ones inserted. A cost
programme over rows and four states (nothing yet, system, user or assistant said last) gives
every node the least cost of all that follows. Arcs that lie on a cheapest repair carry the
initial of their edit. Among cheapest repairs the one whose audit, the initials in order, comes
first in ASCII is taken: nodes are ranked by the first 1, 2, 4, ... initials of their least
audit, each rank made of two ranks half as long, with pointers that double in step. The ranks
pick each node's arc, the pointers find all nodes of the least path.

Turns pass a task in order, twice, and only facts about them (some bytes a row) are held, texts
never: first a conversation's facts give its audit, then its texts stream past the audit into
the repaired turns. An audit is one cell of the result, so a conversation's facts are not larger
than its result by more than a constant factor, whatever share of all rows it has.

Null turns come first; turns of equal number are ordered by role, then text. Conversations with a
null id are one conversation. Null roles and texts count as one space. Repeated rows are
duplicate turns. An empty table has no conversations. Extra columns are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.text import only

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

# Audit initials in ASCII order; an arc's label is its place here.
INITIALS = "DIKR"
D, I, K, R = range(4)  # noqa: E741
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
# The state that a said turn of the pattern leads to, from each state.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}

BLANK, DUPLICATE, CUT = 1, 2, 3
_FAR = np.int64(1) << 60
# Conversations are solved together from so many rows on.
_TOGETHER = 1 << 16


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) with faults dealt by a checksum of ``conv_id:turn``:
    dropped, emptied, without stops, said twice, or with the role of a user. Dropped turns stay
    as rows that are ``gone``, so that a conversation which loses all of them is still known."""
    rows = only(conversations, "conv_id", "turn", "role", "text")
    spoken = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fault = F.crc32(F.concat(spoken[0], F.lit(":"), spoken[1]).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", spoken[2].alias("role"), spoken[3].alias("text"), fault.alias("fault"))
    gone = (F.col("fault") == 0).alias("gone")
    text = F.when(F.col("fault").isin(0, 1), "").when(F.col("fault") == 2, F.translate("text", ".!?", ""))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role")
    twice = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    said = rows.select("conv_id", "turn", role, text.otherwise(F.col("text")).alias("text"), gone, twice.alias("copy"))
    return said.drop("copy")


def _faults(text: str) -> tuple[Column, Column]:
    """Whether a text is blank, and whether it stops without a final mark."""
    blank = ~F.col(text).rlike(r"[^\x20\x09-\x0D]")
    return blank, ~F.col(text).rlike(r"[.!?][\x20\x09-\x0D]*\z")


def solve(sizes: np.ndarray, initials: np.ndarray, faults: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Cost and audit of each conversation. ``sizes`` are their numbers of rows; initials (bytes)
    and faults of all rows follow one another.

    Node ``4 * (row + conversation) + state`` stands before a row; each conversation has four
    more behind its last row, and one node past all is where audits end.
    """
    n_conversations, n_rows = len(sizes), int(sizes.sum())
    ends = np.cumsum(sizes)
    # The place of a row among rows and ends of conversations.
    place = np.arange(n_rows) + np.repeat(np.arange(n_conversations), sizes)
    last = ends + np.arange(n_conversations)
    n_places = n_rows + n_conversations
    end = 4 * n_places

    said = np.full(n_places, -1, np.int64)
    for initial, state in ((b"s", SYSTEM), (b"u", USER), (b"a", ASSISTANT)):
        said[place[initials == initial[0]]] = state
    fault = np.zeros(n_places, np.int64)
    fault[place] = faults
    extra = np.where(fault == CUT, TRUNCATED, 0)
    lost = (fault == BLANK) | (fault == DUPLICATE)

    # What each edit before place p in state s costs by itself; impossible ones are far.
    own = np.full((n_places, 4, 4), _FAR, np.int64)
    own[place, :, D] = DELETE
    own[:, :, I] = INSERT
    for state in range(4):
        fits = (said == NEXT[state]) | ((said == SYSTEM) & (state == NOTHING))
        own[:, state, K] = np.where(fits & ~lost, KEEP + extra, _FAR)
        own[:, state, R] = np.where(lost, _FAR, REROLE + extra)
    behind = np.zeros(n_places, bool)
    behind[last] = True
    own[behind, :, K] = own[behind, :, R] = _FAR

    # Where each edit leads. Keeping a system turn is the one step outside the pattern.
    target = np.empty((n_places, 4, 4), np.int64)
    here = 4 * np.arange(n_places)
    for state in range(4):
        target[:, state, D] = here + 4 + state
        target[:, state, I] = here + NEXT[state]
        target[:, state, R] = here + 4 + NEXT[state]
        target[:, state, K] = here + 4 + np.where(said == SYSTEM, SYSTEM, NEXT[state])
    target[own == _FAR] = end

    cost = np.full((n_places, 4), _FAR, np.int64)
    cost[last, NOTHING] = cost[last, ASSISTANT] = 0
    _insertions(cost, last)
    # Backwards, one row of every conversation that still has one at a time.
    by_size = np.argsort(-sizes, kind="stable")
    still = np.searchsorted(-sizes[by_size], -np.arange(1, sizes.max(initial=0) + 1), "right")
    for step, alive in enumerate(still):
        at = last[by_size[:alive]] - step - 1
        edits = own[at][:, :, (D, K, R)]
        after = cost.ravel()[np.minimum(target[at][:, :, (D, K, R)], end - 1)]
        cost[at] = np.minimum(edits + after, _FAR).min(axis=2)
        _insertions(cost, at)

    following = np.append(cost.ravel(), 0)[target]
    optimal = (own < _FAR) & (own + following == cost[:, :, None])
    optimal[last, NOTHING] = optimal[last, ASSISTANT] = False
    starts = last - sizes
    audits = _least_audits(optimal.reshape(-1, 4), target.reshape(-1, 4), 4 * starts + NOTHING, end)
    return cost[starts, NOTHING], audits


def _insertions(cost: np.ndarray, at: np.ndarray) -> None:
    """Lets turns be inserted before these places."""
    rows = cost[at]
    user, assistant = rows[:, USER].copy(), rows[:, ASSISTANT].copy()
    rows[:, USER] = np.minimum(user, assistant + INSERT)
    rows[:, ASSISTANT] = np.minimum(assistant, user + INSERT)
    for state in (NOTHING, SYSTEM):
        rows[:, state] = np.minimum(rows[:, state], rows[:, USER] + INSERT)
    cost[at] = rows


def _least_audits(arcs: np.ndarray, target: np.ndarray, starts: np.ndarray, end: int) -> list[bytes]:
    """The least audit from each start, over optimal arcs only.

    From a node each edit leads to one node, so the first initials of a least audit fix the node
    behind them, and a rank of twice the length is the pair of a node's rank and of the rank of
    the node its pointer leads to.
    """
    label = np.append(np.where(arcs.any(axis=1), arcs.argmax(axis=1), -1), -1)
    ended = label < 0
    pointer = np.append(np.take_along_axis(target, np.maximum(label[:-1], 0)[:, None], 1)[:, 0], end)
    pointer[ended] = end
    rank = label + 1
    steps = [pointer]
    while (steps[-1] != end).any():
        jump = steps[-1]
        # Ranks of the halves, the second in the place of the first's ties.
        _, rank = np.unique(rank * (rank.max() + 1) + rank[jump], return_inverse=True)
        steps.append(jump[jump])

    # Ranks choose the arc: the least initial, then the least audit behind it.
    choice = np.where(arcs, np.arange(4) * (rank.max() + 1) + rank[np.minimum(target, end)], _FAR).argmin(axis=1)

    # How long each audit is: the largest steps first that do not pass the end.
    length, at = np.zeros(len(starts), np.int64), starts
    for power in range(len(steps) - 1, -1, -1):
        behind = steps[power][at]
        length += (behind != end).astype(np.int64) << power
        at = np.where(behind != end, behind, at)
    # The node of every step of every audit, by the bits of the step's number.
    step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    node = np.repeat(starts, length)
    for power, jump in enumerate(steps):
        node = np.where(step >> power & 1, jump[node], node)
    initials = np.frombuffer(INITIALS.encode(), np.uint8)[choice[node]].tobytes()
    edges = np.append(0, np.cumsum(length)).tolist()
    return [initials[a:b] for a, b in zip(edges, edges[1:])]


_MEASURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_LEGAL = (b"su", b"ua", b"au")


def _measure(sizes: np.ndarray, facts: dict[str, np.ndarray]) -> tuple[list[np.ndarray], list[bytes]]:
    """The measures of conversations whose facts follow one another, and their audits."""
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    said = np.empty(len(owner), [("owner", np.int64), ("a", np.int64), ("b", np.int64)])
    said["owner"], said["a"], said["b"] = owner, facts["said_a"], facts["said_b"]
    repeated = np.ones(len(owner), bool)
    repeated[np.unique(said, return_index=True)[1]] = False
    faults = facts["fault"].astype(np.int64)
    faults[repeated & (faults != BLANK)] = DUPLICATE

    known = facts["known"].astype(bool)
    turns, of_turn = facts["turn"][known], owner[known]
    first = np.append(True, (turns[1:] != turns[:-1]) | (of_turn[1:] != of_turn[:-1]))[: len(turns)]
    begins = np.append(True, of_turn[1:] != of_turn[:-1])[: len(turns)]
    ends = np.append(of_turn[1:] != of_turn[:-1], True)[: len(turns)]
    gaps = np.zeros(n, np.int64)
    gaps[of_turn[begins]] = turns[ends] - turns[begins] + 1
    gaps -= np.bincount(of_turn[first], minlength=n)

    initials = facts["initial"].astype(np.int64)
    pairs = initials[:-1] << 8 | initials[1:]
    wrong = ~np.isin(pairs, [a << 8 | b for a, b in _LEGAL]) & (owner[:-1] == owner[1:])
    counts = [np.bincount(owner[faults == f], minlength=n) for f in (BLANK, DUPLICATE, CUT)]
    illegal = np.bincount(owner[1:][wrong], minlength=n)
    cost, audits = solve(sizes, initials, faults)
    return [gaps, *counts, illegal, cost], audits


_FACTS = ("turn", "known", "initial", "fault", "said_a", "said_b")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[object, int, int]]:
    """(id, begin, end) of consecutive rows of one conversation."""
    ids = batch.column("conv_id").to_pylist()
    edges = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
    for a, b in zip(edges, edges[1:]):
        if a < b:
            yield ids[a], a, b


def _plan_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations follow one another, each in order; one may go on in the next batch."""
    ids, sizes, parts, kind = [], [], [], None

    def planned(n: int) -> pa.RecordBatch:
        """The first n conversations gathered, which are then forgotten."""
        rows = sum(sizes[:n])
        facts = {c: np.concatenate([p[c] for p in parts]) for c in _FACTS}
        measures, audits = _measure(np.array(sizes[:n], np.int64), {c: v[:rows] for c, v in facts.items()})
        columns = [pa.array(ids[:n], kind), *map(pa.array, measures), pa.array([a.decode() for a in audits])]
        del ids[:n], sizes[:n]
        parts[:] = [{c: v[rows:] for c, v in facts.items()}]
        return pa.record_batch(columns, ["conv_id", *_MEASURES, "audit"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        there = ~batch.column("gone").to_numpy(zero_copy_only=False)
        for conv_id, a, b in _runs(batch):
            if not ids or ids[-1] != conv_id:
                ids.append(conv_id)
                sizes.append(0)
            sizes[-1] += int(there[a:b].sum())
        parts.append({c: batch.column(c).to_numpy(zero_copy_only=False)[there] for c in _FACTS})
        if sum(sizes[:-1]) > _TOGETHER:
            yield planned(len(ids) - 1)
    if ids:
        yield planned(len(ids))


def _turns(conversations: DataFrame, gone: bool) -> tuple[DataFrame, list[str]]:
    """Turns with what orders them, as each pass needs it, and the columns of that order. Texts
    are compared by their first characters and then by digests."""
    gone_column = F.col("gone") if gone else F.lit(False)
    turns = conversations.select(
        F.col("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        gone_column.alias("gone"),
    )
    turns = turns.withColumns(
        {
            "head": F.substring("text", 1, 32),
            "said_a": F.xxhash64("role", "text"),
            "said_b": F.xxhash64("text", "role"),
        }
    )
    return turns, ["turn", "role", "head", "said_a", "said_b"]


def plan_repairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation.
    Texts stay behind in the scan: a turn is an order, an initial, a fault and two digests."""
    turns, order = _turns(conversations, "gone" in conversations.columns)
    blank, cut = _faults("text")
    initial = F.ascii(F.substring("role", 1, 1))
    facts = turns.select(
        "conv_id",
        F.coalesce("turn", F.lit(0)).alias("turn"),
        F.col("turn").isNotNull().cast("int").alias("known"),
        # Only three initials matter, and that another is none of them.
        F.when(initial.isin(*map(ord, "sua")), initial).otherwise(0).cast("int").alias("initial"),
        F.when(blank, BLANK).when(cut, CUT).otherwise(0).alias("fault"),
        *order[1:],
        "gone",
    )
    # Turns without a number come first, as do their nulls.
    facts = facts.repartition("conv_id").sortWithinPartitions("conv_id", "known", *order).drop("role", "head")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    measures = ", ".join(f"{m} bigint" for m in _MEASURES)
    return facts.mapInArrow(_plan_sorted, f"conv_id {kind}, {measures}, audit string")


def _repaired(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired turns, while the original ones pass."""
    state = NOTHING
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            yield edit, ROLE_OF[state], ""
            continue
        role, text = next(turns)
        if edit == "D":
            continue
        state = SYSTEM if edit == "K" and state == NOTHING and role[:1] == "s" else NEXT[state]
        yield edit, role if edit == "K" else ROLE_OF[state], text


def _with_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str]]]]:
    """Each conversation's plan and a stream of its turns, to be read before the next one."""

    def rows():
        for batch in batches:
            # In pieces, so that few cells are Python objects at a time.
            for start in range(0, batch.num_rows, 1024):
                yield from batch.slice(start, 1024).to_pylist()

    stream = rows()
    row = next(stream, None)

    def turns():
        nonlocal row
        row = next(stream, None)
        while row is not None and row["audit"] is None:
            yield row["role"], row["text"]
            row = next(stream, None)

    while row is not None:
        plan, rest = row, turns()
        yield plan, rest
        for _ in rest:
            pass


def _beside_plans(conversations: DataFrame) -> DataFrame:
    """Plans and turns by conversation, each plan followed by its turns in order."""
    plans = plan_repairs(conversations)
    turns, order = _turns(conversations, "gone" in conversations.columns)
    both = plans.unionByName(turns.where("NOT gone").drop("gone"), allowMissingColumns=True)
    both = both.withColumn("is_turn", F.col("audit").isNull())
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "is_turn", *order)


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text) of the repaired conversations' turns; places count
    from 0. Edits are the initials K, R and I of the audit."""

    def write(batches):
        for plan, turns in _with_turns(batches):
            rows: list[tuple] = []
            for place, said in enumerate(_repaired(plan["audit"], turns)):
                rows.append((plan["conv_id"], place, *said))
                if len(rows) == 1024:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    kind = conversations.schema["conv_id"].dataType
    arrow_kind = pa.int64() if kind.typeName() == "long" else None

    def _batch(rows):
        ids, *others = zip(*rows)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string())
        arrays = [pa.array(ids, arrow_kind), *(pa.array(c, k) for c, k in zip(others, kinds))]
        return pa.record_batch(arrays, ["conv_id", "place", "edit", "role", "text"])

    schema = f"conv_id {kind.simpleString()}, place bigint, edit string, role string, text string"
    return _beside_plans(conversations).mapInArrow(write, schema)


def report(conversations: DataFrame) -> DataFrame:
    """Every conversation's measures, its audit, and the digest of its repaired turns."""

    def digest(batches):
        ids, measures, audits, digests, kind = [], [], [], [], None

        def typed():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                yield batch

        def found():
            counts = zip(*measures) if measures else [()] * len(_MEASURES)
            arrays = [pa.array(ids, kind), *(pa.array(c, pa.int64()) for c in counts)]
            arrays += [pa.array(audits, pa.string()), pa.array(digests, pa.string())]
            batch = pa.record_batch(arrays, ["conv_id", *_MEASURES, "audit", "repaired_sha256"])
            for column in (ids, measures, audits, digests):
                column.clear()
            return batch

        for plan, turns in _with_turns(typed()):
            text = hashlib.sha256()
            for place, (_, role, said) in enumerate(_repaired(plan["audit"], turns)):
                text.update(("\n" if place else "").encode() + f"{role}:{said}".encode())
            ids.append(plan["conv_id"])
            measures.append([plan[m] for m in _MEASURES])
            audits.append(plan["audit"])
            digests.append(text.hexdigest())
            if len(ids) == 4096:
                yield found()
        if ids:
            yield found()

    kind = conversations.schema["conv_id"].dataType.simpleString()
    measures = ", ".join(f"{m} bigint" for m in _MEASURES)
    schema = f"conv_id {kind}, {measures}, audit string, repaired_sha256 string"
    return _beside_plans(conversations).mapInArrow(digest, schema)
