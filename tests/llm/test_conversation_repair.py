"""Conversation repair beside a recursion over (cost, audit) pairs."""

from __future__ import annotations

import functools
import hashlib
import os
import random
import re
import zlib

import pytest

from veilframe.llm import conversation_repair

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
MEASURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(rows):
    for conv_id, turn, role, text in rows:
        spoken = [" " if x is None else str(x) for x in (conv_id, turn)]
        fault = zlib.crc32(":".join(spoken).encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        for _ in range(2 if fault == 3 else 1):
            yield conv_id, turn, role, text


def plain_report(rows):
    """One conversation's report, from its rows after damage."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, _, role, text in rows:
        said = text.strip(" \t\n\v\f\r")
        blank, duplicate = not said, (role, text) in seen
        faults.append("blank" if blank else "duplicate" if duplicate else "" if said[-1] in ".!?" else "truncated")
        seen.add((role, text))
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]

    @functools.cache
    def best(i, said):
        """(cost, audit, repaired) of the rest after what was said: '', 's', 'u' or 'a'."""
        found = [(0, "", ())] if i == len(rows) and said in ("", "a") else []
        following = {"": "u", "s": "u", "u": "a", "a": "u"}[said]
        name = {"u": "user", "a": "assistant"}[following]
        options = []
        if i < len(rows):
            role, text, fault = rows[i][2], rows[i][3], faults[i]
            options.append((2, "D", i + 1, said, None))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if role[:1] == following or (role[:1] == "s" and said == ""):
                    options.append((more, "K", i + 1, role[:1], (role, text)))
                options.append((1 + more, "R", i + 1, following, (name, text)))
        for cost, edit, j, state, kept in options:
            after = best(j, state)
            found.append((cost + after[0], edit + after[1], ((kept,) if kept else ()) + after[2]))
        # Two insertions bring back the state, so at most one is worth trying at a place, or two
        # behind a system turn at the end.
        for n in (1, 2):
            state, kept = said, ()
            for _ in range(n):
                state = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
                kept += (({"u": "user", "a": "assistant"}[state], ""),)
            for cost, edit, j, then, own in (
                (2, "D", i + 1, state, None),
                *_said(rows, faults, i, state),
            ) if i < len(rows) else ():
                after = best(j, then)
                found.append((5 * n + cost + after[0], "I" * n + edit + after[1], kept + ((own,) if own else ()) + after[2]))
            if i == len(rows) and state == "a":
                found.append((5 * n, "I" * n, kept))
        return min(found) if found else (10**9, "", ())

    cost, audit, repaired = best(0, "")
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
    illegal = sum(p not in ("su", "ua", "au") for p in pairs)
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, digest)


def _said(rows, faults, i, said):
    role, text, fault = rows[i][2], rows[i][3], faults[i]
    if fault in ("blank", "duplicate"):
        return
    more, following = 5 if fault == "truncated" else 0, {"": "u", "s": "u", "u": "a", "a": "u"}[said]
    if role[:1] == following or (role[:1] == "s" and said == ""):
        yield more, "K", i + 1, role[:1], (role, text)
    yield 1 + more, "R", i + 1, following, ({"u": "user", "a": "assistant"}[following], text)


def plain(rows, damage=True):
    found = {r[0]: [] for r in rows}
    kept = damaged(rows) if damage else ((c, t, *(" " if x is None else x for x in rest)) for c, t, *rest in rows)
    for row in kept:
        found[row[0]].append(row)
    return {conv_id: plain_report(of_it) for conv_id, of_it in found.items()}


def reported(df):
    rows = df.collect()
    found = {r.conv_id: tuple(r[m] for m in MEASURES) for r in rows}
    assert len(found) == len(rows)
    return found


def random_rows(seed, conversations=120):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "uploader"]
    texts = ["Yes.", "No!", "And why?", "cut off", "", " \n", None, "Ends. \t", "Was? ja"]
    rows = []
    for conv_id in range(conversations):
        for turn in range(rng.randrange(9)):
            number = rng.choice([turn, turn, turn, turn + 1, None, -turn])
            rows.append((conv_id, number, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"{turn}."))
    rows += [(None, 1, "user", "Hello."), (None, None, None, None), (None, 1, "user", "Hello.")]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_repairs_are_the_cheapest_and_least(spark, seed):
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS edit", "1 AS audit", "2 AS n")
    assert reported(conversation_repair.report(conversation_repair.damage(df))) == plain(rows)
    assert reported(conversation_repair.report(df)) == plain(rows, damage=False)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_whole_table(spark):
    df = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    found = reported(conversation_repair.report(conversation_repair.damage(df)))
    assert found == plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_conversation_longer_than_a_batch(spark):
    """One conversation has nearly all rows and goes on over many batches."""
    size = 30_000
    df = spark.range(size).selectExpr(
        "7 AS conv_id", "id AS turn", "IF(id % 3 = 0, 'user', 'assistant') AS role", "concat('Text ', id, '.') AS text"
    )
    df = df.unionAll(spark.createDataFrame([(3, 0, "user", "Alone.")], SCHEMA))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    try:
        found = {r.conv_id: r for r in conversation_repair.report(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[3].audit == "D" and found[3].cost == 2
    long = found[7]
    # Of user, assistant, assistant twice over, three turns take the other role.
    assert long.cost == size // 2 and long.illegal == size // 3 and long.duplicate == 0
    roles = repaired_roles(long.audit, ["user", "assistant", "assistant"] * (size // 3))
    assert re.fullmatch("s?(ua)+", roles)


def repaired_roles(audit, roles):
    out, at = "", 0
    for edit in audit:
        following = "a" if out.endswith("u") else "u"
        if edit != "I":
            at += 1
        if edit != "D":
            out += roles[at - 1][0] if edit == "K" else following
    assert at == len(roles)
    return out


def test_repaired_turns(spark):
    rows = [
        (1, None, "system", "Be brief."),
        (1, 1, "user", "Hi."),
        (1, 2, "user", "Are you there?"),
        (1, 3, "assistant", ""),
        (1, 4, "assistant", "Yes."),
    ]
    turns = conversation_repair.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("place").collect()
    assert [(r.edit, r.role, r.text) for r in turns] == [
        ("K", "system", "Be brief."),
        ("K", "user", "Are you there?"),
        ("K", "assistant", "Yes."),
    ]


def test_no_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversation_repair.report(conversation_repair.damage(empty)).collect() == []
    assert conversation_repair.repair(empty).collect() == []


def test_conversation_that_loses_all_turns(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hello.")], SCHEMA)
    nothing = hashlib.sha256(b"").hexdigest()
    assert reported(conversation_repair.report(conversation_repair.damage(df))) == {
        gone: (0, 0, 0, 0, 0, 0, "", nothing)
    }
