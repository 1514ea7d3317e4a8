"""Chat formatting by minimum-cost role repair.

A conversation is legal if it has at most one system turn, first of all, then user and assistant turns that alternate,
user first, and ends with the assistant. Dynamic programming over the states of that automaton finds the cheapest
edits: keep a turn, relabel it, merge it into the turn before, or put an empty turn in. Costs are MERGE, RELABEL and
INSERT; a turn whose role is unknown is relabelled at UNKNOWN. Then the repaired turns are rendered.

Ties: of equally cheap repairs, the one that at the last turn where they differ keeps before merging before relabelling before
inserting wins, so results don't depend on the order of rows.

Cases: turns are taken by (turn, role, text), nulls first, and repeated rows are turns like any other; roles are
trimmed and lower-cased, known aliases are mapped, and null or other roles are unknown; a null or blank text is an empty turn, which counts; a null conv_id is a
conversation of its own; an empty table gives no rows. Only conv_id, turn, role and text are read. A conversation is
held by one task: its size is bounded by what a model can be trained on, not by the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

KEEP, MERGE, RELABEL, INSERT, UNKNOWN = 0, 2, 3, 4, 1
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
ROLES = ("system", "user", "assistant")
START = "start"
OUT = "conv_id long, n_turns long, n_repaired long, cost long, n_merged long, n_relabelled long, n_inserted long, rendered string"


def legal_next(state: str) -> tuple[str, ...]:
    """Roles that may follow a state."""
    return {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}[state]


def known_role(role: str | None) -> str | None:
    r = role.strip().lower() if isinstance(role, str) else ""
    r = ALIASES.get(r, r)
    return r if r in ROLES else None


def repair(roles: list[str | None]) -> tuple[int, list[tuple[str, list[int]]]]:
    """Cost, and the repaired turns as (role, indices of the turns they are made of; none for an inserted one)."""
    if not roles:
        return 0, []
    # best[state] = (cost, tie key, link to the state before, what was done)
    best: dict[str, tuple] = {START: (0, None, None)}
    for i, role in enumerate(roles):
        fixed = known_role(role)
        new: dict[str, tuple] = {}

        def offer(state: str, cost: int, rank: tuple, link: tuple, acts: list, new: dict = new) -> None:
            if state not in new or (cost, rank) < new[state][0]:
                new[state] = ((cost, rank), link, acts)

        for s in (START, *ROLES):
            if s not in best:
                continue
            at = best[s]
            cost = at[0] if s == START else at[0][0]
            for r in ROLES:
                label = KEEP if fixed == r else UNKNOWN if fixed is None else RELABEL
                kind = 0 if fixed == r else 2
                if r in legal_next(s):
                    offer(r, cost + label, (kind, 0, s), at, [(r, i)])
                else:
                    for mid in ROLES:  # one empty turn between
                        if mid in legal_next(s) and r in legal_next(mid):
                            offer(r, cost + label + INSERT, (kind, 3, s, mid), at, [(mid, None), (r, i)])
                if s == r:
                    offer(r, cost + MERGE + (0 if fixed == r else UNKNOWN if fixed is None else RELABEL), (1 if fixed == r else 2, 1, s), at, [(None, i)])
        best = new
    ends = []
    for s in ROLES:
        if s in best:
            (cost, _), *_ = best[s]
            tail = {"assistant": [], "user": [("assistant", None)], "system": [("user", None), ("assistant", None)]}[s]
            ends.append((cost + INSERT * len(tail), len(tail), s, tail))
    cost, _, s, tail = min(ends, key=lambda e: e[:3])
    steps, at = [tail], best[s]
    while at is not None and len(at) == 3 and at[2] is not None:
        steps.append(at[2])
        at = at[1]
    turns: list[tuple[str, list[int]]] = []
    for acts in reversed(steps):
        for role, i in acts:
            if role is None:
                turns[-1][1].append(i)
            else:
                turns.append((role, [] if i is None else [i]))
    return cost, turns


def render(turns: list[tuple[str, str]]) -> str:
    """Each turn between role markers; marker-like text in a turn is broken by a space, so that it can't be taken for one."""
    return "".join(f"<|{r}|>\n{t.replace('<|', '< |')}\n<|end|>\n" for r, t in turns)


def format_chats(conversations: DataFrame) -> DataFrame:
    """A row for each conversation: its repaired turns rendered, and what the repair took."""
    C.ship(conversations.sparkSession)
    turns = conversations.select(C.id_key("conv_id").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("x"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x")).select("conv_id", F.transform("x", lambda x: x["role"]).alias("roles"), F.transform("x", lambda x: x["text"]).alias("texts"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, tuple] = {}
        for p in parts:
            rows = []
            for c, roles, texts in zip(p["conv_id"].tolist(), p["roles"], p["texts"]):
                key = tuple(roles)
                if len(key) > 64 or (got := known.get(key)) is None:
                    got = repair(list(key))
                    if len(key) <= 64 and len(known) < 100_000:
                        known[key] = got
                cost, fixed = got
                merged = sum(max(0, len(i) - 1) for _, i in fixed)
                relabelled = sum(known_role(key[j]) != r for r, i in fixed for j in i)
                rows.append((c, len(key), len(fixed), cost, merged, relabelled, sum(not i for _, i in fixed), render([(r, "\n\n".join(t for j in i if (t := (texts[j] or "").strip()))) for r, i in fixed])))
            yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "n_repaired", "cost", "n_merged", "n_relabelled", "n_inserted", "rendered"])

    return chats.mapInPandas(run, OUT).withColumn("conv_id", C.id_back("conv_id"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(C.table(spark, sf_dir, "conversations"))
