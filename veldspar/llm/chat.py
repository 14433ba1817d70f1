"""Chat formatting with repair of role sequences at minimum cost.

Legal conversations are the words of an automaton: an optional system turn, then
user and assistant turns in alternation, user first, assistant last. A conversation
that isn't legal is repaired by the cheapest mix of three edits: a turn is merged
into the one before it, given another role, or an empty turn is put in. Dynamic
programming over (turns read, last role) finds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
START = "start"
#: The automaton: what may follow what, and where a conversation may end.
NEXT = {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
FINAL = ("assistant",)
#: Costs of the edits. A turn of no known role costs the same for every role.
MERGE, RELABEL, NAME, INSERT = 2, 3, 1, 4


def role_cost(role: str | None, to: str) -> int:
    if role == to:
        return 0
    return RELABEL if role in ROLES else NAME


Plan = tuple[int, tuple[tuple[str, tuple[int, ...]], ...]]

#: Turns of the longest sequence whose repair a worker remembers, and how many it remembers: some 50 MB at most.
REMEMBERED_TURNS, REMEMBERED_PLANS = 32, 8192


def repair(roles: tuple[str | None, ...]) -> Plan:
    """(cost, turns of the repaired conversation as (role, numbers of the turns merged in it)).

    Of repairs of one cost the one is taken that reaches it with the first of: keep or
    relabel, merge, insert; then by the order of ROLES. No turns at all need none.
    """
    return _remembered(roles) if len(roles) <= REMEMBERED_TURNS else _solved(roles)


def _solved(roles: tuple[str | None, ...]) -> Plan:
    if not roles:
        return 0, ()
    # state -> (cost, link); a link is (link before, action, role, number)
    states: dict[str, tuple[int, tuple | None]] = {START: (0, None)}

    def with_inserts(now: dict) -> dict:
        for _ in ROLES:
            for state in (START, *ROLES):
                if state in now:
                    for role in NEXT[state]:
                        cost = now[state][0] + INSERT
                        if role not in now or cost < now[role][0]:
                            now[role] = (cost, (now[state][1], "insert", role, -1))
        return now

    for i, given in enumerate(roles):
        states, then = with_inserts(states), {}
        for state in (START, *ROLES):
            if state in states:
                cost, link = states[state]
                for role in NEXT[state]:
                    c = cost + role_cost(given, role)
                    if role not in then or c < then[role][0]:
                        then[role] = (c, (link, "turn", role, i))
        for state in ROLES:
            if state in states:
                cost, link = states[state]
                c = cost + MERGE + role_cost(given, state)
                if state not in then or c < then[state][0]:
                    then[state] = (c, (link, "merge", state, i))
        states = then
    states = with_inserts(states)
    cost, link = min((states[r] for r in FINAL if r in states), key=lambda s: s[0])
    turns: list[tuple[str, tuple[int, ...]]] = []
    merged: list[int] = []  # last first
    while link is not None:
        link, action, role, i = link
        if action != "insert":
            merged.append(i)
        if action != "merge":
            turns.append((role, tuple(reversed(merged))))
            merged = []
    return cost, tuple(reversed(turns))


_remembered = lru_cache(REMEMBERED_PLANS)(_solved)


def _plan(roles: pd.Series) -> pd.DataFrame:
    plans = [repair(tuple(r)) for r in roles]
    return pd.DataFrame({"cost": [c for c, _ in plans], "turns": [[{"role": r, "members": list(m)} for r, m in t] for _, t in plans]})


def formatted_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, cost, roles, chat) for each conversation, its roles made legal.

    Turns are ordered by turn (null last), then role and text, so that ties and repeated
    rows, which all count, have one order. Roles are trimmed and lower-cased; an unknown
    or null one takes whichever is cheapest. A null text is empty. Merged turns are
    joined by a line break. ``roles`` has the repaired roles, joined by commas; ``chat``
    has "<|role|>", a line break, the text, "<|end|>" and a line break for each turn;
    "<|" in a text becomes "<\\|". Rows with a null conv_id belong to no conversation and
    are left out. Other columns aren't looked at.

    Python sees the roles only, and solves each sequence once; texts stay in the JVM.
    """
    role = F.lower(F.trim(F.col("role").cast("string")))
    turn = F.struct(F.col("turn").isNull().alias("last"), F.col("turn").alias("turn"), role.alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = conversations.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("given"))
    planned = whole.withColumn("plan", F.pandas_udf(_plan, "cost int, turns array<struct<role:string,members:array<int>>>")(F.col("given.role")))

    def text(t):
        members = F.transform(t["members"], lambda i: F.get(F.col("given"), i)["text"])
        return F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), F.replace(F.array_join(members, "\n"), F.lit("<|"), F.lit("<\\|")), F.lit("<|end|>\n"))

    return planned.select(
        "conv_id",
        F.size("given").alias("n_turns"),
        F.col("plan.cost").alias("cost"),
        F.array_join(F.col("plan.turns.role"), ",").alias("roles"),
        F.array_join(F.transform(F.col("plan.turns"), text), "").alias("chat"),
    )
