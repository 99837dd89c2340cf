"""What a client holds of a tree, as a stream: wanted nodes and replies in, requests and evictions out.

State per session is the tree's version, the nodes that are there, those asked for, and those wanted in order of
priority. A message of kind `wanted` replaces the wanted nodes and evicts what isn't wanted any more; one of another
version forgets everything. A `reply` moves its nodes from asked for to there; one of another version than the state's
is stale and changes nothing. After either, as many wanted nodes are asked for as there are free slots.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MESSAGE = "session long, seq long, kind string, version long, nodes array<long>"
ANSWER = "session long, seq long, fetch array<long>, evicted array<long>, stale boolean, cached int, in_flight int, total int"
STATE = "version long, cached array<long>, pending array<long>, wanted array<long>"
EMPTY = (-1, [], [], [])


def step(state: tuple, kind: str, version: int, nodes: list[int], slots: int) -> tuple[tuple, list[int], list[int], bool]:
    """The state after a message, the nodes to ask for, those evicted, and whether the message was stale."""
    known, cached, pending, wanted = state
    evicted, stale = [], False
    if kind == "wanted":
        if version != known:
            known, cached, pending = version, [], []
        wanted = list(dict.fromkeys(nodes))
        keep = set(wanted)
        evicted = [n for n in cached if n not in keep]
        cached = [n for n in cached if n in keep]
    elif version != known:
        stale = True
    else:
        asked, got = set(pending), set(nodes)
        cached = list(dict.fromkeys([*cached, *[n for n in nodes if n in asked]]))
        pending = [n for n in pending if n not in got]
    busy = {*cached, *pending}
    fetch = [n for n in wanted if n not in busy][: max(0, slots - len(pending))] if not stale else []
    return (known, cached, [*pending, *fetch], wanted), fetch, evicted, stale


def _answers(rows: pd.DataFrame, state: tuple, slots: int) -> tuple[pd.DataFrame, tuple]:
    out = []
    for r in rows.itertuples(index=False):
        state, fetch, evicted, stale = step(state, r.kind, int(r.version), [int(n) for n in r.nodes] if r.nodes is not None else [], slots)
        held = set(state[1])
        out.append((r.session, r.seq, fetch, evicted, stale, sum(n in held for n in state[3]), len(state[2]), len(state[3])))
    return pd.DataFrame(out, columns=["session", "seq", "fetch", "evicted", "stale", "cached", "in_flight", "total"]), state


def cache_answers(messages: DataFrame, slots: int) -> DataFrame:
    """Batch form: the answer (ANSWER) to every message, a session's in the order of seq; a task holds one state at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, state = None, EMPTY
        for b in batches:
            for s, rows in b.groupby("session", sort=False):
                if s != session:
                    session, state = s, EMPTY
                out, state = _answers(rows, state, slots)
                yield out

    known = messages.where("session is not null and kind is not null and version is not null")
    return known.repartition("session").sortWithinPartitions("session", "seq").mapInPandas(run, ANSWER)


def cache_stream(messages: DataFrame, slots: int) -> DataFrame:
    """Streaming form, for messages that arrive in order; each micro-batch puts out what changed (update mode)."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else EMPTY
        now = (int(now[0]), *[[int(n) for n in x] for x in now[1:]])
        for rows in batches:
            out, now = _answers(rows.sort_values("seq"), now, slots)
            yield out
        state.update(now)

    known = messages.where("session is not null and kind is not null and version is not null")
    return known.groupBy("session").applyInPandasWithState(run, ANSWER, STATE, "update", "NoTimeout")


def message_events(events: DataFrame) -> DataFrame:
    """Messages (MESSAGE) from user events: an event's value says which nodes; every third event is a reply, every fortieth a new version."""
    v = F.floor(F.coalesce("value", F.lit(0.0))).cast("long") % 50
    kind = F.when(F.col("event_id") % 3 == 0, "reply").otherwise("wanted")
    return events.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), kind.alias("kind"), F.floor(F.col("event_id") / 4000).cast("long").alias("version"), F.sequence(v, v + 12).alias("nodes"))
