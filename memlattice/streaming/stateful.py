"""Keyed streaming state: reflection buffers, session caches and soul states.

Reflection buffers and session caches are ``transformWithState`` operators: what a session holds is one row of state a turn or a reference,
so a trigger reads and writes the rows that it touches and not the whole buffer, and idle sessions wake by timers.  Their state needs the RocksDB
provider (``keep_state_in_rocksdb``).  State lives in the state store beside the shuffle partition of its key and is checkpointed with the stream.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from memlattice.functions.scoring import ENERGY_LIMIT, REFLECT, RESONATE, SOUL
from memlattice.operators.chat import IDLE_SECONDS, TURNS
from memlattice.operators.ranking import Knowledge

BATCHES = "session string, batch_no long, trigger string, seqs string, n int"
REFERENCES = "session string, id string, memory_type string, priority int, added_at double, user_id string"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Reflection(StatefulProcessor):
    """Turns of a session until they are a batch, and batches until they are acknowledged."""

    def __init__(self, most: int, idle: float):
        self.most, self.idle = most, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # a turn is a row, by what orders turns; those of a batch that failed come before all others by a lower round
        self.turns = handle.getMapState("turns", "round long, ts double, seq long", "held boolean")
        self.flying = handle.getMapState("flying", "batch_no long", "rounds array<long>, ts array<double>, seq array<long>")
        self.numbers = handle.getValueState("numbers", "held long, batch_no long, lowest long, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, no, lowest, timer = self.numbers.get() or (0, 0, 0, -1)
        new, acks = [], []
        for f in rows:
            for r in f.itertuples(index=False):
                if pd.notna(r.ack):
                    acks.append((int(r.ack), bool(r.ok)))
                else:
                    new.append((0, float(r.ts), int(r.seq)))
        for ack, ok in acks:
            if self.flying.containsKey((ack,)):
                rounds, ts, seq = self.flying.getValue((ack,))
                self.flying.removeKey((ack,))
                if not ok:
                    lowest -= 1
                    for t, q in zip(ts, seq, strict=True):
                        self.turns.updateValue((lowest, float(t), int(q)), (True,))
                    held += len(ts)
        out = []
        for turn in sorted(set(new)):
            if not self.turns.containsKey(turn):
                self.turns.updateValue(turn, (True,))
                held += 1
                if held >= self.most:
                    no, held = self._release(key, "count", no, held, out)
        while held >= self.most:
            no, held = self._release(key, "count", no, held, out)
        if timer >= 0:
            self.handle.deleteTimer(timer)
        timer = timerValues.getCurrentProcessingTimeInMs() + int(self.idle * 1000) if held else -1
        if timer >= 0:
            self.handle.registerTimer(timer)
        self.numbers.update((held, no, lowest, timer))
        yield _batches(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, no, lowest, _ = self.numbers.get() or (0, 0, 0, -1)
        out = []
        while held:
            no, held = self._release(key, "idle", no, held, out)
        self.numbers.update((held, no, lowest, -1))
        yield _batches(out)

    def _release(self, key: tuple, trigger: str, no: int, held: int, out: list) -> tuple[int, int]:
        batch = sorted(tuple(k) for k in self.turns.keys())[: self.most]  # as many as a buffer holds
        for turn in batch:
            self.turns.removeKey(turn)
        self.flying.updateValue((no + 1,), ([t[0] for t in batch], [t[1] for t in batch], [t[2] for t in batch]))
        out.append((key[0], no + 1, trigger, ",".join(str(t[2]) for t in batch), len(batch)))
        return no + 1, held - len(batch)

    def close(self) -> None:
        pass


def _batches(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["session", "batch_no", "trigger", "seqs", "n"])


def reflection_stream(turns: DataFrame, most: int = TURNS, idle: float = IDLE_SECONDS) -> DataFrame:
    """Batches to reflect on, from a stream of (session, seq, ts) and acknowledgements (session, ack long, ok boolean).

    A batch is released when ``most`` turns are in, or when nothing came for ``idle`` seconds.  A turn that is held already is not added again.  A batch stays in
    the state until an acknowledgement arrives: ok drops it, a failure puts its turns back at the head of the buffer.
    """
    return turns.groupBy("session").transformWithStateInPandas(Reflection(most, idle), StructType.fromDDL(BATCHES), "Append", "ProcessingTime")


class Cache(StatefulProcessor):
    """References of a session, a row of state each."""

    def __init__(self, capacity: dict[str, int], default: int, knowledge: Knowledge | None):
        self.capacity, self.default, self.knowledge = capacity, default, knowledge

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "id string", "memory_type string, priority int, added_at double, user_id string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for f in rows:
            for r in f.itertuples(index=False):
                at = float(r.added_at)
                if not self.held.containsKey((r.id,)) or at >= self.held.getValue((r.id,))[2]:
                    self.held.updateValue((r.id,), (r.memory_type, int(r.priority), at, r.user_id))
        every = [(k[0], *v) for k, v in self.held.iterator()]  # as many as the capacities, and what came
        kept = keep_best(every, self.capacity, self.default, self.knowledge)
        for gone in {r[0] for r in every} - {r[0] for r in kept}:
            self.held.removeKey((gone,))
        yield pd.DataFrame([(key[0], *r) for r in kept], columns=["session", "id", "memory_type", "priority", "added_at", "user_id"])

    def close(self) -> None:
        pass


def keep_best(held: list, capacity: dict[str, int], default: int, knowledge: Knowledge | None = None) -> list:
    """Of references (id, type, priority, added_at, user_id) the highest (priority, added_at) of each type.

    With ``knowledge`` references of its type are of two kinds: those about no user have a capacity of their own, those about a user share
    another one equally, so the shares of all users shrink when one joins.
    """
    kept, used, shared = [], {}, {}
    for r in sorted(held, key=lambda r: (r[2], r[3], r[0]), reverse=True):
        if knowledge is not None and r[1] == knowledge.kind and r[4]:
            shared.setdefault(r[4], []).append(r)
            continue
        used[r[1]] = used.get(r[1], 0) + 1
        if used[r[1]] <= (knowledge.regular if knowledge is not None and r[1] == knowledge.kind else capacity.get(r[1], default)):
            kept.append(r)
    for mine in shared.values():
        mine.sort(key=lambda r: (-r[2], r[3], r[0]))
        kept += mine if knowledge.shared <= 0 else mine[: knowledge.shared // len(shared)]
    return kept


def session_cache_stream(references: DataFrame, capacity: dict[str, int], default: int, knowledge: Knowledge | None = None) -> DataFrame:
    """After each trigger the whole cache of every session that changed, from a stream of references.  Of an id the newest reference counts."""
    return references.groupBy("session").transformWithStateInPandas(Cache(capacity, default, knowledge), StructType.fromDDL(REFERENCES), "Append", "None")


def profile_refresh_stream(turns: DataFrame, profiles, refresh, **trigger):
    """A stream of chat turns (CHAT_RECORD) that gives, for every batch, the profiles of the users who spoke in each session, as the store is then.

    ``profiles()`` reads the current profile memories and ``refresh(batch_no, rows)`` takes (session, user_id, memory columns); a session in which no user spoke has
    no rows.  The profiles are read anew with each batch and met in a join, so a change between two batches is seen by the second.
    """
    from memlattice.operators.browse import session_profiles

    run = lambda batch, no: refresh(no, session_profiles(batch, profiles()))
    return turns.writeStream.foreachBatch(run).trigger(**(trigger or {"availableNow": True}))


def hydrate(cache: DataFrame, memories: DataFrame) -> DataFrame:
    """Cached references with their memories; references to memories that are gone fall away (stream-static join)."""
    return cache.join(memories, "id")


def adjust(energy: tuple, code: str, mode: str, mids: dict[str, float] | None = None) -> tuple:
    """The four energies after one adjustment by a code of four digits."""
    if len(code) != 4 or set(code) - {"0", "1"}:
        raise ValueError(f"not a code of four binary digits: {code}")
    strength = RESONATE if mode == "resonate" else REFLECT
    out = []
    for e, digit, (name, (_, mid, _)) in zip(energy, code, SOUL.items(), strict=True):
        mid = (mids or {}).get(name, mid)
        push = (1 if digit == "1" else -1) * strength * math.exp(-0.1 * abs(e - mid))
        out.append(max(-ENERGY_LIMIT, min(ENERGY_LIMIT, e + push + (mid - e) * 0.1)))
    return tuple(out)


def fold_soul(steps: DataFrame) -> DataFrame:
    """Final energies of each key of a finished log (key, ts, seq, code, mode), in order of (ts, seq)."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        energy = (0.0,) * 4
        for r in g.sort_values(["ts", "seq"]).itertuples(index=False):
            energy = adjust(energy, r.code, r.mode)
        return pd.DataFrame([(key[0], *energy)])

    return steps.groupBy("key").applyInPandas(run, "key string, recall double, impression double, expression double, creativity double")


def soul_stream(steps: DataFrame) -> DataFrame:
    """Energies of every key that was adjusted, after each trigger."""
    schema = "key string, recall double, impression double, expression double, creativity double"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        energy = tuple(state.get) if state.exists else (0.0,) * 4
        rows = pd.concat(list(frames))
        for r in rows.sort_values(["ts", "seq"]).itertuples(index=False):
            energy = adjust(energy, r.code, r.mode)
        state.update(energy)
        yield pd.DataFrame([(key[0], *energy)], columns=["key", "recall", "impression", "expression", "creativity"])

    return steps.groupBy("key").applyInPandasWithState(run, schema, "a double, b double, c double, d double", "append", GroupStateTimeout.NoTimeout)


class SleepGate:
    """Lets a maintenance run through at first and then once an interval after its last success."""

    def __init__(self, interval: float):
        self.interval, self.last = interval, None

    def due(self, now: float) -> bool:
        return self.last is None or now - self.last >= self.interval

    def run(self, now: float, steps: list) -> bool:
        """Runs the steps in order if due; a step that raises leaves the gate open."""
        if not self.due(now):
            return False
        for step in steps:
            step()
        self.last = now
        return True
