"""The token ledger as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

OUTPUT = """tenant_id string, entry_id string, entry_type string, token_delta long, statement_id string, accepted boolean,
  balance long, source string, settles_entry_id string"""


def token_processor() -> StatefulProcessor:
    """Applies ledger commands of a tenant in (at, command_id) order within a batch.

    State: the balance, the open reservations by statement, and the ids of commands applied.
    A reservation command covers a whole upload batch: its statements share a command id, and all of
    them are accepted or none. A tenant's commands of one micro-batch are ordered in memory, so the
    source's rate limit (such as ``maxFilesPerTrigger``) bounds what a task holds. The first settlement of a reservation counts; repeated commands and
    settlements change nothing and give no row.
    """

    class TokenLedger(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.balance = handle.getValueState("balance", "tokens long")
            self.open = handle.getMapState("open", "statement_id string", "pages long")
            self.seen = handle.getMapState("seen", "command_id string", "accepted boolean")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            (tenant,) = key
            known = self.balance.get()
            balance = 0 if known is None else known[0]
            batch = pd.concat(list(rows)).sort_values(["at", "command_id", "statement_id"], na_position="first")
            # Every call of the state is a message to the JVM: a new tenant has none to read, and what opens and settles within the batch needs none.
            held: dict[str, int | None] = {}
            stored: set[str] = set()

            def open_pages(statement: str) -> int | None:
                if statement not in held:
                    found = None if known is None else self.open.getValue((statement,))
                    if found is not None:
                        stored.add(statement)
                    held[statement] = None if found is None else found[0]
                return held[statement]

            commands: dict[str, tuple[str, str, dict]] = {}
            for command_id, kind, source, statement, n in zip(*[batch[c].tolist() for c in ("command_id", "kind", "source", "statement_id", "tokens")]):
                if command_id is not None and command_id == command_id:
                    # A line delivered twice in one batch counts once.
                    lines = commands.setdefault(command_id, (kind, source, {}))[2]
                    lines.setdefault(None if statement != statement else statement, (statement, n))
            out = []
            for command_id, (kind, source, lines) in commands.items():
                if known is not None and self.seen.containsKey((command_id,)):
                    continue
                pages = [(s, int(n)) for s, n in lines.values()]
                accepted = True
                if kind == "reserve":
                    total = sum(n for _, n in pages)
                    accepted = balance >= total
                    for statement, n in pages:
                        if accepted:
                            balance -= n
                            open_pages(statement)
                            held[statement] = n
                        out.append((tenant, f"reserve#{statement}", "RESERVE", -n if accepted else 0, statement, accepted, balance, source, None))
                elif kind in ("consume", "release"):
                    for statement, _ in pages:
                        n = open_pages(statement)
                        if n is None:
                            continue
                        held[statement] = None
                        delta = n if kind == "release" else 0
                        balance += delta
                        out.append((tenant, f"{kind}#{statement}", kind.upper(), delta, statement, True, balance, source, f"reserve#{statement}"))
                else:
                    delta = sum(n for _, n in pages)
                    accepted = delta > 0 or balance >= -delta
                    if accepted:
                        balance += delta
                    out.append((tenant, command_id, "ADJUSTMENT", delta if accepted else 0, None, accepted, balance, source, None))
                self.seen.updateValue((command_id,), (accepted,))
            for statement, n in held.items():
                if n is not None:
                    self.open.updateValue((statement,), (n,))
                elif statement in stored:
                    self.open.removeKey((statement,))
            self.balance.update((balance,))
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(",")])

        def close(self) -> None:
            pass

    return TokenLedger()


def token_ledger_stream(commands: DataFrame) -> DataFrame:
    """Ledger rows for a stream of commands.

    ``commands`` has tenant_id, command_id, kind ('reserve', 'consume', 'release' or 'adjust'),
    statement_id, tokens, at and source. Needs the RocksDB state store.
    """
    commands.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return commands.groupBy("tenant_id").transformWithStateInPandas(
        statefulProcessor=token_processor(), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )


def stale_processor(stale_after_ms: int) -> StatefulProcessor:
    """Reports a tenant whose running sync sends no heartbeat for the given time."""

    class Watchdog(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "heartbeat_ms long, running boolean")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            beats = pd.concat(list(rows))
            latest = beats.sort_values("heartbeat_ms").iloc[-1]
            known = self.last.get()[0] if self.last.exists() else -1
            if int(latest["heartbeat_ms"]) >= known:
                self.last.update((int(latest["heartbeat_ms"]), bool(latest["running"])))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if self.last.get()[1]:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + stale_after_ms)
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            heartbeat, running = self.last.get()
            if running:
                yield pd.DataFrame({"tenant_id": [key[0]], "heartbeat_ms": [heartbeat]})

        def close(self) -> None:
            pass

    return Watchdog()


def stale_sync_stream(heartbeats: DataFrame, stale_after_ms: int) -> DataFrame:
    """Tenants that stop sending heartbeats while their sync runs (tenant_id, heartbeat_ms, running)."""
    heartbeats.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return heartbeats.groupBy("tenant_id").transformWithStateInPandas(
        statefulProcessor=stale_processor(stale_after_ms),
        outputStructType="tenant_id string, heartbeat_ms long",
        outputMode="Update",
        timeMode="ProcessingTime",
    )


def silence_processor(stale_after_ms: int) -> StatefulProcessor:
    """Reports every heartbeat of a running sync after which none came for the given time, by the heartbeats' own clock."""

    class Silence(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "at_ms long, running boolean")

        def _rows(self, key, at_ms: list[int]) -> pd.DataFrame:
            return pd.DataFrame({"tenant_id": [key[0]] * len(at_ms), "heartbeat_ms": at_ms})

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            # Every call of the state is a message to the JVM: it is read before the batch's heartbeats and written after them.
            known = self.last.get()
            last = known
            for piece in rows:
                silent = []
                for at_ms, running in sorted(zip(piece["at_ms"].tolist(), piece["running"].tolist(), strict=True)):
                    if last is not None and at_ms <= last[0]:
                        continue  # older than what is known
                    if last is not None and last[1] and at_ms - last[0] > stale_after_ms:
                        silent.append(last[0])
                    last = (int(at_ms), bool(running))
                if silent:
                    yield self._rows(key, silent)
            if last is not known:
                if known is not None and known[1]:
                    self.handle.deleteTimer(known[0] + stale_after_ms)
                self.last.update(last)
                if last[1]:
                    self.handle.registerTimer(last[0] + stale_after_ms)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            at_ms, running = self.last.get()
            if running:
                yield self._rows(key, [at_ms])
                self.last.update((at_ms, False))  # said once

        def close(self) -> None:
            pass

    return Silence()


def silent_sync_stream(heartbeats: DataFrame, stale_after_ms: int, late: str = "1 minute") -> DataFrame:
    """Heartbeats (tenant_id, at, running) of running syncs after which none came for ``stale_after_ms``, by event time.

    The clock is the watermark, ``late`` behind the latest heartbeat, so a recorded stream gives the same rows whenever it
    is replayed. A heartbeat further behind is lost to it. Rows of one tenant in one batch are expected in
    pieces that follow each other in time.
    """
    heartbeats.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = heartbeats.withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    return timed.groupBy("tenant_id").transformWithStateInPandas(
        statefulProcessor=silence_processor(stale_after_ms), outputStructType="tenant_id string, heartbeat_ms long", outputMode="Append", timeMode="EventTime"
    )
