"""Structured Streaming forms of the run-log operators. Each one's batch twin in docweft.operators.runlog gives the reference result."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from docweft.operators import runlog


def stamped(log: DataFrame) -> DataFrame:
    """Watermarks need timestamps with a zone."""
    return log.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(log: DataFrame, width: str = "60 seconds", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events by window and status. Rows more than `late` behind the newest one no longer count."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    counts = stamped(log).withWatermark("ts", late).groupBy(window.alias("w"), "status").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "status", "n")


def exactly_once(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first event of each idempotency key (that of runlog.dedupe: a retried send comes under a later id); keys are forgotten once they are `late` behind."""
    return stamped(log).withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "status", "ts", "value", "payload"])


class RunState(StatefulProcessor):
    """Folds a run's events into status, last event and counts; heartbeats don't change the status, nor do events older than the one that set it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "status string, told_by long, last_event long, completed long, failed long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, told_by, last, completed, failed = self.state.get() if self.state.exists() else ("unknown", -1, -1, 0, 0)
        for batch in rows:
            batch = batch.sort_values("event_id")
            completed += int((batch["status"] == "completed").sum())
            failed += int((batch["status"] == "failed").sum())
            told = batch[batch["status"] != "heartbeat"]
            if len(told) and int(told["event_id"].iloc[-1]) > told_by:
                status, told_by = told["status"].iloc[-1], int(told["event_id"].iloc[-1])
            last = max(last, int(batch["event_id"].max()))
        self.state.update((status, told_by, last, completed, failed))
        yield pd.DataFrame({"run_id": [key[0]], "status": [status], "last_event": [last], "completed": [completed], "failed": [failed]})

    def close(self) -> None:
        pass


def run_states(log: DataFrame, schema: str | StructType = "run_id long, status string, last_event long, completed long, failed long") -> DataFrame:
    """The state of each run after every micro-batch that has events of it."""
    return log.select("run_id", "event_id", "status").groupBy("run_id").transformWithStateInPandas(statefulProcessor=RunState(), outputStructType=schema, outputMode="Update", timeMode="None")


class Limiter(StatefulProcessor):
    """Allows `most` requests of a client in any `millis`; refused ones don't count.

    A batch's requests are taken in order of time. One that is older than what was allowed before is judged by the allowed ones in the `millis` up to its own time; times are held for `late` more, so that
    they are still there.
    """

    def __init__(self, most: int, millis: int, late: int = 0):
        self.most, self.millis, self.late = most, millis, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = sorted(x[0] for x in self.held.get())
        batch = pd.concat(list(rows)).sort_values(["ms", "event_id"])
        allowed = []
        for ms in batch["ms"]:
            allowed.append(bisect.bisect_right(held, ms) - bisect.bisect_right(held, ms - self.millis) < self.most)
            if allowed[-1]:
                bisect.insort(held, ms)
        newest = max([*held[-1:], int(batch["ms"].max())])
        self.held.put([(int(x),) for x in held if newest - x < self.millis + self.late])
        yield pd.DataFrame({"client": batch["client"], "event_id": batch["event_id"], "allowed": allowed})

    def close(self) -> None:
        pass


def rate_limited(requests: DataFrame, most: int = 60, seconds: int = 60, late_seconds: int = 0) -> DataFrame:
    """client, event_id, allowed for requests (client, event_id, ts); only a client's allowed requests in the window are held."""
    timed = requests.select("client", "event_id", runlog.millis("ts").alias("ms"))
    return timed.groupBy("client").transformWithStateInPandas(statefulProcessor=Limiter(most, seconds * 1000, late_seconds * 1000), outputStructType="client long, event_id long, allowed boolean", outputMode="Append", timeMode="None")


def ingest(docs: DataFrame, root: str):
    """Runs new documents through blocks into a table below root, one micro-batch at a time; returns the started query."""
    from docweft.operators import text

    def store(batch: DataFrame, number: int) -> None:
        text.blocks(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/blocks/batch={number}")

    return docs.writeStream.foreachBatch(store).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()


class InOrder(StatefulProcessor):
    """Keeps a key's events until the watermark has passed them, then hands them to take() in order of time; a timer wakes the key for those, and when what it holds expires.

    A subclass has EVENT (the schema of a waiting event, which begins with ms and a number that orders events of one time), OUT (its output's), take(key, events, mark) for events that are due, which
    returns rows, and expires(), the time of its own next timer, or None.
    """

    EVENT = OUT = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.EVENT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in self.EVENT.split(", ")]
        new = []
        for batch in rows:
            plain = batch[names].astype(object)
            new += list(plain.where(plain.notna(), None).itertuples(index=False, name=None))
        yield self.advance(key, new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.advance(key, [], timerValues)

    def advance(self, key, new: list, timerValues) -> pd.DataFrame:
        mark = timerValues.getCurrentWatermarkInMs()
        events = sorted([*(tuple(e) for e in self.waiting.get()), *new], key=lambda e: e[:2])
        due = sum(e[0] < mark for e in events)
        out = self.take(key, events[:due], mark)
        if events[due:]:
            self.waiting.put(events[due:])
        else:
            self.waiting.clear()
        wake = [t for t in (*[e[0] for e in events[due : due + 1]], self.expires()) if t is not None]
        if wake and (at := max(min(wake), mark) + 1) not in set(self.handle.listTimers()):
            self.handle.registerTimer(at)
        kinds = {name: {"long": "Int64"}.get(kind, "object") for name, kind in (c.split() for c in self.OUT.split(", "))}
        return pd.DataFrame(out, columns=list(kinds)).astype(kinds)

    def close(self) -> None:
        pass


class Attempts(InOrder):
    """Attempts of a run, see attempt_sessions. State beside the waiting events: the attempt that is open, as one value."""

    EVENT = "ms long, event_id long, status string"
    OUT = "run_id long, attempt long, queued_ms long, started_ms long, ended_ms long, outcome string"

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getValueState("attempt", "attempt long, queued_ms long, started_ms long, ended_ms long, outcome string, heard_ms long")

    def take(self, key, events: list, mark: int) -> list[tuple]:
        number, queued, started, ended, outcome, heard = self.held.get() if self.held.exists() else (0, None, None, None, None, None)
        out = []

        def over(last: str) -> None:
            nonlocal queued, started, ended, outcome
            if queued is not None:
                out.append((key[0], number, queued, started, ended, outcome or last))
            queued = started = ended = outcome = None

        for at, _, status in events:
            if heard is not None and at - heard > self.timeout_ms:
                over("open")
            heard = at
            if status == "queued":
                over("failed")
                number, queued = number + 1, at
            elif queued is not None and status == "running" and started is None:
                started = at
            elif queued is not None and status in ("completed", "failed") and ended is None:
                ended, outcome = at, status
        if heard is not None and mark > heard + self.timeout_ms:
            over("open")
        self.next = None if queued is None else heard + self.timeout_ms
        if number:
            self.held.update((number, queued, started, ended, outcome, heard))
        return out

    def expires(self) -> int | None:
        return self.next


def attempt_sessions(log: DataFrame, late: str = "10 minutes", timeout_ms: int = 3_600_000) -> DataFrame:
    """Attempts as of runlog.attempts, each once it is over: run_id, attempt, queued_ms, started_ms, ended_ms, outcome.

    Events wait until the watermark has passed them and are taken in order of time and id, so late ones (up to `late`) count as if they had been in time. An attempt is over when the run is
    queued again, or when nothing has been heard of the run for `timeout_ms`: then a timer closes it as it stands (`open` if it hasn't ended), and what the run
    does without being queued again belongs to no attempt.
    """
    timed = stamped(log.select("run_id", "event_id", "ts", "status")).withColumn("ms", runlog.millis("ts")).withWatermark("ts", late)
    return timed.groupBy("run_id").transformWithStateInPandas(statefulProcessor=Attempts(timeout_ms), outputStructType=Attempts.OUT, outputMode="Append", timeMode="EventTime")


class Memory(InOrder):
    """What a session has in memory, see session_memory. State beside the waiting turns: the words as a map, the counts as a value; both go when the session closes."""

    EVENT = "ms long, seq long, kind string, role string, text string"
    OUT = "session_id long, n_turns long, n_questions long, keywords string, closed_by string"
    WORD = re.compile("[a-z]{5,}")

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.words = handle.getMapState("words", "word string", "turn long")
        self.counts = handle.getValueState("counts", "n_turns long, n_questions long, heard_ms long")

    def take(self, key, events: list, mark: int) -> list[tuple]:
        turns, questions, heard = self.counts.get() if self.counts.exists() else (0, 0, None)
        new: dict[str, int] = {}
        out = []

        def over(by: str) -> None:
            nonlocal turns, questions, heard, new
            known = {k[0] for k in self.words.keys()} if self.words.exists() else set()
            out.append((key[0], turns, questions, " ".join(sorted(known | set(new))), by))
            self.words.clear()
            self.counts.clear()
            turns, questions, heard, new = 0, 0, None, {}

        for at, _, kind, role, text in events:
            if heard is not None and at - heard > self.idle_ms:
                over("idle")
            heard = at
            if kind == "close":
                over("close")
            else:
                turns += 1
                questions += role == "user"
                for word in self.WORD.findall((text or "").lower()):
                    new.setdefault(word, turns)
        if heard is not None and mark > heard + self.idle_ms:
            over("idle")
        self.next = None if heard is None else heard + self.idle_ms
        if heard is not None:
            for word, turn in new.items():
                if not self.words.containsKey((word,)):
                    self.words.updateValue((word,), (turn,))
            self.counts.update((turns, questions, heard))
        return out

    def expires(self) -> int | None:
        return self.next


def session_memory(turns: DataFrame, late: str = "10 minutes", idle_ms: int = 86_400_000) -> DataFrame:
    """What each session had in memory when it was closed: session_id, n_turns, n_questions, keywords (its different words of five letters or more, in order), closed_by (`close` or `idle`).

    turns: session_id, seq, ts, kind (`turn` or `close`), role, text. Turns wait until the watermark has passed them and are taken in order of time and seq. A close turn ends the session and drops its
    state; so does a timer when nothing has been heard of it for idle_ms. A session that goes on after that begins anew.
    """
    timed = turns.select("session_id", "seq", F.col("ts").cast("timestamp").alias("ts"), "kind", "role", "text").withColumn("ms", runlog.millis("ts")).withWatermark("ts", late)
    return timed.groupBy("session_id").transformWithStateInPandas(statefulProcessor=Memory(idle_ms), outputStructType=Memory.OUT, outputMode="Append", timeMode="EventTime")


def health_scores(requests: DataFrame, alpha: float = 0.15, start: float = 100.0) -> DataFrame:
    """provider, n, score after each micro-batch that has requests of it: the exponentially weighted success of runlog.ewma. requests: provider, event_id, ts, status.

    A batch's requests are taken in order of time and id; those of a later batch count as later, whatever their time.
    """
    ended = requests.filter(F.col("status").isin("completed", "failed")).select("provider", "event_id", runlog.millis("ts").alias("ms"), "status")

    def fold(key, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        n, score = held.get if held.exists else (0, start)
        for status in pd.concat(list(batches)).sort_values(["ms", "event_id"])["status"]:
            n, score = n + 1, (1 - alpha) * score + alpha * (100.0 if status == "completed" else 0.0)
        held.update((n, score))
        yield pd.DataFrame({"provider": [key[0]], "n": [n], "score": [round(score, 4)]})

    return ended.groupBy("provider").applyInPandasWithState(fold, "provider long, n long, score double", "n long, score double", "update", "NoTimeout")


def ingest_index(changes: DataFrame, root: str, progress: str):
    """Keeps an incremental index (operators.index) up to date with a stream of changes (doc_id, text, op, seq); returns the started query. A micro-batch that runs again after a failure changes nothing, as its number names its part of the index."""
    from docweft.operators import index

    return changes.writeStream.foreachBatch(lambda batch, number: index.update(batch, root, number + 1)).option("checkpointLocation", progress).trigger(availableNow=True).start()
