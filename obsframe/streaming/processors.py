"""Keyed state processors. State per key is small: a sample, a count, a few turns."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)

DONE = ["ids", "reasonings", "answers", "counts", "ended_us"]  # finished replies, packed into arrays
PASSED = ["reply", "bucket", "ts", "seq", "us", "reasoning", "content", "is_last", "done"]  # what goes from ReplyBuckets to PassedReplies


def _moments(us: list[int]) -> pd.Series:
    return pd.Series(pd.to_datetime(us, unit="us", utc=True))


class CounterDeltas(StatefulProcessor):
    """Samples wait until the watermark has passed them and then go on in time order."""

    def __init__(self, series: tuple[str, ...]):
        self.series = series

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long, value double")
        self.waiting = handle.getListState("waiting", "us long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            self.waiting.appendList(list(zip(batch.us.tolist(), batch.value.tolist())))
            first = min(batch.us.min(), first or batch.us.min())
        self._wake(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        ready, later = [], []
        for sample in self.waiting.get():
            (ready if sample[0] <= mark else later).append(tuple(sample))
        if not ready:
            return
        if later:
            self.waiting.put(later)
            self._wake(min(later)[0])
        else:
            self.waiting.clear()
        ready.sort()
        before = self.last.get()
        deltas = []
        for us, value in ready:
            if before is None:
                deltas.append(None)
            else:
                deltas.append(value - before[1] if value >= before[1] else value)
            before = (us, value)
        self.last.update(before)
        out = pd.DataFrame({"ts": _moments([r[0] for r in ready]), "value": [r[1] for r in ready],
                            "delta": pd.array(deltas, dtype="Float64")})
        for i, name in enumerate(self.series):
            out.insert(i, name, key[i])
        yield out

    def _wake(self, us: int) -> None:
        """Ask to be called once the watermark has passed a sample."""
        self.handle.registerTimer(int(us) // 1000 + 1)

    def close(self) -> None:
        pass


class AgentTurns(StatefulProcessor):
    """Running count, creation time and the last turns of one agent."""

    def __init__(self, recent: int):
        self.recent = recent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long, created_us long")
        self.turns = handle.getListState("turns", "query string, response string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("position", kind="stable")
        count, created = self.seen.get() if self.seen.exists() else (0, int(batch.us.min()))
        turns = list(self.turns.get()) if self.turns.exists() else []
        held = []
        for query, response in zip(batch["query"], batch["response"]):
            held.append(min(len(turns), self.recent))
            turns = [*turns, (query, None if pd.isna(response) else response)][-self.recent:]
        numbers = range(count + 1, count + len(batch) + 1)
        self.seen.update((count + len(batch), created))
        self.turns.put([tuple(t) for t in turns])
        yield pd.DataFrame({
            "agent_id": key[0], "position": batch.position.to_numpy(), "ts": _moments(batch.us.tolist()),
            "query": batch["query"].to_numpy(), "response": batch["response"].to_numpy(),
            "reflection_count": list(numbers), "recent_turns": held,
            "created_at": _moments([created] * len(batch))})

    def close(self) -> None:
        pass


class OrderedTurns(StatefulProcessor):
    """An agent's turns in order of event time, whatever batch they come in, until it has been idle too long.

    Turns wait until the watermark has passed them. Kept are their number, the first and last moment and the last few
    turns. After a pause longer than ``idle`` microseconds the agent's state goes out as one last row and is dropped.
    """

    def __init__(self, recent: int, idle: int | None):
        self.recent, self.idle = recent, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n long, created_us long, last_us long")
        self.turns = handle.getListState("turns", "query string, response string")
        self.waiting = handle.getListState("waiting", "us long, position long, query string, response string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.seen.update((int(row.n), int(row.created_us), int(row.last_us)))
        held = [(t["query"], t["response"]) for t in row.turns][-self.recent:]
        if held:
            self.turns.put(held)
        self._wake_when_idle(int(row.last_us))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            texts = [[None if pd.isna(v) else v for v in batch[c]] for c in ("query", "response")]
            self.waiting.appendList(list(zip(batch.us.tolist(), batch.position.tolist(), *texts)))
            first = min(int(batch.us.min()), first or int(batch.us.min()))
        self.handle.registerTimer(first // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        ready, later = [], []
        for turn in self.waiting.get():
            (ready if turn[0] <= mark else later).append(tuple(turn))
        state = tuple(self.seen.get()) if self.seen.exists() else None
        held = [tuple(t) for t in self.turns.get()] if self.turns.exists() else []
        out = []
        for us, position, query, response in sorted(ready, key=lambda t: t[:2]):
            if state and self.idle is not None and us - state[2] > self.idle:
                out.append(self._last(state, held))
                state, held = None, []
            state = (1, us, us) if state is None else (state[0] + 1, state[1], us)
            out.append((position, us, query, response, state[0], len(held), state[1], False))
            held = [*held, (query, response)][-self.recent:]
        if state and self.idle is not None and mark > state[2] + self.idle:
            out.append(self._last(state, held))
            state = None
        self.waiting.put(later) if later else self.waiting.clear()
        if state is None:
            self.seen.clear()
            self.turns.clear()
        else:
            self.seen.update(state)
            self.turns.put(held)
            if ready:
                self._wake_when_idle(state[2])
        if later and ready:
            self.handle.registerTimer(min(t[0] for t in later) // 1000 + 1)
        if out:
            position, us, query, response, count, before, created, evicted = zip(*out)
            yield pd.DataFrame({
                "agent_id": key[0], "position": pd.array(position, dtype="Int64"), "ts": _moments(list(us)), "query": query, "response": response,
                "reflection_count": count, "recent_turns": pd.array(before, dtype="int32"), "created_at": _moments(list(created)), "evicted": evicted})

    def _last(self, state: tuple[int, int, int], held: list) -> tuple:
        return None, state[2] + self.idle, None, None, state[0], len(held), state[1], True

    def _wake_when_idle(self, us: int) -> None:
        if self.idle is not None:
            self.handle.registerTimer((us + self.idle) // 1000 + 1)

    def close(self) -> None:
        pass


class SlidingSums(StatefulProcessor):
    """Sums over a sliding range from one closed pane per step. The state is the panes of one range."""

    def __init__(self, by: tuple[str, ...], width: int, step: int):
        self.by, self.width, self.step = by, width, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getValueState("sent", "start long")
        self.panes = handle.getListState("panes", "start long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        starts = []
        for batch in rows:
            self.panes.appendList(list(zip(batch.pane.tolist(), batch.value.tolist())))
            starts.append(int(batch.pane.min()))
        self._wake(min(starts))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000 - self.width  # the last start whose range is closed
        sent = self.sent.get()[0] if self.sent.exists() else None
        panes = sorted(tuple(p) for p in self.panes.get()) if self.panes.exists() else []
        if not panes:
            return
        at, values = np.array([p for p, _ in panes], np.int64), np.array([v for _, v in panes])
        inside = self.width // self.step
        starts = np.unique((at[:, None] - self.step * np.arange(inside)[None, :]).ravel())
        starts = starts[(starts <= upto) & (starts > sent if sent is not None else True)]
        if not len(starts):
            self._wake(panes[0][0])
            return
        low, high = np.searchsorted(at, starts), np.searchsorted(at, starts + self.width)
        sums = [math.fsum(values[i:j]) for i, j in zip(low.tolist(), high.tolist())]
        last = int(starts[-1])
        self.sent.update((last,))
        left = [p for p in panes if p[0] > last]
        if left:
            self.panes.put(left)
            self._wake(left[0][0])
        else:
            self.panes.clear()
        out = pd.DataFrame({"start": _moments(starts.tolist()), "increase": sums})
        for i, name in enumerate(self.by):
            out.insert(1 + i, name, key[i])
        yield out

    def _wake(self, pane: int) -> None:
        """Ask to be called when the first range that holds a pane and is not sent is closed."""
        first = pane - self.width + self.step
        if self.sent.exists():
            first = max(first, self.sent.get()[0] + self.step)
        self.handle.registerTimer((first + self.width) // 1000)

    def close(self) -> None:
        pass


class ReplyChunks(StatefulProcessor):
    """The chunks of one reply until its last chunk and all before it are there, or until it has been silent for ``silence`` microseconds.

    Of a chunk sent twice the one with the earlier moment counts; at one moment the one with the smaller text. Every call to the state costs
    a round trip to the JVM, so a reply of up to ``HELD`` chunks is one value, read and written once per batch. Longer ones have a map entry per chunk.
    """

    HELD = 64

    def __init__(self, silence: int):
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "seq long", "us long, reasoning string, content string")
        self.seen = handle.getValueState(  # ends: chunks of a whole reply, or -1
            "seen", "last_us long, count long, ends long, held array<struct<seq: long, us: long, reasoning: string, content: string>>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, count, ends, held = self.seen.get() or (0, 0, -1, [])
        held = {seq: tuple(rest) for seq, *rest in held}
        for row in rows:
            found = (row.us, row.reasoning or "", row.content or "")
            if count > self.HELD:
                count += self._file(row.seq, found)
            else:
                held[row.seq] = min(found, held.get(row.seq, found))
                count = len(held)
                if count > self.HELD:
                    for seq, chunk in held.items():
                        self.chunks.updateValue((seq,), chunk)
                    held = {}
            last = max(last, row.us)
            ends = max(ends, row.seq + 1) if row.is_last else ends
        self.seen.update((last, count, ends, [(seq, *chunk) for seq, chunk in held.items()]))
        self.handle.registerTimer((last if count == ends else last + self.silence) // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self.seen.get()
        if state is None:
            return
        last, count, ends, held = state
        mark, complete = timerValues.getCurrentWatermarkInMs() * 1000, count == ends
        if mark < (last if complete else last + self.silence):
            return  # chunks came since; they asked for a later call
        if count > self.HELD:
            chunks = sorted((k[0], *v[1:]) for k, v in self.chunks.iterator())
            self.chunks.clear()
        else:
            chunks = sorted((seq, reasoning, content) for seq, _, reasoning, content in held)
        self.seen.clear()
        yield Row(response_id=key[0], reasoning="".join(c[1] for c in chunks), answer="".join(c[2] for c in chunks),
                  chunks=count, ended_at=EPOCH + timedelta(microseconds=last), complete=complete)

    def _file(self, seq: int, found: tuple) -> bool:
        """Put a chunk into the map; whether its number is new there."""
        known = tuple(self.chunks.getValue((seq,))) if self.chunks.containsKey((seq,)) else None
        if known is None or found < known:
            self.chunks.updateValue((seq,), found)
        return known is None

    def close(self) -> None:
        pass


class ReplyBuckets(StatefulProcessor):
    """Replies wait here until they are whole and the watermark has passed them, all of a bucket as one state value.

    A key of its own costs a reply eight round trips to the JVM and an Arrow batch; in a bucket many replies share them. A reply that is still open and
    got no chunk when the watermark next moves on, or that has more than ``ReplyChunks.HELD`` chunks, goes on to ``ReplyChunks``, and so does every later
    chunk of it: its id is remembered for longer than that operator can hold it. Either operator merges chunks alike and both see the same
    watermark, so where a reply is held does not show in its row.
    """

    PACK = 1000  # whole replies in one row

    def __init__(self, silence: int):
        self.silence, self.linger = silence, silence + 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # pickled: {reply: [last_us, ends, {seq: (us, reasoning, content)}, watermark at its last chunk]}, {reply: last_us} of those passed on
        self.state = handle.getValueState("waiting", "replies binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held, passed = self._load()
        for batch in rows:
            on = []
            numbers = (batch[c].astype("int64").tolist() for c in ("seq", "us"))  # a null is an error here, never a float
            others = (batch[c].tolist() for c in ("reply", "reasoning", "content", "is_last"))
            for seq, us, reply, reasoning, content, is_last in zip(*numbers, *others):
                found = (us, reasoning or "", content or "")
                if reply in passed:
                    passed[reply] = max(passed[reply], us)
                    on.append((reply, seq, *found, is_last))
                    continue
                state = held.get(reply)
                if state is None:
                    state = held[reply] = [us, -1, {}, mark]
                chunks = state[2]
                if seq not in chunks or found < chunks[seq]:
                    chunks[seq] = found
                if us > state[0]:
                    state[0] = us
                if is_last and seq >= state[1]:
                    state[1] = seq + 1
                state[3] = mark
                if len(chunks) > ReplyChunks.HELD:
                    on += self._pass(reply, held, passed)
            if on:
                yield self._chunks(on, mark)
        self._save(held, passed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held, passed = self._load()
        due, ready, on = [reply for reply, state in held.items() if self._due(state) < mark], [], []
        for reply in due:
            last, ends, chunks, _ = held[reply]
            if len(chunks) == ends:
                del held[reply]
                texts = [chunks[seq] for seq in sorted(chunks)]
                ready.append((reply, "".join(t[1] for t in texts), "".join(t[2] for t in texts), ends, last))
            else:
                on += self._pass(reply, held, passed)
        for done in (ready[i:i + self.PACK] for i in range(0, len(ready), self.PACK)):
            yield self._frame([mark + 1000], bucket=[key[0]], done=[{name: list(values) for name, values in zip(DONE, zip(*done))}])
        if on:
            yield self._chunks(on, mark)
        self._save(held, {reply: last for reply, last in passed.items() if last + self.linger >= mark})

    def _due(self, state: list) -> int:
        """The moment at which a reply leaves if no further chunk comes."""
        last, ends, chunks, touched = state
        return last if len(chunks) == ends else min(touched, last + self.silence)

    def _pass(self, reply, held: dict, passed: dict) -> list[tuple]:
        """Chunks that make ``ReplyChunks`` know what is known here, the reply's last moment and end included."""
        last, ends, chunks, _ = held.pop(reply)
        passed[reply] = last
        on = [(reply, seq, *chunk, seq + 1 == ends) for seq, chunk in chunks.items()]
        if last > max(chunk[0] for chunk in chunks.values()):  # the moment of a chunk that came again
            on.append((reply, on[0][1], last, *on[0][3:5], False))
        return on

    def _chunks(self, on: list[tuple], mark: int) -> pd.DataFrame:
        """Rows that the next operator does not take for late ones, since they were not late here."""
        chunks = dict(zip(("reply", "seq", "us", "reasoning", "content", "is_last"), map(list, zip(*on))))
        return self._frame([max(us, mark + 1000) for us in chunks["us"]], **chunks)

    def _frame(self, moments: list[int], **columns: list) -> pd.DataFrame:
        columns["ts"] = _moments(moments)
        return pd.DataFrame({name: columns.get(name, [None] * len(moments)) for name in PASSED})

    def _load(self) -> tuple[dict, dict]:
        state = self.state.get()
        return pickle.loads(state[0]) if state else ({}, {})

    def _save(self, held: dict, passed: dict) -> None:
        """Keep what waits, and ask to be called when the first of it is due."""
        if not held and not passed:
            self.state.clear()
            return
        self.state.update((pickle.dumps((held, passed), 5),))
        self.handle.registerTimer(min([self._due(state) for state in held.values()] + [last + self.linger for last in passed.values()]) // 1000 + 1)

    def close(self) -> None:
        pass


class PassedReplies(ReplyChunks):
    """``ReplyChunks`` behind ``ReplyBuckets``: whole replies, the rows with a bucket, go through; chunks are put together. The result has ``DONE`` columns."""

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[1] is not None:
            return (Row(**row.done, complete=True) for row in rows)
        return super().handleInputRows(key, rows, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for r in super().handleExpiredTimer(key, timerValues, expiredTimerInfo):
            values = (r.response_id, r.reasoning, r.answer, r.chunks, (r.ended_at - EPOCH) // timedelta(microseconds=1))
            yield Row(**{name: [value] for name, value in zip(DONE, values)}, complete=r.complete)
