"""A leased job queue as keyed state over a stream of commands.

Commands (queue, seq, at, op, job_id, worker_id, attempt, value) are handled in (at, seq) order for each
queue: enqueue, claim, heartbeat, save, finish. Claiming first takes back expired leases, respects the
number of leases a queue may have, and gives the oldest queued job. Whoever writes must hold the lease:
job, worker and attempt must fit, or the command is rejected. A queue is one key by its nature: its
commands are serial; many queues run in parallel. A command costs the logarithm of the queue's jobs,
and a finished log passes through in order, so that only the jobs are held.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COMMANDS = "queue string, seq long, at double, op string, job_id string, worker_id string, attempt int, value string"
EVENTS = "queue string, seq long, op string, job_id string, worker_id string, attempt int, status string, accepted boolean"
_STATE = "jobs string"
_NAMES = ["queue", "seq", "op", "job_id", "worker_id", "attempt", "status", "accepted"]
_TYPES = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_())


class Queue:
    """The jobs of one queue; plain dicts, so that the state is one JSON text."""

    def __init__(self, jobs: dict[str, dict] | None = None, *, lease: float = 90.0, attempts: int = 3, ceiling: int = 2):
        self.jobs = jobs or {}
        self.lease, self.attempts, self.ceiling = lease, attempts, ceiling
        # what waits, by age; ends of leases, of which those that no longer hold are passed over; who runs
        self.waiting = [(j["queued"], j["seq"], k) for k, j in self.jobs.items() if j["status"] == "queued"]
        self.running = {k for k, j in self.jobs.items() if j["status"] == "running"}
        self.ends = [(self.jobs[k]["until"], k) for k in self.running]
        heapq.heapify(self.waiting)
        heapq.heapify(self.ends)

    def wait(self, k: str) -> None:
        heapq.heappush(self.waiting, (self.jobs[k]["queued"], self.jobs[k]["seq"], k))

    def extend(self, k: str, now: float) -> None:
        self.jobs[k]["until"] = now + self.lease
        heapq.heappush(self.ends, (now + self.lease, k))

    def reap(self, now: float) -> None:
        while self.ends and self.ends[0][0] <= now:
            until, k = heapq.heappop(self.ends)
            j = self.jobs[k]
            if j["status"] == "running" and j["until"] == until:
                self.running.discard(k)
                j["worker"] = None
                j["status"] = "failed" if j["attempts"] >= self.attempts else "queued"
                if j["status"] == "queued":
                    self.wait(k)

    def handle(self, c: dict) -> tuple[str | None, str | None, int | None, str | None, bool]:
        """(job, worker, attempt, status, accepted) of a command."""
        op, now = c["op"], float(c["at"])
        if op == "enqueue":
            if c["job_id"] in self.jobs:
                return c["job_id"], None, None, self.jobs[c["job_id"]]["status"], False
            self.jobs[c["job_id"]] = {"status": "queued", "queued": now, "seq": int(c["seq"]), "attempts": 0, "worker": None, "until": 0.0, "started": None, "value": None}
            self.wait(c["job_id"])
            return c["job_id"], None, 0, "queued", True
        if op == "reap":
            self.reap(now)
            return None, None, None, None, True
        if op == "claim":
            self.reap(now)
            if not self.waiting or len(self.running) >= self.ceiling:
                return None, c["worker_id"], None, None, False
            k = heapq.heappop(self.waiting)[2]
            j = self.jobs[k]
            j.update(status="running", worker=c["worker_id"], attempts=j["attempts"] + 1, started=j["started"] if j["started"] is not None else now)
            self.running.add(k)
            self.extend(k, now)
            return k, c["worker_id"], j["attempts"], "running", True
        j = self.jobs.get(c["job_id"])
        if not j or j["status"] != "running" or j["worker"] != c["worker_id"] or j["attempts"] != c["attempt"]:
            return c["job_id"], c["worker_id"], c["attempt"], j and j["status"], False
        if op == "heartbeat":
            self.extend(c["job_id"], now)
        elif op == "save":
            j["value"] = c["value"]
        elif op == "finish":
            j.update(status=c["value"] or "completed", worker=None)
            if j["status"] != "running":
                self.running.discard(c["job_id"])
            if j["status"] == "queued":
                self.wait(c["job_id"])
        return c["job_id"], c["worker_id"], j["attempts"], j["status"], True


def _run(queue: Queue, name: str, commands: pd.DataFrame) -> pd.DataFrame:
    out = []
    for c in commands.sort_values(["at", "seq"], kind="stable").to_dict("records"):
        c = {k: None if isinstance(v, float) and v != v else v for k, v in c.items()}
        job, worker, attempt, status, ok = queue.handle(c)
        out.append((name, c["seq"], c["op"], job, worker, attempt, status, ok))
    return pd.DataFrame(out, columns=_NAMES).astype({"attempt": "Int32"})


def replayed(commands: DataFrame, **limits) -> DataFrame:
    """The events of a finished log of commands."""
    columns = ("seq", "at", "op", "job_id", "worker_id", "attempt", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, name = None, None
        for b in batches:
            out = []
            for q, *row in zip(*(b.column(c).to_pylist() for c in ("queue", *columns))):
                if queue is None or q != name:
                    queue, name = Queue(**limits), q
                c = dict(zip(columns, row))
                job, worker, attempt, status, ok = queue.handle(c)
                out.append((q, c["seq"], c["op"], job, worker, attempt, status, ok))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), _TYPES)], names=_NAMES)

    # a queue's commands lie together in one task, in order; as in the stream, what has no place comes last
    order = [F.col("queue"), F.col("at").asc_nulls_last(), F.col("seq").asc_nulls_last()]
    return commands.select("queue", *columns).repartition("queue").sortWithinPartitions(*order).mapInArrow(run, EVENTS)


def streamed(commands: DataFrame, **limits) -> DataFrame:
    """The events of a stream of commands; a queue's jobs live in its state."""
    import json

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        q = Queue(json.loads(state.get[0]) if state.exists else None, **limits)
        yield _run(q, key[0], pd.concat(list(batches)))
        state.update((json.dumps(q.jobs),))

    return commands.groupBy("queue").applyInPandasWithState(step, EVENTS, _STATE, "append", GroupStateTimeout.NoTimeout)
