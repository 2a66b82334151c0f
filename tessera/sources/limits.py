"""Work on single files in a process of its own, which is ended and replaced when a file takes too long."""

from __future__ import annotations

import gc
import multiprocessing
import os
import time
from collections.abc import Callable

#: Seconds in which a forked process says that it is there; else another one takes its place, so many times.
READY_SECONDS, FORKS = 20.0, 5
#: Seconds between two looks at what a process has used.
LOOK = 0.25
#: Bytes of a file for which a function gets its seconds.
MB = 1 << 20


def _used(pid: int) -> float | None:
    """CPU seconds of a process; None where /proc doesn't tell."""
    try:
        with open(f"/proc/{pid}/stat") as f:
            fields = f.read().rpartition(")")[2].split()
    except OSError:
        return None
    return (int(fields[11]) + int(fields[12])) / os.sysconf("SC_CLK_TCK")


class Limited:
    """A function of bytes that gets at most so many seconds for each MB of them, begun ones counted: of its process' CPU time, so that
    what it gives doesn't depend on how busy the machine is. A process that stands still for as long is replaced, once. It is forked when it
    is first needed, or by `begin`, and serves one file after the other, or many at once. Use it as a context, so that it ends with the task."""

    def __init__(self, function: Callable[[bytes], object], seconds: float):
        self.function, self.seconds = function, seconds
        self._process = self._pipe = None

    def __enter__(self) -> Limited:
        return self

    def __exit__(self, *_) -> None:
        self._end()

    def _end(self) -> None:
        if self._process is not None:
            self._pipe.close()
            self._process.kill()
            self._process.join()
            self._process = None

    def begin(self) -> None:
        """A process that has said that it is there: one that was forked while another thread held a lock may never do."""
        fork = multiprocessing.get_context("fork")
        for _ in range(FORKS):
            self._pipe, theirs = fork.Pipe()
            self._process = fork.Process(target=_serve, args=(self.function, theirs, self._pipe), daemon=True)
            self._process.start()
            theirs.close()
            try:
                if self._pipe.poll(READY_SECONDS):
                    self._pipe.recv_bytes()
                    return
            except (EOFError, OSError):
                pass
            self._end()
        raise RuntimeError("no process could be started for a file")

    def _waited(self, seconds: float) -> str:
        """Waits for an answer: ok, or timed_out if the process has used its seconds, or stands_still if it has for as long."""
        look = min(LOOK, seconds / 2)
        if self._pipe.poll(look):
            return "ok"
        first = used = _used(self._process.pid)
        began = still = time.monotonic()
        while not self._pipe.poll(look):
            now, seen = time.monotonic(), _used(self._process.pid)
            if first is None or seen is None:
                if now - began >= seconds:
                    return "ok" if self._pipe.poll(0) else "timed_out"
                continue
            if seen != used:
                used, still = seen, now
            if used - first >= seconds or now - still >= seconds:
                return "ok" if self._pipe.poll(0) else "timed_out" if used - first >= seconds else "stands_still"
        return "ok"

    def _asked(self, files: list[bytes], times: int) -> tuple[str, list[tuple[str, object]]]:
        """ok and the answers, if a process gives them in time; so many processes are tried."""
        seconds = self.seconds * (1 + sum(map(len, files)) // MB)
        for _ in range(times):  # a process may have been ended or stopped from outside, for want of memory
            if self._process is None:
                self.begin()
            try:
                self._pipe.send(files)
                status = self._waited(seconds)
                if status == "ok":
                    return status, self._pipe.recv()
            except (EOFError, OSError):
                status = "failed"
            self._end()
            if status == "timed_out":
                break
        return status, []

    def __call__(self, data: bytes) -> tuple[str, object]:
        """ok and the result; failed (the function raised an error, or two processes died of it) or timed_out, and None."""
        status, found = self._asked([data], 2)
        return found[0] if found else ("failed" if status == "failed" else "timed_out", None)

    def many(self, files: list[bytes]) -> list[tuple[str, object]]:
        """The same for each of some files: all at once, or one by one if that doesn't go well."""
        return (self._asked(files, 1)[1] if len(files) > 1 else []) or [self(x) for x in files]


def _serve(function: Callable[[bytes], object], pipe, other) -> None:
    other.close()
    gc.freeze()  # what came with the fork isn't looked through again
    try:
        pipe.send_bytes(b"here")
        while True:
            answers = []
            for data in pipe.recv():
                try:
                    answers.append(("ok", function(data)))
                except Exception:  # whatever a file makes of the function, the next one is read
                    answers.append(("failed", None))
            pipe.send(answers)
    except (EOFError, OSError):
        pass
    finally:
        os._exit(0)
