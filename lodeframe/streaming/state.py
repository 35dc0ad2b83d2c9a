"""Index state and the run lock of a project and scope; small files beside the tables, on the driver."""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from contextlib import contextmanager
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError

#: A lease lasts so many seconds and is renewed after so many.
LEASE_S, RENEW_S = 30 * 60, 10 * 60
EMPTY = {"state": "idle", "needs_reindex": True, "pending_changes": False, "watcher_state": "stopped", "index_run_id": None, "last_indexed_at": None, "last_error": None, "errors": 0, "files_indexed": 0, "files_total": 0, "config": None, "progress": None}


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


class LocalFiles:
    """Small files of a local folder."""

    def read(self, path: str) -> str | None:
        try:
            return Path(path).read_text()
        except OSError:
            return None

    def write(self, path: str, text: str) -> None:
        """Whole or not at all."""
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        trial = f"{path}-{uuid.uuid4().hex}.tmp"
        Path(trial).write_text(text)
        os.replace(trial, path)

    def create(self, path: str, text: str) -> bool:
        """False if the file is there already."""
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        trial = f"{path}-{uuid.uuid4().hex}.tmp"
        Path(trial).write_text(text)
        try:
            os.link(trial, path)  # with its content at once
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(trial)

    def move(self, path: str, to: str) -> bool:
        """False if the file has gone."""
        try:
            os.rename(path, to)
            return True
        except FileNotFoundError:
            return False

    def delete(self, path: str) -> None:
        Path(path).unlink(missing_ok=True)


class HadoopFiles:
    """The same for any folder that Spark's file systems open."""

    def __init__(self, spark):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def read(self, path: str) -> str | None:
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, path: str, text: str, over: bool) -> None:
        fs, p = self._at(path)
        stream = fs.create(p, over)
        stream.write(bytearray(text.encode()))
        stream.close()

    def write(self, path: str, text: str) -> None:
        trial = f"{path}-{uuid.uuid4().hex}.tmp"
        self._put(trial, text, True)
        fs, p = self._at(path)
        fs.delete(p, False)
        fs.rename(self._at(trial)[1], p)

    def create(self, path: str, text: str) -> bool:
        fs, p = self._at(path)
        try:
            if fs.exists(p):
                return False
            self._put(path, text, False)
            return True
        except Exception:  # noqa: BLE001 - another has made it meanwhile
            return False

    def move(self, path: str, to: str) -> bool:
        fs, p = self._at(path)
        return bool(fs.exists(p) and fs.rename(p, self._at(to)[1]))

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, False)


def files_for(folder: str, spark=None):
    """Local files for a local folder, else those of Spark's file systems."""
    local = "://" not in folder and not folder.startswith("file:")
    return LocalFiles() if local or spark is None else HadoopFiles(spark)


class State:
    def __init__(self, folder: str, clock=time.time, files=None):
        self.folder, self.clock, self.files = folder.rstrip("/"), clock, files or files_for(folder)

    @property
    def lock(self) -> str:
        return f"{self.folder}/run.lock"

    def read(self) -> dict:
        try:
            return EMPTY | json.loads(self.files.read(f"{self.folder}/status.json") or "{}")
        except ValueError:
            return dict(EMPTY)

    def write(self, **changes) -> dict:
        row = self.read() | changes
        self.files.write(f"{self.folder}/status.json", json.dumps(row))
        return row

    def _holder(self, text: str | None) -> dict | None:
        """Who holds a live lease in the text of a lock; null if it has run out or can't be read."""
        try:
            held = json.loads(text or "")
            return held if held["expires"] > self.clock() else None
        except (ValueError, KeyError, TypeError):
            return None

    def _lease(self) -> dict | None:
        return self._holder(self.files.read(self.lock))

    def _claim(self, run_id: str) -> str:
        return json.dumps({"run": run_id, "pid": os.getpid(), "expires": self.clock() + LEASE_S})

    def acquire(self, run_id: str) -> None:
        """Take the run lock; an expired or malformed one is taken over. It is moved away first, and given back if it turns out to be another's live one, so of two starters that see an expired lock one gets it."""
        busy = EngineError("ALREADY_RUNNING", "another run holds the lock")
        if self._lease():
            raise busy
        away = f"{self.lock}-{uuid.uuid4().hex}.stale"
        if self.files.read(self.lock) is not None and self.files.move(self.lock, away):
            if self._holder(self.files.read(away)):
                self.files.create(self.lock, self.files.read(away))
                self.files.delete(away)
                raise busy
            self.files.delete(away)
        if not self.files.create(self.lock, self._claim(run_id)):
            raise busy

    def renew(self, run_id: str) -> None:
        self.assert_owned(run_id)
        self.files.write(self.lock, self._claim(run_id))

    def assert_owned(self, run_id: str) -> None:
        held = self._lease()
        if not held or held["run"] != run_id:
            raise EngineError("LOCK_LOST", "the run lock is not ours")

    def release(self, run_id: str) -> None:
        held = self._lease()
        if held and held["run"] == run_id:
            self.files.delete(self.lock)

    @contextmanager
    def held(self, run_id: str, every: float = RENEW_S):
        """The lock for the time of a run, renewed as it goes on."""
        self.acquire(run_id)
        done = threading.Event()

        def keep() -> None:
            while not done.wait(every):
                try:
                    self.renew(run_id)
                except EngineError:
                    return  # the run finds out by itself

        thread = threading.Thread(target=keep, daemon=True)
        thread.start()
        try:
            yield
        finally:
            done.set()
            thread.join()
            self.release(run_id)

    def recover(self) -> bool:
        """A running state without a live lock is an error and needs a new index."""
        if self.read()["state"] == "running" and not self._lease():
            self.write(state="error", needs_reindex=True, last_error="stale run")
            return True
        return False

    def running(self, run_id: str) -> None:
        self.write(state="running", index_run_id=run_id, pending_changes=False, needs_reindex=False, last_error=None)

    def progress(self, run_id: str, stage: str, done: int, total: int, **counters) -> None:
        """A checkpoint of a run: what it has finished, and its counts so far."""
        self.write(progress={"run": run_id, "stage": stage, "done": done, "total": total, "at": now()}, **counters)

    def completed(self, run_id: str, counters: dict, config: str | None = None) -> None:
        again = self.read()["pending_changes"]
        self.write(state="idle", index_run_id=run_id, last_indexed_at=now(), needs_reindex=again, last_error=None, config=config, progress=None, **counters)

    def failed(self, message: str) -> None:
        self.write(state="error", needs_reindex=True, last_error=message, errors=1, files_indexed=0, files_total=0)

    def pending(self) -> None:
        self.write(needs_reindex=True, pending_changes=True, watcher_state="watching")

    def watcher_failed(self, message: str) -> None:
        self.write(watcher_state="error", last_error=message, needs_reindex=True)

    def status(self, config: str | None = None) -> dict:
        row = self.read()
        changed = config is not None and row["config"] is not None and row["config"] != config
        if changed:
            row |= {"last_error": None, "errors": 0}
        row["needs_reindex"] = bool(row["needs_reindex"] or row["pending_changes"] or row["watcher_state"] == "error" or changed)
        return row

    @staticmethod
    def needs_reindex(stored: Column, pending: Column, watcher: Column, changed: Column) -> Column:
        """The same rule over columns of many indexes' states."""
        return F.coalesce(stored, F.lit(True)) | F.coalesce(pending, F.lit(False)) | F.coalesce(watcher == "error", F.lit(False)) | F.coalesce(changed, F.lit(False))

    def require_ready(self, code: str = "INDEX_NOT_READY") -> None:
        row = self.status()
        if row["last_indexed_at"] is None or row["needs_reindex"] or row["state"] == "error":
            raise EngineError(code, "the index is not ready")
