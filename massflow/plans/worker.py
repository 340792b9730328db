"""Runs one prepared job: ``python -m massflow.plans.worker DIRECTORY``.

The last line of its output is its status as JSON."""

from __future__ import annotations

import json
import os
import platform
import re
import resource
import sys
import time
import traceback
import uuid
from pathlib import Path
from typing import Any

from massflow.plans import artifacts, jobs
from massflow.sources.files import json_safe, write_json


def peak_kb(pid: int | None) -> int | None:
    """The most memory that a process has had resident."""
    try:
        found = re.search(r"VmHWM:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())
    except OSError:
        return None
    return int(found[1]) if found else None


def execute(home: Path, request: dict[str, Any]) -> dict[str, Any]:
    """Run or reuse; failed and interrupted attempts stay beside the result."""
    jobs.verify(request)
    with artifacts.locked(home / "job.lock"):
        found = jobs.result(home, request)
        if found is not None:
            return {"status": "cached", "output": str(found)}
        attempts = home / "attempts"
        attempts.mkdir(exist_ok=True)
        for old in attempts.glob("*/status.json"):  # the lock is held: whatever ran is gone
            if json.loads(old.read_text())["status"] == "running":
                write_json(old, {"status": "interrupted", "id": request["id"]})
        own = attempts / uuid.uuid4().hex
        own.mkdir()
        write_json(own / "status.json", {"status": "running", "id": request["id"], "pid": os.getpid()})
        began, before = time.perf_counter(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        try:
            from massflow.session import build

            spark = build("job", os.environ.get("MASSFLOW_MASTER") or None, 8)
            jvm = spark.sparkContext._jvm.java.lang.ProcessHandle.current().pid()
            made = jobs.TYPES[request["identity"]["type"]][1](spark, request["identity"]["params"], own)
            memory = {"before_kb": before, "driver_kb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, "jvm_kb": peak_kb(jvm)}
            spark.stop()
            jobs.verify(request)
            write_json(own / "task.json", json_safe(made))
            write_json(own / "execution.json", {"seconds": time.perf_counter() - began, "pid": os.getpid(), "platform": platform.platform(), "threads": request["identity"]["threads"], "peak_memory": memory})
            write_json(own / "status.json", {"status": "completed", "id": request["id"], "pid": os.getpid()})
            write_json(home / "result.json", {"attempt": own.name, "digest": artifacts.seal(own), "id": request["id"]})
        except BaseException as e:
            write_json(own / "status.json", {"status": "interrupted" if isinstance(e, KeyboardInterrupt) else "failed", "id": request["id"], "error": type(e).__name__, "message": str(e)[:2000]})
            (own / "failure.txt").write_text(traceback.format_exc())
            raise
        return {"status": "completed", "output": str(own)}


def main(argv: list[str]) -> int:
    home = Path(argv[0]).resolve()
    print(json.dumps(execute(home, json.loads((home / "request.json").read_text()))), flush=True)
    return 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
