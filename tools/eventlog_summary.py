"""Per-query figures from a Spark event log written by ``bench.py`` (``BENCH_EVENT_LOG_DIR``):
jobs, stages, tasks, input rows, shuffle bytes written and summed task time, per job group.

    python tools/eventlog_summary.py <event-log-file-or-dir>
"""

from __future__ import annotations

import io
import json
import os
import sys
from collections import defaultdict


def _files(path: str) -> list[str]:
    """Event files under ``path`` (Spark 4 writes a folder of rolling, zstd-compressed files)."""
    if not os.path.isdir(path):
        return [path]
    found = []
    for root, _, names in os.walk(path):
        found += [os.path.join(root, n) for n in names if n.startswith("events") or n.startswith("local-")]
    return sorted(found)


def _lines(name: str):
    if name.endswith(".zstd"):
        import zstandard

        with open(name, "rb") as raw:
            reader = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
            yield from io.TextIOWrapper(reader, encoding="utf-8")
    else:
        with open(name) as fh:
            yield from fh


def summarise(path: str) -> dict[str, dict[str, float]]:
    stage_group: dict[int, str] = {}
    out: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    for name in _files(path):
        for line in _lines(name):
            ev = json.loads(line)
            kind = ev.get("Event")
            if kind == "SparkListenerJobStart":
                group = (ev.get("Properties") or {}).get("spark.jobGroup.id") or "(none)"
                out[group]["jobs"] += 1
                for sid in ev.get("Stage IDs", []):
                    stage_group[sid] = group
            elif kind == "SparkListenerStageCompleted":
                info = ev["Stage Info"]
                group = stage_group.get(info["Stage ID"], "(none)")
                out[group]["stages"] += 1
                out[group]["tasks"] += info.get("Number of Tasks", 0)
            elif kind == "SparkListenerTaskEnd":
                group = stage_group.get(ev.get("Stage ID"), "(none)")
                m = ev.get("Task Metrics") or {}
                out[group]["input_rows"] += (m.get("Input Metrics") or {}).get("Records Read", 0)
                out[group]["shuffle_bytes_written"] += (m.get("Shuffle Write Metrics") or {}).get(
                    "Shuffle Bytes Written", 0)
                out[group]["task_ms"] += m.get("Executor Run Time", 0)
    return {g: dict(v) for g, v in out.items()}


def main() -> None:
    for group, figures in sorted(summarise(sys.argv[1]).items()):
        print(json.dumps({"query": group, **{k: int(v) for k, v in figures.items()}}))


if __name__ == "__main__":
    main()
