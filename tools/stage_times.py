"""Summarise stage times from a Spark event log folder (e.g. written by BENCH_EVENT_LOG).

Usage: ``python tools/stage_times.py <event-log-folder> [top]``. Reads plain or zstd-compressed
event files; prints the total stage time and the slowest stages.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys


def _lines(path: str):
    with open(path, "rb") as fh:
        if path.endswith(".zstd"):
            import zstandard
            data = zstandard.ZstdDecompressor().stream_reader(fh, read_across_frames=True).read()
        else:
            data = fh.read()
    yield from io.StringIO(data.decode("utf-8", "replace"))


def main() -> None:
    folder, top = sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 10
    files = [f for f in glob.glob(os.path.join(folder, "**", "events_*"), recursive=True) if os.path.isfile(f)]
    stages, desc = [], {}
    for f in sorted(files):
        for line in _lines(f):
            if '"SparkListenerStageSubmitted"' in line:
                e = json.loads(line)
                props = e.get("Properties") or {}
                desc[e["Stage Info"]["Stage ID"]] = props.get("spark.job.description", "")
            elif '"SparkListenerStageCompleted"' in line:
                info = json.loads(line)["Stage Info"]
                stages.append((info["Completion Time"] - info["Submission Time"], info["Number of Tasks"],
                               desc.get(info["Stage ID"], ""), info["Stage Name"][:60]))
    print(f"{len(stages)} stages, {sum(s[0] for s in stages) / 1000:.1f} s of stage time")
    per_query: dict[str, list] = {}
    for ms, tasks, d, _ in stages:
        agg = per_query.setdefault(d or "(untagged)", [0, 0, 0])
        agg[0] += ms
        agg[1] += 1
        agg[2] += tasks
    print("\nper job description: stage seconds, stages, tasks")
    for d, (ms, n, tasks) in sorted(per_query.items(), key=lambda kv: -kv[1][0]):
        print(f"{ms / 1000:7.2f} s  {n:4d} stages  {tasks:6d} tasks  {d}")
    print("\nslowest stages")
    for ms, tasks, d, name in sorted(stages, reverse=True)[:top]:
        print(f"{ms / 1000:7.2f} s  {tasks:5d} tasks  [{d}] {name}")


if __name__ == "__main__":
    main()
