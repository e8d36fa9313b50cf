"""Print stage durations from a Spark event log folder (plain or zstd).

usage: python tools/stage_times.py <event log dir> [top_n]
(the bench writes one with BENCH_EVENT_LOG=<dir>)
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys


def _lines(path: str):
    if path.endswith(".zstd") or path.endswith(".zst"):
        import zstandard
        with open(path, "rb") as f:
            reader = zstandard.ZstdDecompressor().stream_reader(f)
            yield from io.TextIOWrapper(reader, encoding="utf-8")
    else:
        with open(path, encoding="utf-8") as f:
            yield from f


def stage_times(folder: str):
    files = [p for p in glob.glob(os.path.join(folder, "**", "*"), recursive=True)
             if os.path.isfile(p) and "appstatus" not in os.path.basename(p)]
    out = []
    for p in sorted(files):
        for line in _lines(p):
            e = json.loads(line)
            if e.get("Event") == "SparkListenerStageCompleted":
                i = e["Stage Info"]
                dur = i.get("Completion Time", 0) - i.get("Submission Time", 0)
                out.append((dur, i["Stage ID"], i["Number of Tasks"], i["Stage Name"][:60]))
    return out


def main() -> None:
    folder = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    st = stage_times(folder)
    print(f"{len(st)} stages, {sum(s[0] for s in st) / 1000:.2f} s in total")
    for dur, sid, ntasks, name in sorted(st, reverse=True)[:top]:
        print(f"{dur / 1000:7.3f} s  stage {sid:4d}  {ntasks:4d} tasks  {name}")


if __name__ == "__main__":
    main()
