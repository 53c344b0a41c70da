import json
import os

import pytest
from pyspark.sql import functions as F

from skeinwatch.sources import logs, tail


def drained(spark, folder, state, pattern="*"):
    """All lines followed so far, after one more drain from the checkpoint in `state`."""
    q = (
        tail.follow_lines(spark, str(folder), pattern).writeStream.format("parquet")
        .option("checkpointLocation", str(state / "position")).trigger(availableNow=True).start(str(state / "out"))
    )
    q.awaitTermination()
    rows = spark.read.schema("value string, seq long, file string, byte long").parquet(str(state / "out")).collect()
    return sorted((r["file"], r["byte"], r["value"], r["seq"]) for r in rows)


def test_growing_and_rotated_files_give_each_line_once(spark, tmp_path):
    folder, state = tmp_path / "logs", tmp_path / "state"
    folder.mkdir(), state.mkdir()
    log = folder / "conn.log"
    log.write_bytes(b'{"uid": "a"}\n{"uid": "a"}\n{"ui')
    first = drained(spark, folder, state)
    assert [r[2] for r in first] == ['{"uid": "a"}'] * 2
    assert len({r[3] for r in first}) == 2  # equal lines, two numbers
    with open(log, "ab") as f:
        f.write(b'd": "b"}\n')
    assert [r[2] for r in drained(spark, folder, state)][2:] == ['{"uid": "b"}']
    with open(log, "ab") as f:
        f.write(b'{"uid": "c"}\n')
    os.rename(log, folder / "conn.1.log")
    log.write_bytes(b'{"uid": "d"}\n')
    every = drained(spark, folder, state)
    assert sorted(json.loads(r[2])["uid"] for r in every) == ["a", "a", "b", "c", "d"]
    assert drained(spark, folder, state) == every  # nothing new, nothing twice
    batch = tail.scan_lines(spark, str(folder), split_bytes=9).collect()
    assert sorted((r["file"], r["byte"], r["value"], r["seq"]) for r in batch) == every


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_ranges_own_the_lines_that_start_in_them(spark, tmp_path, split):
    lines = ["", "x" * 40, "é中", "#", "last", "", "y"]
    (tmp_path / "a.log").write_bytes("\n".join(lines).encode())  # no end of line at the end
    (tmp_path / "b.log").write_bytes(b"one\r\ntwo\xff\n")
    (tmp_path / "c.log").write_bytes(b"")
    (tmp_path / "d.txt").write_bytes(b"other\n")
    got = tail.scan_lines(spark, str(tmp_path), "*.log", split).orderBy("file", "byte").collect()
    by_file = {}
    for r in got:
        by_file.setdefault(r["file"], []).append(r["value"])
    assert sorted(by_file.values()) == sorted([lines, ["one", "two�"]])
    assert len({r["seq"] for r in got}) == len(got)


def test_an_empty_folder_gives_no_rows(spark, tmp_path):
    assert tail.scan_lines(spark, str(tmp_path)).count() == 0


def test_a_replaced_file_starts_anew(spark, tmp_path):
    folder, state = tmp_path / "logs", tmp_path / "state"
    folder.mkdir(), state.mkdir()
    log = folder / "dns.log"
    log.write_bytes(b"old 1\nold 2\nold 3\n")
    drained(spark, folder, state)
    log.write_bytes(b"new 1\nnew 2\n")  # cut short and written anew, in place
    assert [r[2] for r in drained(spark, folder, state)].count("new 1") == 1


def test_records_keep_their_numbers_over_runs_and_splits(spark, tmp_path):
    entry = {"ts": 1704067200.5, "uid": "C1", "id.orig_h": "10.0.0.1", "id.resp_h": "10.0.0.2", "proto": "tcp"}
    (tmp_path / "conn.log").write_text("#open\n" + (json.dumps(entry) + "\n") * 3)
    runs = [
        sorted(r["seq"] for r in logs.normalize_lines(tail.scan_lines(spark, str(tmp_path), split_bytes=n), "conn").select("seq").collect())
        for n in (50, 1 << 20)
    ]
    assert runs[0] == runs[1] and len(set(runs[0])) == 3
    assert max(runs[0]) * 3 + 2 < 1 << 63
