"""Files that are tried again until they can be read, or are given up."""

import os
import time

from soundtally.streaming import retries

HEAD = "Time (Date hh:mm:ss.ms),LEQ dB-A\n"
NAME = "{}_2031_05_13__09h00m00s.csv"


def put(root, name, text, at):
    (root / NAME.format(name)).write_text(text)
    os.utime(root / NAME.format(name), (at, at))


def body(n, first=0):
    return "".join(f"2031-05-13 09:{first + i:02d}:00,{50 + i}\n" for i in range(n))


def states(spark, place):
    return {r["path"].split("_")[0]: (r["state"], r["attempts"], r["round"]) for r in retries.ledger(spark, place).collect()}


def counts(spark, place):
    return {r["path"].split("_")[0]: r["count"] for r in retries.loaded(spark, place).groupBy("path").count().collect()}


def test_rounds(spark, tmp_path):
    root, place = tmp_path / "in", str(tmp_path / "state")
    root.mkdir()
    assert not retries.attempt(spark, str(root), place) and retries.loaded(spark, place).count() == 0
    put(root, "good", HEAD + body(3), 100)
    put(root, "late", "x", 100)
    put(root, "bad", "x", 100)
    put(root, "empty", "", 100)
    put(root, "blank", "\n \n", 100)
    (root / "other.bin").write_text("x")
    assert retries.attempt(spark, str(root), place, clock=lambda: 1000.0)
    # an empty file isn't there yet
    assert states(spark, place) == {"good": ("loaded", 1, 1), "late": ("failed", 1, 1), "bad": ("failed", 1, 1), "blank": ("failed", 1, 1), "other.bin": ("failed", 1, 1)}
    # nothing has waited long enough
    assert not retries.attempt(spark, str(root), place, wait_ms=60_000, clock=lambda: 1059.0)
    put(root, "late", HEAD + body(4), 200)
    put(root, "good", HEAD + body(9), 200)
    assert retries.attempt(spark, str(root), place, wait_ms=60_000, clock=lambda: 1060.0)
    assert counts(spark, place) == {"good": 3, "late": 4} and states(spark, place)["late"] == ("loaded", 2, 2)
    put(root, "empty", HEAD + body(2), 300)
    assert retries.attempt(spark, str(root), place)
    assert not retries.attempt(spark, str(root), place)
    assert states(spark, place) == {"good": ("loaded", 1, 1), "late": ("loaded", 2, 2), "bad": ("rejected", 3, 3), "blank": ("rejected", 3, 3), "other.bin": ("rejected", 3, 3), "empty": ("loaded", 1, 3)}
    reasons = {r["path"].split("_")[0]: (r["attempts"], r["reason"]) for r in retries.rejects(spark, place).collect()}
    assert reasons == {"bad": (3, "no rows found"), "blank": (3, "no rows found"), "other.bin": (3, "no reader for this name")}
    # a change after that is worth one attempt more
    put(root, "bad", "y", 400)
    assert retries.attempt(spark, str(root), place) and not retries.attempt(spark, str(root), place)
    assert states(spark, place)["bad"] == ("rejected", 4, 4)
    put(root, "bad", HEAD + body(5), 500)
    assert retries.attempt(spark, str(root), place)
    assert counts(spark, place) == {"good": 3, "late": 4, "empty": 2, "bad": 5} and states(spark, place)["bad"] == ("loaded", 5, 5)


def test_a_round_that_broke_off_is_done_again(spark, tmp_path):
    root, place = tmp_path / "in", str(tmp_path / "state")
    root.mkdir()
    put(root, "good", HEAD + body(3), 100)
    retries.attempt(spark, str(root), place)
    put(root, "next", HEAD + body(2), 200)
    # rows of a second round without its states
    retries.loaded(spark, place).write.parquet(f"{place}/rows/round=2")
    assert counts(spark, place) == {"good": 3}
    retries.attempt(spark, str(root), place)
    assert counts(spark, place) == {"good": 3, "next": 2}


def test_blocks_give_all_lines_once(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    lines = [f"{i}" * (i % 50) for i in range(2000)]
    (root / "a.csv").write_text("\n".join(lines))
    parts = spark.createDataFrame([("a", str(root / "a.csv"), (root / "a.csv").stat().st_size), ("b", str(root / "none.csv"), 10)], "path string, file string, bytes long")
    got = retries.lines_of(parts, block=997).collect()
    assert [r["line"] for r in sorted((r for r in got if r["path"] == "a"), key=lambda r: r["line_no"])] == lines
    assert [r["error"].split(":")[0] for r in got if r["path"] == "b"] == ["FileNotFoundError"]


def test_a_timer_makes_rounds(spark, tmp_path):
    root, place = tmp_path / "in", str(tmp_path / "state")
    root.mkdir()
    put(root, "good", HEAD + body(3), 100)
    run = retries.follow(spark, str(root), place, every="1 second")
    try:
        for name in ("good", "next"):
            end = time.time() + 90
            while name not in states(spark, place) and time.time() < end:
                time.sleep(1)
            put(root, "next", HEAD + body(2), 200)
    finally:
        run.stop()
    assert counts(spark, place) == {"good": 3, "next": 2}
