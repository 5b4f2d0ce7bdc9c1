"""Batches of engines, servers of executors, and review sessions."""

import os
import sys
import time

import pytest

from folium.models import answers, engines, keeper, server
from folium.operators import review


class Holds(engines.LengthEngine):
    """Holds three images; x is no image."""

    name, batch = "holds", 16

    def __init__(self):
        self.asked = []

    def read_batch(self, images):
        self.asked.append(len(images))
        if len(images) > 3:
            raise RuntimeError("device: out of memory")
        if b"x" in images:
            raise ValueError("no image")
        return super().read_batch(images)


def test_batches_halve_and_stay_small():
    reader = Holds()
    batches = engines.Batches(reader)
    rows = list(batches.rows([b"a" * k for k in range(2, 12)]))
    assert [r[0] for r in rows] == [f"{k} bytes" for k in range(2, 12)] and {r[3] for r in rows} == {None}
    assert reader.asked == [10, 5, 2, 2, 2, 2, 2] and batches.size == 2
    assert list(batches.rows([])) == []


def test_a_broken_image_fails_alone():
    rows = list(engines.Batches(Holds()).rows([b"aa", b"x", b"bb"]))
    assert [(r[0], r[3], r[6]) for r in rows] == [("2 bytes", None, 1), ("", "no image", 1), ("2 bytes", None, 1)]


def test_an_image_that_memory_never_holds_is_an_error():
    class Full(engines.LengthEngine):
        batch = 4

        def read_batch(self, images):
            if len(images) > 1 or images == [b"big"]:
                raise MemoryError("full")
            return super().read_batch(images)

    rows = list(engines.Batches(Full()).rows([b"a", b"big", b"b"]))
    assert [(r[0], r[3]) for r in rows] == [("1 bytes", None), ("", "full"), ("1 bytes", None)]


def test_too_few_results_are_no_batch():
    class Short(engines.LengthEngine):
        batch = 4

        def read_batch(self, images):
            return super().read_batch(images)[:1]

    assert [r[0] for r in engines.Batches(Short()).rows([b"a", b"bb"])] == ["1 bytes", "2 bytes"]


def test_pages_of_an_engine_that_is_handed_over(spark):
    class Few(engines.LengthEngine):
        batch = 16

        def read_batch(self, images):
            if len(images) > 3:
                raise MemoryError
            return super().read_batch(images)

    pages = spark.createDataFrame([(k, b"a" * k if k else None) for k in range(9)], "page int, image binary").coalesce(1)
    rows = engines.read_pages(pages, Few).collect()
    assert {r.page: (r.text, r.error) for r in rows} == {k: (f"{k} bytes", None) for k in range(9)} and max(r.batch_size for r in rows) <= 3


# Tells its process; asked to die it ends without an answer, asked for half with half of one, but once only for each file. Asked for junk it gives no JSON.
MORTAL = """
import http.server, json, os, sys
class H(http.server.BaseHTTPRequestHandler):
    def do_GET(self): self.answer(b"ok")
    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][0]["content"][-1]["text"]
        if asked.startswith("die ") and not os.path.exists(asked[4:]):
            open(asked[4:], "w").close()
            os._exit(1)
        if asked.startswith("half ") and not os.path.exists(asked[5:]):
            open(asked[5:], "w").close()
            self.answer(b'{"choices": [')
            self.wfile.flush()
            os._exit(1)
        if asked == "junk":
            return self.answer(b"junk")
        self.answer(json.dumps({"choices": [{"message": {"content": str(os.getpid())}}]}).encode())
    def answer(self, body): self.send_response(200); self.end_headers(); self.wfile.write(body)
    def log_message(self, *a): pass
http.server.ThreadingHTTPServer(("127.0.0.1", int(sys.argv[1])), H).serve_forever()
"""
COMMAND = [sys.executable, "-c", MORTAL, "{port}"]


def alive(pid):
    try:
        with open(f"/proc/{pid}/stat") as f:
            return f.read().rsplit(")", 1)[1].split()[0] != "Z"
    except OSError:
        return False


def ended(pid, seconds=15):
    end = time.monotonic() + seconds
    while alive(pid) and time.monotonic() < end:
        time.sleep(0.1)
    return not alive(pid)


def test_workers_of_an_executor_share_a_server(tmp_path):
    own = f"test-{os.getpid()}"
    one, two = (server.ExecutorModel(COMMAND, linger=0.5, executor=f"{own}-a") for _ in range(2))
    other = server.ExecutorModel(COMMAND, linger=0.5, executor=f"{own}-b")
    first = one("who", None)
    assert first == two("who", None) != other("who", None)
    # It ends over a page: a new one answers that page, and the other worker.
    second = one(f"die {tmp_path / 'once'}", None)
    assert second != first and two("who", None) == second and ended(int(first))
    third = one(f"half {tmp_path / 'half'}", None)
    assert third != second and two("who", None) == third
    with pytest.raises(ValueError):
        one("junk", None)
    # It stays as long as one holds on to it.
    one.held.close()
    time.sleep(1.5)
    assert two("who", None) == third
    two.held.close()
    assert ended(int(third))
    other.held.close()


def test_a_server_that_never_starts_is_the_pages_error():
    model = server.ExecutorModel([sys.executable, "-c", "raise SystemExit('no model')"], linger=0.1, executor=f"test-{os.getpid()}-c")
    with pytest.raises(RuntimeError, match="no model"):
        model("who", None)
    model.held.close()


def test_one_server_of_all_partitions_that_is_killed_midway(spark, tmp_path):
    rows = [(str(k), 1, "s", None, f"die {tmp_path / 'job'}" if k == 9 else "who") for k in range(40)]
    pages = spark.createDataFrame(rows, "document_id string, page int, source string, image binary, prompt string").repartition(4)
    got = answers.ask_each(pages, server.executor_model(COMMAND, linger=2.0)).collect()
    assert len(got) == 40 and [r.error for r in got if r.error] == []
    pids = {r.text for r in got}
    assert len(pids) <= 2 and all(ended(int(p)) for p in pids)


def test_a_second_keeper_ends_at_once():
    model = server.ExecutorModel(COMMAND, linger=0.5, executor=f"test-{os.getpid()}-d")
    model("who", None)
    assert keeper.keep(model.held.name, COMMAND, "/", 10, 60) is None
    model.held.close()


def test_a_review_keeps_its_rows_until_a_save(spark, tmp_path):
    path = str(tmp_path / "records")
    read = []

    def load():
        read.append(1)
        return spark.read.parquet(path)

    def write(subject):
        spark.createDataFrame([("/r/vlm/a.json", subject)], "file_path string, subject string").write.mode("overwrite").parquet(path)

    write("old")
    with review.Session(load) as s:
        rows = s.rows()
        assert rows.first().subject == "old" and s.rows() is rows and len(read) == 1
        assert rows.storageLevel.useMemory and rows.storageLevel.useDisk
        s.save(lambda: write("new"))
        assert not rows.storageLevel.useMemory and s.rows().first().subject == "new" and len(read) == 2
        with pytest.raises(ZeroDivisionError):
            s.save(lambda: 1 / 0)
        assert s.rows().first().subject == "new" and len(read) == 3
        last = s.rows()
    assert not last.storageLevel.useMemory
