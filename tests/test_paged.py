"""Paged sources: each record once whatever dies between pages, circles and contradictions refused, refusals for a while tried again."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from kinweave.sources import paged


def lay(root, chain, pages):
    """pages: (cursor, data, next cursor or None)."""
    for cursor, data, following in pages:
        at = root / f"chain={chain}" / f"cursor={cursor}"
        at.mkdir(parents=True)
        meta = {"has_more": following is not None, "next_cursor": following, "snapshot_at": "2024-01-01T00:10:00Z"}
        (at / "page.json").write_text(json.dumps({"data": data, "meta": meta}))


@pytest.fixture
def source(tmp_path):
    root = tmp_path / "pages"
    lay(root, "a", [("first" if i == 0 else f"c{i}", [{"id": 10 * i + j} for j in range(3)], f"c{i + 1}" if i < 6 else None) for i in range(7)])
    lay(root, "b/x".replace("/", "-"), [("first", [], None)])
    lay(root, "c", [("first", [{"id": 1000}, 7, {"no": 1}, {"id": None}], None)])
    return root


def run_once(spark, source, tmp_path, fail_at=None):
    """Runs to the end of the source, or until the batch that fails after it was written."""
    stream = paged.paged_stream(spark, str(tmp_path / "pins"), path=str(source), pagesPerStep="2")

    def write(batch, number):
        batch.write.mode("overwrite").parquet(str(tmp_path / f"rows/batch={number}"))
        if number == fail_at:
            raise RuntimeError("killed")

    run = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()


def test_a_run_killed_between_pages_goes_on_and_gives_each_record_once(spark, source, tmp_path):
    for fail_at in (0, 2):
        with pytest.raises(Exception, match="killed"):
            run_once(spark, source, tmp_path, fail_at)
    run_once(spark, source, tmp_path)
    rows = paged.parsed(spark.read.parquet(str(tmp_path / "rows")).drop("batch"), "id long", "id").collect()
    assert sorted(r.id for r in rows if r.error is None) == [*sorted(10 * i + j for i in range(7) for j in range(3)), 1000]
    assert sorted((r.record, r.error) for r in rows if r.error) == [("7", "bad_json"), ('{"id": null}', "no_key"), ('{"no": 1}', "no_key")]
    since = {r.chain: (r.complete, r.since.isoformat()) for r in paged.next_since(spark, str(tmp_path / "pins")).collect()}
    assert since == {c: (True, "2024-01-01T00:05:00") for c in ("a", "b-x", "c")}


def test_a_step_that_ends_elsewhere_when_run_again_is_refused(source, tmp_path):
    reader = paged.PagedReader({"path": str(source), "state": str(tmp_path / "pins"), "pagesPerStep": "2"})
    assert reader.latestOffset() == {"a": 1, "b-x": 1, "c": 1}
    first = [b.to_pylist() for b in reader.read(paged.Step("a", 0))]
    assert [b.to_pylist() for b in reader.read(paged.Step("a", 0))] == first and reader.latestOffset()["a"] == 2
    at = source / "chain=a" / "cursor=c1" / "page.json"
    at.write_text(at.read_text().replace('"c2"', '"c3"'))
    with pytest.raises(ValueError, match="changed under its cursors"):
        list(reader.read(paged.Step("a", 0)))
    with pytest.raises(ValueError, match="belong together"):
        list(reader.read(paged.Step("a", 5)))


def test_long_chains_take_few_steps(tmp_path):
    lay(tmp_path / "pages", "a", [("first" if i == 0 else f"c{i}", [{"id": i}], f"c{i + 1}" if i < 399 else None) for i in range(400)])
    reader = paged.PagedReader({"path": str(tmp_path / "pages"), "state": str(tmp_path / "pins"), "pagesPerStep": "2", "mostPages": "64"})
    rows, steps = [], 0
    while (last := reader.latestOffset()["a"]) > steps:
        rows.append([r["record"] for part in reader.partitions({"a": steps}, {"a": last}) for b in reader.read(part) for r in b.to_pylist()])
        steps = last
    assert [len(r) for r in rows] == [2, 4, 8, 16, 32, *[64] * 5, 18] and sum(rows, []) == [json.dumps({"id": i}) for i in range(400)]
    assert [b.to_pylist()[0]["record"] for b in reader.read(paged.Step("a", 2))] == rows[2]


def test_pages_of_a_chain_share_files(spark, tmp_path):
    rows = [("a", 3 * n, p, json.dumps({"id": 10 * n + p}, indent=1)) for n in range(10) for p in (1, 0)] + [("b", 5, 0, '{"id": "x\\ny"}')]
    paged.write_pages(spark.createDataFrame(rows, "chain string, page long, place int, record string").repartition(5), str(tmp_path / "pages"), together=4)
    assert len(list((tmp_path / "pages").rglob("*.txt"))) == 4
    reader = paged.PagedReader({"path": str(tmp_path / "pages"), "state": str(tmp_path / "pins"), "pagesPerStep": "3"})
    got, steps = {"a": [], "b": []}, {}
    while (last := reader.latestOffset()) != steps:
        for part in reader.partitions(steps, last):
            got[part.chain] += [json.loads(r["record"])["id"] for b in reader.read(part) for r in b.to_pylist()]
        steps = last
    assert got == {"a": [10 * n + p for n in range(10) for p in (0, 1)], "b": ["x\ny"]}


@pytest.mark.parametrize("tail,length", [(0, 1), (0, 5), (3, 1), (10, 7), (50, 20)])
def test_circles_are_found_within_three_times_their_pages(tail, length):
    pin, n = paged.PagedReader({"path": "", "state": ""})._pin("x", 0), 0
    with pytest.raises(ValueError, match="circle"):
        while True:
            at = n + 1 if n + 1 < tail + length else tail + (n + 1 - tail) % length
            pin, n = paged.follow(pin, {"has_more": True, "next_cursor": f"c{at}"}, "x"), n + 1
            assert n <= 3 * (tail + length) + 3
    with pytest.raises(ValueError, match="names no cursor"):
        paged.follow(paged.PagedReader({"path": "", "state": ""})._pin("x", 0), {"has_more": True, "next_cursor": None}, "x")


def test_http_pages_are_asked_again_after_a_refusal_for_a_while(monkeypatch):
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((self.path, self.headers["Authorization"]))
            code = 503 if len(asked) == 1 else 404 if "gone" in self.path else 200
            self.send_response(code)
            self.end_headers()
            if code == 200:
                self.wfile.write(b'{"data": [{"id": 1}], "meta": {"has_more": false}}')

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setattr(paged, "WAIT_SECONDS", 0)
    monkeypatch.setenv("PAGES_AUTH", "Basic x")
    try:
        pages = paged.HttpPages(f"http://127.0.0.1:{server.server_port}/in", ["users", "gone"], 2, "PAGES_AUTH")
        assert pages.page("users", None, "2024-01-01")["data"] == [{"id": 1}]
        assert pages.page("users", "k 1", "2024-01-01")["meta"] == {"has_more": False}
        assert [p for p, _ in asked] == ["/in/users?limit=2&updated_since=2024-01-01"] * 2 + ["/in/users?limit=2&cursor=k+1"] and asked[0][1] == "Basic x"
        with pytest.raises(Exception, match="404"):
            pages.page("gone", None, None)
        assert len(asked) == 4
    finally:
        server.shutdown()
    with pytest.raises(ValueError, match="https"):
        paged.HttpPages("http://example.org", [], 2, "").page("users", None, None)


def test_tries_are_kept_as_state_until_a_record_succeeds_or_dies(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("k string, failed boolean").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = paged.retry_state(stream, "k", most=2)
    run = out.writeStream.format("parquet").option("path", str(tmp_path / "rows")).option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for i, batch in enumerate([[("a", True), ("b", True), ("c", False)], [("a", True), ("b", False), ("b", True)], [("a", True), ("b", True), (None, None)]]):
            (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"k": k, "failed": f}) for k, f in batch))
            run.processAllAvailable()
    finally:
        run.stop()
    got = spark.read.parquet(str(tmp_path / "rows")).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("tries", "status"))).alias("s")).collect()
    seen = {r.k: [tuple(x) for x in r.s] for r in got}
    assert seen == {"a": [(1, "retry"), (2, "retry"), (3, "dead")], "b": [(1, "done"), (1, "retry"), (1, "retry")], "c": [(0, "done")], None: [(1, "retry")]}
