"""Data sources over folders: batches, streams with a restart, blocks of large files, and a document that is whole or not there."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from mergelake.operators import blocks, parse
from mergelake.sources import files


@pytest.fixture(scope="module")
def sources(spark):
    files.register(spark)
    return spark


def put(folder, name, text):
    with open(folder / name, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


def test_listings(sources, tmp_path):
    put(tmp_path, "a", "UU src/x.go\n M  y \n\nAA\nUU é.py")
    put(tmp_path, "b", "")
    put(tmp_path, "_hidden", "UU z\n")
    got = sorted(tuple(r)[1:] for r in sources.read.format("merge_listing").load(str(tmp_path)).collect())
    assert got == [(1, "UU", "src/x.go"), (2, " M", "y"), (5, "UU", "é.py")]
    assert sources.read.format("merge_listing").load(f"file://{tmp_path}").count() == 3


def test_documents_are_read_as_a_stream_and_after_a_restart(sources, tmp_path):
    """Two files a batch; the stream stops, more files come, and a restart takes up those alone."""
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    texts = {f"p{k:02}.json": json.dumps({"k": k}) for k in range(5)}
    for n, t in texts.items():
        put(folder, n, t)

    def run():
        stream = sources.readStream.format("merge_documents").option("filesPerBatch", 2).load(str(folder))
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
        q.processAllAvailable()
        batches = len({p["batchId"] for p in q.recentProgress if p["numInputRows"]})
        q.stop()
        return batches

    assert run() == 3
    texts |= {f"p{k:02}.json": json.dumps({"k": k}) for k in range(5, 8)}
    for k in range(5, 8):
        put(folder, f"p{k:02}.json", texts[f"p{k:02}.json"])
    assert run() == 2 and run() == 0  # and nothing is taken twice
    got = [(os.path.basename(r.path), r.text) for r in sources.read.parquet(out).collect()]
    assert sorted(got) == sorted(texts.items())
    listing = sources.readStream.format("merge_listing").load(str(folder))
    assert listing.isStreaming and listing.columns == ["listing", "line_no", "status", "path"]


@pytest.mark.parametrize("range_bytes,lines", [(13, 1), (64, 3), (1 << 20, 10_000)])
def test_blocks_hold_the_lines_of_the_files(sources, tmp_path, range_bytes, lines):
    r = random.Random(range_bytes)
    texts = {f"f{k}": "\n".join(r.choice(["<<<<<<< a", "=======", ">>>>>>> b", "x", "", "é", "\r"]) for _ in range(r.randrange(30))) + r.choice(["", "\n"]) for k in range(3)} | {"empty": "", "feed": "\n", "feeds": "\n\n\n"}
    for n, t in texts.items():
        put(tmp_path, n, t)
    got = sources.read.format("merge_blocks").option("rangeBytes", range_bytes).option("blockLines", lines).load(str(tmp_path))
    whole = {}
    for row in sorted(got.collect(), key=lambda r: r.block):
        assert 0 < len(row.lines) <= lines
        whole.setdefault(os.path.basename(row.path), []).extend(row.lines)
    assert whole == {n: t.split("\n") for n, t in texts.items()}
    frame = sources.createDataFrame([(str(tmp_path / n), t.split("\n")) for n, t in texts.items()], "path string, lines array<string>")
    want = frame.select("path", F.posexplode(parse.hunks(F.col("lines"))).alias("idx", "h")).select("path", "idx", "h.*").collect()
    key = lambda r: (r.path, r.idx, r.start_line, r.end_line, r.ours, r.theirs)
    assert sorted(map(key, blocks.hunk_rows(got).collect())) == sorted(map(key, want))


def test_one_document(sources, tmp_path):
    path = str(tmp_path / "report.json")
    rows = sources.range(1000).select(F.col("id"), F.concat(F.lit('é "'), F.col("id").cast("string")).alias("text"), F.array(F.struct(F.col("id").alias("n"), F.lit(None).cast("string").alias("none"))).alias("list")).repartition(5)
    rows.write.format("merge_document").option("header", json.dumps({"success": True})).option("key", "files").mode("append").save(path)
    d = json.load(open(path))
    assert (d["success"], d["count"]) == (True, 1000) and sorted(x["id"] for x in d["files"]) == list(range(1000))
    assert {x["text"] for x in d["files"]} == {f'é "{k}' for k in range(1000)} and d["files"][0]["list"][0]["none"] is None
    assert os.listdir(tmp_path) == ["report.json"]
    rows.limit(0).write.format("merge_document").mode("append").save(path)
    assert json.load(open(path)) == {"count": 0, "rows": []}


def test_a_failed_document_leaves_the_old_one(sources, tmp_path):
    path = str(tmp_path / "report.json")
    sources.range(3).write.format("merge_document").mode("append").save(path)
    before = open(path).read()
    bad = sources.range(0, 1000, 1, 4).select(F.when(F.col("id") < 990, F.col("id")).otherwise(F.raise_error(F.lit("lost")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("merge_document").mode("append").save(path)
    assert open(path).read() == before and os.listdir(tmp_path) == ["report.json"]
