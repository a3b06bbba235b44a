"""Listings as a stream: every record once, over crawls, restarts and failures."""

import json
import random

import pytest
from pyspark.errors import StreamingQueryException

from reviewloom.sources import listing
from reviewloom.streaming.landing import merged_pulls


def at(day):
    return f"2026-01-{day:02}T00:00:00Z"


def land(root, name, pages, done=True):
    """Pages of (day, number) pairs; a string is a page as it is."""
    (root / name).mkdir()
    for i, page in enumerate(pages):
        text = page if isinstance(page, str) else "".join(json.dumps({"number": n, "updated_at": at(d), "title": f"t{d}", "merged_at": at(d) if n % 2 else None, "merge_commit_sha": "" if n == 7 else "f"}) + "\n" for d, n in page)
        (root / name / f"page-{i:03}.jsonl").write_text(text)
    if done:
        (root / name / listing.DONE).touch()


def drain(df, checkpoint, sink):
    q = df.writeStream.foreachBatch(sink).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(100)
    finally:
        q.stop()


def test_each_record_once_over_crawls_and_restarts(spark, tmp_path):
    root, got = tmp_path / "listing", []
    root.mkdir()
    listing.register(spark)
    sink = lambda df, _: got.extend((int(r.updated_at[8:10]), r.number) for r in df.collect())

    def run():
        got.clear()
        # A new reader each time: what it knows comes back from the checkpoint.
        drain(spark.readStream.format("pull_listing").option("since", at(3)).load(str(root)), tmp_path / "cp", sink)
        return sorted(got)

    assert run() == []
    # The listing moved while it was crawled, so page 1 repeats the end of page 0; the page behind ``since`` is never opened.
    land(root, "0001", [[(9, 5), (9, 4), (8, 1)], [(8, 1), (6, 2)], [(3, 9), (2, 8)], [(1, 3)], "not json\n"])
    land(root, "0002", [[(20, 1)]], done=False)
    assert run() == [(3, 9), (6, 2), (8, 1), (9, 4), (9, 5)]
    assert run() == []
    # Edited since: 2 and 8. Two crawls at once, the second of which overlaps the first; an empty one between.
    land(root, "0003", [[(10, 2), (9, 5)], "not json\n"])
    land(root, "0004", ["", "\n"])
    land(root, "0005", [[(12, 8), (10, 2), (9, 5)], [(9, 4)]])
    with pytest.raises(StreamingQueryException):
        run()
    (root / "0003" / "page-001.jsonl").write_text("")
    assert run() == [(10, 2), (12, 8)]
    (root / "0002" / listing.DONE).touch()
    assert run() == []


def test_failed_batch_is_given_again(spark, tmp_path):
    root = tmp_path / "listing"
    root.mkdir()
    listing.register(spark)
    land(root, "a", [[(5, 2), (5, 1)], [(4, 7)]])
    seen = []

    def sink(df, epoch):
        seen.append((epoch, sorted(r.number for r in df.collect())))
        if len(seen) == 1:
            raise RuntimeError("lost")

    df = merged_pulls(spark, str(root))
    with pytest.raises(StreamingQueryException):
        drain(df, tmp_path / "cp", sink)
    # What lands in between is not for the batch that had failed; a run that begins with such a batch may end with it.
    land(root, "b", [[(6, 3), (5, 2)]])
    for _ in range(2):
        drain(merged_pulls(spark, str(root)), tmp_path / "cp", sink)
    assert seen == [(0, [1]), (0, [1]), (1, [3])]


def test_reader_against_brute_force(tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "PAGES", 2)
    rng = random.Random(3)
    pulls, day, done = {n: (1, n) for n in range(1, 30)}, 1, []
    reader, offset = listing.ListingReader(str(tmp_path), ""), listing.ListingReader(str(tmp_path), "").initialOffset()
    for c in range(8):
        day += 1
        for n in rng.sample(sorted(pulls), rng.randint(0, 9)):
            pulls[n] = (day, n)
        rows = sorted(pulls.values(), reverse=True)
        size = rng.randint(2, 7)
        # Each page after the first repeats some of the one before.
        pages = [rows[max(0, i - rng.randint(0, 2)) : i + size] for i in range(0, len(rows), size)]
        land(tmp_path, f"c{c}", pages)
        if rng.random() < 0.6 or c == 7:
            end = reader.latestOffset()
            for p in reader.partitions(offset, end):
                done += [(int(r[1][8:10]), r[0]) for r in reader.read(p)]
            assert max(pulls.values()) == (int(end["updated"][8:10]), end["number"])
            offset = end
            reader = listing.ListingReader(str(tmp_path), "") if rng.random() < 0.5 else reader
    assert len(done) == len(set(done)) and set(pulls.values()) <= set(done)


def test_pages_out_of_order_are_named(tmp_path):
    land(tmp_path, "a", [[(5, 1), (5, 2)]])
    reader = listing.ListingReader(str(tmp_path), "")
    with pytest.raises(ValueError, match="page-000.jsonl, line 2: not in the order"):
        [list(reader.read(p)) for p in reader.partitions(reader.initialOffset(), reader.latestOffset())]
