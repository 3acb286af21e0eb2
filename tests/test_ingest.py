"""The ingest chain over a folder of notes: scans, failures, retries, and what each leaves in the store."""

import os
import uuid
from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loomdex.operators import state
from loomdex.operators.parse import parse
from loomdex.plans import ingest as I

VAULT = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
NOTES = {"a.md": b"# Alpha\n\nOne. #tag\n", "sub/b.md": b"\xef\xbb\xbf# Beta\n\n[[a]]\n", "c.md": b"plain\n", "bad.md": b"\xff\xfe", "other.txt": b"no note"}


def put(root, notes, at):
    for name, data in notes.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "wb") as f:
            f.write(data)
        os.utime(f"{root}/{name}", (at, at))


def run(spark, root, path, kind="incremental"):
    return I.ingest(spark, path, I.vault_source(spark, f"file:{root}"), VAULT, kind, buckets=4)


def documents(store):
    return {r.key: r for r in store.documents.collect()}


def stored(store):
    """Spans of the current elements by path, without the ids."""
    rows = store.elements.join(store.documents.select("document_id", "key"), "document_id").select("key", "element", "kind", "char_start", "char_end", "id")
    return sorted((tuple(r) for r in rows.collect()), key=str)


def parsed(root, store):
    """What the stored elements must be, from the files themselves."""
    out = []
    for key, r in documents(store).items():
        if r.lifecycle == "active":
            with open(f"{root}/{key}", encoding="utf-8-sig", newline="") as f:
                out += [(key, e.element, e.kind, e.char_start, e.char_end, e.id) for e in parse(f.read(), r.current_version_id) if e.element != "title"]
    return sorted(out, key=str)


def chunk_ids(store):
    return {r.id for r in store.elements.where("element = 'chunk'").collect()}


def counts(store):
    return store.outcome.orderBy(F.desc("scan")).first()


def second(root):
    os.rename(f"{root}/a.md", f"{root}/moved.md")
    os.remove(f"{root}/c.md")
    put(root, {"sub/b.md": b"# Beta\n\n[[a]] again\n", "bad.md": b"mended\n"}, 2000)


def test_scans_of_a_folder(spark, tmp_path):
    root, path = f"{tmp_path}/notes", f"{tmp_path}/store"
    put(root, NOTES, 1000)
    first = run(spark, root, path)
    one = documents(first)
    assert {k: r.lifecycle for k, r in one.items()} == {"a.md": "active", "sub/b.md": "active", "c.md": "active", "bad.md": "error"}
    assert (one["a.md"].title, one["c.md"].title, one["bad.md"].current_version_id) == ("Alpha", None, None)
    assert one["a.md"].current_version_id == str(uuid.uuid5(uuid.UUID(one["a.md"].document_id), one["a.md"].hash))
    assert stored(first) == parsed(root, first) and first.gone_chunks.count() == 0
    o = counts(first)
    assert (o.discovered, o.hashed, o.new_count, o.parsed_documents, o.failed_documents) == (4, 4, 4, 3, 1)
    old = {r.document_id: r for r in first.versions.collect()}
    before = chunk_ids(first)

    second(root)
    store = run(spark, root, path)
    two = documents(store)
    assert two["moved.md"].document_id == one["a.md"].document_id
    assert two["moved.md"].current_version_id == one["a.md"].current_version_id and two["moved.md"].title == "Alpha"
    assert {k: r.lifecycle for k, r in two.items()} == {"moved.md": "active", "sub/b.md": "active", "c.md": "deleted", "bad.md": "active"}
    assert two["c.md"].current_version_id is None
    assert stored(store) == parsed(root, store)
    assert {r.chunk_id for r in store.gone_chunks.collect()} == before - chunk_ids(store) != set()
    status = {(r.document_id, r.version_id): r.status for r in store.versions.collect()}
    assert status[one["c.md"].document_id, old[one["c.md"].document_id].version_id] == "superseded"
    assert status[one["sub/b.md"].document_id, one["sub/b.md"].current_version_id] == "superseded"
    assert all(status[r.document_id, r.current_version_id] == "ready" for r in two.values() if r.current_version_id)
    o = counts(store)
    assert (o.discovered, o.hashed, o.new_count, o.modified_count, o.renamed_count, o.deleted_count, o.unchanged_count, o.parsed_documents, o.failed_documents) == (3, 3, 0, 2, 1, 1, 0, 2, 0)

    put(root, {"a.md": b"taken anew\n"}, 3000)
    third = run(spark, root, path)
    three, o = documents(third), counts(third)
    assert three["a.md"].document_id != three["moved.md"].document_id == one["a.md"].document_id
    assert (o.hashed, o.new_count, o.parsed_documents, o.unchanged_count) == (1, 1, 1, 3) and third.gone_chunks.count() == 0
    assert stored(third) == parsed(root, third)


def test_a_scan_that_broke_off_runs_again(spark, tmp_path, monkeypatch):
    root, path, whole = f"{tmp_path}/notes", f"{tmp_path}/store", f"{tmp_path}/whole"
    put(root, NOTES, 1000)
    run(spark, root, path), run(spark, root, whole)
    second(root)
    want = run(spark, root, whole)

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(I, "_publish", broken)
        with pytest.raises(OSError):
            run(spark, root, path)
    assert I.Store.at(spark, path).scan == 1
    got = run(spark, root, path)
    assert got.scan == 2 and stored(got) == stored(want)
    for name in ("documents", "versions", "gone_chunks"):
        assert sorted(getattr(got, name).collect(), key=str) == sorted(getattr(want, name).collect(), key=str)


def test_measure_changes_nothing(spark, tmp_path):
    root, path = f"{tmp_path}/notes", f"{tmp_path}/store"
    put(root, NOTES, 1000)
    first = run(spark, root, path)
    one, elements = documents(first), stored(first)
    put(root, {"c.md": b"other\n"}, 2000)
    measured = run(spark, root, path, "measure")
    o = counts(measured)
    assert (o.scan_type, o.hashed, o.modified_count, o.parsed_documents) == ("measure", 4, 1, 0)
    assert documents(measured) == one and stored(measured) == elements
    after = run(spark, root, path)
    assert counts(after).modified_count == 1 and stored(after) == parsed(root, after)
    with pytest.raises(ValueError):
        run(spark, root, path, "quick")


def test_empty_vault_and_last_file_gone(spark, tmp_path):
    root, path = f"{tmp_path}/notes", f"{tmp_path}/store"
    put(root, {"a.md": b"# A\n", "x.txt": b""}, 1000)
    run(spark, root, path)
    os.remove(f"{root}/a.md")
    gone = run(spark, root, path)
    assert gone._stored().count() == 0 and documents(gone)["a.md"].lifecycle == "deleted" and gone.gone_chunks.count() == 1
    put(root, {"a.md": b"# A\n"}, 3000)
    back = run(spark, root, path)
    assert sorted((r.lifecycle, r.current_version_id is None) for r in back.documents.collect()) == [("active", False), ("deleted", True)]
    assert back.elements.where("kind = 'root'").select("char_end").collect() == [Row(char_end=4)]


def test_unreadable_and_changing_files(spark, tmp_path):
    """A listed file that can't be read is a failed read; one that changes between hash and parse is in error, and mended by the next scan."""
    path = f"{tmp_path}/store"
    listing = spark.createDataFrame([("a", 1, 1, None), ("b", 1, 1, None), ("c", 1, 1, True)], "key string, size long, mtime long, failed boolean")
    contents = lambda *rows: spark.createDataFrame([(*r, None) for r in rows], "key string, hash string, text string, error string")
    given = [contents(("a", "h1", "x"), ("b", "h2", "y")), contents(("a", "h1", "x"), ("b", "h3", "z"))]
    s = I.ingest(spark, path, I.Source(listing, lambda asked: given.pop(0)), VAULT)
    assert {k: r.lifecycle for k, r in documents(s).items()} == {"a": "active", "b": "error"}
    o = counts(s)
    assert (o.failed_count, o.parsed_documents, o.failed_documents) == (1, 1, 1)
    assert [r.error for r in spark.read.parquet(f"{path}/scan=1/failures").collect()] == ["source_changed"]
    now = contents(("b", "h3", "z"), ("c", "h4", "w"))
    s = I.ingest(spark, path, I.Source(listing.withColumn("failed", F.lit(False)), lambda asked: now), VAULT)
    assert {k: r.lifecycle for k, r in documents(s).items()} == {"a": "active", "b": "active", "c": "active"}
    assert s.elements.where("kind = 'root'").count() == 3 and counts(s).hashed == 2


def test_a_job_scans(spark, tmp_path):
    root, path = f"{tmp_path}/notes", f"{tmp_path}/store"
    put(root, NOTES, 1000)
    now = datetime(2026, 1, 1)
    jobs = spark.createDataFrame([(1, "scan_vault", "queued", 0, 0, now, None, None)], "job_id long, kind string, status string, attempts int, priority int, created_at timestamp, next_attempt_at timestamp, lease_expires_at timestamp")
    log = state.run_once(jobs, now, I.handlers(spark, lambda job: (path, I.vault_source(spark, f"file:{root}"), VAULT)), "w")
    assert [r.status for r in log] == ["running", "succeeded"] and I.Store.at(spark, path).scan == 1
    assert isinstance(log[0], Row)
