"""Digests of files, folders and rows, against hashlib."""

import hashlib
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from textloom.sources import files


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a b%20").mkdir()
    for name, data in {"one.bin": b"x" * 10, "a b%20/tw o%.bin": bytes(range(256)) * 5000, "a b%20/ünï.bin": b"\0", "none.bin": b"", "_hidden.bin": b"h", "other.txt": b"t"}.items():
        (tmp_path / name).write_bytes(data)
    return tmp_path


@pytest.mark.parametrize("whole", [-1, 0, 10, 10**9])
def test_digests_of_small_and_large_files(spark, folder, whole):
    got = files.digests(spark, str(folder), "*.bin", files.DigestSettings(whole=whole, chunk=1000)).collect()
    want = {"one.bin", "a b%20/tw o%.bin", "a b%20/ünï.bin"}  # neither hidden nor empty files
    assert {os.path.relpath(r.path.removeprefix("file:"), folder) for r in got} == want
    for r in got:
        data = open(r.path.removeprefix("file:"), "rb").read()
        assert (r.bytes, r.sha256) == (len(data), hashlib.sha256(data).hexdigest())
    assert {(r.path, r.bytes) for r in files.listed(spark, str(folder), "*.bin").collect()} == {(r.path, r.bytes) for r in got}


def test_a_file_of_three_gigabytes_takes_a_chunk_of_memory(spark, tmp_path):
    path = tmp_path / "large.bin"
    with open(path, "wb") as f:
        f.truncate(3_000_000_000)  # takes no room on the disk
        f.seek(2_999_999_000)
        f.write(b"end")
    with open(path, "rb") as f:
        want = hashlib.file_digest(f, "sha256").hexdigest()
    assert [tuple(r)[1:] for r in files.digests(spark, str(tmp_path)).collect()] == [(3_000_000_000, want)]
    # the work of a task, in a process of its own, whose memory grows by a few chunks
    code = (
        "import resource, sys; from textloom.sources import files; peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; files.open_stream('file:' + sys.argv[1]).close(); "
        "before = peak(); files.stream_digest('file:' + sys.argv[1]); print(peak() - before)"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    grown = subprocess.run([sys.executable, "-c", code, str(path)], cwd=root, capture_output=True, text=True, check=True).stdout
    assert int(grown) < 100_000  # KB


def test_an_opener_of_ones_own(spark, folder):
    class Store:
        def __call__(self, path):
            import io

            return io.BytesIO(path.encode())

    got = files.digests(spark, str(folder), "one.bin", files.DigestSettings(whole=-1, opener=Store())).first()
    assert got.sha256 == hashlib.sha256(got.path.encode()).hexdigest()


def test_a_changed_file_of_equal_size_changes_its_folder(spark, folder):
    def now():
        return {r.folder.removeprefix("file:"): (r.n_files, r.bytes, r.digest) for r in files.folder_digests(files.digests(spark, str(folder))).collect()}

    before = now()
    assert {k: v[:2] for k, v in before.items()} == {str(folder): (2, 11), f"{folder}/a b%20": (2, 1_280_001)}
    (folder / "a b%20/ünï.bin").write_bytes(b"\1")
    after = now()
    assert after[str(folder)] == before[str(folder)] and after[f"{folder}/a b%20"] != before[f"{folder}/a b%20"]


def test_rows_a_file(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.range(1000).select("id", (F.col("id") % 3).alias("a.b")).repartition(3, "`a.b`").write.parquet(at)
    got = {r.path: (r.n, r.digest) for r in files.file_rows(spark.read.parquet(at)).collect()}
    assert sum(n for n, _ in got.values()) == 1000
    assert set(got) <= {r.path for r in files.listed(spark, at).collect()}
    # the same rows in another order, in one file: the digests add up
    spark.read.parquet(at).orderBy(F.desc("id")).coalesce(1).write.parquet(at + "2")
    assert [r.digest for r in files.file_rows(spark.read.parquet(at + "2")).collect()] == [str(sum(int(d) for _, d in got.values()))]
