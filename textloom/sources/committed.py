"""Tables that change by whole versions: a version is written aside and counts once its manifest is there.

A manifest ``_version-N`` names the folder of version N. It is created only if there is none, in one step of the file
system, so a writer that dies leaves the version before as it was, and of two writers of one version one fails.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from textloom.sources.scratch import discard

_MANIFEST = "_version-"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> dict[int, str]:
    """Committed versions, each with its manifest's path."""
    at, fs = _files(spark, path)
    if not fs.exists(at):
        return {}
    names = {str(s.getPath().getName()): str(s.getPath()) for s in fs.listStatus(at)}
    return {int(n[len(_MANIFEST) :]): p for n, p in names.items() if n.startswith(_MANIFEST)}


def _folder(spark: SparkSession, manifest: str) -> str:
    at, fs = _files(spark, manifest)
    stream = fs.open(at)
    try:
        return str(stream.readUTF())
    finally:
        stream.close()


def current(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """(number, folder) of the last committed version under ``path``; None where there is none."""
    found = _versions(spark, path)
    return (max(found), f"{path}/{_folder(spark, found[max(found)])}") if found else None


def read_committed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Table ``name`` of the last committed version under ``path``."""
    at = current(spark, path)
    if at is None:
        raise FileNotFoundError(f"{path} has no committed version")
    return spark.read.parquet(f"{at[1]}/{name}")


def commit(spark: SparkSession, path: str, tables: dict[str, DataFrame], after: int | None = None) -> int:
    """Write ``tables`` as the next version under ``path`` and return its number.

    They may read the current version. ``after`` is the version they were made from (by default the current one): if
    another writer has committed since, nothing changes and FileExistsError is raised.
    """
    if after is None:
        at = current(spark, path)
        after = at[0] if at else 0
    folder = f"v-{uuid.uuid4().hex}"
    try:
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{path}/{folder}/{name}")
        _put(spark, f"{path}/{_MANIFEST}{after + 1}", folder)
    except Exception:
        discard(spark, f"{path}/{folder}")
        raise
    return after + 1


def _put(spark: SparkSession, manifest: str, folder: str) -> None:
    """Make the manifest appear whole or not at all: it is written under another name, then renamed to a name that isn't taken."""
    at, fs = _files(spark, manifest)
    if fs.exists(at):
        raise FileExistsError(manifest)
    # a name that sorts among files that readers skip
    draft, _ = _files(spark, f"{manifest.rsplit('/', 1)[0]}/.{folder}")
    stream = fs.create(draft, False)
    stream.writeUTF(folder)
    stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration())
    try:
        # without the option to overwrite this fails where the name is taken
        context.rename(draft, at, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        fs.delete(draft, False)
        if fs.exists(at):
            raise FileExistsError(manifest) from e
        raise


def drop_old_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the last ``keep`` versions, and folders that no manifest names; no reader of those may be left, and no
    writer at work."""
    found = _versions(spark, path)
    last = sorted(found)[-keep:]
    folders = {_folder(spark, found[n]) for n in last}
    for n in set(found) - set(last):
        discard(spark, found[n])
    at, fs = _files(spark, path)
    for s in fs.listStatus(at):
        if str(s.getPath().getName()).startswith("v-") and str(s.getPath().getName()) not in folders:
            discard(spark, str(s.getPath()))
