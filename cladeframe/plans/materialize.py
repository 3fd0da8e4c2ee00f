"""Cutting lineage with tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
_own: dict[str, str] = {}
_made: dict[tuple, object] = {}
#: The tables written within each call of `only`, innermost last; None within `once`, whose tables stay.
_scopes: list[list[str] | None] = []
#: With this on, Spark deletes the shuffle files of a query at its end.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where that is unset on one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError(f"spark.checkpoint.dir is unset, and {master} has no folder that all its machines share")
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-cladeframe-")
    return _own[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing is at yet."""
    return f"{shared_folder(spark)}/cladeframe/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and go on from the files: nothing above is computed again, and a lost
    executor costs only its own tasks. Shuffle files go as soon as it is written; else they stay until the driver happens to
    collect its garbage, and add up from table to table."""
    spark = df.sparkSession
    path = scratch(spark, name)
    if _scopes and _scopes[-1] is not None:
        _scopes[-1].append(path)
    was = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, was)
    return spark.read.schema(df.schema).parquet(path)


def only(name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """materialize(build(), name), after which all tables that `build` wrote on the way are deleted."""
    _scopes.append([])
    try:
        df = build()
    finally:
        made = _scopes.pop()
    done = materialize(df, name)
    for path in made:
        _delete(df.sparkSession, path)
    return done


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that materialize gave and that nothing will read again."""
    spark = df.sparkSession
    own = f"/cladeframe/{spark.sparkContext.applicationId}/"
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if own not in folder:
            raise ValueError(f"not a table of this session: {folder}")
        _delete(spark, folder)


def file_versions(spark: SparkSession, paths: list[str]) -> tuple[tuple[str, int, int], ...]:
    """(file, length, time of change) of the files at or under each path: another tuple once a table is written anew."""
    found = []
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
        found += [(str(f.getPath()), f.getLen(), f.getModificationTime()) for f in files]
    return tuple(found)


def once(spark: SparkSession, name: str, paths: list[str], build: Callable[[], T]) -> T:
    """What `build` gives, built once a session for the present versions of the files at `paths`, and again once these
    change or the session's tables are cleared."""
    key = (spark.sparkContext.applicationId, name, file_versions(spark, paths))
    if key not in _made:
        _scopes.append(None)
        try:
            _made[key] = build()
        finally:
            _scopes.pop()
    return _made[key]


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a small file with its whole content, unless it is there: of several callers one gets True.

    The content is written beside it first, and then given the name in one step that fails where the name is taken: a
    rename without overwriting, which file systems of clusters do as one step; on one machine's disk, a link."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    fs = place.getFileSystem(conf)
    place = fs.makeQualified(place)
    draft = jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{place.getName()}-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if place.toUri().getScheme() == "file":
            at = lambda p: jvm.java.nio.file.Paths.get(p.toUri())
            jvm.java.nio.file.Files.createLink(at(place), at(draft))
        else:
            kinds = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            kinds[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), conf).rename(draft, place, kinds)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception):
            raise
        return False
    finally:
        fs.delete(draft, False)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this session wrote; results not yet read are lost with them."""
    for key in [k for k in _made if k[0] == spark.sparkContext.applicationId]:
        del _made[key]
    _delete(spark, f"{shared_folder(spark)}/cladeframe/{spark.sparkContext.applicationId}")
