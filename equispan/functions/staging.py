"""Keep a result that several branches read: written once as a table in the cluster's shared folder.

Reading it back gives a new leaf, so plans stay short.  Frames that are only persisted keep their whole lineage in the
logical plan; with the self-joins of exact ranks that plan grows by a factor at each step and is not analysed in
reasonable time.  A lost executor costs only the tasks it was running.
"""
import tempfile
import uuid

from pyspark.sql import DataFrame

_own_dirs = {}
_kept = {}
_written = []


def stage_dir(spark) -> str:
    """The folder the cluster names in spark.checkpoint.dir.  Only a local session may go without and gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="run-")
    return _own_dirs[app]


def stage(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark) -> str:
    """The name of a folder of its own among the staged ones, which release() deletes."""
    path = f"{stage_dir(spark)}/stage-{uuid.uuid4().hex}"
    _written.append((spark.sparkContext.applicationId, path))
    return path


def release(spark):
    """Delete what this session has staged, once the results that read it are written."""
    _kept.clear()
    app = spark.sparkContext.applicationId
    for _, path in [x for x in _written if x[0] == app]:
        path = spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _written[:] = [x for x in _written if x[0] != app]


def _files(spark, folder):
    """Names, sizes and times of the tables in a folder: a result is shared only while these are the same."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for table in fs.listStatus(path):
        parts = fs.listStatus(table.getPath()) if table.isDirectory() else [table]
        out += [(x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in parts]
    return tuple(sorted(out))


def keep(spark, sf_dir, name, make):
    """Stage make() once for the same tables, for queries that share it."""
    key = (spark.sparkContext.applicationId, sf_dir, name, _files(spark, sf_dir))
    if key not in _kept:
        _kept[key] = stage(make())
    return _kept[key]


def forget():
    """Drop the shared results, so that the next query computes its own."""
    _kept.clear()
