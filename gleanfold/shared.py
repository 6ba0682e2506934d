"""Folders that driver and executors share, and files in them through pyarrow's file systems."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, a temporary one serves in local mode."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = _local.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="gleanfold-"))
    return f"{shared.rstrip('/')}/gleanfold-work/{name}-{uuid.uuid4().hex}"


def opened(folder: str):
    """The file system of a folder's address, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def names(files, path: str) -> list[str]:
    """Names of a folder's files, ascending; none if there is no such folder. Files that are being written have names that begin with a point."""
    from pyarrow import fs

    found = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file and not f.base_name.startswith("."))


def put(files, path: str, name: str, content: bytes) -> bool:
    """Write a file whole: under another name first, then moved. False if there is one of that name: the first stays."""
    from pyarrow import fs

    if files.get_file_info(f"{path}/{name}").type != fs.FileType.NotFound:
        return False
    files.create_dir(path, recursive=True)
    part = f"{path}/.{uuid.uuid4().hex}"
    with files.open_output_stream(part) as f:
        f.write(content)
    files.move(part, f"{path}/{name}")
    return True


def get(files, path: str, name: str) -> bytes:
    with files.open_input_stream(f"{path}/{name}") as f:
        return f.read()


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder, wherever it is."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
