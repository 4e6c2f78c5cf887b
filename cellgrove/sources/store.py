"""Files on any store that pyarrow knows (local, file://, hdfs://, s3://, gs://): byte ranges, and two-phase output.

Tasks write under names of their own attempt in a staging folder beside the target; one commit on the driver moves what
the successful attempts reported and drops the rest, so lost or repeated tasks leave nothing behind.
"""

from __future__ import annotations

import fnmatch
import os
import tempfile
import uuid
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import SparkSession


def resolve(path: str) -> tuple[pafs.FileSystem, str]:
    """The filesystem of a path or URI, and the path within it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def named(root: str, path: str) -> str:
    """A path within the filesystem of `root`, as tasks can name it again."""
    if "://" not in root or root.startswith("file:"):
        return path
    scheme, _, rest = root.partition("://")
    return f"{scheme}://{path}" if scheme in ("s3", "gs", "gcs", "abfs") else f"{scheme}://{rest.partition('/')[0]}{path}"


def files(path: str, suffix: str) -> list[str]:
    """The files of a folder (names in _ or . left out), of a pattern in the last part, or the file itself, in order."""
    fs, at = resolve(path)
    kind = fs.get_file_info(at).type
    if kind == pafs.FileType.File:
        return [named(path, at)]
    folder, pattern = (at, f"*{suffix}") if kind == pafs.FileType.Directory else os.path.split(at)
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted(named(path, f.path) for f in found if f.type == pafs.FileType.File and fnmatch.fnmatchcase(f.base_name, pattern) and f.base_name[0] not in "_.")


def exists(path: str) -> bool:
    """Whether there is a file, or a folder with files that count."""
    fs, at = resolve(path)
    kind = fs.get_file_info(at).type
    return kind == pafs.FileType.File or kind == pafs.FileType.Directory and any(f.base_name[0] not in "_." for f in fs.get_file_info(pafs.FileSelector(at)))


def reader(path: str):
    fs, at = resolve(path)
    return fs.open_input_file(at)


def read(path: str, offset: int = 0, length: int | None = None) -> bytes:
    with reader(path) as f:
        return f.read_at(f.size() - offset if length is None else length, offset)


def replace(path: str, data: bytes) -> None:
    """Writes a whole file under a name of this attempt and moves it into place, whatever is there."""
    fs, at = resolve(path)
    folder, name = os.path.split(at)
    fs.create_dir(folder, recursive=True)
    temp = f"{folder}/_{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temp) as f:
        f.write(data)
    fs.move(temp, at)


@dataclass(frozen=True)
class Staging:
    """The files of one job on their way into `target`; goes to the tasks by value."""

    target: str
    job: str

    @classmethod
    def begin(cls, target: str) -> Staging:
        if exists(target):
            raise FileExistsError(f"{target} is not empty")
        return cls(target, uuid.uuid4().hex)

    @property
    def folder(self) -> str:
        return f"{resolve(self.target)[1]}/_staging-{self.job}"

    def write(self, data: list[bytes], number: int, suffix: str) -> str:
        """A file of this task attempt from its parts; its name within the staging folder."""
        fs, t = resolve(self.target)[0], TaskContext.get()
        part, attempt = (t.partitionId(), t.taskAttemptId()) if t else (0, uuid.uuid4().hex)
        fs.create_dir(self.folder, recursive=True)
        name = f"{part:05d}-{number:05d}.{attempt}{suffix}"
        with fs.open_output_stream(f"{self.folder}/{name}") as f:
            for d in data:
                f.write(d)
        return name

    def commit(self, moves: list[tuple[str, str]]) -> None:
        """Moves (staged name, final name) into place; whatever else was staged goes."""
        fs, target = resolve(self.target)
        for name, final in moves:
            fs.move(f"{self.folder}/{name}", f"{target}/{final}")
        self.abort()

    def abort(self) -> None:
        fs = resolve(self.target)[0]
        if fs.get_file_info(self.folder).type == pafs.FileType.Directory:
            fs.delete_dir(self.folder)


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share: beside the checkpoints; a temporary one only in local mode."""
    shared = spark.sparkContext._jsc.sc().getCheckpointDir()
    root = shared.get() if shared.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        root = tempfile.mkdtemp(prefix="scratch-")
    return f"{root}/scratch-{uuid.uuid4().hex}"
