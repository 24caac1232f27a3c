"""Source trees and git as Python data sources, which see files that Spark's own readers hide."""

from __future__ import annotations

import os
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Folders that are never searched, endings that are, and the largest file.
SKIPPED = frozenset((".git", "node_modules", "vendor", ".venv", "venv", "__pycache__", "dist", "build", ".mypy_cache", ".pytest_cache"))
ENDINGS = frozenset(".py .js .jsx .ts .tsx .go .java .rb .rs .c .h .cpp .hpp .cs .php .kt .swift .scala".split())
MOST_BYTES = 2_000_000


def tree_files(root: str) -> list[str]:
    """Paths below root, relative and sorted, of files worth searching. Only folders below root are judged by name."""
    found = []
    for folder, inner, names in os.walk(root):
        inner[:] = sorted(d for d in inner if d not in SKIPPED)
        found += [os.path.relpath(os.path.join(folder, n), root) for n in names if os.path.splitext(n)[1] in ENDINGS]
    return sorted(found)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.most, self.parts = options["path"], int(options.get("maxbytes", MOST_BYTES)), int(options.get("partitions", 8))

    def partitions(self):
        paths = tree_files(self.root)
        return [_Files(paths[i :: self.parts]) for i in range(min(self.parts, max(1, len(paths))))]

    def read(self, partition):
        for p in partition.paths:
            try:
                full = Path(self.root, p)
                if full.stat().st_size <= self.most:
                    yield p, full.read_text(encoding="utf-8", errors="ignore")
            except OSError:
                continue


class SourceTree(DataSource):
    """spark.read.format('source_tree').load(folder): (path, text), one row for each file worth searching."""

    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return "path string, text string"

    def reader(self, schema):
        return _TreeReader(self.options)


class GitError(RuntimeError):
    pass


def _git(repo: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, check=False)
    if done.returncode:
        raise GitError(done.stderr.strip() or f"git {args[0]} failed")
    return done.stdout


def git_diff(repo: str, base: str, head: str) -> str:
    """The diff of head against its merge base with base; raises if git does."""
    return _git(repo, "diff", f"{base}...{head}")


def merge_base(repo: str, base: str, head: str) -> str:
    return _git(repo, "merge-base", base, head).strip()


def file_at(repo: str, ref: str, path: str) -> str | None:
    """A file's text at a ref; None if it isn't there."""
    try:
        return _git(repo, "show", f"{ref}:{path}")
    except GitError:
        return None


class _GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.ref, self.paths = options["repo"], options["ref"], [p for p in options.get("paths", "").split("\n") if p]

    def partitions(self):
        return [_Files(self.paths[i::8]) for i in range(min(8, max(1, len(self.paths))))]

    def read(self, partition):
        for p in partition.paths:
            text = file_at(self.repo, self.ref, p)
            if text is not None:
                yield self.ref, p, text


class GitFiles(DataSource):
    """(ref, path, text) of the files named by option paths, by lines, at option ref; absent files have no row."""

    @classmethod
    def name(cls):
        return "git_files"

    def schema(self):
        return "ref string, path string, text string"

    def reader(self, schema):
        return _GitReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SourceTree)
    spark.dataSource.register(GitFiles)


def read_tree(spark: SparkSession, folder: str) -> DataFrame:
    register(spark)
    return spark.read.format("source_tree").load(folder)


def read_git(spark: SparkSession, repo: str, ref: str, paths: list[str]) -> DataFrame:
    register(spark)
    return spark.read.format("git_files").option("repo", repo).option("ref", ref).option("paths", "\n".join(paths)).load()


def read_diff(spark: SparkSession, path: str) -> DataFrame:
    """(diff_id, diff): whole diff files; diff_id is the file's path."""
    from pyspark.sql import functions as F

    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("diff_id"), F.col("value").alias("diff"))


def read_diff_stream(spark: SparkSession, stream, diff_id: str = "-") -> DataFrame:
    """(diff_id, diff): one diff from an open stream of text, as a command reads its standard input."""
    return spark.createDataFrame([(diff_id, stream.read())], "diff_id string, diff string")
