"""Reports: rendered lines, and a sink that many tasks write and one manifest commits.

Registered as the data source ``report``. Each task writes the lines of its
range to a file of its own and sends its name, first key, size and hash; the
commit orders the files by key and publishes them by one manifest, which is
renamed into place. What no manifest names isn't part of a report: a task that
fails takes its file away, an aborted job all of them, and a commit clears what
lost executors left behind.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

MANIFEST = "manifest.json"


@dataclass
class Part(WriterCommitMessage):
    name: str
    first: tuple[int, int]
    last: tuple[int, int]
    lines: int
    sha256: str


@dataclass
class PartFile(InputPartition):
    name: str
    before: int
    sha256: str


def _place(options: dict) -> tuple[fs.FileSystem, str]:
    path = options["path"].rstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class ReportWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = options, overwrite

    def write(self, iterator: Iterator) -> Part:
        files, folder = _place(self.options)
        name, first, last, lines, digest = f"part-{uuid.uuid4().hex}.txt", None, None, 0, hashlib.sha256()
        files.create_dir(folder, recursive=True)
        try:
            with files.open_output_stream(f"{folder}/{name}") as out:
                for row in iterator:
                    last = (row[0], row[1])
                    first = first or last
                    data = (row[2] or "").replace("\n", " ").encode() + b"\n"
                    out.write(data)
                    digest.update(data)
                    lines += 1
        except BaseException:
            _delete(files, f"{folder}/{name}")
            raise
        return Part(name, first or (0, 0), last or (0, 0), lines, digest.hexdigest())

    def commit(self, messages: list) -> None:
        files, folder = _place(self.options)
        parts = sorted((m for m in messages if m is not None and m.lines), key=lambda m: m.first)
        for a, b in zip(parts, parts[1:], strict=False):
            if b.first <= a.last:
                raise ValueError("ranges of sections overlap: partition the lines by range and sort them")
        earlier = [] if self.overwrite else _manifest(files, folder)
        listed = earlier + [{"name": p.name, "lines": p.lines, "sha256": p.sha256} for p in parts]
        files.create_dir(folder, recursive=True)
        temporary = f"{folder}/{MANIFEST}.{uuid.uuid4().hex}"
        with files.open_output_stream(temporary) as out:
            out.write(json.dumps({"parts": listed}).encode())
        files.move(temporary, f"{folder}/{MANIFEST}")
        named = {p["name"] for p in listed} | {MANIFEST}
        for info in files.get_file_info(fs.FileSelector(folder)):
            if info.base_name not in named:
                _delete(files, info.path)

    def abort(self, messages: list) -> None:
        files, folder = _place(self.options)
        for m in messages:
            if m is not None:
                _delete(files, f"{folder}/{m.name}")


def _delete(files: fs.FileSystem, path: str) -> None:
    if files.get_file_info(path).type == fs.FileType.File:
        files.delete_file(path)


def _manifest(files: fs.FileSystem, folder: str) -> list[dict]:
    if files.get_file_info(f"{folder}/{MANIFEST}").type != fs.FileType.File:
        return []
    with files.open_input_stream(f"{folder}/{MANIFEST}") as f:
        return json.loads(f.read())["parts"]


class ReportReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[PartFile]:
        out, before = [], 0
        for p in _manifest(*_place(self.options)):
            out.append(PartFile(p["name"], before, p["sha256"]))
            before += p["lines"]
        return out or [PartFile("", 0, "")]

    def read(self, partition: PartFile) -> Iterator[tuple]:
        if not partition.name:
            return
        files, folder = _place(self.options)
        with files.open_input_stream(f"{folder}/{partition.name}") as f:
            data = f.read()
        if hashlib.sha256(data).hexdigest() != partition.sha256:
            raise ValueError(f"{partition.name} isn't what was committed")
        for i, line in enumerate(data.decode().split("\n")[:-1]):
            yield partition.before + i + 1, line


class Report(DataSource):
    """``report``: written from ``section int, ord long, line string``, read as ``pos long, line string``."""

    @classmethod
    def name(cls) -> str:
        return "report"

    def schema(self) -> str:
        return "pos long, line string"

    def reader(self, schema) -> DataSourceReader:
        return ReportReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ReportWriter(dict(self.options), overwrite)


def write_report(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write ``section, ord, line`` in the order of (section, ord), by as many tasks as the session shuffles into.

    Line feeds within a line become spaces, null lines are empty.
    """
    spark = lines.sparkSession
    spark.dataSource.register(Report)
    ordered = lines.select(F.col("section").cast("int"), F.col("ord").cast("long"), F.col("line").cast("string"))
    ordered.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "section", "ord").sortWithinPartitions("section", "ord").write.format("report").mode(mode).save(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(Report)
    return spark.read.format("report").load(path)


def finding_lines(findings: DataFrame, severities: tuple[str, ...], severity: str, ord_col: str, item: Column, title: str, form: str = "markdown") -> DataFrame:
    """A report's lines ``section, ord, line``: a title and a count, then a section for each severity that occurs, its findings in order.

    ``form`` is markdown, rst or json (one object a line, no headings).
    ``ord_col`` is a positive long, unique within a severity; unknown severities
    come last, under their own names.
    """
    known = F.nullif(F.array_position(F.array(*map(F.lit, severities)), F.col(severity)), F.lit(0))
    rank = F.coalesce(known, F.lit(len(severities) + 1)).cast("int")
    body = findings.select(rank.alias("section"), F.col(ord_col).cast("long").alias("ord"), (F.to_json(F.struct(*findings.columns)) if form == "json" else F.concat(F.lit("- "), item)).alias("line"))
    if form == "json":
        return body
    names = findings.groupBy(rank.alias("section")).agg(F.count("*").alias("n"), F.min(severity).alias("name"))
    heading = F.concat_ws("", F.initcap("name"), F.lit(" ("), F.col("n"), F.lit(")"))
    total = findings.agg(F.count("*").alias("n")).select(F.concat(F.col("n"), F.lit(" findings")).alias("t"))
    if form == "rst":
        heads = [(-3, F.lit("")), (-2, heading), (-1, F.repeat(F.lit("-"), F.length(heading))), (0, F.lit(""))]
        tops = [(0, F.lit(title)), (1, F.lit("=" * len(title))), (2, F.lit("")), (3, F.col("t"))]
    else:
        heads = [(-2, F.lit("")), (-1, F.concat(F.lit("## "), heading)), (0, F.lit(""))]
        tops = [(0, F.lit(f"# {title}")), (1, F.lit("")), (2, F.col("t"))]
    rows = lambda pairs: F.inline(F.array(*(F.struct(F.lit(o).cast("long").alias("ord"), line.alias("line")) for o, line in pairs)))
    return total.select(F.lit(0).alias("section"), rows(tops)).unionByName(names.select("section", rows(heads))).unionByName(body)
