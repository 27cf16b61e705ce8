"""Labelled samples and reports as Spark data sources.

    register(spark)
    spark.read.format("labelled_samples").option("samples", folder).load(manifest)
    report.write.format("report").option("layout", "latex").mode("overwrite").save(folder)

Paths go through Arrow's file systems. Neither source passes rows through the driver.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from ..session import ship

SPLIT_BYTES = 8 << 20


def _files(path: str):
    """The file system of a path or address, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


@dataclass
class Span(InputPartition):
    """Bytes of a manifest of lines; end None: a manifest that is one array."""

    start: int
    end: int | None

    def __post_init__(self):
        super().__init__(self.start)


class SampleReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.manifest, self.samples = schema.names, options["path"], options["samples"].rstrip("/")
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))

    def partitions(self) -> list[Span]:
        store, path = _files(self.manifest)
        size = store.get_file_info(path).size or 0
        with store.open_input_file(path) as f:
            if f.read(4096).lstrip().startswith(b"["):
                return [Span(0, None)]
        return [Span(a, min(size, a + self.split)) for a in range(0, size, self.split)] or [Span(0, 0)]

    def _entries(self, span: Span) -> Iterator[dict]:
        store, path = _files(self.manifest)
        with store.open_input_file(path) as f:
            if span.end is None:
                yield from json.loads(f.read())
                return
            lines = io.BufferedReader(f)
            if span.start:  # the line that begins before belongs to the span before
                lines.seek(span.start - 1)
                lines.readline()
            while lines.tell() < span.end:
                line = lines.readline()
                if line.strip():
                    yield json.loads(line)

    def read(self, span: Span) -> Iterator[tuple]:
        store, folder = _files(self.samples)
        for entry in self._entries(span):
            try:
                with store.open_input_file(f"{folder}/{entry['file']}") as f:
                    raw = f.read()
            except FileNotFoundError:
                continue
            yield tuple(raw if n == "raw" else entry.get(n) for n in self.names)


class LabelledSamples(DataSource):
    """The entries of a manifest with the bytes of their files, in a column raw. Entries without a file go.

    A manifest is JSON lines, read in spans of splitBytes, or one JSON array, read by one task. A line that is no JSON
    fails the read; a field that an entry lacks is null; fields that the schema doesn't name are left out; an empty
    manifest has no rows; an entry that comes twice makes two rows.
    """

    @classmethod
    def name(cls) -> str:
        return "labelled_samples"

    def schema(self) -> str:
        return "file string, expected_safe boolean, category string, raw binary"

    def reader(self, schema: StructType) -> SampleReader:
        return SampleReader(schema, self.options)


@dataclass
class Part(WriterCommitMessage):
    name: str


def latex_value(value) -> str:
    """A cell: marks for booleans, nothing for null, four places for fractions, special characters escaped."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return r"\checkmark" if value else r"$\times$"
    if isinstance(value, float):
        return f"{value:.4f}"
    return "".join({"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}.get(c, "\\" + c if c in "&%$#_{}" else c) for c in str(value))


class ReportWriter(DataSourceWriter):
    """Tasks write parts to a folder of the run; the commit moves them into place, an abort removes them."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.names, self.path, self.overwrite = schema.names, options["path"].rstrip("/"), overwrite
        self.layout, self.caption, self.label = options.get("layout", "csv"), options.get("caption", ""), options.get("label", "")
        if self.layout not in ("csv", "json", "latex"):
            raise ValueError(f"unknown layout: {self.layout}")
        self.run = uuid.uuid4().hex

    def _lines(self, rows: Iterator[Row]) -> Iterator[str]:
        line = io.StringIO()
        out = csv.writer(line, lineterminator="\n")
        if self.layout == "csv":
            out.writerow(self.names)
        for row in rows:
            if self.layout == "csv":
                out.writerow(["" if v is None else str(v).lower() if isinstance(v, bool) else v for v in row])
            elif self.layout == "json":
                line.write(json.dumps({n: v for n, v in zip(self.names, row, strict=True) if v is not None}, default=str) + "\n")
            else:
                line.write(" & ".join(map(latex_value, row)) + " \\\\\n")
            yield line.getvalue()
            line.seek(0), line.truncate()
        yield line.getvalue()

    def write(self, rows: Iterator[Row]) -> Part:
        from pyspark import TaskContext

        store, path = _files(self.path)
        store.create_dir(f"{path}/_run-{self.run}", recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{self.run}.{'tex' if self.layout == 'latex' else self.layout}"
        with store.open_output_stream(f"{path}/_run-{self.run}/{name}") as f:
            for line in self._lines(rows):
                f.write(line.encode())
        return Part(name)

    def commit(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        store, path = _files(self.path)
        store.create_dir(path, recursive=True)
        old = [f.path for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File] if self.overwrite else []
        names = sorted(m.name for m in messages if m is not None)
        for name in names:
            store.move(f"{path}/_run-{self.run}/{name}", f"{path}/{name}")
        if self.layout == "latex":
            head = [r"\begin{table}[ht]", r"\centering", rf"\caption{{{self.caption}}}", rf"\label{{{self.label}}}", rf"\begin{{tabular}}{{{'l' * len(self.names)}}}", r"\toprule", " & ".join(map(latex_value, self.names)) + r" \\", r"\midrule"]
            body = [rf"\input{{{name}}}" for name in names]
            with store.open_output_stream(f"{path}/table-{self.run}.tex") as f:
                f.write("\n".join([*head, *body, r"\bottomrule", r"\end{tabular}", r"\end{table}", ""]).encode())
        for file in old:
            store.delete_file(file)
        self._clear(store, path)

    def abort(self, messages: list[Part | None]) -> None:
        self._clear(*_files(self.path))

    def _clear(self, store, path: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{path}/_run-{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/_run-{self.run}")


class Report(DataSource):
    """Rows as parts of a folder: csv with a header in each part, json lines, or latex rows with a table that takes them in.

    Append adds parts; overwrite puts the new parts there and then removes the files of before. A write that fails leaves
    the folder as it was.
    """

    @classmethod
    def name(cls) -> str:
        return "report"

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        return ReportWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes both formats known to this session."""
    ship(spark)
    for source in (LabelledSamples, Report):
        spark.dataSource.register(source)
