"""A sink that writes each row as one JSON document, with a two-phase commit.

A task writes its documents below a folder of its own inside the target; the driver moves them into
place once all tasks have succeeded, and deletes the folders if any fails; a task that is still
running then may leave its own behind. Readers that look for
``*.json`` in the target never see a part of a failed job.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "tallyforge_documents"
STAGED = "_staged"


@dataclass
class Staged(WriterCommitMessage):
    """What one task has written: its folder and the names in it."""

    folder: str
    names: list[str]


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else "file://" + path.removeprefix("file:"))


class DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.indent = int(options.get("indent", "2"))

    def write(self, iterator) -> Staged:
        store, base = _store(self.path)
        folder = f"{base}/{STAGED}-{self.job}/{uuid.uuid4().hex}"
        names = []
        for row in iterator:
            name = row["name"]
            if not name or name.startswith((".", "_")) or "/" in name:
                raise ValueError(f"not a name of a document: {name!r}")
            store.create_dir(folder, recursive=True)
            body = json.dumps(json.loads(row["body"]), indent=self.indent, ensure_ascii=False)
            with store.open_output_stream(f"{folder}/{name}.json") as out:
                out.write(body.encode() + b"\n")
            names.append(name)
        return Staged(folder, names)

    def commit(self, messages: list) -> None:
        store, base = _store(self.path)
        names = [n for m in messages if m for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two documents have the same name")
        store.create_dir(base, recursive=True)
        if self.overwrite:
            for info in store.get_file_info(_selector(base)):
                if info.extension == "json":
                    store.delete_file(info.path)
        for m in messages:
            for n in m.names if m else ():
                store.move(f"{m.folder}/{n}.json", f"{base}/{n}.json")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        store, base = _store(self.path)
        staged = f"{base}/{STAGED}-{self.job}"
        if store.get_file_info(staged).type == fs.FileType.Directory:
            store.delete_dir(staged)


def _selector(base: str):
    from pyarrow import fs

    return fs.FileSelector(base, allow_not_found=True)


class DocumentSink(DataSource):
    """``format(FORMAT)``: rows (name, body), body a JSON text, to ``<path>/<name>.json``, indented, in UTF-8."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        if not {"name", "body"} <= set(schema.fieldNames()):
            raise ValueError("columns name and body are needed")
        return DocumentWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentSink)


def write_documents(rows: DataFrame, path: str, append: bool = False) -> None:
    """Each row (name, body) as one file. A null or empty name, one with a slash, two equal ones and a body that is no JSON are errors; no document is left then, at most a staging folder that readers pass over."""
    register(rows.sparkSession)
    rows.select("name", "body").write.format(FORMAT).mode("append" if append else "overwrite").save(path)
