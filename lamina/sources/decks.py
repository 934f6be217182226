"""Decks as a Spark data source, and folders that are watched for new images."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from lamina.sources.files import SUFFIXES


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]  # as written, and as they are to be


class DeckWriter(DataSourceWriter):
    """Writes the binary column of each row to its own file below the path.

    Tasks write under names of their own; the commit renames the files once all are there, and refuses a name that two
    rows have. A task that runs twice leaves one whole file, a job that fails none.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path = path

    def opened(self):  # noqa: ANN201
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def write(self, rows: Iterator[Row]) -> Written:
        store, folder = self.opened()
        store.create_dir(folder, recursive=True)
        names = []
        for row in rows:
            own = f"_{uuid.uuid4().hex}"
            with store.open_output_stream(f"{folder}/{own}") as out:
                out.write(bytes(row["pptx"]))
            names.append((own, row["name"]))
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = self.opened()
        every = [x for m in messages if m for x in m.names]
        if len({name for _, name in every}) < len(every):
            self.abort(messages)
            raise ValueError("two decks have one name")
        for own, name in every:
            store.move(f"{folder}/{own}", f"{folder}/{name}.pptx")

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = self.opened()
        for m in messages:
            for own, _ in m.names if m else ():
                store.delete_file(f"{folder}/{own}")


class Decks(DataSource):
    """df.write.format("pptx").mode("append").save(path), for rows of name and pptx."""

    @classmethod
    def name(cls) -> str:
        return "pptx"

    def schema(self) -> str:
        return "name string, pptx binary"

    def writer(self, schema, overwrite: bool) -> DeckWriter:
        return DeckWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Decks)


def watched_images(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the image files that are put into a folder."""
    pattern = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in s) for s in SUFFIXES.split(",")) + "}"
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(folder)
