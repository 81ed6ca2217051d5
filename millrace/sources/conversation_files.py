"""A Spark data source that writes conversations, one JSON file each.

Each task writes into a folder of its own whose name begins with a dot, which readers pass over; the commit gives the folders
of the tasks that succeeded their final names.  So a failed or repeated task leaves nothing that is read, the driver hears one name
a task, and a folder holds as many conversations as a task had.  A message is written when it arrives: a conversation is never held whole.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow.fs import FileSystem
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Rows: the conversation's id, its message as JSON, sorted by id and turn.
SCHEMA = "conv_id string, message string"


def file_name(conv_id: str) -> str:
    """A name that no reader takes for hidden; an empty id is a zero byte."""
    name = quote(conv_id or "\0", safe=" ")
    return f"%{ord(name[0]):02X}{name[1:]}.json" if name[0] in "._" else f"{name}.json"


@dataclass
class Written(WriterCommitMessage):
    folder: str


class ConversationWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def _files(self) -> tuple[FileSystem, str]:
        return FileSystem.from_uri(self.path.replace("file:/", "file:///") if self.path.startswith("file:/") and not self.path.startswith("file://") else self.path)

    def write(self, rows) -> Written:
        fs, root = self._files()
        name = uuid.uuid4().hex
        fs.create_dir(f"{root}/.{name}", recursive=True)
        last, out = None, None
        for conv_id, message in rows:
            if out is None or conv_id != last:
                if out:
                    out.write(b"]")
                    out.close()
                last, out = conv_id, fs.open_output_stream(f"{root}/.{name}/{file_name(conv_id)}")
                out.write(b"[" + message.encode())
            else:
                out.write(b"," + message.encode())
        if out:
            out.write(b"]")
            out.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = self._files()
        for m in messages:
            if m is not None:
                fs.move(f"{root}/.{m.folder}", f"{root}/{m.folder}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = self._files()
        for m in messages:
            if m is not None:
                fs.delete_dir(f"{root}/.{m.folder}")


class ConversationFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "conversation_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> ConversationWriter:
        if overwrite:
            raise ValueError("conversations are added to a folder; write to a new one instead of replacing it")
        return ConversationWriter(self.options["path"])
