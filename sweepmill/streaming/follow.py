"""Following a preview: snapshots of a live reconstruction as a stream, one row for each that was seen.

`spark.dataSource.register(PreviewSource)`, then `spark.readStream.format("preview").load(folder)`. The folder is one that
the driver's machine has mounted, as a viewer's is. The state file is read at each poll; snapshots that were replaced
between two polls are not seen, and a state file that is missing, half written or names files elsewhere is no snapshot."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

# The keys of the state of a preview.
SNAPSHOT = "snapshot long, cloud_file string, trajectory_file string, phase string, processed long, total long, progress_percent double, points long"
KEYS = tuple(part.split()[0] for part in SNAPSHOT.split(", "))


def bare(name: str) -> bool:
    """Whether a name is that of a file in the folder itself."""
    return bool(name) and "/" not in name and "\\" not in name and not name.startswith(".")


def state_of(folder: str) -> dict | None:
    """The state of the last snapshot, or None while there is none that can be trusted."""
    try:
        with open(os.path.join(folder, "preview_state.json"), encoding="utf-8") as file:
            state = json.load(file)
        state = {k: state[k] for k in KEYS}
    except (OSError, ValueError, KeyError, TypeError):
        return None
    return state if bare(state["cloud_file"]) and bare(state["trajectory_file"]) else None


class PreviewReader(SimpleDataSourceStreamReader):
    """An offset is the number of the last snapshot seen, and its row, so that a batch that is run again has it still."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"snapshot": -1}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        state = state_of(self.folder)
        if state is None or state["snapshot"] == start["snapshot"]:
            return iter(()), start
        return iter([tuple(state[k] for k in KEYS)]), state

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(()) if end["snapshot"] == start["snapshot"] else iter([tuple(end[k] for k in KEYS)])

    def commit(self, end: dict) -> None:
        """Nothing is kept for offsets that were processed."""


class PreviewSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "preview"

    def schema(self) -> str:
        return SNAPSHOT

    def simpleStreamReader(self, schema) -> PreviewReader:
        return PreviewReader(self.options["path"].removeprefix("file:"))
