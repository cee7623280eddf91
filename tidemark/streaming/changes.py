"""The changes of a store's file list as a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..sources.location import open_fs

SCHEMA = "version long, change string, tier string, seq_no long, state string, path string, min_key string, max_key string"


class ManifestChanges(DataSource):
    """spark.readStream.format("tidemark_changes").load(folder of a store's _manifest).

    A row for each file that a version lists anew or in another state (change put) or drops (change gone);
    a version without such changes has none. Option `since`: the version after which to begin (0).
    """

    @classmethod
    def name(cls) -> str:
        return "tidemark_changes"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> ManifestChangesReader:
        return ManifestChangesReader(self.options)


class ManifestChangesReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.path, self.since = options["path"], int(options.get("since", 0))

    def initialOffset(self) -> dict:
        return {"version": self.since}

    def _rows(self, version: int) -> list[tuple] | None:
        fs, path = open_fs(self.path)
        name = f"{path}/v{version:012d}.json"
        if not fs.get_file_info(name).is_file:
            return None
        with fs.open_input_file(name) as f:
            change = json.loads(f.read())
        put = [(version, "put", x["tier"], x["seq_no"], x["state"], x["path"], x["min_key"], x["max_key"]) for x in change["put"]]
        return put + [(version, "gone", tier, seq, None, None, None, None) for tier, seq in change["gone"]]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        version, rows = start["version"], []
        while (got := self._rows(version + 1)) is not None:
            rows += got
            version += 1
        return iter(rows), {"version": version}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for version in range(start["version"] + 1, end["version"] + 1):
            yield from self._rows(version) or ()
