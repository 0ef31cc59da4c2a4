"""A stream of cursor positions: each run of a query gets the next stretch of a table."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class CursorSource(DataSource):
    """Stretches (run, start, end) of a table of ``total`` rows, ``size`` rows at a time.

    The offset is the number of runs and the end of the last stretch; a stretch that would begin
    behind the last row begins at the front instead. An empty table gives no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "cursor_positions"

    def schema(self) -> str:
        return "run long, start long, end long"

    def simpleStreamReader(self, schema) -> CursorReader:
        return CursorReader(int(self.options["size"]), int(self.options["total"]))


class CursorReader(SimpleDataSourceStreamReader):
    def __init__(self, size: int, total: int):
        self.size, self.total = size, total

    def initialOffset(self) -> dict:
        return {"run": 0, "end": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        begin = start["end"] if start["end"] < self.total else 0
        end = {"run": start["run"] + 1, "end": min(begin + self.size, self.total)}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The stretch that ends at ``end``; a front stretch begins at 0."""
        begin = start["end"] if start["end"] < end["end"] else 0
        return iter([(end["run"], begin, end["end"])] if end["end"] > begin else [])

    def commit(self, end: dict) -> None:
        pass
