"""A Spark data source of recorded series: JSON files, each an activity."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from cadenza.functions.ordered import KEY

#: Names of the signals in the files.
SIGNALS = ("watts", "heartrate", "cadence", "altitude", "distance", "velocity_smooth", "temp", "grade")
#: Files are put together in a task up to this many bytes.
TASK_BYTES = 32 << 20


def number(x: object) -> float | None:
    """A number or the text of one; null for anything else."""
    try:
        return None if x is None or isinstance(x, bool) else float(x)
    except (TypeError, ValueError):
        return None


def flag(x: object) -> bool | None:
    """A boolean or the text of one; null for anything else."""
    return {"true": True, "false": False}.get(str(x).strip().lower())


class Files(InputPartition):
    def __init__(self, paths: list[tuple[str, str]]) -> None:
        self.paths = paths


class SeriesReader(DataSourceReader):
    def __init__(self, path: str, signals: list[str], task_bytes: int) -> None:
        self.path, self.signals, self.task_bytes, self.ids = path, signals, task_bytes, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keeps filters on the activity's id, which choose files; the others are Spark's."""
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if values is None or f.attribute != (KEY,):
                yield f
            else:
                self.ids = set(values) if self.ids is None else self.ids & set(values)

    def partitions(self) -> list[Files]:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        out, size = [], 0
        for x in sorted(fs.get_file_info(pyarrow.fs.FileSelector(root)), key=lambda x: x.path):
            name = x.base_name.split(".")[0]
            if x.is_file and x.base_name.endswith(".json") and not x.base_name.startswith((".", "_")) and (self.ids is None or name in self.ids):
                if not out or size + x.size > self.task_bytes:
                    out.append([])
                    size = 0
                out[-1].append((name, x.path))
                size += x.size
        return [Files(paths) for paths in out]

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        for name, path in partition.paths if partition else []:
            with fs.open_input_stream(path) as file:
                content = json.loads(file.read())
            yield self.samples(name, content)

    def samples(self, name: str, content: dict | list) -> pa.RecordBatch:
        """A file's samples; of a list of {type, data} or streams by name, only what was asked for is looked at."""
        streams = {x["type"]: x for x in content} if isinstance(content, list) else content.get("streams") or {}
        device = None if isinstance(content, list) else flag(content.get("device_watts"))
        data = lambda s: (streams.get(s) or {}).get("data") or []
        t = [number(x) for x in data("time")]
        columns = [pa.array([name] * len(t), pa.string()), pa.array([device] * len(t), pa.bool_()), pa.array(range(len(t)), pa.int32()), pa.array(t, pa.float64())]
        for s in self.signals:
            values = data("grade_smooth") or data("grade") if s == "grade" else data(s)
            read = (flag, pa.bool_()) if s == "moving" else (number, pa.float64())
            values = [read[0](x) for x in values[: len(t)]]
            columns.append(pa.array(values + [None] * (len(t) - len(values)), read[1]))
        return pa.record_batch(columns, names=[KEY, "device_watts", "sample_idx", "t", *self.signals])


class RecordedSeries(DataSource):
    """`spark.read.format("cadenza_series").option("signals", "watts,moving").load(folder)`: a row a sample.

    A folder's JSON files are one activity each, named by its id, with `streams` by name or a list of {type, data}; other files
    are passed over. Only the signals asked for are turned into columns (all of SIGNALS and `moving` by default). With
    spark.sql.python.filterPushdown.enabled a filter on activity_id (= or IN) chooses the files, others aren't opened. Files
    are put together in tasks of about `taskBytes`; a file that isn't JSON raises. Register it with spark.dataSource.register().
    """

    @classmethod
    def name(cls) -> str:
        return "cadenza_series"

    def signals(self) -> list[str]:
        found = [s.strip() for s in self.options.get("signals", ",".join((*SIGNALS, "moving"))).split(",") if s.strip()]
        if unknown := set(found) - {*SIGNALS, "moving"}:
            raise ValueError(f"no such signals: {sorted(unknown)}")
        return list(dict.fromkeys(found))

    def schema(self) -> StructType:
        kind = lambda s: BooleanType() if s == "moving" else DoubleType()
        fixed = [StructField(KEY, StringType()), StructField("device_watts", BooleanType()), StructField("sample_idx", IntegerType()), StructField("t", DoubleType())]
        return StructType(fixed + [StructField(s, kind(s)) for s in self.signals()])

    def reader(self, schema: StructType) -> SeriesReader:
        return SeriesReader(self.options["path"], self.signals(), int(self.options.get("taskBytes", TASK_BYTES)))


def register(spark: SparkSession) -> None:
    """Make the source known to the session, and let it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordedSeries)
