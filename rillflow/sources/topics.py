"""Topics: a flat manifest of them, and Kafka reader options for exact offset ranges."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from ..workers import importable


@dataclass
class Topic:
    name: str
    partitions: int = 1
    replication_factor: int = 1
    configs: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.name or self.partitions < 1 or self.replication_factor < 1:
            raise ValueError(f"topic {self.name!r} needs a name and positive counts")


def read_manifest(text: str) -> list[Topic]:
    """Topics of a manifest: a list of flat entries under ``topics:``, each with one nested map ``configs:``.

    Comments and blank lines don't count; anything else that is no ``key: value`` is an error.
    """
    found: list[dict] = []
    nested = False
    for number, line in enumerate(text.splitlines(), 1):
        body = line.split(" #", 1)[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#") or body.strip() == "topics:":
            continue
        entry = body.strip()
        if entry.startswith("- "):
            found.append({"configs": {}})
            entry, nested = entry[2:].strip(), False
        key, colon, value = (part.strip() for part in entry.partition(":"))
        if not colon or not found:
            raise ValueError(f"line {number}: {line!r}")
        if key == "configs":
            nested = True
        elif nested:
            found[-1]["configs"][key] = value
        else:
            found[-1][key] = value
    counts = ("partitions", "replication_factor")
    return [Topic(**{k: int(v) if k in counts else v for k, v in t.items()}) for t in found]


def manifest_topics(texts: DataFrame, text: str = "manifest") -> DataFrame:
    """The topics of many manifests, one text a row: the other columns, name, partitions, replication_factor, configs.

    A text that is no manifest gives one row with its ``problem`` and no
    topic; null and empty ones have no topics.
    """
    importable(texts.sparkSession)
    kept = [c for c in texts.columns if c != text]
    shape = pa.list_(pa.struct([("name", pa.string()), ("partitions", pa.int32()), ("replication_factor", pa.int32()), ("configs", pa.map_(pa.string(), pa.string())), ("problem", pa.string())]))
    ddl = "array<struct<name: string, partitions: int, replication_factor: int, configs: map<string,string>, problem: string>>"

    def topics(manifest: str | None) -> list[dict]:
        try:
            return [{"name": t.name, "partitions": t.partitions, "replication_factor": t.replication_factor, "configs": sorted(t.configs.items())} for t in read_manifest(manifest or "")]
        except (TypeError, ValueError) as e:  # also fields that a topic doesn't have
            return [{"problem": str(e)}]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = pa.array([topics(m) for m in batch.column(len(kept)).to_pylist()], shape)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), found], [*kept, "_topics"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != text), f"_topics {ddl}"])
    return texts.select(*kept, text).mapInArrow(batches, schema).selectExpr(*[f"`{c}`" for c in kept], "inline(_topics)")


def range_options(topic: str, ranges: dict[int, tuple[int, int]]) -> dict[str, str]:
    """Options of a bounded Kafka read: each partition from its start offset up to, not including, its end."""
    side = lambda k: json.dumps({topic: {str(p): r[k] for p, r in sorted(ranges.items())}})
    return {"subscribe": topic, "startingOffsets": side(0), "endingOffsets": side(1)}
