"""Settings of the job and the read interface: from arguments, else environment variables, checked before anything starts."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from .schema import DEDUP_TTL

PREFIX = "RILLFLOW_"


@dataclass(frozen=True)
class Settings:
    out: str  # folder of the job's tables
    source: str = ""  # topic or folder of raw records
    kind: str = "text"  # text or kafka
    brokers: str = ""
    checkpoint: str = ""  # by default beside the tables
    every_s: float = 0.0  # seconds between micro-batches; 0 takes what is there and ends
    most_records: int = 500_000  # of Kafka that a micro-batch takes
    most_files: int = 100
    merge_s: float = 10.0  # seconds between looks for segments to merge
    remember: str = DEDUP_TTL
    strict: bool = True
    restarts: int = 10
    pause_s: float = 5.0
    host: str = "127.0.0.1"
    port: int = 8000
    places: int = 10
    wait_s: float = 2.0

    def __post_init__(self) -> None:
        if not self.out:
            raise ValueError("out names the folder of the tables")
        if self.kind not in ("text", "kafka"):
            raise ValueError("kind is text or kafka")
        if self.kind == "kafka" and not self.brokers:
            raise ValueError("kafka needs brokers")
        if self.every_s < 0 or self.restarts < 0 or self.pause_s < 0 or self.wait_s < 0 or self.merge_s <= 0 or min(self.places, self.most_records, self.most_files) < 1 or not 0 <= self.port < 65_536:
            raise ValueError("a number is out of range")

    @classmethod
    def of(cls, given: Mapping[str, str | None], environ: Mapping[str, str] | None = None) -> Settings:
        """Given values hold, then variables named after them in capitals behind RILLFLOW_."""
        environ = os.environ if environ is None else environ
        found = {}
        for name, field in cls.__dataclass_fields__.items():
            text = given.get(name)
            text = environ.get(PREFIX + name.upper()) if text is None else text
            if text is not None:
                found[name] = _typed(name, text, field.type)
        return cls(**({"out": ""} | found))


def _typed(name: str, text: str, kind: str) -> object:
    try:
        if kind == "bool":
            return {"1": True, "true": True, "yes": True, "0": False, "false": False, "no": False}[text.lower()]
        return {"int": int, "float": float}.get(kind, str)(text)
    except (KeyError, ValueError) as e:
        raise ValueError(f"{name} can't be {text!r}") from e
