"""Run settings: defaults, JSON files, and the folders of finished stages."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path


@dataclass
class Settings:
    """Settings of an alignment run; the numbers are the usual ones of the task."""

    src_file: str = ""
    tgt_file: str = ""
    properties: list[str] = field(default_factory=lambda: ["rdfs:label"])
    cut: int = 0
    sample_rate: int = 10
    train_share: float = 0.2
    val_share: float = 0.1
    test_share: float = 0.7
    io_soft_rate: int = 2
    io_hard_rate: int = 2
    co_soft_rate: int = 4
    depth_threshold: int | None = None
    depth_strategy: str = "max"
    learning: str = "us"
    candidate_limits: list[int] = field(default_factory=lambda: [200, 50, 150, 100, 25])
    nbest: int = 1
    string_match: bool = True
    pooling: str = "mean"
    mode: str = "edit"
    extension_threshold: float = 0.9
    extension_rounds: int = 50
    repair_threshold: float = 0.999

    def __post_init__(self) -> None:
        self.mode = {"nes": "edit"}.get(self.mode, self.mode)  # both names are in use

    @classmethod
    def read(cls, path: str) -> Settings:
        """Settings of a JSON file, flat or in sections; keys that are not known are an error."""
        data: dict = {}
        for key, value in json.loads(Path(path).read_text()).items():
            data |= value if isinstance(value, dict) else {key: value}
        known = {f.name for f in fields(cls)}
        if unknown := sorted(data.keys() - known):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return cls(**data)

    def write(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2))

    def key(self) -> str:
        """Names the results of these settings: other settings, other folder."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:12]
