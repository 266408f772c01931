"""Settings of the recognition dataflow, checked once on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

DECODERS = ("ctc", "attention", "transformer")


@dataclass(frozen=True)
class OcrConfig:
    binarize_threshold: float = 0.1
    polygon_threshold: float = 0.3
    unclip_ratio: float = 1.5
    max_candidates: int = 200
    upside_down: bool = False
    rotation_threshold: float = 0.0
    decoder: str = "ctc"
    only_alnum: bool = False
    only_lowercase: bool = False
    tile: int = 320
    overlap_rate: float = 0.5
    keep_aspect_ratio: bool = False
    crop_width: int = 100
    crop_height: int = 32
    #: Size that whole images are brought to before detection; 0 leaves them as they are.
    detect_width: int = 0
    detect_height: int = 0
    #: Images or tiles, and crops, that a model is given at once.
    detect_batch: int = 16
    recognise_batch: int = 64

    def __post_init__(self):
        for name in ("binarize_threshold", "polygon_threshold"):
            if not 0 < getattr(self, name) <= 1:
                raise ValueError(f"{name} must be in (0, 1]")
        if self.unclip_ratio <= 0:
            raise ValueError("unclip_ratio must be positive")
        if self.decoder not in DECODERS:
            raise ValueError(f"decoder must be one of {DECODERS}")
        if not 0 <= self.overlap_rate < 1:
            raise ValueError("overlap_rate must be in [0, 1)")
        if min(self.tile, self.crop_width, self.crop_height, self.detect_batch, self.recognise_batch) < 1:
            raise ValueError("sizes must be positive")
        if min(self.detect_width, self.detect_height) < 0 or (self.detect_width > 0) != (self.detect_height > 0):
            raise ValueError("detect_width and detect_height are both positive, or both 0")

    @classmethod
    def from_json(cls, text: str) -> OcrConfig:
        """Settings from a JSON object; unknown names are errors."""
        return cls._of(json.loads(text))

    @classmethod
    def from_properties(cls, text: str) -> OcrConfig:
        """Settings from ``key:value`` lines; blank lines are skipped."""
        return cls._of(dict((part.strip() for part in line.split(":", 1)) for line in text.splitlines() if line.strip()))

    @classmethod
    def _of(cls, given: dict) -> OcrConfig:
        kinds = {f.name: type(f.default) for f in fields(cls)}
        if unknown := set(given) - set(kinds):
            raise ValueError(f"unknown settings: {sorted(unknown)}")

        def cast(kind: type, value):
            return str(value).lower() in ("1", "true") if kind is bool else kind(value)

        return cls(**{k: cast(kinds[k], v) for k, v in given.items()})
