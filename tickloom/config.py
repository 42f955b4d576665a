"""Service settings from command-line arguments, and what makes them valid."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from .functions.text import split_list


@dataclass(frozen=True)
class Settings:
    # fixed values: the defaults of the service
    interval_ms: int = 5000
    exchanges: tuple[str, ...] = ("binance", "bybit", "okx")
    instruments: tuple[str, ...] = ("BTCUSDT", "ETHUSDT", "SOLUSDT")
    grpc_port: int = 50051
    unknown: tuple[str, ...] = field(default=(), compare=False)

    @classmethod
    def from_args(cls, args: Sequence[str]) -> Settings:
        """Reads --interval_ms=, --exchanges=, --instruments= and --grpc_port=; the last of each counts.

        Empty lists fall back to the defaults; other arguments are kept in `unknown`.
        """
        values: dict = {}
        unknown = []
        for arg in args:
            name, equals, value = arg.partition("=")
            if not equals or name not in ("--interval_ms", "--exchanges", "--instruments", "--grpc_port"):
                unknown.append(arg)
            elif name in ("--interval_ms", "--grpc_port"):
                values[name[2:]] = int(value)
            elif items := split_list(value):
                values[name[2:]] = tuple(items)
        return cls(**values, unknown=tuple(unknown))

    def validate(self) -> Settings:
        if self.interval_ms <= 0:
            raise ValueError("interval_ms must be positive")
        if not self.exchanges:
            raise ValueError("at least one exchange is required")
        if not self.instruments:
            raise ValueError("at least one instrument is required")
        return self
