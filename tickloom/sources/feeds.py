"""Feeds: where each is, how to subscribe, which parser reads it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import subscribe_text
from ..operators.parsers import PARSERS, Parser


@dataclass(frozen=True)
class Feed:
    """A public trade feed. sources.live lands its messages; here they are files or a stream of text."""

    name: str
    exchange: str
    host: str
    port: int
    path: str
    parser: str

    @property
    def parse(self) -> Parser:
        return PARSERS[self.parser]

    @property
    def url(self) -> str:
        return f"wss://{self.host}:{self.port}{self.path}"

    def subscription(self, symbols: Sequence[str]) -> str:
        return subscribe_text(self.name, symbols)

    def unsubscription(self, symbols: Sequence[str]) -> str:
        return subscribe_text(self.name, symbols, "unsubscribe")


# fixed values: the feeds' public endpoints
FEEDS = {
    f.name: f
    for f in (
        Feed("binance", "BINANCE", "fstream.binance.com", 443, "/ws", "binance_raw"),
        Feed("bybit", "BYBIT", "stream.bybit.com", 443, "/v5/public/linear", "bybit_provider"),
        Feed("okx", "OKX", "ws.okx.com", 8443, "/ws/v5/public", "okx"),
    )
}


def landed(spark: SparkSession, path: str) -> DataFrame:
    """Messages landed as text files, one a line."""
    return spark.read.text(path).where("value <> ''")


def landing(spark: SparkSession, path: str, files_per_trigger: int | None = 64) -> DataFrame:
    """The same as a stream. files_per_trigger bounds a micro-batch: back-pressure in place of dropping."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).where("value <> ''")
