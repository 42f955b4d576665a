"""Market-data candles on Spark: parse, normalise, deduplicate and fold trades, batch and streaming."""
