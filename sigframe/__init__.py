"""Analytics over time-stamped market and event data, as DataFrame and streaming operators."""
