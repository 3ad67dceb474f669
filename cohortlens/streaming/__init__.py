"""Streaming.

The studied analyses read closed batch files only: there is no watermark,
time window, stateful operator or late data anywhere in them, so this package
holds no operator.  Every operator in ``cohortlens.operators`` is a plain
DataFrame transformation and accepts a streaming DataFrame where Spark allows
the same transformation on a stream (projections, filters, recodes); the
history windows and quantile operators need a bounded input.
"""
