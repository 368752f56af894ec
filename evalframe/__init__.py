"""evalframe — multilingual LLM-benchmark analytics as Spark DataFrame jobs.

Public surface is plain functions ``f(df, ...) -> DataFrame`` (operators) and
``f(col, ...) -> Column`` (functions). Nothing here collects data to the driver;
every operator is a Spark plan that Catalyst/AQE optimise.
"""

from evalframe.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
