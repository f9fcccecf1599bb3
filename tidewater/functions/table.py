"""Table functions in Python for SQL: a forecast of each partition's rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

#: What the function takes a series' order and target from, unless it is told.
TARGET, HORIZON = "sales", 30


def register_forecast(spark: SparkSession, load: Callable[[], Callable], name: str = "forecast") -> None:
    """Makes a model a table function: SELECT * FROM forecast(TABLE(t) PARTITION BY key ORDER BY idx).

    load() gives predict(target, past, future, horizon, levels), as for hosted
    models, and is called once a partition. The partition's key is the column named
    series (by default the table's first), the values are those of target, missing
    ones count as 0; horizon, target and series may be given by name, as constants.
    One row a step comes back: the key, step, p10, median, p90. A partition is one
    series, and its target alone is held.
    """
    from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
    from pyspark.sql.types import DoubleType, LongType, StructType

    target_default, horizon_default = TARGET, HORIZON

    class Forecast:
        @staticmethod
        def analyze(rows: AnalyzeArgument, horizon: AnalyzeArgument = None, target: AnalyzeArgument = None, series: AnalyzeArgument = None) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError("the first argument must be a table")
            fields = {f.name: f.dataType for f in rows.dataType}
            of = series.value if series is not None else rows.dataType[0].name
            measured = target.value if target is not None else target_default
            for column in (of, measured):
                if column not in fields:
                    raise ValueError(f"columns not found: [{column!r}]")
            if horizon is not None and (horizon.value is None or horizon.value < 1):
                raise ValueError("horizon must be a constant of 1 or more")
            schema = StructType().add("series_id", fields[of]).add("step", LongType())
            for column in ("p10", "median", "p90"):
                schema = schema.add(column, DoubleType())
            return AnalyzeResult(schema=schema)

        def __init__(self):
            self.key, self.values, self.horizon = None, [], horizon_default

        def eval(self, rows, horizon=None, target=None, series=None):
            self.key = rows[series] if series is not None else rows[0]
            value = rows[target if target is not None else target_default]
            self.values.append(0.0 if value is None else value)
            self.horizon = horizon_default if horizon is None else horizon

        def terminate(self):
            import numpy as np

            if self.values:
                low, middle, high = np.asarray(load()(np.asarray(self.values, np.float32), {}, {}, self.horizon, [0.1, 0.5, 0.9]), float)
                for step in range(self.horizon):
                    yield self.key, step, float(low[step]), float(middle[step]), float(high[step])

    spark.udtf.register(name, udtf(Forecast))
