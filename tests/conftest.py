import pytest

from macrospark.session import local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def series(spark):
    """Builds a long frame from {series: [values]}, monthly from 2000-01."""
    import pandas as pd

    def build(data, start="2000-01-01"):
        parts = [pd.DataFrame({"series_id": k, "date": pd.date_range(start, periods=len(v), freq="MS").date,
                               "value": pd.array(v, dtype="Float64").to_numpy(dtype=float, na_value=float("nan"))})
                 for k, v in data.items()]
        frame = spark.createDataFrame(pd.concat(parts), "series_id string, date date, value double")
        return frame.replace(float("nan"), None, ["value"])

    return build
