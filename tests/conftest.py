import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from linkcast.operators.ordering import index_series  # noqa: E402
from linkcast.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s


@pytest.fixture(scope="session")
def make_signal(spark):
    """A signal from {series name: values}."""

    def make(series: dict, base="x", **index):
        pdf = pd.concat(
            [pd.DataFrame({"series": k, "t": range(len(v)), base: np.asarray(v, float)}) for k, v in series.items()]
        )
        # Shuffled rows: nothing may depend on their order.
        df = spark.createDataFrame(pdf.sample(frac=1, random_state=1))
        return index_series(df, ["series"], ["t"], [base], **index)

    return make


def by_series(df, name):
    pdf = df.where(f"series = '{name}'").toPandas()
    return pdf.sort_values("seq").reset_index(drop=True)
