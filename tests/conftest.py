import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from skeinwatch import schemas as S  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        # tiny inputs: compiling a stage costs more than running it interpreted
        .config("spark.sql.codegen.wholeStage", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_flows(spark):
    """FLOW rows from dicts; `t` is the time in seconds."""

    def build(rows):
        out = []
        for i, given in enumerate(rows):
            r = dict(given)
            t = r.pop("t", 5000.0)
            base = dict(
                seq=i, ts_us=round(t * 1_000_000), record_kind="conn", src_ip="10.0.0.1", src_port=40000,
                dst_ip="10.0.0.2", dst_port=443, protocol="TCP", flags=[], bytes_out=0, bytes_in=0,
                packets_out=1, packets_in=0, source="live",
            )
            base.update(r)
            key = f"{base['src_ip']}:{base['src_port']}->{base['dst_ip']}:{base['dst_port']}"
            base.setdefault("flow_id_raw", key if base["record_kind"] == "conn" else None)
            base.setdefault("flow_id", key)
            base["ts"] = dt.datetime.fromtimestamp(base["ts_us"] / 1e6, dt.timezone.utc)
            out.append(tuple(base.get(f.name) for f in S.FLOW.fields))
        return spark.createDataFrame(out, S.FLOW)

    return build
