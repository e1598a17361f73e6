import pytest

from orderloom import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    s = session.build(
        "local[4]", "tests", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_driver_memory="4g", spark_sql_warehouse_dir=str(base / "warehouse"), spark_checkpoint_dir=str(base / "shared")
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
