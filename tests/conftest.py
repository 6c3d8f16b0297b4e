import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


RECORD = "source string, source_id string, npi string, name_raw string, name_first string, name_last string, name_middle string, name_suffix string, specialty string, facility_name string, facility_address string, facility_city string, facility_state string, facility_zip string, latitude double, longitude double, record_id long"


@pytest.fixture(scope="session")
def five(spark):
    """Two physicians in five records."""

    def r(i, source, sid, npi, raw, first, last, middle, spec, state):
        return (source, sid, npi, raw, first, last, middle, None, spec, None, None, None, state, None, None, None, i)

    return spark.createDataFrame(
        [
            r(0, "cms", "cms_001", "1234567890", "SMITH, JOHN A", "JOHN", "SMITH", "A", "Internal Medicine", "MA"),
            r(1, "license", "lic_001", None, "John A. Smith, MD", "John", "Smith", "A", "Internal Med", "MA"),
            r(2, "hospital", "hosp_001", "1234567890", "Dr. John Smith", "John", "Smith", None, "Internal Medicine", "MA"),
            r(3, "cms", "cms_002", "9876543210", "JONES, MARY B", "MARY", "JONES", "B", "Cardiology", "NY"),
            r(4, "license", "lic_002", None, "Mary Jones, MD", "Mary", "Jones", None, "Cardiovascular Disease", "NY"),
        ],
        RECORD,
    )


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame([("cms_001", "lic_001", 0.92), ("cms_001", "hosp_001", 0.95), ("lic_001", "hosp_001", 0.88), ("cms_002", "lic_002", 0.90)], "source_id_1 string, source_id_2 string, weight double")
