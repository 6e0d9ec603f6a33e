import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield s
    s.stop()


TEA = [
    ("d1", "2019-03-02", "blog", "Tea is my morning ritual. I drink green tea from a big cup. A cup of tea makes the day calm."),
    ("d2", "2019-11-20", "news", "Coffee prices rose again this year. Traders expect coffee demand to grow. The market for coffee is volatile."),
    ("d3", "2020-05-14", "blog", "I prefer green tea over coffee. A cup of green tea with honey is lovely. My sister drinks black tea."),
    ("d4", "2020-08-03", "news", "Coffee exports fell sharply. The coffee harvest was poor, and prices for coffee climbed."),
    ("d5", "2021-02-27", "blog", "Some days I drink a cup of coffee, but tea wins. Hot tea, a cup of tea, and a quiet book."),
    ("d6", "2021-09-09", "news", "Tea imports grew, while coffee imports fell. Analysts say green tea is gaining market share."),
    ("d7", "2022-04-18", "news", "TEA and COFFEE futures were quiet. Tea traders waited for the harvest."),
    ("d8", "2022-10-01", "blog", "Green tea, green tea, always green tea. A cup of tea is a small ritual."),
]


@pytest.fixture(scope="session")
def tea(spark):
    from korpuscle.operators.corpus import Corpus

    rows = [(i, name, date, register, text) for i, (name, date, register, text) in enumerate(TEA, 1)]
    df = spark.createDataFrame(rows, "doc_id long, name string, date string, register string, text string")
    return Corpus.from_documents(df, persist=True)
