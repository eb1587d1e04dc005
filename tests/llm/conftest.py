import pytest


@pytest.fixture(autouse=True)
def shared_folder(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs; source and extra columns with clashing names beside them."""

    def make(*rows, sources=None):
        full = [
            (i, t, None, sources[k] if sources else "s", None, "x", 1, 2, "y") for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, DOCUMENTS + ", h string, key long, n int, keep_id string")

    return make
