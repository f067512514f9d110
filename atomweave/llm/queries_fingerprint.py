"""op3: fingerprints of every document and its edited text."""

from atomweave.llm.common import table
from atomweave.llm.fingerprint import fingerprints


def op3_fingerprints(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op3_fingerprints": op3_fingerprints}
ORACLES: dict = {}
