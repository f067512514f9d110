"""op8: a toxicity score for every document."""

from atomweave.llm.common import table
from atomweave.llm.toxicity import classify


def op8_toxicity(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES: dict = {}
