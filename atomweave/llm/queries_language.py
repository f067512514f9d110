"""op2: the language of every document."""

from atomweave.llm.common import table
from atomweave.llm.language_id import identify


def op2_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op2_language_id": op2_language_id}
ORACLES: dict = {}
