"""op7: all documents packed into sequences of at most 4096 tokens."""

from atomweave.llm.common import table
from atomweave.llm.packing import pack_documents


def op7_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op7_packing": op7_packing}
ORACLES: dict = {}
