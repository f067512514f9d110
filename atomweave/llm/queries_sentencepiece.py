"""op10: every whole text of documents, encoded and decoded."""

from atomweave.llm.common import table
from atomweave.llm.sentencepiece_bpe import encode_digests


def op10_sentencepiece(spark, sf_dir):
    return encode_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op10_sentencepiece": op10_sentencepiece}
ORACLES: dict = {}
