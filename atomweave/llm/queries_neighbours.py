"""op5: the ten nearest embeddings of every embedding whose vec_id is divisible by 100."""

from pyspark.sql import functions as F

from atomweave.llm.common import table
from atomweave.llm.nn_descent import nearest


def op5_nn_descent(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


QUERIES = {"op5_nn_descent": op5_nn_descent}
ORACLES: dict = {}
