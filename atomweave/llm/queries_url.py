"""op9: a verdict for every url of pages."""

from atomweave.llm.common import table
from atomweave.llm.url_filter import judge


def op9_url_filter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))


QUERIES = {"op9_url_filter": op9_url_filter}
ORACLES: dict = {}
