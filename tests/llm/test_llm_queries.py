"""Every query of the package runs on the smallest data, and equals its SQL where it has one."""

import pytest

from tarnweave.llm import queries as llm
from tarnweave.llm import sql
from tests.test_queries import canonical, duck  # noqa: F401


@pytest.mark.parametrize("name", llm.NAMES)
def test_query(spark, sf, duck, name):  # noqa: F811
    df = llm.queries()[name](spark, sf)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    text = sql.oracle_sql().get(name)
    if text is not None:
        cursor = duck.execute(text)
        assert got == canonical([c[0] for c in cursor.description], cursor.fetchall())


def test_found_columns(spark, sf):
    shapes = {"p1_found": ["seq"], "p2_found": ["seq"], "p3_found": ["seq", "lang_code"], "p4_found": ["seq_a", "seq_b"], "p6_found": ["page_id", "block_md5"], "p7_found": ["term", "term_mark"], "p8_found": ["doc_id", "item_id"], "p10_found": ["doc_id"]}
    for name, columns in shapes.items():
        assert llm.queries()[name](spark, sf).columns == columns
