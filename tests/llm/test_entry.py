"""What the driver's contract asks of the training-data queries as a whole."""

import re
from pathlib import Path

import pytest

from pricelens.llm import queries

ROOT = Path(__file__).resolve().parents[2]


def test_each_operator_has_one_query():
    names = list(queries.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)


def test_nothing_else_imports_the_subpackage():
    for path in ROOT.glob("pricelens/**/*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"pricelens\.llm|from pricelens import llm", path.read_text()), path


@pytest.mark.parametrize("name, empty, columns", [
    ("op11_trie", "conversations", "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256"),
    ("op12_neighbours", "embeddings", "query_id rank vec_id score"),
    ("op13_alignment", "documents", "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256"),
])
def test_contract_columns_on_whole_and_on_empty_tables(spark, tmp_path, name, empty, columns):
    frame = queries.queries()[name](spark, "/root/testdata/sf0.001")
    kinds = dict(frame.dtypes)
    assert frame.columns == columns.split() and frame.count() > 0
    assert all(kinds[c] == {"rank": "int", "score": "double"}.get(c, "string" if c.endswith("sha256") else "bigint") for c in frame.columns)
    spark.read.parquet(f"/root/testdata/sf0.001/{empty}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{empty}.parquet")
    assert queries.queries()[name](spark, f"file://{tmp_path}").count() == 0
