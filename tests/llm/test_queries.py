"""Every query of the subpackage runs on the small data with the columns it promises."""

import pytest

from packetflow.llm import queries

COLUMNS = {
    "p3_found": "field_name string, raw_value string, canonical_id int", "p4_found": "packet_id bigint, field_name string, value_norm string", "p5_found": "id_a bigint, field_a string, id_b bigint, field_b string",
    "p6_found": "id_a bigint, role_a string, id_b bigint, role_b string", "p7_found": "doc_id bigint, item_id int", "p9_found": "doc_id bigint",
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, data, name):
    df = queries.queries()[name](spark, data)
    rows = df.collect()
    assert rows and len(rows) == len({tuple(r) for r in rows})
    if name in COLUMNS:
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    if name in ("p5_found", "p6_found"):
        assert all((r[0], r[1]) < (r[2], r[3]) for r in rows)
