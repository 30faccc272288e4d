"""Property: the shared variant-table plan equals per-variant naive recomputation."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from faultbench.operators.checksum import table_checksums
from faultbench.operators.downstream import build_tables, plain
from faultbench.operators.faults import (
    DUPLICATE_KEYS,
    JOIN_KEY_CORRUPTION,
    NULL_DENSITY_SURGE,
    NUMERIC_SCALE,
    REF_INTEGRITY_BREAK,
    STALE_PARTITION,
    FaultSpec,
    apply_faults,
)
from faultbench.operators.variants import VariantSet, only
from faultbench.plans.contract import PRIMARY_KEYS
from tests.fixture import fixture_tables


def _spec(i: int, kind: str, n: int) -> FaultSpec:
    params = {
        NUMERIC_SCALE: {"column": "amount_cents", "factor": 7},
        STALE_PARTITION: {"timestamp_column": "order_ts", "partition_column": "source_partition",
                          "group_column": "customer_id", "days": 3},
        NULL_DENSITY_SURGE: {"column": "customer_id"},
        JOIN_KEY_CORRUPTION: {"column": "customer_id"},
        DUPLICATE_KEYS: {},
        REF_INTEGRITY_BREAK: {},
    }[kind]
    target = "raw_customers" if kind == REF_INTEGRITY_BREAK else "raw_orders"
    return FaultSpec(f"f{i}-{kind}", kind, target, {**params, "row_count": n})


KINDS = [NUMERIC_SCALE, STALE_PARTITION, NULL_DENSITY_SURGE, JOIN_KEY_CORRUPTION, DUPLICATE_KEYS, REF_INTEGRITY_BREAK]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(KINDS), st.integers(1, 20)), min_size=1, max_size=4), st.integers(0, 99))
def test_shared_equals_naive(spark, faults, seed):
    specs = [_spec(i, k, n) for i, (k, n) in enumerate(faults)]
    ft = apply_faults(fixture_tables(spark), PRIMARY_KEYS, specs, seed)
    vs = ft.variants
    vary = any(s.target_table == "raw_customers" for s in specs)
    shared_tables = build_tables(ft.tables["raw_customers"], ft.tables["raw_orders"], vs, customers_vary=vary)
    shared = sorted(tuple(r) for r in table_checksums(shared_tables, vs).collect())
    naive = []
    for v in vs.names:
        t = build_tables(only(ft.tables["raw_customers"], vs, v), only(ft.tables["raw_orders"], vs, v), VariantSet())
        naive += [(v, *tuple(r)[1:]) for r in table_checksums({k: plain(x) for k, x in t.items()}).collect()]
    assert shared == sorted(naive)
    ft.release()
