"""Steps that prefabs of large tables share: what is asked of few rows or of a value is asked once."""

from test_queries import SF, spark  # noqa: F401

from graphloom.operators import prefab
from graphloom.plans import prefab_queries


def test_priorities_are_few_before_they_are_looked_at(spark):  # noqa: F811
    told = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderpriority" not in told(prefab_queries.derived_catalog(spark, SF))
    texts = told(prefab_queries.derived_prefabs(spark, SF))
    assert "RepartitionByExpression [o_custkey" in texts and texts.count("conv(") <= 18


def test_values_of_fields_are_read_once(spark):  # noqa: F811
    found = prefab.objects(spark.createDataFrame([("p", '[{"__type__":"cc.Node","_name":"n"},{"__type__":"x","node":{"__id__":0},"a":{"__id__":0},"b":{"__uuid__":"u@1"},"c":3,"__prefab":{"__id__":0},"d":null}]')], "file string, text string"))
    refs = prefab.references(found, spark.createDataFrame([("u", "i.png")], "uuid string, path string"))
    assert {(r.field, r.kind, r.target) for r in refs.collect()} == {("a", "node", "0"), ("b", "asset", "i.png")}
    assert refs._jdf.queryExecution().optimizedPlan().toString().count("__uuid__") == 1
