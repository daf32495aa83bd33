"""Kinds of manifest fields, each looked up once."""

from mosaiq.sources import manifests

FIELDS = (("a", "integer"), ("b.c", "number"), ("d", "list"), ("e", "string"))
TEXTS = [
    (1, '{"a": 1, "b": {"c": 2}, "d": [{"x": 1}, {"x": "y"}], "e": "s"}', set()),
    (2, '{"a": 1.0, "b": {"c": 1e3}, "d": [], "e": null}', {("a", "number"), ("e", "null")}),
    (3, '{"a": "1", "b": [2.5], "d": {"x": 1}}', {("a", "string"), ("b.c", "missing"), ("d", "object"), ("e", "missing")}),
    (4, '{"a": true, "b": {"c": "2"}, "d": "[]", "e": 12345678901234567890}', {("a", "boolean"), ("b.c", "string"), ("d", "string"), ("e", "number")}),
    (5, '{"a": 1', {(None, "not json")}),
    (6, None, {(None, "not json")}),
    (7, "[]", {("a", "missing"), ("b.c", "missing"), ("d", "missing"), ("e", "missing")}),
]


def test_kinds_of_fields(spark):
    found = manifests.field_problems(spark.createDataFrame([x[:2] for x in TEXTS], "capture long, manifest string"), FIELDS).collect()
    for key, _, wanted in TEXTS:
        assert {(r.field, r.kind) for r in found if r.capture == key} == wanted, key


def test_a_field_is_named_once(spark):
    """A chain of conditions over each field held a look-up and a schema for every condition: 186 us a manifest (F17)."""
    found = manifests.field_problems(spark.createDataFrame([x[:2] for x in TEXTS], "capture long, manifest string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("schema_of_variant") + plan.count("schemaOfVariant") == 1
