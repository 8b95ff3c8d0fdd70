"""Each operation of the service on a small table."""

import pytest

from kinloom.operators import search
from kinloom.service import ROUTES, Service

RECORDS = [
    ("S1-1", "S1", 1, "Acme Bakery", "12 Main Road, near City Mall", "India"),
    ("S1-2", "S1", 2, "Blue Motors", "4 Side Street", "France"),
    ("S2-3", "S2", 3, "Acme Bakery Ltd", "12 Main Rd", "India"),
    ("S3-4", "S3", 4, "Acme Bakers", "12 Main Road", "India"),
]


@pytest.fixture()
def service(spark):
    records = spark.createDataFrame(RECORDS, "entity_id string, source string, ord long, business_name string, business_address string, country string")
    return Service(records, spark.createDataFrame([("S1-1", "S2-3"), ("S1-1", "S3-4")], "s1 string, target string"))


def test_every_route_is_a_method(service):
    assert len(ROUTES) == 13 and all(callable(getattr(service, name)) for name in ROUTES)
    assert {r.operation for r in service.root().collect()} == set(ROUTES)


def test_reads(service):
    assert service.health().first().asDict() == {"status": "healthy", "entities": 2, "links": 2}
    assert [(r.doc, r["rank"]) for r in service.search("acme bakery").collect()] == [("S1-1", 1)]
    assert [r.doc for r in service.search("what is s1-2?").collect()] == ["S1-2"]
    assert service.search("acme", country="France").isEmpty()
    one = service.entity("S1-1").collect()
    assert [(r.name, r.n_sources, r.category, r.aliases) for r in one] == [("Acme Bakery", 3, "food_dining", ["Acme Bakery", "Acme Bakery Ltd", "Acme Bakers"])]
    assert service.entity("S1-9").isEmpty() and service.graph("S1-9").isEmpty() and service.passport("S1-9").isEmpty()
    graph = service.graph("S1-1").collect()
    assert {r.id for r in graph if r.kind == "node"} >= {"node-S1-1", "node-src-S2-3", "node-land-S1-1"}
    assert {(r.id, r.target) for r in graph if r.kind == "edge"} >= {("node-src-S3-4", "node-S1-1")}
    assert "Acme Bakery" in service.passport("S1-1").first().passport
    assert {(r.figure, r.value): r.n for r in service.stats().collect()}["source", "S1"] == 2
    assert service.demo_queries(1).first().normalized == "Acme Bakery"


def test_review(service):
    assert [(r.entity_id, r.n_sources) for r in service.review_queue().collect()] == []  # lists of ten characters are short
    service.matches = service.matches.union(service.matches.selectExpr("s1", "'S3-55'"))
    service.review_action("S1-1", "separated", reason="apart")
    assert [(r.entity_id, r.n_sources, r.status) for r in service.review_queue().collect()] == [("S1-1", 4, "SEPARATED")]
    assert [(r.canonical_id, r.decision, r.reviewer, r.reason) for r in service.audit_logs().collect()] == [("S1-1", "SEPARATED", "Admin Reviewer", "apart")]


def test_batch(service):
    found = service.batch_resolve(service.batch_sample())
    assert {r.id: r.resolved_id for r in found.collect()} == {"S2-3": "S1-1", "S3-4": "S1-1"}
    assert search.batch_summary(found).first().total == 2


def test_refused(service):
    for call in (lambda: service.search(" "), lambda: service.search("x", limit=51), lambda: service.review_queue(0), lambda: service.audit_logs(101)):
        with pytest.raises(ValueError):
            call()
