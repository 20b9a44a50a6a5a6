"""The Cypher subset on a small graph in time: the statements it answers, and those it refuses."""

from datetime import datetime

import pytest

from tessera.operators import cypher

EARLY, SWITCH, NOW = datetime(2024, 1, 1, 9), datetime(2024, 1, 1, 10), "2024-01-01 11:00:00"
ROWS = [
    ("notes-api", "uses", "auth_mjs", EARLY, None), ("auth", "uses", "hmac-session-tokens", EARLY, SWITCH), ("auth", "uses", "signed-session-tokens", SWITCH, None),
    ("class:Store", "DEFINES", "method:Store_graph_path", EARLY, None), ("method:Store_query_graph", "CALLS", "function:cypher_eval", EARLY, None),
    ("auth", "exposes", "issueToken", EARLY, None), ("auth", "exposes", "verifyToken", EARLY, None), ("notes-api", "exposes", "issueToken", EARLY, None), ("auth", "timeout_seconds", "900", EARLY, None), ("notes-api", "timeout_seconds", "30", EARLY, None),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(*r[:3], "s.md", *r[3:]) for r in ROWS], "src string, predicate string, dst string, source string, valid_from timestamp, valid_until timestamp")


@pytest.mark.parametrize("text, rows", [
    ("MATCH (n)-[:uses]->(m) WHERE n.name = 'notes-api' RETURN n.name AS from, m.name AS to ORDER BY to", [{"from": "notes-api", "to": "auth_mjs"}]),
    ("MATCH (n:Class)-[:DEFINES]->(m:Method) RETURN n.name AS class, m.name AS method ORDER BY method LIMIT 5", [{"class": "class:Store", "method": "method:Store_graph_path"}]),
    ("MATCH (n:Method)-[:CALLS]->(m:Function) WHERE n.name = 'method:Store_query_graph' RETURN labels(n) AS n_labels, m.name AS fn", [{"n_labels": ["Method"], "fn": "function:cypher_eval"}]),
    ("MATCH (n)-[:uses]->(m) RETURN count(*) AS uses_count", [{"uses_count": 2}]),
    ("MATCH (n)-[:exposes]->(m) RETURN count(DISTINCT m.name) AS exposed_count", [{"exposed_count": 2}]),
    ("MATCH (n)-[:exposes]->(m) WITH DISTINCT m.name AS name RETURN name ORDER BY name LIMIT 1", [{"name": "issueToken"}]),
    ("MATCH (n)-[:timeout_seconds]->(m) WHERE toInteger(m.name) >= 600 RETURN toInteger(m.name) AS seconds", [{"seconds": 900}]),
    ("MATCH (n)-[:exposes]->(m) WHERE m.name CONTAINS 'Token' OR NOT m.name = 'issueToken' RETURN DISTINCT m.name AS name ORDER BY name", [{"name": "issueToken"}, {"name": "verifyToken"}]),
    ("MATCH (n)-[:uses]->(m) WHERE n.name = 'auth' RETURN m.name AS token", [{"token": "signed-session-tokens"}]),
    ("AS OF '2024-01-01 09:30:00' MATCH (n)-[:uses]->(m) WHERE n.name = 'auth' RETURN m.name AS token", [{"token": "hmac-session-tokens"}]),
    ("MATCH (n)-[:exposes]->(m) WITH n, count(*) AS k WHERE k > 1 RETURN n.name AS who, k", [{"who": "auth", "k": 2}]),
    ("MATCH (n)-[:exposes]->(m) WITH m AS what, count(*) AS k WITH k, count(*) AS names ORDER BY k DESC LIMIT 1 RETURN k, names", [{"k": 2, "names": 1}]),
    ("MATCH (n)-[r]->(m) WITH r.predicate AS p, n.name AS who WHERE p = 'exposes' OR who STARTS WITH 'method' WITH p, count(*) AS k RETURN p, k ORDER BY p", [{"p": "CALLS", "k": 1}, {"p": "exposes", "k": 3}]),
    ("MATCH (n)-[:exposes]->(m) WITH count(*) AS k WHERE k > 100 RETURN k", []),
    ("MATCH (n)-[:nothing]->(m) WITH count(*) AS k RETURN k", [{"k": 0}]),
])
def test_answers(edges, text, rows):
    assert [r.asDict() for r in cypher.query(edges, text, at=NOW).collect()] == rows


@pytest.mark.parametrize("text", [
    "MATCH (n)-[r]->(m) WITH n.name AS a RETURN m.name", "MATCH (n)-[r]->(m) WITH m RETURN r.predicate", "MATCH (n)-[r]->(m) WITH n.name RETURN n.name", "MATCH (n)-[r]->(m) RETURN n.name, count(*)", "MATCH (n)-[r]->(m) WITH count(*) RETURN count(*)" + " x",
    "MATCH (n)-[r]->(m) WITH n.name AS a, m.name AS a RETURN a", "MATCH (n)-[r]->(m) WITH n AS x RETURN x", "MATCH (n)-[r]->(m) RETURN n", "MATCH (n)-[r]->(m) WITH n", "MATCH (n)-[r]->(m) RETURN n.name LIMIT x",
    "MATCH p=(n)-[:uses]->(m) RETURN p", "MATCH (n)<-[:uses]-(m) RETURN n.name", "MATCH (n)-[*1..2]->(m) RETURN m.name", "CREATE (n)", "MATCH (n) DETACH DELETE n", "MATCH (n)-[:uses|depends_on]->(m) RETURN m.name", "MATCH (n) RETURN n",
])
def test_refuses(edges, text):
    with pytest.raises(cypher.CypherError):
        cypher.query(edges, text)


@pytest.mark.parametrize("most, n, more", [(1, 1, True), (2, 2, True), (3, 3, False), (100, 3, False), (0, 1, True)])
def test_pages_say_whether_rows_are_left(edges, most, n, more):
    rows, truncated = cypher.query_page(edges, "MATCH (n)-[:exposes]->(m) RETURN n.name AS who, m.name AS what ORDER BY what", most, at=NOW)
    assert (rows.count(), truncated) == (n, more)
