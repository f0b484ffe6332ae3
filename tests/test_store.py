"""Writes to a managed graph."""

from __future__ import annotations

import pytest

from loomgraph.errors import ConstraintFault, SemanticFault
from loomgraph.store import Store


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_create_set_delete(spark, tmp_path):
    s = Store(spark, str(tmp_path / "g"))
    s.cypher("CREATE (a:P {name: 'a', k: 1})-[:R {w: 5}]->(b:P {name: 'b', k: 2})")
    assert s.revision == 1
    assert rows(s.cypher("MATCH (x:P)-[r:R]->(y) RETURN x.name, r.w, y.name")) == [("a", 5, "b")]
    s.cypher("MATCH (x:P {name: 'a'}) SET x.k = x.k + 10, x.extra = 'new'")
    assert rows(s.cypher("MATCH (x:P) RETURN x.name, x.k, x.extra")) == [("a", 11, "new"), ("b", 2, None)]
    s.cypher("MATCH (x:P {name: 'b'}) SET x += {k: 7}")
    s.cypher("MATCH (x:P {name: 'a'}) REMOVE x.extra")
    assert rows(s.cypher("MATCH (x:P) RETURN x.name, x.k, x.extra")) == [("a", 11, None), ("b", 7, None)]
    with pytest.raises(ConstraintFault):
        s.cypher("MATCH (x:P {name: 'a'}) DELETE x")
    s.cypher("MATCH (x:P {name: 'a'}) DETACH DELETE x")
    assert rows(s.cypher("MATCH (x:P) RETURN x.name")) == [("b",)] and s.cypher("MATCH ()-[r:R]->() RETURN r").count() == 0
    again = Store(spark, str(tmp_path / "g"))
    assert again.revision == s.revision and rows(again.cypher("MATCH (x:P) RETURN x.k")) == [(7,)]


def test_merge_and_transactions(spark, tmp_path):
    s = Store(spark, str(tmp_path / "g"))
    for _ in range(2):
        s.cypher("UNWIND [1, 2, 2] AS i MERGE (n:N {i: i}) ON CREATE SET n.made = true")
    assert rows(s.cypher("MATCH (n:N) RETURN n.i, n.made")) == [(1, True), (2, True)]
    with pytest.raises(SemanticFault):
        s.cypher("MERGE (n:N {i: null})")
    s.begin()
    s.cypher("CREATE (:N {i: 9})")
    assert s.cypher("MATCH (n:N) RETURN n").count() == 3
    s.rollback()
    assert s.cypher("MATCH (n:N) RETURN n").count() == 2
    other = Store(spark, str(tmp_path / "g"))
    s.begin()
    s.cypher("CREATE (:N {i: 10})")
    other.cypher("CREATE (:N {i: 11})")
    with pytest.raises(ConstraintFault):
        s.commit()


def test_label_sets_do_not_hide_each_other(spark, tmp_path):
    s = Store(spark, str(tmp_path / "g"))
    s.cypher("CREATE (:A {k: 1}), (:A:B {k: 2}), (:B {k: 3}), ({k: 4})")
    assert rows(s.cypher("MATCH (n:A) RETURN n.k")) == [(1,), (2,)]
    assert rows(s.cypher("MATCH (n:B) RETURN n.k")) == [(2,), (3,)]
    assert rows(s.cypher("MATCH (n) RETURN n.k, size(labels(n))")) == [(1, 1), (2, 2), (3, 1), (4, 0)]
    s.cypher("MATCH (x:A {k: 1}), (y:A:B {k: 2}) CREATE (x)-[:R {w: 1}]->(y), (y)-[:R {w: 2}]->(x)")
    assert rows(s.cypher("MATCH (x:A)-[r:R]->(y:B) RETURN x.k, y.k, r.w")) == [(1, 2, 1)]


def test_labels_are_set_and_removed(spark, tmp_path):
    s = Store(spark, str(tmp_path / "g"))
    s.cypher("CREATE (x:A {k: 1})-[:R {w: 5}]->(y:A {k: 2}), (y)-[:R {w: 6}]->(y)")
    s.cypher("MATCH (n:A {k: 2}) SET n:Hot:B, n.seen = true")
    assert rows(s.cypher("MATCH (n:Hot) RETURN n.k, n.seen, size(labels(n))")) == [(2, True, 3)]
    assert rows(s.cypher("MATCH (a:A)-[r:R]->(b:Hot) RETURN a.k, r.w, b.k")) == [(1, 5, 2), (2, 6, 2)]
    s.cypher("MATCH (n:Hot) REMOVE n:A")
    assert rows(s.cypher("MATCH (n:A) RETURN n.k")) == [(1,)] and rows(s.cypher("MATCH (n:B) RETURN n.k")) == [(2,)]
    assert rows(s.cypher("MATCH (a)-[r:R]->(b) RETURN a.k, r.w, b.k")) == [(1, 5, 2), (2, 6, 2)]


def test_commits_are_whole_or_absent(spark, tmp_path):
    path = str(tmp_path / "g")
    s = Store(spark, path)
    s.cypher("CREATE (:N {i: 1})")
    one, two = Store(spark, path), Store(spark, path)
    one.begin(), two.begin()
    one.cypher("CREATE (:N {i: 2})"), two.cypher("CREATE (:N {i: 3})")
    one.commit()
    two._load = lambda: (two.revision, two.tables)  # both have passed the first check
    with pytest.raises(ConstraintFault):
        two.commit()
    (tmp_path / "g" / "staged").mkdir(exist_ok=True)
    (tmp_path / "g" / "staged" / "left-behind").write_text('{"revision": 9')  # a writer that died before its rename
    again = Store(spark, path)
    assert again.revision == 2 and rows(again.cypher("MATCH (n:N) RETURN n.i")) == [(1,), (2,)]


def test_a_failed_statement_latches_the_transaction(spark, tmp_path):
    s = Store(spark, str(tmp_path / "g"))
    s.begin()
    s.cypher("CREATE (:N {i: 1})")
    with pytest.raises(SemanticFault):
        s.cypher("CREATE (:N {i: nope})")
    for act in (lambda: s.cypher("MATCH (n) RETURN n"), s.commit):
        with pytest.raises(SemanticFault):
            act()
    s.rollback()
    assert s.cypher("MATCH (n) RETURN n").count() == 0 and s.revision == 0
