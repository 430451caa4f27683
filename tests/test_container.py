"""The contact matrix as an object."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

from pairloom.operators import matrix
from pairloom.operators.container import ContactMatrix, as_edge, is_symmetric, with_sparse_rows, without_sparse_rows
from pairloom.sources import files


def test_edges_of_all_kinds_and_pairs(spark):
    _, regions = files.dummy_matrix(spark, (4, 2))
    m = ContactMatrix.empty(regions.drop("valid"))
    assert as_edge([3, 1]) == as_edge({"source": 1, "sink": 3}) == as_edge(SimpleNamespace(source=3, sink=1)) == (1, 3, 1.0)
    m.add_edge((3, 1, 2.0))
    m.add_edges([(1, 3), {"source": 0, "sink": 0, "weight": 4}])
    m.add_edges(spark.createDataFrame([(5, 4, 1.5)], "source long, sink long, weight double"))
    m.add_read_pairs(spark.createDataFrame([("chr1", 1, "chr2", 1500), ("chr1", 3999, "chr1", 1001)], "left_chromosome string, left_position long, right_chromosome string, right_position long"))
    assert {(e.source, e.sink): e.weight for e in m.flush().edges.collect()} == {(1, 3): 4.0, (0, 0): 4.0, (4, 5): 1.5, (0, 5): 1.0}
    assert {(e.source, e.sink): e.weight for e in m.update_edges(lambda w: w * 2, F.col("source") == F.col("sink")).edges.collect()}[0, 0] == 8.0
    assert m.copy(inter=False).edges.count() == 3
    more = m.add_regions(spark.createDataFrame([("chr3", 1, 10)], "chromosome string, start long, end long"))
    assert more.regions.agg(F.max("ix")).first()[0] == 6
    assert (m.bins_to_distance(3), m.distance_to_bins(2500)) == (3000, 3)
    assert [e.weight for e in m.sorted().collect()] == [4.0, 4.0, 1.5, 1.0]


def test_biases_parts_and_results(spark):
    edges, regions = files.dummy_matrix(spark, (5, 3))
    m = ContactMatrix(regions.drop("valid"), edges)
    assert m.bias_vector().tolist() == [1.0] * 8
    b = m.set_biases([0.5] * 4 + [0.0] + [1.0] * 3)
    assert b.bias_vector().tolist() == [0.5] * 4 + [0.0] + [1.0] * 3
    d = b.dense()
    assert is_symmetric(d) and np.isnan(d[4]).all() and d[0, 1] == 2 * 0.25 and d[5, 6] == 12
    assert b.copy(bias=False).bias_vector().tolist() == [1.0] * 8
    assert {r.ix: r.label for r in m.region_data("label", {2: "x"}).region_data("label").collect()}[2] == "x"
    own = m.within("chr1:1-3000")
    assert own.edges.count() == 6 and own.regions.count() == 3
    assert {(r.distance, r.possible) for r in m.possible_contacts("chr1:1-3000").collect()} == {(0, 3), (1, 2), (2, 1)}
    assert {r.distance: r.expected for r in m.expected("chr1:1-3000").where("chromosome is not null").collect()} == {0: 3.0, 1: 3.0, 2: 3.0}
    k = m.normalise("kr", regions=m.regions)
    cis = k.copy(inter=False)
    assert cis.marginals().agg(F.max(F.abs(F.col("marginal") - 1))).first()[0] < 1e-5
    kept, counts = m.filtered(diagonal=matrix.near_diagonal(0), heavy=F.col("weight") > 3)
    assert kept.edges.count() == edges.where("source <> sink and weight > 3").count() and {r.name for r in counts.collect()} == {"diagonal", "heavy", "valid"}
    r = m.rebinned(2)
    assert [(x.chromosome, x.start, x.end) for x in r.regions.orderBy("ix").collect()] == [("chr1", 1, 2000), ("chr1", 2001, 4000), ("chr1", 4001, 5000), ("chr2", 1, 2000), ("chr2", 2001, 3000)]
    assert r.edges.agg(F.sum("weight")).first()[0] == edges.agg(F.sum("weight")).first()[0]
    assert m.rebinned(2, lambda e, to: e.limit(1)).edges.count() == 1
    assert m.statistic(F.max).first().value == 15.0 and m.statistic(F.sum, F.col("source")).count() == 8
    assert m.enriched(1.0).where("oe < 1").count() == 0


def test_sparse_rows_go_and_come_back():
    m = np.array([[4.0, 1, 0, 2], [1, 3, 0, 1], [0, 0, 0, 0], [2, 1, 0, 0]])
    a, one = without_sparse_rows(m, 0)
    b, two = without_sparse_rows(a)
    assert one.tolist() == [2] and two.tolist() == [2] and b.shape == (2, 2)
    back = with_sparse_rows(b, [one, two])
    assert back.shape == m.shape and is_symmetric(back) and back[0, 1] == 1 and back[3].sum() == back[2].sum() == 0
    assert not is_symmetric(np.array([[1.0, 2], [3, 1]]))
