from pyspark.sql import functions as F

from docweave.llm import quality, queries


def test_held_out_rows_are_ranked(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op1_rule_ensemble_quality(spark, sf)
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").select("score", "quality", "predicted").collect()
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.95
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9
    assert got.filter("score is null or score < 0 or score > 1").count() == 0


def test_rules_are_the_paths_of_the_trees():
    text = """RandomForest
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 1 <= 2.0)
      Predict: 0.0
     Else (feature 1 > 2.0)
      Predict: 1.0
    Else (feature 0 > 0.5)
     If (feature 0 > 0.25)
      Predict: 1.0
"""
    a, b = quality.STATISTICS[:2]
    assert set(quality.tree_rules(text)) == {((a, True, 0.5),), ((a, True, 0.5), (b, True, 2.0)), ((a, True, 0.5), (b, False, 2.0)), ((a, False, 0.5),)}


def test_edges(spark, edge, empty):
    labels = spark.createDataFrame([(4, 1), (8, 0), (8, 0), (9, None), (6, 1), (7, 1)], "doc_id long, quality int")
    table, _ = quality.scored(edge, labels, F.lit(True))
    assert table.count() == edge.count() and table.filter("score is null").count() == 0
    same = {r.score for r in table.filter("doc_id = 4").collect()}
    assert len(same) == 1
    one, ensemble = quality.scored(edge, labels.filter("quality = 1"), F.lit(True))
    assert ensemble.weights == {} and one.first().score > 0.5
    assert quality.scored(empty, labels, F.lit(True))[0].count() == 0
