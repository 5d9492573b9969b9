from pyspark.sql import functions as F

from flowloom.operators import detect
from flowloom.schemas import SHORT_HEADERS


def labelled(spark):
    return (spark.range(200).withColumn("Tot Fwd Pkts", F.col("id") % 100).withColumn("Flow Byts/s", F.col("id") * 1.5)
            .withColumn("label", (F.col("id") % 100 > 50).cast("int")))


def test_train_score_save_load(spark, tmp_path):
    rows = labelled(spark)
    names = ["Total Fwd Packets", "Flow Bytes/s"]  # long names on a short-named table
    model = detect.train_flow_model(rows, names, "label", trees=5)
    model.save(str(tmp_path / "model"))
    again = detect.FlowModel.load(str(tmp_path / "model"))
    assert again.feature_names == names
    scored = detect.score_flows(rows, again)
    assert scored.columns == rows.columns + ["proba"]
    wrong = scored.filter((F.col("proba") > 0.5).cast("int") != F.col("label")).count()
    assert wrong <= 4 and set(rows.columns[1:3]) <= set(SHORT_HEADERS)


def test_verdict(spark):
    df = spark.createDataFrame([(0.9, 5000), (0.5, 2001), (0.5, 2000)], "p double, n int")
    plain = [r[0] for r in df.select(detect.verdict(F.col("p"), F.col("n"))).collect()]
    ruled = [r[0] for r in df.select(detect.verdict(F.col("p"), F.col("n"), True)).collect()]
    assert plain == ["DDoS", "Normal", "Normal"] and ruled == ["DDoS", "Warning", "Normal"]
