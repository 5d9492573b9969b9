"""Flow classification: a Spark ML model, its scores, and the three-way verdict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators.columns import quoted, with_features
from flowloom.session import names_in

ATTACK_PROBABILITY = 0.5
WARNING_PACKETS = 2000


@dataclass
class FlowModel:
    """A fitted pipeline and the feature list it expects, in order."""

    pipeline: PipelineModel
    feature_names: list[str]

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        spark = SparkSession.active()
        names = [(i, n) for i, n in enumerate(self.feature_names)]
        spark.createDataFrame(names, "pos int, name string").coalesce(1).write.mode("overwrite").json(f"{path}/features")

    @classmethod
    def load(cls, path: str) -> FlowModel:
        spark = SparkSession.active()
        names = spark.read.schema("pos int, name string").json(f"{path}/features").orderBy("pos").collect()
        return cls(PipelineModel.load(f"{path}/pipeline"), [r["name"] for r in names])


def _model_input(df: DataFrame, feature_names: list[str]) -> tuple[DataFrame, list[str]]:
    """The rows as one struct beside the features as plain-named doubles, NULL read as 0."""
    names = [f"x{i}" for i in range(len(feature_names))]
    features = [F.coalesce(quoted(n).cast("double"), F.lit(0.0)).alias(x) for n, x in zip(feature_names, names)]
    rows = F.struct(*[quoted(c) for c in df.columns]).alias("row")
    return with_features(df, feature_names).select(rows, *features), names


def train_flow_model(df: DataFrame, feature_names: list[str], label: str, trees: int = 20, depth: int = 5,
                     seed: int = 42) -> FlowModel:
    """Fit assembler, scaler and random forest on labelled flows (label 0 or 1)."""
    table, names = _model_input(df, feature_names)
    table = table.select(*names, F.col("row").getField(label).cast("double").alias("label"))
    stages = [
        VectorAssembler(inputCols=names, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=False, withStd=True),
        RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed),
    ]
    return FlowModel(Pipeline(stages=stages).fit(table), list(feature_names))


def score_flows(df: DataFrame, model: FlowModel) -> DataFrame:
    """Input rows plus ``proba``, the probability of an attack. Works on batch and stream."""
    table, _ = _model_input(df, model.feature_names)
    scored = model.pipeline.transform(table)
    # a model that has seen no attack knows one class only
    return scored.select("row.*", F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0)).alias("proba"))


def verdict(proba: Column, packets: Column, high_rate_rule: bool = False) -> Column:
    """DDoS above the probability limit; with the rule on, Warning for many packets; else Normal."""
    out = F.when(proba > ATTACK_PROBABILITY, "DDoS")
    if high_rate_rule:
        out = out.when(packets > WARNING_PACKETS, "Warning")
    return out.otherwise("Normal")


def add_verdict(df: DataFrame, high_rate_rule: bool = False) -> DataFrame:
    packets = F.col("tot_fwd_pkts") + F.col("tot_bwd_pkts")
    return df.withColumn("verdict", verdict(F.col("proba"), packets, high_rate_rule))


class VerdictSink:
    """Scores the flows of each batch of a ``FlowAssembler`` (its ``then``) and writes them with their verdicts, one folder a batch.

    The model is read from ``model_path`` and read again when the folder has changed, so a model saved there anew takes effect with the
    next batch.
    """

    def __init__(self, spark: SparkSession, model_path: str, target: str, high_rate_rule: bool = False):
        self.spark, self.model_path, self.target, self.high_rate_rule = spark, model_path.rstrip("/"), target.rstrip("/"), high_rate_rule
        self._model: FlowModel | None = None
        self._seen: list[str] = []

    def model(self) -> FlowModel:
        # the names of written parts differ with each save
        now = names_in(self.spark, f"{self.model_path}/features") + names_in(self.spark, f"{self.model_path}/pipeline/metadata")
        if self._model is None or now != self._seen:
            self._model, self._seen = FlowModel.load(self.model_path), now
        return self._model

    def __call__(self, flows: DataFrame, name: str) -> None:
        scored = add_verdict(score_flows(flows, self.model()), self.high_rate_rule)
        scored.write.mode("overwrite").parquet(f"{self.target}/batch={name}")

    def verdicts(self) -> DataFrame:
        return self.spark.read.option("basePath", self.target).parquet(f"{self.target}/batch=*").drop("batch")
