"""Registries for what users plug in: ranked-list columns, reasoning modules, reward functions, ingestion modules, reviewable datasets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rewards import OF_RESPONSE
from ..operators import rank as R


class Named(dict):
    """name → what is registered under it, once."""

    def add(self, name: str):
        def keep(f):
            if not name or name in self:
                raise ValueError(f"{name or 'an empty name'} can't be registered")
            self[name] = f
            return f

        return keep


#: name → (candidates(node_id, …), k) → ranked frame of k rows
COLUMNS: Named = Named()
#: name → (candidates, options) → candidates with another score
REASONING: Named = Named()
REWARDS = Named(OF_RESPONSE)


@COLUMNS.add("vector")
def vector(candidates: DataFrame, k: int) -> DataFrame:
    return R.ranked(candidates.select("node_id", F.round("vector", 6).alias("score")).orderBy(F.desc("score"), "node_id").limit(k))


@COLUMNS.add("recency")
def recency(candidates: DataFrame, k: int) -> DataFrame:
    return R.ranked(candidates.select("node_id", F.round("recency", 6).alias("score")).orderBy(F.desc("score"), "node_id").limit(k))


def voted(candidates: DataFrame, weights: dict[str, float], k: int, columns: Named = COLUMNS) -> DataFrame:
    """The registered columns fused, each with four times the final number of rows."""
    lists = {name: columns[name](candidates, 4 * k) for name in weights}
    return R.consensus(lists, weights).orderBy(F.desc(F.round("score", 9)), "node_id").limit(k)


@REASONING.add("booster")
def booster(candidates: DataFrame, factor: float = 1.1) -> DataFrame:
    return candidates.withColumn("score", F.col("score") * factor)


@REASONING.add("keyword_booster")
def keyword_booster(candidates: DataFrame, words: tuple[str, ...] = (), weight: float = 0.2) -> DataFrame:
    """Adds `weight` times the share of the words that a candidate's name has."""
    name = F.lower("name")
    hits = sum((F.when(name.contains(w.lower()), 1).otherwise(0) for w in words), F.lit(0))
    return candidates.withColumn("score", F.col("score") + weight * hits / max(1, len(words)))


@REASONING.add("cooler")
def cooler(candidates: DataFrame, days: str = "days", half_life: float = 30.0) -> DataFrame:
    """Halves a score with every half-life that the candidate has not been used."""
    return candidates.withColumn("score", F.col("score") * F.pow(F.lit(0.5), F.col(days) / half_life))


@REASONING.add("reflection")
def reflection(candidates: DataFrame, edges: DataFrame | None = None, share: float = 0.3, least: float = 0.5, most: int = 2000) -> DataFrame:
    """What reflecting on the candidates adds: each passes `share` of its score times the edge's weight on to its neighbours among them, if its score is `least` or more; a candidate takes the most that any neighbour passes on. edges(src, dst, weight), in both directions; the `most` best candidates pass on."""
    if edges is None:
        return candidates
    sources = candidates.where(F.col("score") >= least).orderBy(F.desc("score"), "node_id").limit(most).select("node_id", F.col("score").alias("_from"))
    links = edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight"))
    passed = links.join(F.broadcast(sources), F.col("src") == F.col("node_id")).groupBy(F.col("dst").alias("node_id")).agg(F.max(share * F.col("_from") * F.col("weight")).alias("_add"))
    return candidates.join(passed, "node_id", "left").withColumn("score", F.col("score") + F.coalesce("_add", F.lit(0.0))).drop("_add")


@dataclass(frozen=True)
class Ingestion:
    """endings: of files that the module takes; read: (spark, paths) → observations(source, number, text)."""

    endings: tuple[str, ...]
    read: Callable[[SparkSession, list[str]], DataFrame]

    def matches(self, path: str) -> bool:
        return path.lower().endswith(self.endings)


INGESTION: Named = Named()


def of_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """An observation for each paragraph of text files."""
    files = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("source"), F.posexplode(F.split("value", "\n\n+")).alias("number", "text"))
    return files.where("trim(text) <> ''")


def of_json(spark: SparkSession, paths: list[str]) -> DataFrame:
    """An observation for each line of JSON lines, from its field `text`; number counts within a file by the line's hash."""
    rows = spark.read.schema("text string").option("mode", "DROPMALFORMED").json(paths).withColumn("source", F.input_file_name())
    return rows.where("text is not null").select("source", F.xxhash64("text").alias("number"), "text")


INGESTION.add("paragraphs")(Ingestion((".txt", ".md"), of_lines))
INGESTION.add("json_lines")(Ingestion((".json", ".jsonl"), of_json))


def ingested(spark: SparkSession, paths: list[str], modules: Named = INGESTION) -> DataFrame:
    """(module, source, number, text) of all files; each goes to the first module that takes it, one of no module is left out."""
    todo, out = list(paths), None
    for name, module in modules.items():
        own = [p for p in todo if module.matches(p)]
        todo = [p for p in todo if p not in own]
        if own:
            rows = module.read(spark, own).select(F.lit(name).alias("module"), "source", F.col("number").cast("long").alias("number"), "text")
            out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "module string, source string, number long, text string")


@dataclass(frozen=True)
class Dataset:
    """A dataset to review: rows: (spark, folder) → frame; key: its id column; wants_review: the condition of rows that a person should see."""

    rows: Callable[[SparkSession, str], DataFrame]
    key: str
    wants_review: str


DATASETS: Named = Named()
DATASETS.add("labels")(Dataset(lambda spark, folder: spark.read.parquet(f"{folder}/labels.parquet"), "doc_id", "toxic = 1 and quality = 1"))
DATASETS.add("errors")(Dataset(lambda spark, folder: spark.read.parquet(f"{folder}/events.parquet").where("event_type = 'error'"), "event_id", "value > 30"))


def review_queue(spark: SparkSession, folder: str, datasets: Named = DATASETS) -> DataFrame:
    """(dataset, id) of all rows that want a review, of all registered datasets."""
    out = None
    for name in sorted(datasets):
        d = datasets[name]
        rows = d.rows(spark, folder).where(d.wants_review).select(F.lit(name).alias("dataset"), F.col(d.key).cast("long").alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return out
