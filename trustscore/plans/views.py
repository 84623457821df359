"""The given tables seen as reviews, behavior inputs, labelled rows and job events.

Every view is a projection or an equi-join of whole tables; ``catalog`` states the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def documents(self) -> DataFrame:
        return self.table("documents")

    def reviews(self) -> DataFrame:
        return self.documents().select(
            F.col("doc_id").cast("string").alias("review_id"),
            F.col("source").alias("product_id"),
            F.lit("web").alias("platform"),
            F.col("text").alias("content"),
            F.col("doc_id").alias("row_no"),
        )

    def texts(self) -> DataFrame:
        """Documents and conversation turns."""
        turns = self.table("conversations").select(
            F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("id"), "text"
        )
        return self.documents().select(F.concat(F.lit("d-"), "doc_id").alias("id"), "text").unionByName(turns)

    def probabilities(self) -> DataFrame:
        """Stand-in probability per document, spread over 0..1 by its id."""
        return self.documents().select(
            F.col("doc_id").alias("row_no"),
            F.col("doc_id").cast("string").alias("review_id"),
            F.col("source").alias("product_id"),
            ((F.col("doc_id") * 37) % 101 / 100.0).alias("suspicious_probability"),
        )

    def events(self) -> DataFrame:
        return self.table("events")

    def history(self) -> DataFrame:
        return self.events().select(F.col("user_id").cast("string").alias("user_id"), F.col("ts").alias("review_date"))

    def behavior_inputs(self) -> DataFrame:
        """One review per event; the account is created at the user's first signup."""
        events = self.events()
        created = (
            events.filter(F.col("event_type") == "signup").groupBy("user_id").agg(F.min("ts").alias("account_created_at"))
        )
        kind = F.col("event_type")
        return events.join(created, "user_id", "left").select(
            F.col("event_id").cast("string").alias("review_id"),
            F.col("event_id").alias("row_no"),
            F.col("user_id").cast("string").alias("user_id"),
            F.col("ts").alias("review_date"),
            F.when(kind == "purchase", True).when(kind != "error", False).alias("verified_purchase"),
            "account_created_at",
            F.array(
                F.col("ts"),
                F.col("ts") + F.make_dt_interval(mins=F.col("value").cast("int")),
                F.col("ts") - F.make_dt_interval(mins=(F.col("value") * 2).cast("int")),
            ).alias("user_review_dates"),
        )

    def master(self) -> DataFrame:
        """Review master: labelled documents, with a label that is neither normal nor suspicious for the rest."""
        return (
            self.documents()
            .join(self.table("labels"), "doc_id")
            .select(
                F.col("doc_id").alias("row_no"),
                F.concat(F.col("doc_id").cast("string"), F.lit(".0")).alias("master_id"),
                F.col("source").alias("platform"),
                F.col("text").alias("review"),
                F.when(F.col("toxic") == 1, " suspicious ")
                .when(F.col("quality") == 1, "Normal")
                .otherwise("UNCERTAIN")
                .alias("final_label"),
                F.concat_ws(" ", F.col("lang"), F.lit("상세 페이지")).alias("collection_reason"),
                F.when(F.col("n_chars") > 2000, "다른 리뷰와 유사")
                .when(F.col("n_chars") > 1000, "개인 경험 없음")
                .alias("재검수근거"),
                F.upper("lang").alias("use_for_training"),
                "n_chars",
            )
        )

    def diagnoses(self) -> DataFrame:
        """A diagnosis for every suspicious master row, typed by length."""
        size = F.col("n_chars")
        kind = F.when(size < 1000, " TEXT_STRONG").when(size < 2500, "TEXT_WEAK").otherwise("NETWORK_STRONG")
        return (
            self.master()
            .filter(F.trim("final_label") == "suspicious")
            .withColumn("diagnostic_type", kind)
            .drop("final_label", "use_for_training", "n_chars")
        )

    def synthetic(self) -> DataFrame:
        """Benchmark passages and suspicious documents as candidate augmentation rows."""
        passages = self.table("benchmark").select(
            F.col("item_id").alias("row_no"), F.col("text").alias("content"), F.lit("SUSPICIOUS").alias("final_label"),
            F.lit("yes ").alias("use_for_training"),
        )
        repeated = self.master().filter(F.trim("final_label") == "suspicious").select(
            (F.col("row_no") + 1_000_000_000_000).alias("row_no"), F.upper("review").alias("content"),
            F.lit("SUSPICIOUS").alias("final_label"), F.lit("YES").alias("use_for_training"),
        )
        return passages.unionByName(repeated)

    def job_events(self) -> DataFrame:
        """One collection job per user; some payloads are broken on purpose."""
        text, value = F.col("event_id").cast("string"), F.col("value").cast("int").cast("string")
        job = F.concat(F.lit("j"), F.col("user_id").cast("string"))
        kind = F.col("event_type")
        review = F.concat(
            F.lit('{"platform":"web","product_id":"p'), F.col("user_id").cast("string"),
            F.lit('","review_id":"r'), text, F.lit('","content":"review number '), text,
            F.lit(' has some words of its own","extra":1}'),
        )
        target = F.when(F.col("value") > 50, value).otherwise("null")
        progress = F.concat(F.lit('{"job_id":"'), job, F.lit('","collected":'), value, F.lit(',"target":'), target, F.lit("}"))
        done = F.concat(F.lit('{"job_id":"'), job, F.lit('","collected":'), value, F.lit("}"))
        error = F.concat(
            F.lit('{"job_id":"'), job, F.lit('","detail":"failed","retryable":'),
            F.when(F.col("value") > 20, "true").otherwise("false"), F.lit("}"),
        )
        data = (
            F.when(F.col("value") < 0.3, "not json")
            .when(F.col("value") < 0.6, '{"job_id":null}')
            .when(kind == "view", review)
            .when(kind == "click", progress)
            .when(kind == "purchase", done)
            .when(kind == "error", error)
            .otherwise("{}")
        )
        name = (
            F.when((kind == "signup") & (F.col("value") > 100), "rate_limited")
            .when(kind == "view", "review").when(kind == "click", "progress").when(kind == "purchase", "done")
            .when(kind == "error", "error").otherwise("heartbeat")
        )
        # Most failures and completions come late: only large values end a job.
        ends = kind.isin("purchase", "error") & (F.col("value") < 60)
        return self.events().select(
            job.alias("job"),
            F.col("event_id").alias("seq"),
            F.when(ends, "review").otherwise(name).alias("event"),
            F.when(ends & (F.col("value") >= 0.6), review).otherwise(data).alias("data"),
            F.col("ts").alias("received_at"),
        )
