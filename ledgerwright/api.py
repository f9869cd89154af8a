"""The engine as one object: a corpus of passages that is added to, searched and asked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwright import runtime
from ledgerwright.operators import answers, facts, questions, ranking
from ledgerwright.sources import readers


class Engine:
    """Passages, filings and the index over them. The index is made when it is first needed after a change."""

    def __init__(self, spark: SparkSession, passages: DataFrame | None = None):
        runtime.ship(spark)
        self.spark, self.passages = spark, passages if passages is not None else spark.createDataFrame([], readers.PASSAGE)
        self._index: ranking.Index | None = None

    def add(self, passages: DataFrame) -> Engine:
        """Adds passages behind those there are: every reader numbers its own rows, so they are moved past the last `ord`."""
        last = self.passages.agg(F.max("ord")).first()[0]
        passages = passages.withColumn("ord", F.col("ord") + (0 if last is None else last + 1))
        self.passages, self._index = self.passages.unionByName(passages, allowMissingColumns=True), None
        return self

    def ingest_file(self, path: str) -> Engine:
        """Reads a file by its extension; what isn't known is read as text."""
        read = {"csv": readers.read_csv, "json": readers.read_json}.get(path.rsplit(".", 1)[-1].lower(), readers.read_prose)
        return self.add(read(self.spark, path))

    def ingest_text(self, company: str, title: str, text: str) -> Engine:
        src = self.spark.createDataFrame([(company, title, f"Company: {company} | Document: {title} | Text: {text}")], "company string, title string, content string")
        return self.add(src.select(F.concat_ws("_", F.lit("custom"), "company", "title").alias("id"), "company", F.col("title").alias("table_name"), "content", F.lit("custom_upload").alias("type"), F.monotonically_increasing_id().alias("ord")))

    @property
    def index(self) -> ranking.Index:
        self._index = self._index or ranking.Index(self.passages)
        return self._index

    def _asked(self, asked: DataFrame | str, company: str | None) -> DataFrame:
        return self.spark.createDataFrame([("q", company, asked)], "id string, doc_name string, question string") if isinstance(asked, str) else asked

    def search(self, asked: DataFrame | str, company: str | None = None, top_k: int = 5, **options) -> DataFrame:
        """The best passages of one question, or of a table of questions (id, doc_name, question)."""
        return ranking.search(self.passages, self._asked(asked, company), top_k, index=self.index, **options)

    def ask(self, asked: DataFrame | str, company: str | None = None) -> DataFrame:
        """id, answer_mode, statement, facts, decision, failure: facts a question asks for, and whether its evidence holds."""
        q = self._asked(asked, company)
        found = answers.direct_lookup(q, self.passages).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("metric", "year", "value"))).alias("facts"))
        checks = answers.checked(q, self.search(q).select("id", "ord"), self.passages)
        return questions.classified(q).select("id", "answer_mode", "statement").join(found, "id", "left").join(checks.select("id", "decision", "failure"), "id", "left")

    def formula(self, key: str) -> DataFrame:
        return facts.evaluate(facts.wide_facts(facts.row_facts(self.passages)), key)
