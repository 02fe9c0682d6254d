"""The reference's inputs, derived from the supplied tables: corpus chunks, golden cases, rankings, answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import first_words, tokens
from siftwell.operators import answers, chunking, dense, fusion, lexical, metrics
from siftwell.session import scratch


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Corpus:
    """Lazily built relations over one folder of tables; relevance, rankings and what is made of them are written once."""

    _known: dict = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Corpus":
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._known:
            cls._known[key] = cls(spark, sf_dir)
        return cls._known[key]

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._made, self._tasks = spark, sf_dir, {}, {}

    def table(self, name: str) -> DataFrame:
        return read(self.spark, self.dir, name)

    def keep(self, name: str, make, write: bool = False) -> DataFrame:
        """The relation made once; with ``write`` its rows are, in the shared folder, and plans over it begin there.

        A persisted relation would keep its plan: queries that use several of them many times hold thousands of nodes,
        and the driver runs out of memory over the smallest tables.
        """
        if name not in self._made:
            df = make()
            if write:
                df.write.parquet(path := scratch(self.spark, name))
                df = self.spark.read.schema(df.schema).parquet(path)
            self._made[name] = df
        return self._made[name]

    @property
    def documents(self) -> DataFrame:
        rows = self.table("documents").select(F.col("doc_id").cast("string").alias("document_id"), "lang", "source", "text")
        # a file may be one row group, so one task: where there are fewer than cores, deal the texts out before they are cut
        n = self.spark.sparkContext.defaultParallelism
        return rows if self.tasks("documents") >= n else rows.repartition(n)

    def tasks(self, name: str) -> int:
        if name not in self._tasks:
            self._tasks[name] = self.table(name).rdd.getNumPartitions()
        return self._tasks[name]

    @property
    def chunks(self) -> DataFrame:
        return self.keep("chunks", lambda: chunking.window_chunks(self.documents.select("document_id", F.col("source").alias("heading"), "text")))

    def chunks_of(self, *rankings: DataFrame) -> DataFrame:
        """The chunks of documents that rankings name: at most a few for each question, so their ids are broadcast."""
        ids = reduce(DataFrame.union, (r.select("document_id") for r in rankings)).distinct()
        docs = self.documents.join(F.broadcast(ids), "document_id", "left_semi")
        return chunking.window_chunks(docs.select("document_id", F.col("source").alias("heading"), "text"))

    @property
    def tok(self) -> DataFrame:
        """The tokenised chunks, made anew by each pass: kept, they are several times the documents on disk."""
        return self.keep("tok", self._tok)

    def _tok(self) -> DataFrame:
        again = self.documents.groupBy("document_id").count().where("count > 1").select("document_id")
        if again.isEmpty():
            return lexical.tokenised(self.chunks)
        again = self.keep("again", lambda: again, True)
        rows = lambda how: lexical.tokenised(chunking.window_chunks(self.documents.join(again, "document_id", how).select("document_id", F.col("source").alias("heading"), "text")))
        return rows("left_anti").withColumn("times", F.lit(1).cast("long")).unionByName(lexical.repeated(rows("left_semi")))

    @property
    def questions(self) -> DataFrame:
        b = self.table("benchmark").where("text is not null")
        return b.select(F.col("item_id").alias("case_id"), F.col("text").alias("question"), F.when(F.col("item_id") % 3 == 2, "test").otherwise("dev").alias("split"))

    @property
    def relevant(self) -> DataFrame:
        """case_id, document_id: documents whose tokens contain the item's tokens in a row.

        Each token of a document meets the items that begin with it, and what follows is compared in place: no text
        is shuffled.
        """
        return self.keep("relevant", self._relevant, True)

    def _relevant(self) -> DataFrame:
        items = self.questions.select("case_id", tokens(F.col("question")).alias("item")).where(F.size("item") > 0)
        items = items.select("case_id", "item", F.element_at("item", 1).alias("term"), F.try_element_at("item", F.lit(2)).alias("next"))
        docs = self.documents.select("document_id", tokens(F.col("text")).alias("t"))
        at = docs.select("document_id", "t", F.posexplode("t").alias("pos", "term"))
        # the second token is compared before the whole item is: words with which items begin may be frequent
        second = F.col("next").isNull() | (F.col("next") == F.try_element_at("t", F.col("pos") + 2))
        whole = F.slice("t", F.col("pos") + 1, F.size("item")) == F.col("item")
        found = at.join(F.broadcast(items), "term").where(F.when(second, whole).otherwise(False))
        return found.select("case_id", "document_id").distinct()

    @property
    def cases(self) -> DataFrame:
        """case_id, question, split, answerable, language, relevant_documents."""
        return self.keep("cases", self._cases, True)

    def _cases(self) -> DataFrame:
        docs = self.documents.select("document_id", "lang")
        first = self.relevant.join(docs, "document_id").groupBy("case_id").agg(F.min(F.struct(F.col("document_id").cast("long").alias("d"), "lang")).alias("m"), F.array_sort(F.collect_set("document_id")).alias("relevant_documents"))
        out = self.questions.join(first, "case_id", "left")
        return out.select("case_id", "question", "split", F.col("m").isNotNull().alias("answerable"), F.coalesce("m.lang", F.lit("en")).alias("language"), F.coalesce("relevant_documents", F.array().cast("array<string>")).alias("relevant_documents"))

    @property
    def bm25(self) -> DataFrame:
        return self.keep("bm25", lambda: lexical.top_documents(lexical.bm25_scores(self.tok, self.questions, k=lexical.DEPTH, by="document_id")), True)

    @property
    def dense_scores(self) -> DataFrame:
        asked = self.questions.select("case_id", tokens(F.col("question")).alias("tokens"))
        return lexical.top_chunks(dense.hashed_scores(self.tok, asked, dense.CANDIDATES), dense.CANDIDATES)

    @property
    def dense(self) -> DataFrame:
        return self.keep("dense", lambda: lexical.top_documents(self.dense_scores.drop("rank")), True)

    @property
    def hybrid(self) -> DataFrame:
        return self.keep("hybrid", lambda: fusion.fuse(fusion.weighted(self.bm25, self.dense), "case_id"), True)

    def metrics_of(self, ranked: DataFrame) -> DataFrame:
        """Case metrics with split and language, of answerable cases."""
        return metrics.case_metrics(ranked, self.relevant, "case_id").join(self.cases.select("case_id", "split", "language"), "case_id")

    @property
    def contexts(self) -> DataFrame:
        return self.keep("contexts", lambda: answers.candidates(self.hybrid, self.bm25, self.dense, self.chunks_of(self.hybrid), answers.CONTEXT_DOCUMENTS, answers.PASSAGE_WORDS), True)

    @property
    def extracted(self) -> DataFrame:
        return self.keep("extracted", lambda: answers.extract_answers(self.questions.select("case_id", "question"), self.contexts), True)

    def answer_rows(self) -> DataFrame:
        """What answer_metrics takes: facts are thirds of the question, the reference its first 30 words."""
        t = tokens(F.col("question"))
        third = F.ceil(F.size(t) / 3).cast("int")
        facts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.array_join(F.slice(t, i * third + 1, third), " ")), lambda x: x != "")
        evidence = self.contexts.join(self.extracted.select("case_id", F.explode("citations").alias("document_id")), ["case_id", "document_id"], "left_semi")
        evidence = evidence.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ordinal", "text"))), lambda x: x["text"]), " ").alias("evidence"))
        available = self.contexts.groupBy("case_id").agg(F.collect_set("document_id").alias("available"))
        cases = self.cases.select("case_id", "split", "language", F.col("answerable").alias("case_answerable"), F.col("relevant_documents").alias("relevant"), first_words(F.col("question"), 30).alias("reference_answer"), F.when(F.col("answerable"), facts).otherwise(F.array().cast("array<string>")).alias("facts"), F.array(F.lit("guaranteed forever"), F.lit("the")).alias("claims"))
        rows = cases.join(self.extracted, "case_id").join(evidence, "case_id", "left").join(available, "case_id", "left")
        return rows.withColumn("schema_valid", F.lit(True)).withColumn("evidence", F.coalesce("evidence", F.lit(""))).withColumn("available", F.coalesce("available", F.array().cast("array<string>")))
