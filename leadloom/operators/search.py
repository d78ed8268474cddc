"""Substring search over leads by trigram postings.

Fields (domain, name, each e-mail and phone) stay a long table; the index lists
which fields hold which three characters.  A query reads the postings of its
own trigrams only, keeps the fields that have all of them, and looks into those
texts at last.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

GRAM = 3


def fields(leads: DataFrame, contacts: DataFrame, org: str = "domain") -> DataFrame:
    """Searchable texts of leads in lower case, long: domain, text.

    ``leads``: domain, name; ``contacts``: domain, kind, value.  Contacts of
    organisations that are no leads are left out; nulls and '' hold nothing.
    """
    own = leads.select(F.col(org).alias("domain"), F.explode(F.array(F.col(org), F.col("name"))).alias("text"))
    listed = contacts.where(F.col("kind").isin("email", "phone")).select(F.col(org).alias("domain"), F.col("value").alias("text"))
    named = leads.select(F.col(org).alias("domain")).distinct()
    return (own.unionByName(listed.join(named, "domain", "left_semi"))
            .select("domain", F.lower("text").alias("text")).where("text <> ''").distinct())


def grams(text: Column) -> Column:
    """The distinct runs of three characters of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - GRAM + 1, F.lit(1))),
                                        lambda i: F.substr(text, i, F.lit(GRAM))))


@dataclass(frozen=True)
class LeadIndex:
    """Stored postings (bucket, gram, domain, text) of the fields of leads."""

    spark: SparkSession
    path: str
    buckets: int

    @staticmethod
    def build(leads: DataFrame, contacts: DataFrame, path: str, buckets: int = 64) -> "LeadIndex":
        index = LeadIndex(leads.sparkSession, path, buckets)
        postings = fields(leads, contacts).select("domain", "text", F.explode(grams(F.col("text"))).alias("gram"))
        # a gram that most fields hold is spread over tasks by its text
        (postings.withColumn("bucket", index._bucket(F.col("gram")))
         .repartition(4 * buckets, "bucket", F.pmod(F.xxhash64("text"), F.lit(4))).sortWithinPartitions("bucket", "gram")
         .write.partitionBy("bucket").parquet(path))
        return index

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def _postings(self) -> DataFrame:
        return self.spark.read.schema("domain string, text string, gram string, bucket int").parquet(self.path)

    def find(self, query: str) -> DataFrame:
        """Domains of the leads one of whose fields contains ``query``, ignoring case.

        A query shorter than a trigram is looked for in all grams and so finds
        whatever text holds it; '' finds every lead.
        """
        q = query.lower()
        if len(q) < GRAM:
            return self._postings().where(F.contains("gram", F.lit(q))).select("domain").distinct()
        wanted = sorted({q[i:i + GRAM] for i in range(len(q) - GRAM + 1)})
        places = [r[0] for r in self.spark.createDataFrame([(g,) for g in wanted], "gram string")
                  .select(self._bucket(F.col("gram"))).distinct().collect()]
        held = self._postings().where(F.col("bucket").isin(places) & F.col("gram").isin(wanted))
        return (held.groupBy("domain", "text").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted))
                .where(F.contains("text", F.lit(q))).select("domain").distinct())


def search(leads: DataFrame, contacts: DataFrame, query: str, only_email: bool = False,
           index: LeadIndex | None = None) -> DataFrame:
    """Leads one of whose fields contains a text, ignoring case; all of them for ''.

    With an ``index`` the postings are asked, else the fields are scanned; a
    text that spans two fields is not found.
    """
    if query:
        hits = index.find(query) if index else fields(leads, contacts).where(
            F.contains("text", F.lit(query.lower()))).select("domain").distinct()
        leads = leads.join(hits, "domain", "left_semi")
    if only_email:
        leads = leads.join(contacts.where("kind = 'email'").select("domain").distinct(), "domain", "left_semi")
    return leads
