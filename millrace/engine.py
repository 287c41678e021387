"""The engine as one object over a folder of warehouse tables: what a service or a command line would call."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.rules import DEFAULT, LEGACY_STATUS, STATUSES, RulePack
from .operators import analysis, answers, cleaning, dedup, followup, reports, vectors, warehouse
from .schemas import WAREHOUSE
from .tables import BUCKETS, Tables


def normal_status(c):
    """A raw status in the life cycle's words; unknown ones are RAW_COLLECTED."""
    mapping = F.create_map(*(F.lit(x) for kv in LEGACY_STATUS.items() for x in kv))
    known = F.coalesce(mapping[F.lower(F.trim(c))], F.upper(F.trim(c)))
    return F.when(known.isin(*STATUSES), known).otherwise("RAW_COLLECTED")


#: The column whose hash names the bucket of a row.
KEYS = {"ods_raw_intel": "id", "dwd_clean_intel": "id", "dwd_intel_analysis": "raw_id", "dwd_entity": "raw_id", "dwd_entity_relation": "src_entity_id", "dim_slang_dict": "term", "ads_risk_case": "case_id", "agent_report": "raw_id", "annotation_log": "annotation_id", "analysis_job": "job_id"}


class Engine:
    """Warehouse tables under root, in hash buckets of their keys: a change writes only the buckets that it touches (tables.Tables).

    One writer at a time: a second one of the same version fails instead of overwriting. as_of stands for now wherever a time is
    written, so that runs can be repeated.
    """

    def __init__(self, spark: SparkSession, root: str, pack: RulePack = DEFAULT, buckets: int = BUCKETS):
        self.spark, self.root, self.pack = spark, root.rstrip("/"), pack
        self.tables = Tables(spark, self.root, WAREHOUSE, KEYS, buckets)
        self.table, self.write, self.append = self.tables.table, self.tables.write, self.tables.append
        self._kept: list[str] = []

    def upsert(self, name: str, df: DataFrame, keys: list[str], fixed: tuple[str, ...] = ()) -> None:
        self.tables.upsert(name, df, keys, fixed)

    def kept(self, df: DataFrame) -> DataFrame:
        """df written to a work folder and read again, so that what uses it several times works it out once. tidy() drops it."""
        path = f"{self.root}/_work/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self._kept.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def tidy(self) -> None:
        """Drops the work folders of this engine, and versions of tables that are no longer the last two."""
        for path in self._kept:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self._kept.clear()
        for name in KEYS:
            self.tables.vacuum(name)

    # -- ingest --

    def add_posts(self, posts: DataFrame, first_id: int, as_of: datetime.datetime, keyword: str = "") -> None:
        """Posts of the common schema as raw rows, those that the table has not yet by (platform, url)."""
        known = self.table("ods_raw_intel").select("source_platform", "source_url")
        fresh = posts.withColumn("source_platform", F.col("platform")).join(known.filter("source_url <> ''").distinct(), ["source_platform", "source_url"], "left_anti")
        has_url = F.coalesce(F.col("source_url"), F.lit("")) != ""
        # posts without a URL are different people's messages even where the text is the same, unless the author is too
        fresh = fresh.filter(has_url).dropDuplicates(["source_platform", "source_url", "content_raw"]).unionByName(fresh.filter(~has_url).dropDuplicates(["source_platform", "author_uid", "group_id", "message_id", "content_raw"]))
        rows = fresh.select(
            (F.lit(first_id) + F.monotonically_increasing_id()).alias("id"), "source_platform", F.coalesce(F.nullif(F.col("group_id"), F.lit("")), F.col("platform")).alias("source_channel"), "source_url", F.lit(keyword).alias("source_keyword"),
            F.col("author_uid").alias("author_id"), F.col("author_username").alias("author_name"), F.lit(as_of).cast("timestamp_ntz").alias("collect_time"), "content_type", "content_raw", F.col("image_urls").alias("media_urls"), F.lit("RAW_COLLECTED").alias("raw_status"), "metadata",
        )
        self.append("ods_raw_intel", rows)

    # -- cleaning and analysis --

    def clean(self, as_of: datetime.datetime) -> dict[str, int]:
        """Cleans what is RAW_COLLECTED, newest first, and writes clean rows and statuses; returns the counts by status."""
        raw = self.table("ods_raw_intel")
        todo = raw.filter("raw_status = 'RAW_COLLECTED'")
        posts = todo.select("id", F.col("source_platform").alias("platform"), "content_raw", F.col("author_name").alias("author_username"), F.col("author_id").alias("author"), "source_keyword", (-F.unix_micros(F.col("collect_time").cast("timestamp")) - F.pmod("id", F.lit(1_000_000))).alias("batch_seq"))
        told = dedup.author_aware(self.kept(cleaning.clean(posts, self.pack)))
        status = cleaning.status(F.col("is_noise"), F.col("is_media_only"), F.col("dup_type"))
        told = told.select("id", "clean_text", "simhash", "content_md5", "dup_type", "noise_score", "priority", status.alias("_status"), F.left(F.coalesce("noise_reason", F.lit("")), F.lit(256)).alias("clean_reason"))
        rows = told.select("id", F.col("id").alias("raw_id"), "clean_text", "simhash", "content_md5", (F.col("dup_type") == "duplicate").alias("is_duplicate"), "noise_score", "priority", F.col("_status").alias("clean_status"), "clean_reason", F.lit(as_of).cast("timestamp_ntz").alias("created_at"))
        rows = self.kept(rows)
        self.upsert("dwd_clean_intel", rows, ["id"])
        done = rows.select("id", F.when(F.col("clean_status") == "DISCARDED", "DISCARDED").otherwise("CLEANED").alias("raw_status"))
        self.upsert("ods_raw_intel", done, ["id"])
        counts = {r.clean_status: r["count"] for r in rows.groupBy("clean_status").count().collect()}
        self.tidy()
        return counts

    def preferred_text(self) -> DataFrame:
        """(raw_id, text): the merged text, else the clean one, else the raw one."""
        c = self.table("dwd_clean_intel").select("raw_id", "merged_text", "clean_text")
        r = self.table("ods_raw_intel").select(F.col("id").alias("raw_id"), "content_raw", "raw_status")
        empty = lambda x: F.nullif(F.col(x), F.lit(""))
        return r.join(c, "raw_id", "left").select("raw_id", "raw_status", F.coalesce(empty("merged_text"), empty("clean_text"), "content_raw").alias("text"))

    def _found(self, posts: DataFrame, ruled: DataFrame, embed=None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """What is found in posts: their entities, a row a post of counts and evidence, and new terms near known ones (raw_id, term)."""
        found = self.kept(analysis.first_entities(analysis.entities(posts, "raw_id"), "raw_id"))
        terms = self.table("dim_slang_dict").filter("status = 'active'").select("term", F.col("normalized_meaning").alias("meaning"))
        slang = analysis.dictionary_entities(posts, terms, "raw_id").groupBy("raw_id").agg(F.count(F.lit(1)).alias("slang"))
        of = lambda *t: F.count_if(F.col("entity_type").isin(*t))
        counts = found.groupBy("raw_id").agg(of("wechat", "qq", "phone").alias("contacts"), of("url", "domain", "ip").alias("links"), of("tool").alias("tools"), F.collect_set("entity_type").alias("entity_types"))
        spans = answers.composed_evidence(ruled.select("raw_id", "text", "label"), found, "raw_id", "text", "label", self.pack)
        span = F.struct("n", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("text").alias("evidence"), "risk")
        listed = spans.groupBy("raw_id").agg(F.count(F.lit(1)).alias("evidence"), F.array_sort(F.collect_list(span)).alias("_spans"))
        by_post = listed.select("raw_id", "evidence", F.transform("_spans", lambda x: x.dropFields("n")).alias("evidence_spans"))
        variants = self.spark.createDataFrame([], "raw_id long, term string")
        if embed is not None:
            grams = posts.select("raw_id", F.explode(answers.candidate_grams(F.col("text"), limit=None, most=None)).alias("word"))
            near = vectors.term_variants(vectors.embedded(grams, "word", embed), vectors.embedded(terms, "term", embed), key="raw_id")
            variants = self.kept(near.select("raw_id", F.col("word").alias("term")))
        new = variants.groupBy("raw_id").agg(F.count(F.lit(1)).alias("candidates"))
        full = posts.select("raw_id").join(counts, "raw_id", "left").join(slang, "raw_id", "left").join(by_post, "raw_id", "left").join(new, "raw_id", "left")
        full = full.na.fill(0, ["contacts", "links", "tools", "slang", "evidence", "candidates"]).withColumn("entity_types", F.coalesce("entity_types", F.expr("cast(array() as array<string>)")))
        return found, self.kept(full), variants

    def _related(self, found: DataFrame) -> DataFrame:
        """(raw_id, related): how many other posts, of now and before, have the values of a post's accounts, contacts, links and tools.

        A post that shares several values counts for each. Values are counted before they are joined, so posts are never paired.
        """
        columns = ["raw_id", "entity_type", "entity_value"]
        shared = F.col("entity_type").isin(*followup.GRAPH_TYPES["expansion"])
        now = found.select(*columns).filter(shared)
        before = self.table("dwd_entity").select(*columns).filter(shared).join(now.select("raw_id").distinct(), "raw_id", "left_anti")
        posts = before.unionByName(now).distinct().groupBy("entity_type", "entity_value").agg((F.count(F.lit(1)) - 1).alias("others"))
        return now.distinct().join(posts, ["entity_type", "entity_value"]).groupBy("raw_id").agg(F.sum("others").alias("related"))

    def analyse(self, as_of: datetime.datetime, model=None, embed=None, auto: bool = True) -> DataFrame:
        """Classifies, extracts, scores and screens what is CLEANED, and sends to a second pass what the screening asks for.

        The first pass goes by rules and dictionary alone. If auto, posts that need a standard analysis get the model's label, those
        that need the graph also the posts that share their values, and a second version of the analysis with the new score. model is
        that of analysis.cascade(); embed, as of vectors.embedded(), finds words near known terms, which are screened as candidates
        and put into the dictionary as such. Writes analyses, entities and statuses; returns the decisions.
        """
        posts = self.kept(self.preferred_text().filter("raw_status = 'CLEANED'").drop("raw_status"))
        ruled = self.kept(analysis.cascade(posts, "text", None, pack=self.pack))
        found, full, variants = self._found(posts, ruled, embed)
        quick = ruled.join(full, "raw_id").withColumn("related", F.lit(0))
        judged = self.kept(analysis.screen(analysis.risk_score(quick)).withColumn("options", followup.followup_options(F.col("decision"), F.lit(auto))))
        self._write_analyses(judged, as_of)
        second = judged.filter("options is not null")
        if auto:
            deep = self.kept(analysis.cascade(posts.join(second.select("raw_id"), "raw_id"), "text", model, pack=self.pack))
            graph = self._related(found).join(second.filter("options.enable_graph_expand").select("raw_id"), "raw_id")
            again = deep.join(full, "raw_id").join(second.select("raw_id", "decision"), "raw_id").join(graph, "raw_id", "left").na.fill(0, ["related"])
            self._write_analyses(self.kept(analysis.risk_score(again)), as_of + datetime.timedelta(microseconds=1))
        entities = found.select("raw_id", "entity_type", "entity_value", "context").withColumns({"normalized_value": F.col("entity_value"), "extract_method": F.lit("regex"), "confidence": F.lit(0.9)})
        # posts that have no entity any more lose those they had
        again = lambda old, ids: old.join(ids.select("raw_id").distinct(), "raw_id", "left_anti").unionByName(entities, allowMissingColumns=True)
        self.tables.merge("dwd_entity", posts.select("raw_id"), again)
        if embed is not None:
            new = answers.new_slang(variants.select("term").distinct(), self.table("dim_slang_dict"))
            self.put_slang(self.kept(new.withColumns({"normalized_meaning": F.lit(answers.NO_MEANING), "source": F.lit("embedding")})), as_of, "candidate")
        settled = F.col("options").isNotNull() | (F.lit(auto) & F.col("decision").isin("LOW_RISK_ARCHIVED", "CONFIRMED_RISK"))
        self.upsert("ods_raw_intel", self.kept(judged.select(F.col("raw_id").alias("id"), F.when(settled, "ANALYZED").otherwise("SCREENED").alias("raw_status"))), ["id"])
        done = self.kept(judged.select("raw_id", "decision"))
        self._kept.pop()  # what is returned outlives the rest
        self.tidy()
        return done

    def _write_analyses(self, judged: DataFrame, at: datetime.datetime) -> None:
        """Another version of each post's analysis."""
        rows = judged.select("raw_id", F.col("label").alias("risk_label"), F.col("sub_label").alias("risk_sub_label"), "risk_score", "risk_level", F.col("method").alias("classification_method"), "evidence_spans", F.col("decision").alias("analysis_status"), F.lit(at).cast("timestamp_ntz").alias("created_at"))
        numbered = lambda old, new: warehouse.versioned(old.drop("version", "is_latest", "id").unionByName(new, allowMissingColumns=True), "raw_id", "created_at").withColumn("id", F.col("raw_id") * 1000 + F.col("version"))
        self.tables.merge("dwd_intel_analysis", self.kept(rows), numbered)

    # -- reads --

    def stats(self, as_of: datetime.date) -> DataFrame:
        raw, latest = self.table("ods_raw_intel"), self.table("dwd_intel_analysis").filter("is_latest = 1")
        r = raw.agg(F.count(F.lit(1)).alias("raw_total"), F.count_if(F.to_date("collect_time") == F.lit(as_of)).alias("raw_today"), F.count_if(F.col("raw_status").isin("RAW_COLLECTED", "CLEANED")).alias("pending"))
        a = latest.agg(F.count(F.lit(1)).alias("analysed"), F.count_if(F.col("risk_level").isin("high", "critical")).alias("high"))
        return r.join(a)

    def intel(self, status: str | None = None, platform: str | None = None, keyword: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        """Raw rows with their latest analysis, newest first."""
        rows = self.table("ods_raw_intel")
        if status:
            rows = rows.filter(F.col("raw_status") == status)
        if platform:
            rows = rows.filter(F.col("source_platform") == platform)
        if keyword:
            rows = rows.filter(F.contains(F.lower("content_raw"), F.lit(keyword.lower())) | F.contains(F.lower("author_name"), F.lit(keyword.lower())))
        latest = self.table("dwd_intel_analysis").filter("is_latest = 1").select(F.col("raw_id").alias("id"), "risk_label", "risk_score", "risk_level", "analysis_status")
        return rows.join(latest, "id", "left").orderBy(F.desc("collect_time"), F.desc("id")).offset(offset).limit(limit)

    def history(self, raw_id: int) -> DataFrame:
        return self.table("dwd_intel_analysis").filter(F.col("raw_id") == raw_id).orderBy(F.desc("version"))

    def entity(self, kind: str, value: str) -> DataFrame:
        return self.table("dwd_entity").filter((F.col("entity_type") == kind) & (F.col("entity_value") == value))

    def report(self, raw_id: int | None = None) -> DataFrame:
        latest = self.table("dwd_intel_analysis").filter("is_latest = 1")
        if raw_id is not None:
            latest = latest.filter(F.col("raw_id") == raw_id)
        spans = latest.select("raw_id", F.explode("evidence_spans").alias("s")).select("raw_id", "s.start", "s.evidence", "s.risk")
        posts = latest.select("raw_id", F.col("risk_label").alias("label"), F.col("risk_sub_label").alias("sub_label"), "risk_score", "risk_level")
        terms = self.table("dim_slang_dict").filter("status = 'active'").select("term", F.col("normalized_meaning").alias("meaning"))
        slang = analysis.slang_meanings(self.preferred_text().join(posts.select("raw_id", "label"), "raw_id"), terms, "raw_id")
        return reports.report(posts, self.table("dwd_entity"), spans, slang)

    # -- dictionary, annotations, jobs --

    def put_slang(self, terms: DataFrame, as_of: datetime.datetime, status: str = "active") -> None:
        """Adds or updates terms; a candidate never replaces an active term."""
        rows = terms.withColumns({"status": F.lit(status), "updated_at": F.lit(as_of).cast("timestamp_ntz")})
        if status == "candidate":
            rows = rows.join(self.table("dim_slang_dict").filter("status = 'active'").select("term"), "term", "left_anti")
        self.upsert("dim_slang_dict", rows, ["term"], fixed=("source",))

    def review_slang(self, term: str, approve: bool, reviewer: str, as_of: datetime.datetime, meaning: str = "") -> None:
        known = self.table("dim_slang_dict").filter((F.col("term") == term) & ((F.col("status") == "candidate") | F.lit(approve)))
        rows = known.select("term", F.coalesce(F.nullif(F.lit(meaning), F.lit("")), "normalized_meaning").alias("normalized_meaning"), F.lit("active" if approve else "rejected").alias("status"), F.lit(reviewer).alias("reviewed_by"), F.lit(as_of).cast("timestamp_ntz").alias("updated_at"))
        self.upsert("dim_slang_dict", rows, ["term"])

    def annotate(self, rows: DataFrame) -> None:
        self.append("annotation_log", rows.withColumn("synced", F.lit(0)))

    def sync_annotations(self) -> int:
        """Applies what is not synced yet: labels and levels of latest analyses, meanings of terms' ids are not touched."""
        todo = self.kept(self.table("annotation_log").filter("synced = 0"))
        n = todo.count()
        labels = todo.filter("target_type = 'classification'")

        def applied(base: DataFrame, _: DataFrame) -> DataFrame:
            latest, rest = base.filter("is_latest = 1"), base.filter("is_latest = 0")
            for field in ("risk_label", "risk_level"):
                latest = warehouse.apply_annotations(latest, labels, "raw_id", field)
            return latest.unionByName(rest)

        self.tables.merge("dwd_intel_analysis", labels.select(F.col("target_id").alias("raw_id")), applied)
        self.upsert("annotation_log", todo.withColumn("synced", F.lit(1)), ["annotation_id"])
        self.tidy()
        return n

    def submit(self, jobs: DataFrame, as_of: datetime.datetime) -> None:
        self.upsert("analysis_job", jobs.withColumns({"status": F.lit("pending"), "progress": F.lit(0), "created_at": F.lit(as_of).cast("timestamp_ntz")}), ["job_id"])

    def unfinished_jobs(self, limit: int = 100) -> DataFrame:
        """What a restart has to take up again, oldest first."""
        return self.table("analysis_job").filter(F.col("status").isin("pending", "running")).orderBy("created_at", "job_id").limit(limit)

    def finish_jobs(self, ids: DataFrame, as_of: datetime.datetime, status: str = "success") -> None:
        self.upsert("analysis_job", ids.select("job_id").withColumns({"status": F.lit(status), "progress": F.lit(100), "finished_at": F.lit(as_of).cast("timestamp_ntz")}), ["job_id"])

    def migrate(self, old: DataFrame) -> None:
        """Rows of the former raw table (id, platform, content, status, is_high_risk, ...) that the new one doesn't have."""
        rows = old.join(self.table("ods_raw_intel").select("id"), "id", "left_anti")
        priority = F.when(F.col("is_high_risk") == 1, "high").otherwise("normal")
        self.append("ods_raw_intel", rows.select("id", F.col("platform").alias("source_platform"), F.col("content").alias("content_raw"), normal_status(F.col("status")).alias("raw_status"), F.create_map(F.lit("priority"), priority).alias("metadata")))
