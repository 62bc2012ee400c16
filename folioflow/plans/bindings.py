"""The given tables seen as papers, labels, reactions, digests and posts.

``Bound`` holds the Spark side; ``with_ctes`` gives the same shapes to SQL. Remainders of ids only give
rows different values (a date, a missing score); they never leave rows out.
"""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioflow.config import Settings
from folioflow.functions import vectors as V
from folioflow.functions.hashing import uniform
from folioflow.session import materialise

SETTINGS = Settings(
    as_of=datetime(2024, 12, 31),
    categories=("cs.EN", "cs.DE", "src3"),
    embedding_columns=("v1", "v2"),
    neg_sample_ratio=1.0,
    start_date="2024-04-01",
    end_date="2024-12-31",
    sample_rate=0.05,
)

OWNER = "user0"
VECTORS = ("v1", "v2")
DIMENSIONS = 128
COEFFICIENTS = [((j * 37) % 19 - 9) / 5.0 for j in range(DIMENSIONS)]
INTERCEPT = -0.25
SITE = "https://example.org"
MODEL = "summariser-1"


def paper_id(doc_id: Column) -> Column:
    return F.format_string("24%02d.%05d", F.lit(1) + doc_id % 12, doc_id)


class Bound:
    """Tables of one data folder in the shapes the operators take."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread_table(self, name: str) -> DataFrame:
        """For work that costs far more than moving the rows: a file too small to split is dealt out to all cores.

        A table with more splits than cores is read as it lies.
        """
        df = self.table(name)
        cores = self.spark.sparkContext.defaultParallelism
        return df if df.rdd.getNumPartitions() > cores else df.repartition(cores)

    @cached_property
    def documents(self) -> DataFrame:
        return self._with_paper_facts(self.table("documents"))

    @cached_property
    def spread_documents(self) -> DataFrame:
        return self._with_paper_facts(self.spread_table("documents"))

    @staticmethod
    def _with_paper_facts(documents: DataFrame) -> DataFrame:
        days = (F.col("doc_id") * 37 % 730).cast("int")
        return documents.withColumns(
            {
                "id": paper_id(F.col("doc_id")),
                "updated": F.date_add(F.lit("2023-01-01").cast("date"), days).cast("string"),
                "created": F.date_add(F.lit("2022-12-01").cast("date"), days).cast("string"),
                "title": F.substring_index("text", "\n", 1),
            }
        )

    @cached_property
    def papers(self) -> DataFrame:
        vectors = self.table("embeddings").select("vec_id", "embedding")
        blank = F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))
        return self.documents.join(vectors, F.col("doc_id") == F.col("vec_id"), "left").select(
            "doc_id",
            "id",
            "title",
            F.col("text").alias("abstract"),
            F.array(F.concat(F.lit("cs."), F.upper("lang")), F.col("source")).alias("categories"),
            "created",
            "updated",
            F.when(F.col("vec_id") % 10 < 3, blank).otherwise(F.col("embedding")).alias("v1"),
            F.col("embedding").alias("v2"),
        )

    @cached_property
    def paper_texts(self) -> DataFrame:
        """``id, title, abstract`` of ``papers`` as often as a paper has a vector, or once; texts are read where they lie.

        Only papers with several vectors are looked up, so nothing but these is joined.
        """
        texts = self.documents.select("doc_id", "id", "title", F.col("text").alias("abstract"))
        vectors = self.table("embeddings").where(F.col("embedding").isNotNull()).groupBy("vec_id").agg(F.count(F.lit(1)).alias("times"))
        several = materialise(vectors.where("times > 1"), "several-vectors")
        if not several.isEmpty():
            times = F.sequence(F.lit(1).cast("bigint"), F.coalesce("times", F.lit(1).cast("bigint")))
            texts = texts.join(several, F.col("doc_id") == F.col("vec_id"), "left").withColumn("_time", F.explode(times))
        return texts.select("id", "title", "abstract")

    @cached_property
    def labels(self) -> DataFrame:
        return self.table("labels").select(
            "doc_id",
            paper_id(F.col("doc_id")).alias("id"),
            F.when(F.col("toxic") == 1, "dislike").when(F.col("quality") == 1, "like").otherwise("neutral").alias("preference"),
        )

    @cached_property
    def reactions(self) -> DataFrame:
        """One row per event: the reaction of a reader in the discussion of a paper."""
        kind = F.col("event_type")
        return self.table("events").select(
            "event_id",
            "ts",
            discussion_title().alias("title"),
            F.when(kind == "purchase", "THUMBS_UP")
            .when(kind == "signup", "HEART")
            .when(kind == "error", "THUMBS_DOWN")
            .when(kind == "view", "EYES")
            .otherwise("ROCKET")
            .alias("content"),
            F.concat(F.lit("user"), (F.col("event_id") % 10).cast("string")).alias("login"),
            paper_id(F.col("user_id")).alias("id"),
        )

    @cached_property
    def reaction_pages(self) -> DataFrame:
        """The reactions as nested pages of discussions; a page holds at most a thousand events.

        A title that several pages hold is a discussion of its own in each.
        """
        rows = self.reactions.withColumn("page", F.floor(F.col("event_id") / 1000))
        user = F.struct(F.col("login").alias("login")).alias("user")
        node = (
            rows.groupBy("page", "title")
            .agg(F.collect_list(F.struct("content", user)).alias("nodes"))
            .select(
                "page",
                F.struct(
                    F.concat_ws("#", "title", "page").alias("id"), "title", F.struct(F.col("nodes").alias("nodes")).alias("reactions")
                ).alias("node"),
            )
        )
        page = node.groupBy("page").agg(F.collect_list("node").alias("nodes"))
        return page.select(
            F.struct(
                F.struct(F.struct(F.col("nodes").alias("nodes")).alias("discussions")).alias("repository")
            ).alias("data")
        )

    @cached_property
    def published_ids(self) -> DataFrame:
        """Unlabelled papers that somebody reacted to."""
        reacted = self.table("events").select(F.col("user_id").alias("doc_id"))
        return (
            self.documents.join(self.labels.select("doc_id"), "doc_id", "left_anti")
            .join(reacted, "doc_id", "left_semi")
            .select("id")
        )

    @cached_property
    def digests(self) -> DataFrame:
        """A full digest record per document."""
        return self.spread_documents.select(
            "doc_id",
            "title",
            F.array(F.concat("source", F.lit(" team")), F.concat(F.lit("Author "), "lang")).alias("authors"),
            F.array(F.concat(F.lit("Institute "), "source")).alias("institution"),
            F.col("text").alias("problem_background"),
            F.concat(F.lit("read "), "source").alias("method"),
            F.concat(F.lit("in "), "lang").alias("experiment"),
            F.concat(F.lit('About "'), "title", F.lit('"')).alias("one_sentence_summary"),
            F.concat("source", F.lit("-"), "lang").alias("slug"),
            tags().alias("keywords"),
            F.lit("none").alias("further_thoughts"),
            F.lit(MODEL).alias("model"),
            F.lit(0.1).alias("temperature"),
            F.lit(0.8).alias("top_p"),
            "lang",
            "id",
            F.lit("unknown").alias("preference"),
            F.concat("updated", F.lit("T00:00:00+00:00")).alias("summary_time"),
            F.round(uniform("s", "doc_id"), 6).alias("score"),
            F.lit(None).cast("string").alias("abstract"),
            F.lit(None).cast("array<string>").alias("categories"),
            "created",
            "updated",
        )

    @cached_property
    def published(self) -> DataFrame:
        return self.digests.join(self.published_ids, "id", "left_semi").drop("doc_id")

    @cached_property
    def posts(self) -> DataFrame:
        doc_id = F.col("doc_id")
        days = doc_id * 37 % 730
        seconds = days * 86400 + doc_id * 37 % 86400 + F.lit(1672531200)
        label = self.labels.select("doc_id", F.col("preference").alias("label"))
        preference = F.when(doc_id % 13 != 0, F.coalesce("label", F.lit("unknown")))
        return self.documents.join(label, "doc_id", "left").select(
            "doc_id",
            "id",
            "title",
            F.concat_ws(" ", "lang", "source").alias("description"),
            F.timestamp_seconds(seconds).alias("pub"),
            F.when(doc_id % 5 == 0, F.timestamp_seconds(seconds + 3 * 86400)).alias("mod"),
            F.when(doc_id % 11 != 0, uniform("s", "doc_id")).alias("score"),
            preference.alias("preference"),
            F.coalesce(preference == "dislike", F.lit(False)).alias("draft"),
            tags().alias("tags"),
            (doc_id % 50 == 0).alias("featured"),
            file_path().alias("file_path"),
        )

    # Rows the model operators start from.

    @cached_property
    def clean_papers(self) -> DataFrame:
        rows = self.papers.where(V.all_clean(VECTORS))
        return rows.withColumn("vector", V.concat_features(VECTORS))

    @cached_property
    def positives(self) -> DataFrame:
        liked = self.labels.where("preference = 'like'").select("id")
        return self.clean_papers.join(liked, "id", "left_semi").select("id", "vector")

    @cached_property
    def unlabelled(self) -> DataFrame:
        return self.papers.join(self.labels.select("id"), "id", "left_anti")

    @cached_property
    def background(self) -> DataFrame:
        """Unlabelled papers with vectors, NaN as zero."""
        rows = self.unlabelled.where(V.all_present(VECTORS)).withColumns({c: V.nan_to_zero(c) for c in VECTORS})
        return rows.select("id", V.concat_features(VECTORS, "float").alias("vector"))

    @cached_property
    def scored(self) -> DataFrame:
        """Clean papers with the probability of the fixed model."""
        score = V.logistic_probability(F.col("vector"), COEFFICIENTS, INTERCEPT)
        return self.clean_papers.select("id", "title", "updated", *VECTORS, score.alias("score"))

    @cached_property
    def extracted(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Texts by source: cached, latex, pdf. A source lacks the papers whose text is null in it."""
        docs = self.documents

        def have(condition: Column) -> DataFrame:
            return docs.select("id", F.when(condition, F.col("text")).alias("text"))

        doc_id = F.col("doc_id")
        return have(doc_id % 3 == 0), have(doc_id % 2 == 0), have(doc_id % 5 != 0)


def tags() -> Column:
    size = F.least(F.expr("n_chars div 1000"), F.lit(9))
    return F.array(F.col("lang"), F.col("source"), F.concat(F.lit("len "), size.cast("string")))


def file_path() -> Column:
    """Posts of English papers lie in nested folders, others in a hidden or a flat one."""
    name = F.concat("id", F.lit(".md"))
    folder = F.when(F.col("lang") == "en", F.concat(F.col("source"), F.lit("/paper notes/"))).when(
        F.col("lang") == "de", F.lit("_hidden/")
    ).otherwise("")
    return F.concat(F.lit("../content/"), folder, name)


def discussion_title() -> Column:
    """Most titles are paths ending in a paper id; some name no paper."""
    tail = F.when(F.col("event_id") % 3 == 0, "/").otherwise("")
    return F.when(F.col("user_id") % 7 == 0, "general/ideas").otherwise(
        F.concat(F.lit("posts/"), paper_id(F.col("user_id")), tail)
    )


# --- the same shapes in SQL -------------------------------------------------------------------


def sql_hash52(tag: str, *keys: str) -> str:
    text = " || ':' || ".join([f"'{tag}'", *[f"({k})::VARCHAR" for k in keys]])
    return f"('0x' || substr(md5({text}), 1, 13))::BIGINT"


def sql_uniform(tag: str, *keys: str) -> str:
    return f"({sql_hash52(tag, *keys)} / 4503599627370496.0::DOUBLE)"


def sql_open_uniform(tag: str, *keys: str) -> str:
    return f"(({sql_hash52(tag, *keys)} + 1) / 4503599627370497.0::DOUBLE)"


def sql_paper_id(doc_id: str) -> str:
    return f"printf('24%02d.%05d', 1 + {doc_id} % 12, {doc_id})"


SQL_TAGS = "[lang, source, 'len ' || least(n_chars // 1000, 9)::VARCHAR]"
SQL_CLEAN = "v1 IS NOT NULL AND v2 IS NOT NULL AND len(list_filter(v1, lambda x: isnan(x))) = 0 AND len(list_filter(v2, lambda x: isnan(x))) = 0"
SQL_ZEROED = "list_transform({0}, lambda x: CASE WHEN isnan(x) THEN 0::FLOAT ELSE x END)"
SQL_COEFFICIENTS = "[" + ", ".join(repr(c) for c in COEFFICIENTS) + "]::DOUBLE[]"
SQL_SCORE = f"1.0 / (1.0 + exp(-(list_dot_product(vector, {SQL_COEFFICIENTS}) + {INTERCEPT})))"

_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "docs": (
        (),
        f"""SELECT *, {sql_paper_id('doc_id')} AS id,
            CAST(date '2023-01-01' + (doc_id * 37 % 730)::INT AS VARCHAR) AS updated,
            CAST(date '2022-12-01' + (doc_id * 37 % 730)::INT AS VARCHAR) AS created,
            split_part(text, chr(10), 1) AS title
        FROM documents""",
    ),
    "papers": (
        ("docs",),
        """SELECT d.doc_id, d.id, d.title, d.text AS abstract, ['cs.' || upper(d.lang), d.source] AS categories,
            d.created, d.updated,
            CASE WHEN e.vec_id % 10 < 3 THEN list_transform(e.embedding, lambda x: 'nan'::FLOAT) ELSE e.embedding END AS v1,
            e.embedding AS v2
        FROM docs d LEFT JOIN embeddings e ON d.doc_id = e.vec_id""",
    ),
    "label_rows": (
        (),
        f"""SELECT doc_id, {sql_paper_id('doc_id')} AS id,
            CASE WHEN toxic = 1 THEN 'dislike' WHEN quality = 1 THEN 'like' ELSE 'neutral' END AS preference
        FROM labels""",
    ),
    "reactions": (
        (),
        f"""SELECT event_id, ts, CASE WHEN user_id % 7 = 0 THEN 'general/ideas'
                ELSE 'posts/' || {sql_paper_id('user_id')} || CASE WHEN event_id % 3 = 0 THEN '/' ELSE '' END END AS title,
            CASE event_type WHEN 'purchase' THEN 'THUMBS_UP' WHEN 'signup' THEN 'HEART' WHEN 'error' THEN 'THUMBS_DOWN'
                WHEN 'view' THEN 'EYES' ELSE 'ROCKET' END AS content,
            'user' || (event_id % 10)::VARCHAR AS login, {sql_paper_id('user_id')} AS id, user_id
        FROM events""",
    ),
    "published_ids": (
        ("docs", "label_rows"),
        """SELECT id FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM label_rows)
            AND doc_id IN (SELECT user_id FROM events)""",
    ),
    "digests": (
        ("docs",),
        f"""SELECT doc_id, title, [source || ' team', 'Author ' || lang] AS authors, ['Institute ' || source] AS institution,
            text AS problem_background, 'read ' || source AS method, 'in ' || lang AS experiment,
            'About "' || title || '"' AS one_sentence_summary, source || '-' || lang AS slug, {SQL_TAGS} AS keywords,
            'none' AS further_thoughts, '{MODEL}' AS model, 0.1::DOUBLE AS temperature, 0.8::DOUBLE AS top_p, lang, id,
            'unknown' AS preference, updated || 'T00:00:00+00:00' AS summary_time,
            round({sql_uniform('s', 'doc_id')}, 6) AS score, NULL::VARCHAR AS abstract, NULL::VARCHAR[] AS categories,
            created, updated
        FROM docs""",
    ),
    "published": (("digests", "published_ids"), "SELECT * FROM digests WHERE id IN (SELECT id FROM published_ids)"),
    "posts": (
        ("docs", "label_rows"),
        f"""SELECT *, coalesce(preference = 'dislike', false) AS draft, coalesce(mod, pub) AS shown_at FROM (
            SELECT d.doc_id, d.id, d.title, d.lang || ' ' || d.source AS description,
            timestamp '2023-01-01' + to_seconds((d.doc_id * 37 % 730) * 86400 + d.doc_id * 37 % 86400) AS pub,
            CASE WHEN d.doc_id % 5 = 0 THEN timestamp '2023-01-04' + to_seconds((d.doc_id * 37 % 730) * 86400 + d.doc_id * 37 % 86400) END AS mod,
            CASE WHEN d.doc_id % 11 <> 0 THEN {sql_uniform('s', 'd.doc_id')} END AS score,
            CASE WHEN d.doc_id % 13 <> 0 THEN coalesce(l.preference, 'unknown') END AS preference,
            {SQL_TAGS.replace('lang', 'd.lang').replace('source', 'd.source')} AS tags, d.doc_id % 50 = 0 AS featured,
            '../content/' || CASE d.lang WHEN 'en' THEN d.source || '/paper notes/' WHEN 'de' THEN '_hidden/' ELSE '' END
                || d.id || '.md' AS file_path, d.lang, d.source
            FROM docs d LEFT JOIN label_rows l ON d.doc_id = l.doc_id)""",
    ),
    "visible": (
        ("posts",),
        f"SELECT * FROM posts WHERE NOT draft AND timestamp '{SETTINGS.as_of_text}' > pub - INTERVAL 900 SECOND",
    ),
    "clean_papers": (
        ("papers",),
        f"SELECT *, list_concat(v1, v2)::DOUBLE[] AS vector FROM papers WHERE {SQL_CLEAN}",
    ),
    "positives": (
        ("clean_papers", "label_rows"),
        "SELECT id, vector FROM clean_papers WHERE id IN (SELECT id FROM label_rows WHERE preference = 'like')",
    ),
    "unlabelled": (("papers", "label_rows"), "SELECT * FROM papers WHERE id NOT IN (SELECT id FROM label_rows)"),
    "background": (
        ("unlabelled",),
        f"""SELECT id, list_concat({SQL_ZEROED.format('v1')}, {SQL_ZEROED.format('v2')})::DOUBLE[] AS vector
            FROM unlabelled WHERE v1 IS NOT NULL AND v2 IS NOT NULL""",
    ),
    "scored": (("clean_papers",), f"SELECT id, title, updated, {SQL_SCORE} AS score FROM clean_papers"),
}


def with_ctes(*names: str) -> str:
    """``WITH`` clause holding the named shapes and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        needs, _ = _CTES[name]
        for need in needs:
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({_CTES[n][1]})" for n in order)
