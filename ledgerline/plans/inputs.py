"""Operator inputs derived from the supplied tables, whole tables at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import scalars as X
from ledgerline.operators import ordered

SOURCES = {
    "events": (
        "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    ),
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp, o_orderpriority string"
    ),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
EPOCH = 1_672_531_200  # 2023-01-01
FRAMES_IN_TASK = 250_000


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SOURCES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _minutes(n: Column | str) -> Column:
    return F.timestamp_seconds(F.lit(EPOCH) + X.as_column(n).cast("bigint") * 60)


def _by_event(otherwise: object = "", **values: object) -> Column:
    chain = F
    for name, value in values.items():
        chain = chain.when(
            F.col("event_type") == name, value if isinstance(value, Column) else F.lit(value)
        )
    return chain.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def user(key: str) -> Column:
    return F.concat(F.lit("u"), F.col(key).cast("string"))


def user_day() -> Column:
    return F.col("user_id") * 1000 + F.dayofyear("ts")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_actions(source(spark, sf_dir, "events"))


def as_actions(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("id"),
        user("user_id").alias("persona"),
        F.col("event_type").alias("action"),
        F.col("props").alias("detail"),
        "ts",
    )


def personas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers; suppliers have no accounts."""

    def build(df, name, key, nation, balance, description):
        n, b = F.col(nation), F.col(balance)
        return df.select(
            name.alias("name"),
            description.alias("description"),
            F.when(b > 5000, "ordering").otherwise("").alias("purpose"),
            F.lit("en-US").alias("locale"),
            F.lit("UTC").alias("timezone"),
            F.when(b < 0, F.concat(F.lit("Short sentences for "), name)).otherwise("").alias("profile"),
            F.when(n == 7, "Knows nation seven.").otherwise("").alias("context_summary"),
            _minutes(key).alias("created_at"),
            F.when(n >= 10, _minutes(F.col(key) + n * 1440)).alias("last_used_at"),
        )

    return build(
        source(spark, sf_dir, "customer"),
        user("c_custkey"),
        "c_custkey",
        "c_nationkey",
        "c_acctbal",
        F.lower("c_mktsegment"),
    ).unionByName(
        build(
            source(spark, sf_dir, "supplier"),
            F.concat(F.lit("s"), F.col("s_suppkey").cast("string")),
            "s_suppkey",
            "s_nationkey",
            "s_acctbal",
            F.lit(""),
        )
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    s = F.col("o_orderstatus")
    key = F.col("o_orderkey").cast("string")
    return source(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        user("o_custkey").alias("persona"),
        F.when(p == "1-URGENT", "Gmail")
        .when(p == "2-HIGH", "outlook.com")
        .when(p == "3-MEDIUM", "code.example.com")
        .when(p == "4-NOT SPECIFIED", "newsboard")
        .otherwise("protonmail")
        .alias("service"),
        F.concat(F.lit("m"), key, F.lit("@example.com")).alias("email"),
        F.when(s == "P", "").otherwise(F.concat(F.lit("local/ns/"), key)).alias("creds_ref"),
        F.when(s == "F", "active").when(s == "O", "pending").otherwise("blocked").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_totalprice") > 400_000, "large").otherwise("").alias("notes"),
    )


def milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_milestones(source(spark, sf_dir, "events"))


def as_milestones(events: DataFrame) -> DataFrame:
    def tags(*names):
        return F.array(*[F.lit(n) for n in names]).cast("array<string>")

    return events.select(
        F.col("event_id").alias("id"),
        user("user_id").alias("persona"),
        F.col("event_type").alias("event"),
        _by_event(F.col("props"), view="").alias("detail"),
        _by_event(
            "",
            click=F.concat(F.lit("https://www.example.com/item/"), F.col("user_id").cast("string")),
        ).alias("url"),
        _by_event(
            tags(),
            purchase=tags("post", "shop"),
            signup=tags("account"),
            error=tags("reply", "error"),
            click=tags("comment"),
        ).alias("tags"),
        _by_event(
            "", signup=F.concat(F.lit("shots/"), F.col("event_id").cast("string"), F.lit(".png"))
        ).alias("screenshot_path"),
        F.lit("manual").alias("source"),
        "ts",
    )


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as knowledge entries; labels decide what was digested, edited or deleted."""
    created = _minutes(F.col("doc_id") * 60)
    day = F.expr("interval 1 day")
    return (
        source(spark, sf_dir, "documents")
        .join(source(spark, sf_dir, "labels"), "doc_id", "left")
        .select(
            F.col("doc_id").alias("id"),
            F.col("source").alias("persona"),
            F.col("text").alias("summary"),
            F.when(
                F.col("lang") == "en",
                F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string")),
            ).alias("source"),
            F.concat(F.col("lang"), F.lit(" , "), F.col("source"), F.lit(",")).alias("tags"),
            created.alias("created_at"),
            F.when(
                F.col("quality") == 1, _minutes(F.col("doc_id") * 60 + F.col("n_chars"))
            ).alias("updated_at"),
            F.when(F.col("quality").isNotNull(), created + day).alias("digested_at"),
            F.when(F.col("toxic") == 1, created + F.expr("interval 3 days")).alias("deleted_at"),
        )
    )


def digest_personas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personas of the knowledge table, one per document source."""
    return (
        source(spark, sf_dir, "documents")
        .groupBy(F.col("source").alias("name"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "name",
            F.when(F.col("n") > 50, F.concat(F.lit("Summary of "), F.col("name")))
            .otherwise("")
            .alias("context_summary"),
        )
    )


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source(spark, sf_dir, "pages").select("page_id", "url")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes of all pages.

    Those of plain http pages are held under a host of their own, so that they match by base domain at most, and
    those of example.org under a domain without pages, so that its URLs match nothing.
    """
    held = F.when(F.col("url").startswith("https://"), F.replace("domain", F.lit("example.org"), F.lit("example.invalid")))
    sites = urls(spark, sf_dir).select(
        "page_id",
        "url",
        X.extract_domain("url").alias("domain"),
        F.regexp_extract("url", r"://[^/]*/([a-z]+)/", 1).alias("action"),
    )
    sites = sites.withColumn("domain", held.otherwise(F.concat(F.lit("old."), F.col("domain"))))
    grouped = sites.groupBy("domain", "action").agg(
        F.min("page_id").alias("id"),
        F.count(F.lit(1)).alias("n"),
        F.min("url").alias("first_url"),
    )
    navigate = F.struct(
        F.lit("navigate").alias("action"),
        F.lit(None).cast("string").alias("selector"),
        F.lit("").alias("expected_url"),
        F.lit(None).cast("string").alias("detail"),
        F.col("first_url").alias("url"),
    )
    click = F.struct(
        F.lit("click").alias("action"),
        F.lit("#main").alias("selector"),
        F.col("first_url").alias("expected_url"),
        F.lit("open").alias("detail"),
        F.lit(None).cast("string").alias("url"),
    )
    empty = F.array().cast("array<string>")
    return grouped.select(
        "id",
        "domain",
        "action",
        F.concat(F.lit("Read "), F.col("action")).alias("description"),
        F.least(F.lit(10), F.col("n")).cast("int").alias("confidence"),
        F.array(navigate, click).alias("steps"),
        F.when(F.col("n") > 1, F.array(F.lit("slow"), F.lit("moves")))
        .otherwise(empty)
        .alias("caveats"),
        F.when(F.col("n") > 2, F.array(F.concat("domain", F.lit("/login"))))
        .otherwise(empty)
        .alias("refs"),
        _minutes("id").alias("created"),
        F.when(F.col("n") > 1, _minutes(F.col("id") + 60)).alias("last_verified"),
        F.when(F.col("n") > 3, _minutes(F.col("id") + 30)).alias("last_failed"),
    )


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One element per event; a page is what one user met on one day."""
    v = F.col("value")
    name = F.when(v < 20, "Terms").when(v > 120, "q").otherwise("email")
    box = F.when(v < 20, "checkbox").when(v < 70, "email").otherwise("text")
    src = (
        F.when(v > 250, "https://hcaptcha.example/x")
        .when(v > 200, "https://arkoselabs.example/x")
        .otherwise("https://recaptcha.example/x")
    )
    return source(spark, sf_dir, "events").select(
        user_day().alias("page_id"),
        F.col("event_id").alias("pos"),
        _by_event(
            "",
            click="BUTTON",
            view="a",
            purchase="input",
            signup="input",
            error=F.when(v > 150, "iframe").otherwise("div"),
        ).alias("tag"),
        F.when(v > 30, F.concat(F.lit("el"), F.col("event_id").cast("string"))).otherwise("").alias("id"),
        _by_event("", purchase=name).alias("name"),
        _by_event("", signup="password", purchase=box).alias("type"),
        F.lit("").alias("role"),
        _by_event(
            "",
            click=F.when(v < 10, "Accept all cookies").otherwise("Buy now"),
            view="Read more",
            error="Something failed",
        ).alias("text"),
        F.lit("").alias("value"),
        _by_event("", purchase=F.when((v > 70) & (v < 75), "Search here").otherwise("")).alias(
            "placeholder"
        ),
        _by_event("", view="Open the article").alias("ariaLabel"),
        F.lit("").alias("class"),
        _by_event("", error=F.when(v > 150, src).otherwise("")).alias("src"),
        (v >= 1).alias("visible"),
    )


def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user-day pages, and the stored pages, which have no element rows."""
    visited = (
        source(spark, sf_dir, "events")
        .groupBy(user_day().alias("page_id"))
        .agg(F.when(F.min("value") < 1, "Top 500 pages").otherwise("Visit").alias("title"))
    )
    stored = source(spark, sf_dir, "pages").select(
        (-1 - F.col("page_id")).alias("page_id"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
    )
    return visited.unionByName(stored)


def as_steps(events: DataFrame, run: Column, *carried: str) -> DataFrame:
    """Step rows without their number; ``carried`` are columns of the events to keep."""
    v = F.col("value")
    return events.select(
        run.alias("run_id"),
        "event_id",
        "ts",
        F.when(v < 50, "content").otherwise("search").alias("page_type"),
        F.col("props").alias("description"),
        _by_event(
            "",
            click="click",
            view="scroll",
            signup="fill",
            purchase=F.when(v > 100, "done").otherwise("click"),
            error=F.when(v > 80, "abort")
            .when(v < 10, "recaptcha_checkbox_passed")
            .otherwise("click"),
        ).alias("action_taken"),
        F.when((v < 15) | (F.col("event_type") == "view"), "heuristics").otherwise("api").alias("tier"),
        F.least(F.lit(1.0), v / 100).alias("confidence"),
        *carried,
    )


def _steps(spark: SparkSession, sf_dir: str, run: Column, *carried: str) -> DataFrame:
    rows = as_steps(source(spark, sf_dir, "events"), run, *carried)
    return ordered.ordinal(rows, ["run_id"], ["ts", "event_id"], "step", keep_ranges=True)


def day_steps(spark: SparkSession, sf_dir: str, *carried: str) -> DataFrame:
    return _steps(spark, sf_dir, user_day(), *carried)


def user_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir, F.col("user_id"))


def flow_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_outcomes(source(spark, sf_dir, "events"))


def as_outcomes(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("site"), F.col("user_id").cast("string"), F.lit(".example.com")).alias("domain"),
        F.lit("visit").alias("action"),
        user_day().alias("run_id"),
        _by_event(
            "success",
            signup="save",
            error=F.when(F.col("value") < 100, "fast_fail").otherwise("delete"),
        ).alias("outcome"),
        "ts",
    )


def stored_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes stored before the first outcome."""
    n = F.col("c_nationkey")
    return (
        source(spark, sf_dir, "customer")
        .select(
            F.concat(F.lit("site"), F.col("c_custkey").cast("string"), F.lit(".example.com")).alias(
                "domain"
            ),
            F.lit("visit").alias("action"),
            F.least(F.lit(10), n).alias("confidence"),
            _minutes("c_custkey").alias("created"),
            F.when(n > 5, _minutes(F.col("c_custkey") + 10)).alias("last_verified"),
            F.when(n > 15, _minutes(F.col("c_custkey") + 5)).alias("last_failed"),
        )
    )


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recording per user, started two hours after the first event."""
    first = F.min(F.struct("ts", "event_id", "event_type"))["event_type"]
    return (
        source(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("rec_id"))
        .agg(
            (F.unix_millis(F.min("ts")) + 7_200_000).alias("start_ms"),
            F.unix_millis(F.max("ts")).alias("last_ms"),
            F.when(first.isin("error", "view"), 2.0**-14).otherwise(2.0**-11).alias("fps"),
        )
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor((F.col("last_ms") - F.col("start_ms")) * F.col("fps") / 1000).cast("bigint")
    idx = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(
        F.array().cast("array<bigint>")
    )
    # The few recordings would otherwise be merged into one task just before they grow into their frames. Partitions
    # follow the number of frames, and are more than those of the grouping: Spark drops a repartition to as many.
    made = recordings(spark, sf_dir)
    total = made.agg(F.sum(F.greatest(n, F.lit(0)))).first()[0] or 0
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")) + 1, total // FRAMES_IN_TASK + 1)
    return (
        made.repartition(spread, "rec_id")
        .select("rec_id", F.explode(idx).alias("frame_idx"))
        .withColumn("file", F.concat(F.lit("frame-"), F.col("frame_idx").cast("string"), F.lit(".png")))
    )


def frame_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions with their time in ms; sign-ups are fills that take a while."""
    return source(spark, sf_dir, "events").select(
        F.col("user_id").alias("rec_id"),
        F.unix_millis("ts").alias("ts_ms"),
        _by_event("click", signup="fill").alias("action"),
        F.when(F.col("event_type") == "signup", F.floor(F.col("value")) * 60_000).alias("duration_ms"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers in the shapes a parser must take: bare, fenced, in prose, cut off, listed."""
    p = F.col("props")
    fence = "```"
    return source(spark, sf_dir, "events").select(
        F.col("event_id").alias("resp_id"),
        _by_event(
            p,
            click=F.concat(F.lit(f"Here:\n{fence}json\n"), p, F.lit(f"\n{fence}\ndone")),
            view=F.concat(F.lit("The answer is "), p, F.lit(" as asked.")),
            error=F.concat(F.lit(f"{fence}\n"), p),
            signup=F.concat(F.lit("{"), p),
        ).alias("text"),
    )
