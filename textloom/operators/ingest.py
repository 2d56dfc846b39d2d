"""From harvested records to the store of raw documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.urls import content_hash, normalize_url

_S = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: Keywords come as strings or as objects, so they are read as JSON text and told apart later.
ARTICLE = _struct(
    pmcid=_S,
    title=_S,
    abstractText=_S,
    journalTitle=_S,
    pubYear=_S,
    doi=_S,
    authorList=_struct(author=T.ArrayType(_struct(firstName=_S, lastName=_S))),
    keywordList=_struct(keyword=T.ArrayType(_S)),
)
TRIAL = _struct(
    protocolSection=_struct(
        identificationModule=_struct(nctId=_S, officialTitle=_S, briefTitle=_S),
        descriptionModule=_struct(briefSummary=_S, detailedDescription=_S),
        statusModule=_struct(overallStatus=_S),
        designModule=_struct(phases=T.ArrayType(_S)),
        conditionsModule=_struct(conditions=T.ArrayType(_S)),
        armsInterventionsModule=_struct(interventions=T.ArrayType(_struct(type=_S, name=_S))),
    )
)


def _or(c: Column, other: str = "") -> Column:
    return F.coalesce(c, F.lit(other))


def _page(title: Column, parts: list[tuple[str, str, Column]]) -> Column:
    head = [F.lit("<html><head><title>"), title, F.lit("</title></head><body><h1>"), title, F.lit("</h1>")]
    for tag, name, value in parts:
        head += [F.lit(f"<{tag} class='{name}'>"), value, F.lit(f"</{tag}>")]
    return F.concat(*head, F.lit("</body></html>"))


def article_html(r: Column) -> Column:
    """Page of a literature record (a struct as ARTICLE). Null and missing values are treated alike."""
    people = F.coalesce(r["authorList"]["author"], F.array().cast("array<struct<firstName:string,lastName:string>>"))
    authors = F.array_join(F.transform(people, lambda a: F.concat(_or(a.firstName), F.lit(" "), _or(a.lastName))), ", ")
    words = F.coalesce(r["keywordList"]["keyword"], F.array().cast("array<string>"))
    keywords = F.array_join(F.transform(words, lambda k: F.coalesce(F.get_json_object(k, "$.keyword"), k)), "; ")
    return _page(
        _or(r["title"], "Untitled"),
        [
            ("p", "authors", authors),
            ("p", "journal", F.concat(_or(r["journalTitle"]), F.lit(" ("), _or(r["pubYear"]), F.lit(")"))),
            ("p", "doi", _or(r["doi"])),
            ("p", "keywords", keywords),
            ("div", "abstract", _or(r["abstractText"])),
        ],
    )


def trial_html(r: Column) -> Column:
    """Page of a trial record (a struct as TRIAL)."""
    s = r["protocolSection"]
    ident, about = s["identificationModule"], s["descriptionModule"]
    title = F.coalesce(ident["officialTitle"], ident["briefTitle"], F.lit("Untitled"))

    def listed(c: Column, glue: str) -> Column:
        return F.array_join(F.coalesce(c, F.array().cast("array<string>")), glue)

    arms = F.coalesce(s["armsInterventionsModule"]["interventions"], F.array().cast("array<struct<type:string,name:string>>"))
    return _page(
        title,
        [
            ("p", "nctid", _or(ident["nctId"])),
            ("p", "status", _or(s["statusModule"]["overallStatus"])),
            ("p", "phases", listed(s["designModule"]["phases"], ", ")),
            ("p", "conditions", listed(s["conditionsModule"]["conditions"], ", ")),
            ("p", "interventions", F.array_join(F.transform(arms, lambda a: F.concat(_or(a.type), F.lit(": "), _or(a["name"]))), "; ")),
            ("div", "summary", _or(about["briefSummary"])),
            ("div", "description", _or(about["detailedDescription"])),
        ],
    )


def present(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def with_store_columns(df: DataFrame, url: Column, html: Column, source: str, crawl_time: Column) -> DataFrame:
    """``(url, raw_html, source, crawl_time, content_hash)`` as the store holds it."""
    return df.select(
        normalize_url(url).alias("url"), html.alias("raw_html"), F.lit(source).alias("source"), crawl_time.cast("long").alias("crawl_time"), content_hash(html).alias("content_hash")
    )


def articles(records: DataFrame, base_url: str, crawl_time: Column, least: int = 100) -> DataFrame:
    """Literature records with an id and an abstract of at least ``least`` characters, as documents.
    ``records`` has a column ``r`` as ARTICLE."""
    r = F.col("r")
    kept = records.where(present(r["pmcid"]) & (F.length(r["abstractText"]) >= least))
    return with_store_columns(kept, F.concat(F.lit(base_url), r["pmcid"]), article_html(r), "literature_api", crawl_time)


def trials(records: DataFrame, base_url: str, crawl_time: Column, least: int = 300) -> DataFrame:
    """Trial records with an id whose page has at least ``least`` characters, as documents."""
    r = F.col("r")
    nct = r["protocolSection"]["identificationModule"]["nctId"]
    docs = with_store_columns(records.where(present(nct)), F.concat(F.lit(base_url), nct), trial_html(r), "trials_api", crawl_time)
    return docs.where(F.length("raw_html") >= least)


def first_by_url(batch: DataFrame, order: list[str]) -> DataFrame:
    """One row for each url, the first in ``order``; rows without url are dropped."""
    rest = [c for c in batch.columns if c != "url"]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return batch.where(F.col("url").isNotNull()).groupBy("url").agg(first).select("url", "_r.*")


def crawl_state(store: DataFrame) -> DataFrame:
    """``(url, content_hash)`` of what is stored, a missing hash as an empty string."""
    return store.select("url", F.coalesce("content_hash", F.lit("")).alias("content_hash"))


def not_stored(batch: DataFrame, store: DataFrame) -> DataFrame:
    return batch.join(store.select("url"), "url", "left_anti")


def bulk_insert(store: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    """Store with the documents of the batch whose url is new; of several the first, and what is
    stored stays."""
    return store.unionByName(not_stored(first_by_url(batch, order), store).select(*store.columns))


def upsert(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Store after a batch ``(url, raw_html, source, crawl_time, content_hash)``, one row for each
    url, with ``action``: ``insert`` for a new url; ``update`` where the hash differs, which
    replaces body, hash and time but keeps the source; else ``keep``."""
    new = batch.select("url", *[F.col(c).alias(f"_{c}") for c in ("raw_html", "source", "crawl_time", "content_hash")], F.lit(True).alias("_new"))
    j = store.withColumn("_old", F.lit(True)).join(new, "url", "full_outer")
    is_new = F.col("_old").isNull()
    changed = F.col("_old") & F.col("_new") & ~F.col("content_hash").eqNullSafe(F.col("_content_hash"))
    action = F.when(is_new, "insert").when(changed, "update").otherwise("keep")

    def pick(c: str) -> Column:
        take = is_new if c == "source" else is_new | F.coalesce(changed, F.lit(False))
        return F.when(take, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)

    return j.select("url", *[pick(c) for c in ("raw_html", "source", "crawl_time", "content_hash")], action.alias("action"))


def quota(docs: DataFrame, source: str, order: list[str], targets: dict[str, int], already: DataFrame | None = None) -> DataFrame:
    """At most ``target - already`` documents of each source, the first in ``order``; sources without
    a target are left out. The best of each partition are found before sources meet in one task."""
    limits = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv]) if targets else F.create_map().cast("map<string,int>")
    d = docs.where(F.col(source).isin(*targets))
    room = F.try_element_at(limits, F.col(source))
    if already is not None:
        d = d.join(F.broadcast(already.select(source, F.col("already").alias("_a"))), source, "left")
        room = room - F.coalesce("_a", F.lit(0))
    by = ", ".join(order)
    d = d.withColumn("_room", room).withColumn("_p", F.spark_partition_id())
    d = d.withColumn("_n", F.expr(f"row_number() OVER (PARTITION BY {source}, _p ORDER BY {by})")).where("_n <= _room")
    d = d.withColumn("_n", F.expr(f"row_number() OVER (PARTITION BY {source} ORDER BY {by})")).where("_n <= _room")
    return d.select(*docs.columns)


def stored_by_source(store: DataFrame, patterns: dict[str, list[str]]) -> DataFrame:
    """How many stored urls contain one of a source's patterns."""
    counts = [F.count_if(F.reduce(F.array(*[F.contains("url", F.lit(p)) for p in ps]), F.lit(False), lambda a, b: a | b)).alias(s) for s, ps in patterns.items()]
    one = store.agg(*counts)
    return one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.col(s).alias("already")) for s in patterns])).alias("x")).select("x.*")
