"""JSON sources: scraped posts of three platforms, nested account maps, wrapped lists, noisy output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmetric.functions.dates import iso_prefix, social_date
from quillmetric.functions.numbers import count_or_zero
from quillmetric.functions.text import bind, compute_once, strip
from quillmetric.session import new_work_path

POST = ("struct<text:string,url:string,author:string,date:string,platform:string,score:double,relevance:double,"
        "outlier:boolean,engagement:map<string,double>>")
NESTED = f"struct<results:map<string,map<string,array<{POST}>>>>"


def _json(item: Column, path: str) -> Column:
    return F.get_json_object(item, f"$.{path}")


def _filled(*values: Column) -> Column:
    """First value that is neither null nor empty, else empty text."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


# one schema for the items of all platforms; counts are read as text, so junk becomes 0 and not an error
ITEM = ("struct<noResults:string,error:string,fullText:string,text:string,url:string,createdAt:string,likeCount:string,"
        "retweetCount:string,replyCount:string,quoteCount:string,bookmarkCount:string,viewCount:string,title:string,"
        "channelName:string,date:string,likes:string,commentsCount:string,duration:string,content:string,linkedinUrl:string,"
        "author:struct<userName:string,name:string,publicIdentifier:string>,postedAt:struct<date:string>,"
        "engagement:struct<likes:string,comments:string,shares:string>>")


def _parsed(items: DataFrame, item: str) -> DataFrame:
    """Each item parsed once, as column p."""
    return compute_once(items, p=F.from_json(item, ITEM)).drop(item)


def _field(path: str) -> Column:
    return F.col(f"p.{path}")


def _counts(fields: dict[str, str]) -> Column:
    flat: list[Column] = []
    for name, path in fields.items():
        flat += [F.lit(name), count_or_zero(_field(path))]
    return F.create_map(*flat)


# Count fields of each platform's items.
X_COUNTS = {"likes": "likeCount", "reposts": "retweetCount", "replies": "replyCount", "quotes": "quoteCount",
            "bookmarks": "bookmarkCount", "views": "viewCount"}
YOUTUBE_COUNTS = {"views": "viewCount", "likes": "likes", "comments": "commentsCount"}
LINKEDIN_COUNTS = {"likes": "engagement.likes", "comments": "engagement.comments", "shares": "engagement.shares"}


def real_items(items: DataFrame, item: str = "item") -> DataFrame:
    """Drop items that are not objects and the markers for no results or an error."""
    marks = compute_once(items, _m=F.from_json(item, "struct<noResults:string,error:string>"),
                         _object=strip(F.col(item)).startswith("{") & F.try_parse_json(item).isNotNull())
    no_results, error = F.coalesce("_m.noResults", F.lit("false")), F.coalesce("_m.error", F.lit(""))
    return marks.filter(F.col("_object") & ~no_results.isin("true", "1") & error.isin("", "false", "0", "null")).drop("_m", "_object")


def x_posts(items: DataFrame, item: str = "item") -> DataFrame:
    return _parsed(items, item).select(
        *[c for c in items.columns if c != item], _filled(_field("fullText"), _field("text")).alias("text"),
        _filled(_field("url")).alias("url"), _filled(_field("author.userName")).alias("author"),
        social_date(_field("createdAt")).alias("post_date"), F.lit("x").alias("platform"),
        _counts(X_COUNTS).alias("engagement"))


def youtube_posts(items: DataFrame, item: str = "item", handle: str = "handle") -> DataFrame:
    return _parsed(items, item).select(
        *[c for c in items.columns if c != item], _filled(_field("title")).alias("text"),
        _filled(_field("url")).alias("url"), _filled(_field("channelName"), F.col(handle)).alias("author"),
        iso_prefix(_field("date")).alias("post_date"), F.lit("youtube").alias("platform"),
        _counts(YOUTUBE_COUNTS).alias("engagement"), _field("duration").alias("duration"),
        _filled(_field("text")).alias("description"))


def linkedin_posts(items: DataFrame, item: str = "item", handle: str = "handle") -> DataFrame:
    return _parsed(items, item).select(
        *[c for c in items.columns if c != item], _filled(_field("content")).alias("text"),
        _filled(_field("linkedinUrl")).alias("url"),
        _filled(_field("author.name"), _field("author.publicIdentifier"), F.col(handle)).alias("author"),
        iso_prefix(_field("postedAt.date")).alias("post_date"), F.lit("linkedin").alias("platform"),
        _counts(LINKEDIN_COUNTS).alias("engagement"))


def nested_posts(results: DataFrame, value: str = "value") -> DataFrame:
    """{platform: {handle: [post]}} as one row per post with its position; accounts without posts give one empty row."""
    parsed = results.select(*[c for c in results.columns if c != value], F.from_json(value, NESTED)["results"].alias("r"))
    keep = [c for c in parsed.columns if c != "r"]
    platforms = parsed.select(*keep, F.explode("r").alias("platform", "accounts"))
    accounts = platforms.select(*keep, "platform", F.explode("accounts").alias("handle", "posts"))
    return accounts.select(*keep, "platform", "handle", F.posexplode_outer("posts").alias("position", "post"))


def after_noise(text: Column) -> Column:
    """The JSON part of program output: from the first bracket or brace on."""
    return F.regexp_extract(text, r"(?s)^[^\[{]*([\[{].*)$", 1)


def wrapped_items(docs: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """Objects of a bare list, or of the list under the first of several keys, with their 0-based position."""
    raw = strip(F.col(value))
    under = F.coalesce(*[F.when(_json(raw, k).startswith("["), _json(raw, k)) for k in keys])
    listed = F.when(raw.startswith("["), raw).otherwise(under)
    items = F.from_json(listed, "array<string>")
    keep = [c for c in docs.columns if c != value]
    return docs.select(*keep, F.posexplode(items).alias("position", "item")).filter(strip(F.col("item")).startswith("{"))


# Keys that lists of ranked posts and of queue items come under.
POST_KEYS = ("posts", "results", "ranked")
QUEUE_KEYS = ("items", "actions", "results")


def ranked_posts(docs: DataFrame, value: str = "value") -> DataFrame:
    """Ranked posts, flat or with a nested post whose outer fields win. A missing rank is the position."""
    items = wrapped_items(docs, value, POST_KEYS)
    v = F.col("item")

    def field(*names: str) -> Column:
        return F.coalesce(*[_json(v, p) for n in names for p in (n, f"post.{n}")])

    hits = _json(v, "breakdown.hits")
    hit_list = F.from_json(hits, "array<string>")
    return items.select(
        *[c for c in items.columns if c not in ("item", "position")],
        F.coalesce(_json(v, "rank").try_cast("int"), F.col("position") + 1).alias("rank"),
        _json(v, "score").try_cast("double").alias("score"),
        F.coalesce(F.nullif(field("author_name"), F.lit("")), F.nullif(field("author"), F.lit("")), F.lit("?")).alias("author"),
        F.bround(_json(v, "breakdown.age_hours").try_cast("double") / 24, 1).alias("age_days"),
        field("like_count").try_cast("bigint").alias("likes"), field("comment_count").try_cast("bigint").alias("comments"),
        F.coalesce(F.when(hits.startswith("["), F.array_join(hit_list, ", ")),
                   F.when(~hits.isin("0", ""), hits), F.lit("")).alias("hits"),
        F.coalesce(field("text"), F.lit("")).alias("text"))


def queue_items(docs: DataFrame, value: str = "value") -> DataFrame:
    items = wrapped_items(docs, value, QUEUE_KEYS)
    v = F.col("item")
    return items.select("position", *[_json(v, c).alias(c) for c in (
        "target_type", "action_type", "status", "counterparty_name", "draft_content")])


def id_list(docs: DataFrame, value: str, is_json: Column) -> DataFrame:
    """Distinct ids of a list, of {ids: []}, of {messages: [{id}]}, or of text lines."""
    raw = strip(F.col(value))
    under = F.coalesce(F.when(raw.startswith("["), raw), *[
        F.when(_json(raw, k).startswith("["), _json(raw, k)) for k in ("ids", "messages")])
    entries = F.transform(F.from_json(under, "array<string>"),
                          lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.id")).otherwise(x))
    lines = F.transform(F.split(raw, r"\r?\n"), strip)
    keep = [c for c in docs.columns if c != value]
    ids = F.when(is_json, entries).otherwise(lines)
    return docs.select(*keep, F.explode(ids).alias("id")).filter(F.coalesce("id", F.lit("")) != "").distinct()


def message_pages(pages: DataFrame, value: str = "value") -> DataFrame:
    """Listing pages to distinct ids; of repeats the last listed counts. Needs page_no."""
    schema = "struct<messages:array<struct<id:string,threadId:string>>>"
    rows = pages.select("page_no", F.posexplode(F.from_json(value, schema)["messages"]).alias("position", "m"))
    last = rows.filter("m.id IS NOT NULL").groupBy(F.col("m.id").alias("id")).agg(
        F.max(F.struct("page_no", "position", F.col("m.threadId").alias("thread_id"))).alias("last"))
    return last.select("id", F.col("last.thread_id").alias("thread_id"))


def entities(payloads: DataFrame, key: str, value: str, paths: tuple[str, ...]) -> DataFrame:
    """Person entities found at known array paths of JSON payloads, one row per canonical profile URL.

    The arrays are read as lists of JSON texts, so entities of any shape pass through.
    """
    lists = [F.coalesce(F.from_json(F.get_json_object(value, p), "array<string>"), F.array().cast("array<string>"))
             for p in paths]
    return _entity_rows(payloads.select(key, F.posexplode(F.concat(*lists)).alias("position", "e")), key)


def walked_entities(payloads: DataFrame, key: str, value: str) -> DataFrame:
    """Person entities found anywhere in JSON payloads, at any depth, one row per canonical profile URL.

    An entity is an object under ``entityResult``, or one with a title and a navigation or target URL. Payloads are walked
    a level at a time, all of them together: a level's objects and arrays are opened into the next level's rows, until none is left. The
    first of a payload counts in order of the path: elements by place, members by name. Bad JSON has no entities.
    """
    found = []
    level = _level(payloads.select(key, F.array().cast("array<int>").alias("position"), F.lit(None).cast("string").alias("name"),
                                   F.try_parse_json(value).alias("node")))
    while not level.isEmpty():
        has = {f: F.variant_get("node", f"$.{f}", "variant").isNotNull() for f in ("title", "navigationUrl", "targetUrl")}
        wrapped = F.coalesce(F.col("name").isin("entityResult", "EntityResult"), F.lit(False))
        named = has["title"] & (has["navigationUrl"] | has["targetUrl"])
        found.append(level.filter(F.col("is_object") & (wrapped | named)).select(key, "position", F.to_json("node").alias("e")))
        opened = level.alias("l").lateralJoin(level.sparkSession.tvf.variant_explode(F.col("l.node").outer()).alias("c"))
        level = _level(opened.select(f"l.{key}", F.array_append("l.position", F.col("c.pos")).alias("position"), F.col("c.key").alias("name"),
                                     F.col("c.value").alias("node")))
    none = payloads.limit(0).select(key, F.array().cast("array<int>").alias("position"), F.lit("").alias("e"))
    return _entity_rows(reduce(DataFrame.unionByName, found, none), key)


def _level(nodes: DataFrame) -> DataFrame:
    """The objects and arrays among the nodes, written, so that no level is opened twice."""
    kind = F.schema_of_variant("node")
    path = new_work_path(nodes.sparkSession, "walk")
    (nodes.withColumn("is_object", kind.startswith("OBJECT")).filter(F.col("is_object") | kind.startswith("ARRAY")).write.parquet(path))
    return nodes.sparkSession.read.parquet(path)


def _entity_rows(flat: DataFrame, key: str) -> DataFrame:
    """Rows of the entities ``e``, JSON texts, that are persons; the first of a profile by key and position.

    Members are read from the text once, into columns of their own, as what is made of them needs them many times.
    """
    from quillmetric.functions.people import degree_code, employer_loose
    from quillmetric.functions.urls import canonical_profile

    v = F.col("e")

    def text_of(name: str) -> Column:
        return F.coalesce(_json(v, f"{name}.text"), bind(_json(v, name), lambda whole: F.when(~whole.startswith("{"), whole)))

    links = [bind(_json(v, n), lambda x: F.nullif(x, F.lit(""))) for n in ("navigationUrl", "targetUrl", "url")]
    by_id = F.concat(F.lit("https://www.linkedin.com/in/"), _json(v, "publicIdentifier"))
    linked = compute_once(flat, _full=F.coalesce(*links, by_id))
    full = F.col("_full")
    linked = compute_once(linked, _link=F.when(full.startswith("/in/"), F.concat(F.lit("https://www.linkedin.com"), full)).otherwise(full))
    linked = persons(compute_once(linked, profile_url=canonical_profile(F.col("_link"))), "profile_url").drop("_full", "_link")
    read = compute_once(
        linked, _title=F.coalesce(text_of("title"), F.lit("")), _head=F.coalesce(text_of("primarySubtitle"), text_of("subtitle"), F.lit("")),
        _place=text_of("secondarySubtitle"), _badge=F.coalesce(text_of("badgeText"), _json(v, "degree"), _json(v, "networkDistance")),
        _company=F.coalesce(_json(v, "currentCompany.name"), _json(v, "currentCompany")))
    place = F.col("_place")
    name = bind(strip(F.regexp_replace("_title", r"(?s)[\n·•].*$", "")), lambda t: F.when(t != "", t).otherwise(
        strip(F.coalesce(_json(v, "actorTitle"), F.lit("")))))
    people = compute_once(
        read, name=name, headline=strip(F.col("_head")),
        location=F.when(~F.contains(F.lower(place), F.lit("mutual")), strip(place)), degree=degree_code(F.col("_badge")),
        current_company=F.coalesce(F.col("_company"), employer_loose(F.col("_head")))).drop("e", "_title", "_head", "_place", "_badge", "_company")
    people = people.filter("name <> ''")
    from quillmetric.operators.merge import keep_first
    return keep_first(people, ["profile_url"], [F.col(key), F.col("position")])


def persons(rows: DataFrame, url: str) -> DataFrame:
    """Rows whose canonical URL is a person's."""
    return rows.filter(F.contains(F.coalesce(F.col(url), F.lit("")), F.lit("/in/")))
