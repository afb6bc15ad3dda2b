"""Joins between posts, connections, entities, text and page nodes.

Each join is an equi-join on a derived key, with the other side pre-aggregated where only a
summary is needed; nothing pairs rows without a key. Catalyst picks broadcast or sort-merge from
the sizes it knows, and adaptive execution splits hot partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmetric.functions.people import display_company
from quillmetric.functions.text import bind, slug_join


# ---- connections and posts -------------------------------------------------

def connections_with_posts(connections: DataFrame, posts: DataFrame) -> DataFrame:
    """Own posts by handle and employer posts by company slug per connection, with engagement.

    The raw company key wins over the normalised one. Posts are summed per key before the joins, so
    a busy author or employer meets the connections as one row.
    """
    eng = (F.coalesce("like_count", F.lit(0)) + F.coalesce("comment_count", F.lit(0))
           + F.coalesce("repost_count", F.lit(0))).cast("bigint")
    is_page = F.col("author_type") == "company"
    key = F.when(is_page, slug_join(F.col("author_id"))).otherwise(
        F.lower(F.regexp_extract("author_id", r"(?i)^\s*urn:li:member:(.+)$", 1)))
    sums = (posts.select(is_page.alias("is_page"), key.alias("post_key"), eng.alias("eng"))
            .filter(F.coalesce("post_key", F.lit("")) != "")
            .groupBy("is_page", "post_key").agg(F.count(F.lit(1)).alias("n"), F.sum("eng").alias("eng")))
    own = sums.filter(~F.col("is_page")).select(F.col("post_key").alias("handle"), F.col("n").alias("own_n"), F.col("eng").alias("own_eng"))
    page = sums.filter("is_page")
    raw = page.select(F.col("post_key").alias("_raw"), F.col("n").alias("raw_n"), F.col("eng").alias("raw_eng"))
    norm = page.select(F.col("post_key").alias("_norm"), F.col("n").alias("norm_n"), F.col("eng").alias("norm_eng"))
    handle = F.nullif(F.lower(F.coalesce(F.try_url_decode(F.regexp_extract("profile_url", r"(?i)/in/([^/?#]+)", 1)),
                                         F.lit(""))), F.lit(""))
    out = (connections.withColumn("handle", handle)
           .withColumn("_raw", slug_join(F.col("current_company")))
           .withColumn("_norm", slug_join(display_company(F.col("current_company"))))
           .join(own, "handle", "left").join(raw, "_raw", "left").join(norm, "_norm", "left"))
    zero = F.lit(0).cast("bigint")
    company_n = F.coalesce("raw_n", "norm_n", zero)
    company_eng = F.when(F.col("raw_n").isNotNull(), F.col("raw_eng")).otherwise(F.coalesce("norm_eng", zero))
    total_n = F.coalesce("own_n", zero) + company_n
    total_eng = F.coalesce("own_eng", zero) + company_eng
    return out.select(
        *connections.columns, "handle", total_n.alias("posts"), F.coalesce("own_n", zero).alias("own_posts"),
        company_n.alias("company_posts"), total_eng.alias("total_engagement"),
        F.coalesce(F.bround(F.try_divide(total_eng, total_n), 1), F.lit(0.0)).alias("avg_engagement"))


def attach_author(posts: DataFrame, contacts: DataFrame, name: str, author: str, order: str,
                  columns: Sequence[str]) -> DataFrame:
    """Contact columns by trimmed lower-case name; of several contacts with a name the last one counts."""
    key = F.lower(F.trim(F.col(name)))
    best = contacts.groupBy(key.alias("_who")).agg(F.max(F.struct(order, *columns)).alias("_c"))
    out = posts.withColumn("_who", F.lower(F.trim(F.col(author)))).join(best, "_who", "left")
    return out.select(*posts.columns, *[F.col("_c")[c].alias(c) for c in columns])


def fill_tier(posts: DataFrame, contacts: DataFrame, name: str, author: str, order: str) -> DataFrame:
    """Missing author tiers from the first contact of that name that has one."""
    key = F.lower(F.trim(F.col(name)))
    first = (contacts.filter(F.col("tier").isNotNull()).groupBy(key.alias("_who"))
             .agg(F.min(F.struct(order, "tier")).alias("_c")))
    return (posts.withColumn("_who", F.lower(F.trim(F.col(author)))).join(first, "_who", "left")
            .withColumn("author_tier", F.coalesce("author_tier", F.col("_c")["tier"])).drop("_who", "_c"))


def without_queued(posts: DataFrame, queued: DataFrame, key: str) -> DataFrame:
    return posts.join(queued.select(key).distinct(), key, "left_anti")


def with_counterparty(actions: DataFrame, threads: DataFrame, posts: DataFrame) -> DataFrame:
    """Name of the person an action is about: thread participant for messages, author for posts."""
    as_dm = F.when(F.col("target_type") == "dm", F.col("target_id"))
    as_post = F.when(F.col("target_type") == "post", F.col("target_id"))
    return (actions.withColumn("_dm", as_dm).withColumn("_post", as_post)
            .join(threads.select(F.col("thread_id").alias("_dm"), "participant_name"), "_dm", "left")
            .join(posts.select(F.col("post_id").alias("_post"), "author_name"), "_post", "left")
            .withColumn("counterparty_name", F.coalesce("participant_name", "author_name"))
            .drop("_dm", "_post", "participant_name", "author_name"))


# ---- flat entity payloads ----------------------------------------------------

def connections_from_entities(payloads: DataFrame, payload_key: str, entities: str) -> DataFrame:
    """Relationship entity to profile entity of the same payload; dangling references drop out.

    ``entities`` is array<struct<type, urn, ref, first_name, last_name, public_id, headline, created_at>>.
    """
    flat = payloads.select(payload_key, F.posexplode(entities).alias("pos", "e")).select(payload_key, "pos", "e.*")
    links = flat.filter((F.col("type") == "connection") & F.col("ref").isNotNull()).select(
        payload_key, F.col("ref").alias("urn"), "pos", "created_at")
    people = (flat.filter((F.col("type") == "profile") & (F.coalesce("public_id", F.lit("")) != ""))
              .groupBy(payload_key, "urn").agg(F.max(F.struct("pos", "first_name", "last_name", "public_id", "headline")).alias("p")))
    joined = links.join(people, [payload_key, "urn"])
    rank = F.row_number().over(Window.partitionBy("public_id").orderBy(payload_key, "pos"))
    named = joined.select(
        payload_key, "pos", "created_at", F.col("p.public_id").alias("public_id"), F.col("p.headline").alias("headline"),
        F.trim(F.concat_ws(" ", "p.first_name", "p.last_name")).alias("name"))
    return named.filter("name <> ''").withColumn("_r", rank).filter("_r = 1").drop("_r")


def posts_with_counts(entities: DataFrame) -> DataFrame:
    """Post to social detail to counts, two hops by urn; a missing hop leaves null counts.

    ``entities`` has type, urn, ref, payload_id, post_id, likes, comments, shares.
    """
    def kind(name: str) -> DataFrame:
        return entities.filter(F.col("type") == name)

    detail = kind("detail").groupBy(F.col("urn").alias("detail_urn")).agg(F.max("ref").alias("counts_urn"))
    counts = kind("counts").groupBy(F.col("urn").alias("counts_urn")).agg(
        F.max(F.struct("likes", "comments", "shares")).alias("c"))
    posts = kind("post").select("post_id", F.col("ref").alias("detail_urn"))
    rows = posts.join(detail, "detail_urn", "left").join(counts, "counts_urn", "left").select(
        "post_id", F.col("c.likes").alias("like_count"), F.col("c.comments").alias("comment_count"),
        F.col("c.shares").alias("repost_count"))
    return rows.dropDuplicates(["post_id"])


def ids_in_spans(texts: DataFrame, key: str, text: str, card: str, member: str) -> DataFrame:
    """First member id between a card key and the next distinct card key, inside each text.

    A text is cut at its card keys, so each span is a piece of the row itself.
    """
    def spans(pieces: Column) -> Column:
        cards = F.filter(F.transform(pieces, lambda p, i: F.struct(
            F.lower(F.regexp_extract(p, "^" + card, 1)).alias("handle"), i.alias("i"))), lambda c: c["handle"] != "")
        # a repeated card key does not end a span: only first occurrences do
        firsts = bind(cards, lambda cs: bind(F.transform(cs, lambda c: c["handle"]), lambda hs: F.filter(
            cs, lambda c, i: F.array_position(hs, c["handle"]) == i + 1)))

        def cut(starts: Column) -> Column:
            def span(c: Column, i: Column) -> Column:
                stop = F.coalesce(F.get(starts, i + 1)["i"], F.size(pieces))
                body = F.array_join(F.slice(pieces, c["i"] + 1, stop - c["i"]), "")
                return F.struct(c["handle"].alias("handle"), F.regexp_extract(body, member, 1).alias("member"))

            return F.transform(starts, span)

        return F.filter(bind(firsts, cut), lambda s: s["member"] != "")

    pieces = F.split(F.col(text), "(?=" + card + ")", -1)
    return texts.select(key, F.explode(bind(pieces, spans)).alias("s")).select(key, "s.*")


# ---- text containment --------------------------------------------------------

#: Needles meet texts by windows of at most so many letters; longer needles by their first letters, and are compared whole.
WINDOW_LETTERS = 64


def _window_hashes(letters: Column, lengths: Column) -> Column:
    """Distinct hashes of all windows of the given lengths; windows of a length beyond the text's do not exist."""
    def of(n: Column) -> Column:
        starts = F.when(F.size(letters) >= n, F.sequence(F.lit(1), F.greatest(F.size(letters) - n + 1, F.lit(1))))
        return F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.xxhash64(F.slice(letters, i, n)))

    return F.array_distinct(F.flatten(F.transform(lengths, of)))


def containment_pairs(hays: DataFrame, hay_id: str, hay: str, needles: DataFrame, needle_id: str, needle: str) -> DataFrame:
    """(hay_id, needle_id) where the hay holds the needle; nulls and empty needles are in none. Ids of hays are distinct.

    Texts send the hashes of their windows, with their id and no text, and only of lengths that needles have: at most
    ``WINDOW_LETTERS`` lengths, one row for the plan. A hash meets its needles by equality, so a needle meets a text once, however
    often it occurs there; only texts that met one are read again, to compare the letters themselves.
    """
    asked = needles.filter(F.length(needle) > 0).select(
        F.col(needle_id), F.col(needle).alias("_needle"), F.least(F.length(needle), F.lit(WINDOW_LETTERS)).alias("_size"))
    lengths = asked.agg(F.collect_set("_size").alias("_lengths")).scalar()
    windows = (hays.filter(F.col(hay).isNotNull()).select(F.col(hay_id), F.split(F.col(hay), "").alias("_letters"), lengths.alias("_lengths"))
               .select(hay_id, F.explode(bind(F.col("_letters"), lambda ls: _window_hashes(ls, F.col("_lengths")))).alias("_hash")))
    keyed = asked.select(needle_id, "_needle", F.xxhash64(F.slice(F.split("_needle", ""), F.lit(1), F.col("_size"))).alias("_hash"))
    met = windows.join(keyed, "_hash").select(hay_id, needle_id, "_needle")
    return (met.join(hays.select(F.col(hay_id), F.col(hay).alias("_hay")), hay_id)
            .filter(F.contains("_hay", "_needle")).select(hay_id, needle_id))


def first_detail(contacts: DataFrame, details: DataFrame, contact_id: str, name: str, detail_id: str,
                 title: str) -> DataFrame:
    """First detail record (by id) whose title holds the contact's name or the other way round.

    Group headings (two people in one title) are left out. Equal names and equal titles meet once; a title stands for its
    smallest id.
    """
    people = contacts.select(contact_id, F.lower(name).alias("_name"))
    names = people.select("_name").distinct().withColumn("_n", F.col("_name"))
    titles = (details.select(F.lower(title).alias("_title"), detail_id).filter(~F.col("_title").rlike(" & | and "))
              .groupBy("_title").agg(F.min(detail_id).alias(detail_id)))
    inside_name = containment_pairs(names, "_n", "_name", titles, detail_id, "_title")
    inside_title = containment_pairs(titles, detail_id, "_title", names, "_n", "_name").select("_n", detail_id)
    best = inside_name.unionByName(inside_title).groupBy("_n").agg(F.min(detail_id).alias(detail_id))
    return people.join(best, F.col("_name") == F.col("_n")).select(contact_id, detail_id)


# ---- history -----------------------------------------------------------------

def check_history(claims: DataFrame, history: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """Verdict per claim: 'match', 'conflict' with the sorted expected values, or 'missing'.

    A match is an equality join on key and value. Expected values are listed for keys in conflict only.
    """
    value = F.concat_ws(" | ", *[F.col(a) for a in attributes])
    known = history.select(F.lower(key).alias("_key"), value.alias("_v")).distinct()
    asked = claims.withColumn("_key", F.lower(key)).withColumn("_v", value)
    judged = (asked.join(known.withColumn("_same", F.lit(True)), ["_key", "_v"], "left")
              .join(known.select("_key").distinct().withColumn("_there", F.lit(True)), "_key", "left")
              .withColumn("verdict", F.when(F.col("_same"), "match").when(F.col("_there"), "conflict").otherwise("missing")))
    disputed = judged.filter("verdict = 'conflict'")
    expected = (known.join(disputed.select("_key").distinct(), "_key", "left_semi").groupBy("_key")
                .agg(F.array_join(F.array_sort(F.collect_list("_v")), "; ").alias("expected")))
    settled = judged.filter("verdict <> 'conflict'").withColumn("expected", F.lit(None).cast("string"))
    return disputed.join(expected, "_key").unionByName(settled).drop("_key", "_v", "_same", "_there")


# ---- keyword alignment ---------------------------------------------------------

def alignment(hits_a: Column, hits_b: Column, hits_c: Column) -> Column:
    """Tiered alignment: base by best tier, a tenth per extra hit up to two tenths, at most one."""
    base = (F.when(F.size(hits_a) > 0, 1.0).when(F.size(hits_b) > 0, 0.7).when(F.size(hits_c) > 0, 0.3).otherwise(0.0))
    extra = F.least((F.size(hits_a) + F.size(hits_b) + F.size(hits_c) - 1) * F.lit(0.1), F.lit(0.2))
    return F.when(base > 0, F.least(base + extra, F.lit(1.0))).otherwise(0.0)


def rename_map(pairs: Mapping[str, str]) -> Column:
    if not pairs:
        return F.create_map().cast("map<string,string>")
    flat: list[Column] = []
    for k, v in pairs.items():
        flat += [F.lit(k), F.lit(v)]
    return F.create_map(*flat)
