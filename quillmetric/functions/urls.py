"""URL column functions: platform, handle, canonical form, ids, page blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmetric.functions.text import strip

# The canonical site, its path shapes and the id patterns in them.
SITE = "linkedin.com"
SITE_ROOT = "https://www.linkedin.com"
JOB_PATH = r"/jobs/view/(?:[^/?#]*-)?(\d+)"
JOB_QUERY = r"currentJobId=(\d+)"
COMPANY_PATH = r"/company/([^/?#]+)"
ACTIVITY_ID = r"(?:urn:li:activity:|/activity[:-])(\d+)"
RESERVED_SEGMENTS = ("p", "reel", "reels", "stories", "tv")

# Paths and titles of pages that ask the reader to log in.
BLOCK_PATH = r"(?i)/(authwall|login|checkpoint|uas/|challenge|captcha)"
BLOCK_TITLE = r"(?i)security verification|security check|sign in|log in|let.s do a quick"


def platform_of(url: Column) -> Column:
    low = F.lower(url)

    def has(*parts: str) -> Column:
        test = F.contains(low, F.lit(parts[0]))
        for part in parts[1:]:
            test = test | F.contains(low, F.lit(part))
        return test

    return (F.when(has("x.com/", "twitter.com/"), "x").when(has("instagram.com/"), "instagram")
            .when(has("tiktok.com/"), "tiktok").when(has("youtube.com/", "youtu.be/"), "youtube"))


def handle_of(url: Column, platform: Column) -> Column:
    parts = F.split(url, "/")
    trimmed = F.split(F.regexp_replace(url, "/+$", ""), "/")
    x_at = F.coalesce(F.nullif(F.array_position(parts, "x.com"), F.lit(0)),
                      F.nullif(F.array_position(parts, "twitter.com"), F.lit(0)))
    from_x = F.get(parts, x_at.cast("int"))
    ig_host = F.get(F.filter(trimmed, lambda p: F.contains(p, F.lit("instagram.com"))), F.lit(0))
    from_ig = F.get(trimmed, F.array_position(trimmed, ig_host).cast("int"))
    at_part = F.get(F.filter(parts, lambda p: p.startswith("@")), F.lit(0))
    return (F.when(platform == "x", from_x)
            .when(platform == "instagram", F.when(~from_ig.isin(*RESERVED_SEGMENTS), from_ig))
            .when(platform.isin("tiktok", "youtube"), F.regexp_replace(at_part, "^@+", "")))


def _with_scheme(url: Column) -> Column:
    return F.regexp_replace(strip(url), "^(?!https?://)/*", "https://")


def _host(full: Column) -> Column:
    return F.lower(F.regexp_extract(full, r"^https?://([^/?#]*)", 1))


def _path(full: Column) -> Column:
    return F.regexp_extract(full, r"^https?://[^/?#]*([^?#]*)", 1)


def foreign_host(url: Column) -> Column:
    """True where the URL belongs to another site: such rows go to a reject table."""
    own = r"(?i)^https?://(?:[^/?#]*\." + SITE.replace(".", r"\.") + "|" + SITE.replace(".", r"\.") + r"|)(?:[/?#]|$)"
    return ~_with_scheme(url).rlike(own)


def _squeeze(path: Column) -> Column:
    return F.regexp_replace(path, "/+", "/")


def _guard(url: Column, value: Column) -> Column:
    return F.when(F.coalesce(url, F.lit("")) == "", F.lit("")).when(~foreign_host(url), value)


def canonical_profile(url: Column) -> Column:
    path = F.regexp_replace(_path(_with_scheme(url)), "/+$", "")
    # a path of one bare handle gets the profile prefix
    return _guard(url, F.concat(F.lit(SITE_ROOT), _squeeze(F.regexp_replace(path, r"^(/[a-zA-Z0-9_\-]+)$", "/in$1"))))


def _found(full: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(full, pattern, 1), F.lit(""))


def profile_handle(url: Column) -> Column:
    full = _with_scheme(url)
    named = _found(full, r"(?i)^https?://[^/?#]*[^?#]*?/in/+([^/?#]+)")
    bare = _found(full, r"^https?://[^/?#]*/([a-zA-Z0-9_\-]+)/*(?:[?#]|$)")
    return F.when(~foreign_host(url), F.lower(F.coalesce(named, bare)))


def _job(full: Column) -> Column:
    return F.coalesce(_found(full, r"^https?://[^/?#]*[^?#]*?" + JOB_PATH), _found(full, r"\?[^#]*" + JOB_QUERY))


def _rest(full: Column) -> Column:
    return _squeeze(F.regexp_replace(_path(full), "/+$", ""))


def canonical_job(url: Column) -> Column:
    full = _with_scheme(url)
    return _guard(url, F.concat(F.lit(SITE_ROOT), F.coalesce(
        F.concat(F.lit("/jobs/view/"), _job(full), F.lit("/")), _rest(full))))


def job_id(url: Column) -> Column:
    return F.when(~foreign_host(url), _job(_with_scheme(url)))


def _company(full: Column) -> Column:
    return _found(full, r"^https?://[^/?#]*[^?#]*?" + COMPANY_PATH)


def canonical_company(url: Column) -> Column:
    full = _with_scheme(url)
    # a path of one bare name gets the company prefix
    rest = F.regexp_replace(_rest(full), r"^(/[a-zA-Z0-9_\-]+)$", "/company$1")
    return _guard(url, F.concat(F.lit(SITE_ROOT), F.coalesce(
        F.concat(F.lit("/company/"), _company(full), F.lit("/")), rest)))


def company_slug(url: Column) -> Column:
    full = _with_scheme(url)
    bare = _found(full, r"^https?://[^/?#]*/+([a-zA-Z0-9_\-]+)/*(?:[?#]|$)")
    return F.when(~foreign_host(url), F.lower(F.coalesce(_company(full), bare)))


def activity_id(text: Column) -> Column:
    return _found(text, ACTIVITY_ID)


def canonical_post(url: Column) -> Column:
    full = _with_scheme(url)
    return _guard(url, F.concat(F.lit(SITE_ROOT), F.coalesce(
        F.concat(F.lit("/feed/update/urn:li:activity:"), activity_id(full), F.lit("/")), _rest(full))))


def post_id(url: Column) -> Column:
    return F.when(~foreign_host(url), activity_id(_with_scheme(url)))


def block_reason(url: Column, title: Column) -> Column:
    """Why a fetched page is not content: its path, or its title, asks for a login or a check."""
    path = _path(F.coalesce(url, F.lit("")))
    return (F.when(path.rlike(BLOCK_PATH), F.concat(F.lit("blocked page: "), path))
            .when(title.rlike(BLOCK_TITLE) & ~F.contains(path, F.lit("/mynetwork/")),
                  F.concat(F.lit("blocked page title: "), F.substring(title, 1, 60))))


def host_of(url: Column) -> Column:
    return _host(url)
