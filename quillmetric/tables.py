"""Typed views over the driver tables.

A ``View`` states its columns once. Where Spark and the checking database spell an expression
differently, the column holds a (spark, check) pair; everything else is shared text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Expr = str | tuple[str, str]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


@dataclass(frozen=True)
class View:
    name: str
    source: str
    columns: dict[str, Expr]
    where: str | None = None

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, self.source)
        if self.where:
            df = df.filter(self.where)
        return df.selectExpr(*[f"{e if isinstance(e, str) else e[0]} AS {c}" for c, e in self.columns.items()])

    @property
    def sql(self) -> str:
        body = ", ".join(f"{e if isinstance(e, str) else e[1]} AS {c}" for c, e in self.columns.items())
        tail = f" WHERE {self.where}" if self.where else ""
        return f"{self.name} AS (SELECT {body} FROM {self.source}{tail})"


K: Expr = ("CAST(get_json_object(props, '$.k') AS BIGINT)", "CAST(json_extract_string(props, '$.k') AS BIGINT)")
DAY: Expr = ("date_format(ts, 'yyyy-MM-dd')", "strftime(ts, '%Y-%m-%d')")

POSTS = View("posts", "events", {
    "event_id": "event_id",
    "handle": "'u' || user_id",
    "platform": "CASE event_type WHEN 'click' THEN 'x' WHEN 'view' THEN 'youtube' "
                "WHEN 'purchase' THEN 'linkedin' ELSE 'other' END",
    "likes": "CAST(floor(value) AS BIGINT)",
    "k": K,
    "post_date": (f"CASE WHEN event_id % 97 = 0 THEN NULL ELSE {DAY[0]} END",
                  f"CASE WHEN event_id % 97 = 0 THEN NULL ELSE {DAY[1]} END"),
}, where="event_type <> 'error'")

# Run instant of the text-post view: 2024-06-01 00:00:00 UTC in milliseconds.
NOW_MILLIS = 1717200000000
RUN_DATE = "2024-06-01"

TEXT_POSTS = View("text_posts", "documents", {
    "doc_id": "doc_id",
    "post_id": ("CAST((1717200000000 - (doc_id % 500) * 1800000) * 4194304 + doc_id % 4194304 AS STRING)",
                "CAST((1717200000000 - (doc_id % 500) * 1800000) * 4194304 + doc_id % 4194304 AS VARCHAR)"),
    "author_name": "source",
    "author_type": "CASE WHEN source IN ('src0', 'src5', 'src10', 'src15') THEN 'company' ELSE 'person' END",
    "author_id": "CASE WHEN source IN ('src0', 'src5', 'src10', 'src15') THEN source ELSE 'urn:li:member:' || source END",
    "text": "text",
    "lang": "lang",
    "like_count": "CAST(n_chars % 211 AS BIGINT)",
    "comment_count": "CAST(n_chars % 97 AS BIGINT)",
    "repost_count": "CAST(n_chars % 13 AS BIGINT)",
})

CONTACTS = View("contacts", "customer", {
    "contact_id": "c_custkey",
    "name": "c_name",
    "author_alias": "'SRC' || (c_custkey % 40)",
    "org": "'Org ' || (c_custkey % 700) || CASE WHEN c_custkey % 3 = 0 THEN ' Inc.' "
           "WHEN c_custkey % 3 = 1 THEN ' / Circle ' || c_nationkey ELSE ' (labs)' END",
    "org_base": "'org ' || (c_custkey % 700)",
    "company": "'Org ' || (c_custkey % 700)",
    "degree": "CASE c_custkey % 4 WHEN 0 THEN '1st' WHEN 1 THEN '2nd' WHEN 2 THEN '3rd' ELSE 'unknown' END",
    "relationship": "CASE c_custkey % 4 WHEN 0 THEN '1st degree, team lead' "
                    "WHEN 1 THEN '2nd; mutuals: Ann Lee, Bo Chu (x), +3 more' "
                    "WHEN 2 THEN 'third, met once' ELSE '' END",
    "mutual_count": "CAST(CASE WHEN c_custkey % 4 = 1 THEN 2 ELSE 0 END AS INT)",
    "focus": "CASE c_custkey % 5 WHEN 0 THEN 'VP data' WHEN 1 THEN 'recruiting' "
             "WHEN 2 THEN 'infrastructure' WHEN 3 THEN 'talent search' ELSE '' END",
    "status": "CASE c_custkey % 9 WHEN 0 THEN 'not sent yet' WHEN 1 THEN 'sent' WHEN 2 THEN 'drafted note' "
              "WHEN 3 THEN 'Replied, call booked' WHEN 4 THEN 'closed' WHEN 5 THEN 'messaged; nudge 1' "
              "WHEN 6 THEN 'messaged May 13, 2024' WHEN 7 THEN 'sent, touch 3' ELSE '' END",
    "next_action": "CASE WHEN c_custkey % 2 = 0 THEN 'write back' ELSE 'TBD' END",
    "touch_date": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE DATE '2024-06-01' - CAST(c_custkey % 41 AS INT) END",
    "tier": "CASE c_custkey % 5 WHEN 0 THEN 'WARM' WHEN 1 THEN 'BRIDGE' WHEN 2 THEN 'COLD' "
            "WHEN 3 THEN 'FROZEN' ELSE NULL END",
    "segment": "c_mktsegment",
    "nation_key": "c_nationkey",
    "balance": "c_acctbal",
})

STAGES = View("stages", "orders", {
    "row_id": "o_orderkey",
    "company": "'Org ' || (o_custkey % 900) || CASE WHEN o_orderkey % 2 = 0 THEN ', LLC' ELSE '' END",
    "company_base": "'org ' || (o_custkey % 900)",
    "role": "CASE o_orderpriority WHEN '1-URGENT' THEN 'Growth Engineer (remote)' "
            "WHEN '2-HIGH' THEN 'growth engineer' WHEN '3-MEDIUM' THEN 'Web Lead' ELSE 'Data Lead' END",
    "status": "CASE o_orderkey % 11 WHEN 0 THEN 'Interviewing (2)' WHEN 1 THEN 'applied' WHEN 2 THEN 'Networking' "
              "WHEN 3 THEN 'Drafting' WHEN 4 THEN 'ready' WHEN 5 THEN 'researching' ELSE 'Rejected' END",
    "state": "CASE o_orderkey % 11 WHEN 0 THEN 'interviewing' WHEN 1 THEN 'applied' WHEN 2 THEN 'networking' "
             "WHEN 3 THEN 'drafting' WHEN 4 THEN 'ready' WHEN 5 THEN 'researching' ELSE 'rejected' END",
    "score": "CASE WHEN o_orderkey % 3 = 0 THEN '' "
             "ELSE (o_orderkey % 40 + 20) || '–' || (o_orderkey % 40 + 41) END",
    "follow_up": "CAST(o_orderdate AS DATE) + CAST(8500 AS INT)",
    "next_action": "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'ping owner' END",
    "source": "o_orderpriority",
    "segment": "o_orderstatus",
})

LEDGER = View("ledger", "events", {
    "event_id": "event_id",
    "session_id": "user_id",
    "ts": "ts",
    "category": "event_type",
    "failed": "event_type IN ('error', 'signup')",
    "value": "value",
    "k": K,
})


def with_sql(*views: View) -> str:
    """WITH clause of the check SQL for these views."""
    return "WITH " + ", ".join(v.sql for v in views)
