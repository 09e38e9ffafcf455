"""Registered queries in which every rule fires: checks (V1–V4, V6), e-mail
rules (C10, E1, E5), the null policy (C15) and merged details (D13, C2, C3, C5).

Values are built from the customers' keys, one variant per remainder, so the
DuckDB twins state the expected result per remainder without any pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.functions import text as T
from placeweave.operators import emails as E
from placeweave.operators import relational as R
from placeweave.plans import quality as V
from placeweave.plans.q_captured import _pick, _text, key
from placeweave.plans.registry import register
from placeweave.sources.tables import load



def null() -> Column:
    return F.lit(None).cast("string")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@register("business_checks", """
SELECT c_custkey AS row_id, 'placeId' AS field, CASE c_custkey % 6 WHEN 4 THEN 'ChIJ' || c_custkey || '?x' END AS value
FROM customer WHERE c_custkey % 6 >= 4
UNION ALL SELECT c_custkey, 'address', CASE c_custkey % 4 WHEN 1 THEN '4.5 (1,200)' ELSE '4.9(200)' END FROM customer WHERE c_custkey % 4 IN (1, 2)
UNION ALL SELECT c_custkey, 'phone', '200-400' FROM customer WHERE c_custkey % 3 = 0
""")
def business_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6 over V1–V3: each failed check of each business.  Ids are well-formed
    for four remainders of six, carry a ``?`` or are missing for the others."""
    rows = _customers(spark, sf_dir).select(
        key().alias("row_id"),
        _pick(key() % 6, _text("ChIJ", key()), _text("hex_0x", key()), _text("generated_", key()), _text("fallback_", key()),
              _text("ChIJ", key(), "?x"), null()).alias("placeId"),
        _pick(key() % 4, _text(key(), " Main St"), F.lit("4.5 (1,200)"), F.lit("4.9(200)"), null()).alias("address"),
        _pick(key() % 3, F.lit("200-400"), F.lit("+886 2 2345 6789"), null()).alias("phone"))
    return V.violations(rows, "row_id")


@register("group_size_checks", """
SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey
HAVING count(*) < (SELECT count(*) // 25 FROM customer) OR count(*) > (SELECT count(*) // 25 * 11 // 10 FROM customer)
""")
def group_size_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: nations with fewer customers than a 25th, or over a tenth more."""
    cust = _customers(spark, sf_dir)
    share = F.floor(cust.agg(F.count(F.lit(1))).scalar() / 25)
    return V.check_counts(cust, "c_nationkey", share, F.floor(share * 11 / 10))


@register("email_rules", """
SELECT c_custkey,
       CASE c_custkey % 9 WHEN 8 THEN FALSE WHEN 5 THEN FALSE WHEN 7 THEN FALSE ELSE TRUE END AS is_email,
       CASE c_custkey % 9 WHEN 0 THEN 'a' || c_custkey || '@shop.tw' END AS kept,
       coalesce(c_custkey % 4 = 0, FALSE) AS eligible
FROM customer
""")
def email_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10, E5 with each of its rules, E1 with each of its reasons."""
    rows = _customers(spark, sf_dir).select(
        "c_custkey",
        _pick(key() % 9, _text("a", key(), "@shop.tw"), F.lit("x@Example.com"), F.lit("x@o1.sentry.io"), F.lit("No-Reply@shop.tw"),
              F.lit("noreply@a.tw"), F.lit("bad@shape"), F.lit("x@mail.wixpress.com"), F.lit("a b@c.tw"), null()).alias("email"),
        _pick(key() % 4, F.lit("https://a.tw"), F.lit(""), F.lit("https://maps.google.com/x"), null()).alias("website"))
    ok = E.eligible_websites(rows).select(F.col("c_custkey").alias("ok"))
    kept = F.try_element_at(E.filter_emails_expr(F.filter(F.array("email"), lambda e: e.isNotNull())), F.lit(1))
    return (rows.join(ok, F.col("c_custkey") == F.col("ok"), "left")
            .select("c_custkey", T.is_email("email").alias("is_email"), kept.alias("kept"), F.col("ok").isNotNull().alias("eligible")))


@register("null_policy", """
SELECT c_custkey, '' AS type, '' AS price, '' AS hours, '' AS address, '' AS name, '' AS phone, '' AS compact, '' AS website,
       FALSE AS is_email, 0 AS n_emails, CAST(0 AS DOUBLE) AS rating, CAST(0 AS BIGINT) AS reviews, '' AS strict
FROM customer
""")
def null_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every rule makes of NULL (even keys) and of '' (odd keys)."""
    v = F.col("v")
    return _customers(spark, sf_dir).select("c_custkey", F.when(key() % 2 == 1, F.lit("")).alias("v")).select(
        "c_custkey", T.standard_type(v).alias("type"), T.standard_price(v).alias("price"), T.standard_hours(v).alias("hours"),
        T.standard_address(v).alias("address"), T.standard_name(v).alias("name"), T.standard_phone(v).alias("phone"),
        T.compact_address(v).alias("compact"), T.standard_website(v).alias("website"), T.is_email(v).alias("is_email"),
        F.size(T.extract_emails(v)).alias("n_emails"), T.standard_rating(v).alias("rating"),
        T.standard_reviews(v).alias("reviews"), T.strict_type(v).alias("strict"))


@register("merged_details", """
SELECT c_custkey AS placeId,
       CASE c_custkey % 6 WHEN 0 THEN '$$' WHEN 1 THEN '¥¥' WHEN 2 THEN '' ELSE '$' END AS priceLevel,
       CASE c_custkey % 5 WHEN 0 THEN 'Tea house' WHEN 1 THEN '' ELSE c_mktsegment END AS businessType,
       CASE c_custkey % 4 WHEN 0 THEN c_custkey || ' Long Road' WHEN 1 THEN '' ELSE 'old' END AS address
FROM customer
""")
def merged_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detail value replaces the listing's only when it is not empty,
    and passes C3, C2 or C5 after that test.  Keys that leave
    4 or 5 by 6 get NULL prices."""
    cust = _customers(spark, sf_dir)
    listing = cust.select(key().alias("placeId"), F.lit("$").alias("priceLevel"), F.col("c_mktsegment").alias("businessType"),
                          F.lit("old").alias("address"))
    detail = cust.select(
        key().alias("placeId"),
        _pick(key() % 6, F.lit("moderately priced"), F.lit("about ¥¥"), F.lit("free"), F.lit(""), null()).alias("priceLevel"),
        _pick(key() % 5, F.lit(" Tea  house "), F.lit("4.9(200)"), F.lit(""), null()).alias("businessType"),
        _pick(key() % 4, _text(key(), " Long Road Opens 9 AM"), F.lit("abc"), F.lit(""), null()).alias("address"))
    return R.merge_details(listing, detail, fields=("priceLevel", "businessType", "address"))
