"""Queries over the evidence of shelf cards: candidates, model answers, annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grammar
from ..operators import evidence, normalize
from ..operators.tree import sorted_join
from .common import registry, table
from .shelves import SHELF_SQL, shelf_nodes

QUERIES, ORACLE_SQL, query = registry()


@query(
    "card_candidates",
    f"""WITH {SHELF_SQL}, c AS (
      SELECT page_id, b AS card, unnest([b, b + 3, b + 4]) AS node, 'p' AS kind, 0 AS i, cents::DOUBLE AS cents, NULL::DOUBLE AS value, NULL::INTEGER AS packs FROM p
      UNION ALL SELECT page_id, b, unnest([b, b + 3, b + 5]), 'p', CASE WHEN node_is_last THEN 0 ELSE 1 END, more, NULL, NULL FROM (SELECT *, CASE form WHEN 0 THEN p_size + 100 ELSE cents + 250 END AS more, false AS node_is_last FROM p WHERE form < 2)
      UNION ALL SELECT page_id, b, unnest([b, b + 1]), 'q', 0, NULL, p_size, NULL FROM p
      UNION ALL SELECT page_id, b, unnest([b, b + 3, b + 5]), 'u', 0, p_size + 100, NULL, NULL FROM p WHERE form = 0
      UNION ALL SELECT page_id, b, unnest([b, b + 3]), 'u', 0, cents, NULL, NULL FROM p WHERE form = 2
      UNION ALL SELECT page_id, b, b, 'u', 1, cents, NULL, NULL FROM p WHERE form = 2
      UNION ALL SELECT page_id, b, unnest([b, b + 3]), 'k', 0, NULL, NULL, CASE WHEN cents % 100 > 1 THEN cents % 100 ELSE 4 END FROM p WHERE form = 3
      UNION ALL SELECT page_id, b, b + 5, 'k', 0, NULL, NULL, 4 FROM p WHERE form = 3)
    SELECT page_id, card, concat('n', node, '@', kind, CASE WHEN kind = 'p' AND (node - 2) % 8 = 5 THEN 0 ELSE i END) AS id, cents, value, packs FROM c""",
)
def card_candidates(spark, sf_dir):
    """What each card offers as evidence, rates split over two nodes included."""
    n = shelf_nodes(spark, sf_dir)
    cards = n.where("node % 8 = 2").select("page_id", F.col("node").alias("card"))
    return evidence.candidates(n, cards).select("page_id", "card", "id", "cents", "value", "packs")


def answers(spark, sf_dir):
    """A model's answer for each part: right ones, and wrong in one way by key."""
    p, v = table(spark, sf_dir, "part"), F.col("p_partkey") % 8
    b, other = F.expr("2 + 8 * (p_partkey % 8)"), F.expr("2 + 8 * ((p_partkey + 1) % 8)")
    name = lambda x, more="": F.concat(F.lit("n"), x.cast("string"), F.lit(more))
    title = F.when(v == 4, "n9999").when(v == 5, name(other + 1)).otherwise(name(b + 1))
    price = F.when(v == 1, name(b + 4, "@p7")).when(v == 2, name(other + 4, "@p0")).when(v == 3, name(b + 1, "@q0")).when(v != 6, name(b + 4, "@p0"))
    native = F.when(v == 7, F.when(F.col("p_partkey") % 5 == 2, name(b, "@u1")).otherwise(name(b + 5, "@u0")))
    pack = F.when((v == 0) & (F.col("p_partkey") % 5 == 3), name(b + 5, "@k0"))
    status = F.when(v == 6, "insufficient-evidence").otherwise("comparable")
    quantity = F.when(v != 6, name(b + 1, "@q0"))
    values = dict(zip(grammar.KINDS, (price, native, quantity, pack), strict=True))
    return p.select(F.col("p_partkey").alias("answer_id"), F.expr("p_partkey div 8").alias("page_id"), grammar.serialize_pointer(name(b), F.array(title), values, status).alias("answer"))


@query(
    "pointer_resolution",
    f"""WITH {SHELF_SQL}, a AS (SELECT *, p_partkey % 8 AS v, 2 + 8 * ((p_partkey + 1) % 8) AS other FROM p),
    i AS (SELECT *, CASE v WHEN 1 THEN 'CURRENT_PRICE:unknown-candidate' WHEN 2 THEN CASE WHEN EXISTS (SELECT 1 FROM n WHERE n.page_id = a.page_id AND n.node = other + 4) THEN 'CURRENT_PRICE:evidence-outside-card' ELSE 'CURRENT_PRICE:unknown-candidate' END
        WHEN 3 THEN 'CURRENT_PRICE:candidate-kind-mismatch' WHEN 4 THEN 'TITLE:unknown-node' WHEN 5 THEN CASE WHEN EXISTS (SELECT 1 FROM n WHERE n.page_id = a.page_id AND n.node = other + 1) THEN 'TITLE:evidence-outside-card' ELSE 'TITLE:unknown-node' END
        WHEN 7 THEN CASE WHEN form IN (0, 2) THEN '' ELSE 'NATIVE_UNIT_PRICE:unknown-candidate' END ELSE '' END AS issues FROM a)
    SELECT p_partkey AS answer_id, CASE WHEN issues <> '' THEN 'invalid' WHEN v = 6 THEN 'abstained' ELSE 'comparable' END AS state, issues,
      CASE WHEN issues = '' THEN p_name || ', ' || p_size || CASE p_partkey % 4 WHEN 3 THEN ' ct' ELSE ' oz' END END AS title, CASE WHEN issues = '' AND v <> 6 THEN cents END AS cents,
      CASE WHEN issues = '' AND v = 7 THEN CASE form WHEN 0 THEN (p_size + 100)::DOUBLE ELSE cents::DOUBLE END END AS rate, CASE WHEN issues = '' AND v = 7 THEN CASE form WHEN 0 THEN 'oz' ELSE 'sq_ft' END END AS rate_unit,
      CASE WHEN issues = '' AND v = 7 THEN CASE form WHEN 0 THEN 1 ELSE 2 END END AS cited, CASE WHEN issues = '' AND v <> 6 THEN p_size::DOUBLE END AS value, CASE WHEN issues = '' AND v <> 6 THEN CASE WHEN v = 0 AND form = 3 THEN 4 ELSE 1 END END AS packs FROM i""",
)
def pointer_resolution(spark, sf_dir):
    """Answers of a model as products, or the reason that they are none."""
    found = evidence.resolve_pointers(answers(spark, sf_dir), shelf_nodes(spark, sf_dir))
    return found.select(
        "answer_id", "state", F.array_join("issues", ",").alias("issues"), "title", "cents", F.col("native.cents").alias("rate"), F.col("native.unit").alias("rate_unit"),
        F.when(F.col("native").isNotNull(), F.size("native.evidence")).alias("cited"), F.col("quantity.value").alias("value"), "packs",
    )


@query(
    "preannotation",
    f"""WITH {SHELF_SQL}
    SELECT page_id, b AS card, CASE WHEN form IN (0, 2) THEN 'native-unit-price' ELSE 'price-and-package' END AS method, p_name || ', ' || p_size || CASE p_partkey % 4 WHEN 3 THEN ' ct' ELSE ' oz' END AS title,
      CASE WHEN form NOT IN (0, 2) THEN cents END AS cents, CASE form WHEN 0 THEN (p_size + 100)::DOUBLE WHEN 2 THEN cents::DOUBLE END AS rate, CASE form WHEN 0 THEN 'oz' WHEN 2 THEN 'sq_ft' END AS rate_unit,
      CASE WHEN form = 2 OR (form = 0 AND p_partkey % 4 = 3) THEN NULL ELSE p_size::DOUBLE END AS value, NULL AS abstain_reason, 0 AS issues FROM p
    UNION ALL SELECT page_id, b + 3, 'explicit-abstention', {"concat('$', cents // 100, '.', lpad((cents % 100)::VARCHAR, 2, '0'))"}, NULL, NULL, NULL, NULL, 'not-a-product', 0 FROM p WHERE form = 4""",
)
def preannotation(spark, sf_dir):
    """What cards say without a model; the bare price boxes are no products."""
    n = shelf_nodes(spark, sf_dir)
    cards = table(spark, sf_dir, "part").select(F.expr("p_partkey div 8").alias("page_id"), F.expr("cast(2 + 8 * (p_partkey % 8) as int)").alias("card"), F.expr("p_partkey % 5").alias("form"))
    bare = cards.where("form = 4").select("page_id", (F.col("card") + 3).alias("card"), F.lit(None).cast("string").alias("dimension"))
    asked = cards.select("page_id", "card", F.when(F.col("form") == 2, "area").alias("dimension")).unionByName(bare)
    found = evidence.annotate(n, asked)
    return found.select(
        "page_id", "card", "method", "title", F.col("price.cents").alias("cents"), F.col("native.cents").alias("rate"), F.col("native.unit").alias("rate_unit"),
        F.col("quantity.value").alias("value"), "abstain_reason", F.size("issues").alias("issues"),
    )


@query(
    "pointer_selections",
    f"""WITH {SHELF_SQL}, a AS (SELECT *, p_partkey % 8 AS v FROM p)
    SELECT p_partkey AS answer_id, CASE WHEN v = 6 THEN 'T01 P-- U-- Q-- K-- SE' ELSE 'T01 P' || CASE form WHEN 0 THEN '08' WHEN 1 THEN '06' WHEN 2 THEN '07' WHEN 3 THEN '06' ELSE '04' END
      || ' U' || CASE WHEN v <> 7 THEN '--' WHEN form = 0 THEN '0A' ELSE '02' END || ' Q' || CASE form WHEN 0 THEN '04' WHEN 1 THEN '03' WHEN 2 THEN '04' WHEN 3 THEN '03' ELSE '02' END || ' K' || CASE WHEN v = 0 AND form = 3 THEN '07' ELSE '--' END || ' SC' END AS selection,
      true AS same FROM a WHERE v IN (0, 6) OR (v = 7 AND form IN (0, 2))""",
)
def pointer_selections(spark, sf_dir):
    """Answers that resolve as 22 characters, and back."""
    n, a = shelf_nodes(spark, sf_dir), answers(spark, sf_dir)
    told = normalize.checkpointed(evidence.pointers_to_selections(a, n))
    back = evidence.selections_to_pointers(told, n).select("answer_id", F.col("answer").alias("back"))
    rows = sorted_join(sorted_join(told, back, "answer_id"), a.select("answer_id", "answer"), "answer_id")
    return rows.select("answer_id", "selection", (F.col("back") == F.col("answer")).alias("same"))
