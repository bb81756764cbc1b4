"""Text operators on whole documents and on texts derived from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import query, table
from bindings.shared import case, norm
from cartolex.functions.attributes import (
    find_notes,
    find_process,
    find_roast,
    find_varieties,
    is_decaf_text,
    is_target_product,
    parse_process,
    parse_roast,
    parse_size_grams,
)
from cartolex.functions.text import normalize_text, normalize_variety, singularize, words_of
from cartolex.operators.keep import cap_per_group, keep_first
from cartolex.operators.lexicon import gazetteer_scan, lexicon_map, unmapped_texts
from cartolex.sources.dims import as_lexicon

_WORDS = f"list_filter(string_split({norm('text')}, ' '), lambda w: w <> '')"


@query(
    "normalize_key",
    f"""
SELECT sha256(key) AS key_hash, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang
FROM (SELECT doc_id, lang, {norm('text')} AS key FROM documents) GROUP BY key""",
)
def keys(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", F.sha2(normalize_text(F.col("text")), 256).alias("key_hash"))
    return keep_first(docs, ["key_hash"], ["doc_id"])


@query(
    "singular_words",
    f"""
WITH w AS (SELECT DISTINCT unnest({_WORDS}) AS word FROM documents)
SELECT word, CASE WHEN word LIKE '%ies' AND length(word) > 4 THEN word[:-4] || 'y'
  WHEN regexp_matches(word, '(ch|sh|x|ss)es$') THEN word[:-3]
  WHEN word LIKE '%oes' AND length(word) > 4 THEN word[:-3]
  WHEN word LIKE '%s' AND word NOT LIKE '%ss' AND length(word) > 3 THEN word[:-2] ELSE word END AS singular FROM w""",
)
def singulars(spark, folder):
    words = table(spark, folder, "documents").select(F.explode(words_of(normalize_text(F.col("text")))).alias("word"))
    return words.distinct().select("word", singularize(F.col("word")).alias("singular"))


LEXICON = [("of the", "A"), ("the", "B"), ("que", "C"), ("der", "D"), ("and", "E")]
# At each word: is it "of" with "the" next; the pair uses up both words.
_LEXICON_SQL = f"""
w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
t AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
n AS (SELECT *, lag(word) OVER d AS before FROM t WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
hits AS (
  SELECT doc_id, 2 AS size, pos - 1 AS pos, 'A' AS value FROM n WHERE word IN ('the', 'thes') AND before = 'of'
  UNION ALL SELECT doc_id, 1, pos, 'B' FROM n WHERE word IN ('the', 'thes') AND before IS DISTINCT FROM 'of'
  UNION ALL SELECT doc_id, 1, pos, 'C' FROM n WHERE word IN ('que', 'ques')
  UNION ALL SELECT doc_id, 1, pos, 'D' FROM n WHERE word IN ('der', 'ders')
  UNION ALL SELECT doc_id, 1, pos, 'E' FROM n WHERE word IN ('and', 'ands')),
firsts AS (SELECT doc_id, value, min(-size * 1000000 + pos) AS place FROM hits GROUP BY 1, 2)"""


def _lexicon(spark):
    return as_lexicon(spark.createDataFrame(LEXICON, "phrase string, value string"))


@query(
    "lexicon_map",
    f"WITH {_LEXICON_SQL} SELECT doc_id, string_agg(value, '|' ORDER BY place) AS found FROM firsts GROUP BY 1",
)
def lexicon(spark, folder):
    found = lexicon_map(table(spark, folder, "documents"), "doc_id", F.col("text"), _lexicon(spark))
    return found.select("doc_id", F.array_join("values", "|").alias("found"))


@query(
    "lexicon_unmapped",
    f"WITH {_LEXICON_SQL} SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hits)",
)
def unmapped(spark, folder):
    docs = table(spark, folder, "documents")
    mapped = lexicon_map(docs, "doc_id", F.col("text"), _lexicon(spark))
    return unmapped_texts(docs, "doc_id", mapped).select("doc_id", "lang")


PLACES = [("of the", "A"), ("the", "B"), ("in that", "C"), ("that", "D"), ("de la", "E"), ("la", "F"), ("el", "G"), ("in that the", "H")]


@query(
    "gazetteer",
    f"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
t AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
n AS (SELECT *, lead(word) OVER d AS w2, lead(word, 2) OVER d AS w3 FROM t WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
hits AS (
  SELECT doc_id, 3 AS size, pos, 'H' AS value FROM n WHERE word = 'in' AND w2 = 'that' AND w3 = 'the'
  UNION ALL SELECT doc_id, 2, pos, 'A' FROM n WHERE word = 'of' AND w2 = 'the'
  UNION ALL SELECT doc_id, 2, pos, 'C' FROM n WHERE word = 'in' AND w2 = 'that'
  UNION ALL SELECT doc_id, 2, pos, 'E' FROM n WHERE word = 'de' AND w2 = 'la'
  UNION ALL SELECT doc_id, 1, pos, 'B' FROM n WHERE word = 'the'
  UNION ALL SELECT doc_id, 1, pos, 'D' FROM n WHERE word = 'that'),
firsts AS (SELECT doc_id, value, min(-size * 1000000 + pos) AS place FROM hits GROUP BY 1, 2)
SELECT doc_id, string_agg(value, '|' ORDER BY place) AS found FROM firsts GROUP BY 1""",
)
def gazetteer(spark, folder):
    places = as_lexicon(spark.createDataFrame(PLACES, "phrase string, value string"))
    found = gazetteer_scan(table(spark, folder, "documents"), "doc_id", F.col("text"), places)
    return found.select("doc_id", F.array_join("values", "|").alias("found"))


# Product text of a part: the wording depends on its type, brand and size.
ROAST_WORDS = {
    "ECONOMY": "Our light roast.",
    "SMALL": "Roast level: Medium-Light.",
    "MEDIUM": "A city favourite",
    "LARGE": "Roast: medium dark",
    "STANDARD": "French roasted",
    "PROMO": "Omni roast",
}
PROCESS_WORDS = {
    "Brand#1": "Process: Washed | slow",
    "Brand#2": "Processing method - carbonic maceration",
    "Brand#3": "natural process",
    "Brand#4": "honey sweetness",
    "Brand#5": "Process: unknown\nnatural process",
    "Brand#6": "wet hulled lot",
}
VARIETY_WORDS = {
    "Brand#7": "Pink Bourbon and Geisha",
    "Brand#8": "red bourbon, SL-28",
    "Brand#9": "Bourbon; Typica",
    "Brand#10": "sl 34 & SL28",
    "Brand#11": "Ruiru 11",
}
SIZE_WORDS = {"red": "12 oz", "blue": "340g", "hot": "2 lb bag", "cold": "1.5 kg", "new": "no weight"}


def _labelled(column, words):
    out = F
    for k, v in words.items():
        out = out.when(column == k, F.lit(v))
    return out.otherwise(F.lit(""))


def products(spark, folder):
    part = table(spark, folder, "part")
    text = F.concat_ws(
        "\n",
        "p_name",
        _labelled(F.col("p_type"), ROAST_WORDS),
        _labelled(F.col("p_brand"), PROCESS_WORDS),
        _labelled(F.col("p_brand"), VARIETY_WORDS),
        _labelled(F.split("p_name", " ")[0], SIZE_WORDS),
    )
    return part.withColumn("text", text)


@query(
    "attribute_tags",
    f"""
SELECT p_partkey,
  CASE p_type WHEN 'ECONOMY' THEN 'light' WHEN 'SMALL' THEN 'medium-light' WHEN 'LARGE' THEN 'medium-dark' WHEN 'PROMO' THEN 'omni' END AS roast,
  CASE p_brand WHEN 'Brand#1' THEN 'washed' WHEN 'Brand#2' THEN 'carbonic-maceration' WHEN 'Brand#3' THEN 'natural' WHEN 'Brand#6' THEN 'wet-hulled' END AS process,
  CASE p_type WHEN 'ECONOMY' THEN 'light' WHEN 'SMALL' THEN 'medium-light' WHEN 'MEDIUM' THEN 'medium' WHEN 'LARGE' THEN 'medium-dark' WHEN 'STANDARD' THEN 'dark' ELSE 'omni' END AS roast_word,
  CASE p_brand WHEN 'Brand#1' THEN 'washed' WHEN 'Brand#2' THEN 'carbonic-maceration' WHEN 'Brand#3' THEN 'natural' WHEN 'Brand#4' THEN 'honey' WHEN 'Brand#5' THEN 'natural' WHEN 'Brand#6' THEN 'wet-hulled' END AS process_word,
  CASE p_brand WHEN 'Brand#7' THEN 'gesha|pink bourbon' WHEN 'Brand#8' THEN 'red bourbon|sl28' WHEN 'Brand#9' THEN 'bourbon|typica' WHEN 'Brand#10' THEN 'sl28|sl34' WHEN 'Brand#11' THEN 'ruiru11' ELSE '' END AS varieties,
  CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 340 WHEN 'blue' THEN 340 WHEN 'hot' THEN 907 WHEN 'cold' THEN 1500 END AS grams
FROM part""",
)
def tags(spark, folder):
    t = F.col("text")
    return products(spark, folder).select(
        "p_partkey",
        find_roast(t).alias("roast"),
        find_process(t).alias("process"),
        parse_roast(_labelled(F.col("p_type"), ROAST_WORDS)).alias("roast_word"),
        parse_process(_labelled(F.col("p_brand"), PROCESS_WORDS)).alias("process_word"),
        F.array_join(find_varieties(t), "|").alias("varieties"),
        parse_size_grams(t).alias("grams"),
    )


@query(
    "product_filter",
    """
SELECT p_partkey, p_name, p_name NOT LIKE '%gear%' AND p_type <> 'PROMO' AND (p_type IN ('ECONOMY', 'LARGE') OR p_name LIKE 'red%') AS target FROM part""",
)
def product_filter(spark, folder):
    part = table(spark, folder, "part")
    title = F.when(F.col("p_name").startswith("red"), F.concat(F.lit("Peru "), "p_name")).otherwise(F.col("p_name"))
    kind = F.when(F.col("p_type") == "PROMO", F.lit("Matcha")).when(F.col("p_type") == "ECONOMY", F.lit("Coffee"))
    labels = F.array(F.when(F.col("p_type") == "LARGE", F.lit("Single-Origin")).otherwise(F.lit("misc")))
    return part.select("p_partkey", "p_name", is_target_product(title, kind, labels).alias("target"))


@query(
    "labelled_notes",
    """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE split_part(p_name, ' ', 1) || '|' || split_part(p_name, ' ', 2) || ' nut|' || lower(p_type) END AS notes,
       p_size > 40 AS decaf, lower(replace(p_brand, '#', ' ')) AS variety FROM part""",
)
def notes(spark, folder):
    part = table(spark, folder, "part")
    words = F.split("p_name", " ")
    listed = F.concat(words[0], F.lit(", "), words[1], F.lit(" nut & with AND "), F.lower("p_type"), F.lit("."))
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("no label "), listed)).otherwise(
        F.concat(F.lit("Great.\nTasting Notes: "), listed, F.lit("\nmore"))
    )
    wording = F.when(F.col("p_size") > 40, F.lit("Swiss Water treated")).otherwise(F.lit("plain"))
    return part.select(
        "p_partkey",
        F.array_join(find_notes(text), "|").alias("notes"),
        is_decaf_text(wording).alias("decaf"),
        normalize_variety(F.col("p_brand")).alias("variety"),
    )


@query(
    "cap_per_group",
    """
SELECT source, doc_id, n_chars FROM documents
QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 5""",
)
def capped(spark, folder):
    docs = table(spark, folder, "documents").select("source", "doc_id", "n_chars")
    return cap_per_group(docs, ["source"], [F.desc("n_chars"), F.col("doc_id")], 5)


# Flavour words for part names, looked up in the core note lexicon.
FLAVOUR_WORDS = {
    "widget": "Dark Chocolates",
    "gear": "strawberry jam",
    "bolt": "rose petals",
    "rod": "brown sugar",
    "ring": "dried figs",
    "plate": "black teas",
    "gizmo": "zzz",
    "anvil": "cedar",
}
FAMILY_OF = {
    "widget": "nutty-cocoa/cocoa",
    "gear": "fruity/berry",
    "bolt": "floral/floral",
    "rod": "sweet/brown-sugar",
    "ring": "fruity/dried-fruit",
    "plate": "floral/tea",
    "anvil": "other",
}


@query(
    "note_families",
    f"""
WITH p AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN 'spices|' ELSE '' END AS spice,
                  {case("split_part(p_name, ' ', 2)", FAMILY_OF)} AS family FROM part)
SELECT p_partkey, CASE WHEN family IS NULL THEN rtrim(spice, '|')
   WHEN family IN ('other', 'floral/floral') THEN spice || family
   ELSE family || CASE WHEN spice = '' THEN '' ELSE '|spices' END END AS families
FROM p WHERE family IS NOT NULL OR spice <> ''""",
)
def note_families(spark, folder):
    from cartolex.sources.dims import note_lexicon

    part = table(spark, folder, "part")
    word = _labelled(F.split("p_name", " ")[1], FLAVOUR_WORDS)
    text = F.when(F.col("p_size") > 25, F.concat(F.lit("Spicy "), word)).otherwise(word)
    found = lexicon_map(part, "p_partkey", text, note_lexicon(spark))
    return found.select("p_partkey", F.array_join("values", "|").alias("families"))
