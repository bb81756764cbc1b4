"""The operators bound to the test tables: one query for each, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolex.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op2_suffix_dedup")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    from cartolex.llm.suffix_dedup import remove_repeats

    out = remove_repeats(table(spark, folder, "documents"), length=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_byte_bpe")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers as public

    from cartolex.llm.bpe import WORDS, decode, encode

    path = public.path("byte_bpe_50k.tiktoken")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = decode(encode(docs, path, public.PATTERN, WORDS).drop("text"), path)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: Tokens of a model's context: longer documents are flagged.
TOKEN_LIMIT = 4096


@query("op7_token_counts")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers as public

    from cartolex.llm.token_counts import count_tokens

    out = count_tokens(table(spark, folder, "documents"), public.path("piece_bpe_32k.model"))
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query("op10_decontaminate")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    from cartolex.llm.decontaminate import find_leaks

    out = find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"), window=10)
    listed = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op3_near_dedup")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    from cartolex.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, folder, "documents"), words=4, percent=80)


@query("op4_personal_data")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    from cartolex.llm.personal_data import KINDS, find_personal_data

    out = find_personal_data(table(spark, folder, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    return out.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


@query("op1_warc")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    from cartolex.llm.common import shared_folder
    from cartolex.llm.warc import read_warc, write_warc

    archive = shared_folder(spark, "warc")
    write_warc(table(spark, folder, "pages"), archive)
    out = read_warc(spark, archive, payload=False)
    return out.select(F.col("record_key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Grades from 0 to 2; documents stay that are good with this chance.
GOOD, LEAST_CHANCE = 2, 0.6


@query("op5_quality")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    from cartolex.llm.quality import grades_of, score, train

    docs = table(spark, folder, "documents")
    model = train(docs, grades_of(table(spark, folder, "labels")))
    out = score(docs.select("doc_id", "text"), model, GOOD)
    return out.select("doc_id", "expected_grade", "chance", (F.col("chance") >= LEAST_CHANCE).alias("kept"))


@query(
    "op9_top_k",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q
      FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
    SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
    """,
)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    from cartolex.llm.top_k import top_k

    vectors = table(spark, folder, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20, scale=64)


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query("op8_url_filter")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    from cartolex.llm.url_filter import host_and_path, judge_urls

    pages = table(spark, folder, "pages").select("page_id", "url")
    # The number in a page's path is the document that it shows, and documents have labels.
    shown = F.expr("try_cast(regexp_extract(path, '/([0-9]+)', 1) AS bigint)")
    numbers = pages.select("page_id", host_and_path(F.col("url"))[1].alias("path")).select("page_id", shown.alias("doc_id"))
    labels = table(spark, folder, "labels").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    return judge_urls(pages, numbers.join(labels, "doc_id").select("page_id", "good"), RULES)


@query(
    "op13_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    from cartolex.llm.exact_dedup import duplicate_groups

    return duplicate_groups(table(spark, folder, "documents"))


@query(
    "op12_collocations",
    r"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, doc_id,
                 string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents),
    p AS (SELECT lang, regexp_extract_all(unnest(p), '[^\x20\x09]+') AS w FROM d),
    g AS (
      SELECT lang, k AS size, array_to_string(w[i : i + k - 1], ' ') AS phrase
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
    words AS (SELECT lang, count(*) AS n FROM g WHERE size = 1 GROUP BY 1),
    f AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 10),
    c AS (SELECT lang, phrase, size, f AS a, w, unnest(range(1, size)) AS k FROM f WHERE size > 1),
    s AS (
      SELECT c.lang, c.phrase, c.size, c.w, c.a, k, x.f AS l, y.f AS r, CAST(1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS BIGINT) AS score
      FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : k], ' ')
             JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1 : c.size], ' ')),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    o AS (
      SELECT lang, phrase, max(f) AS most
      FROM (SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM f WHERE size = 3) GROUP BY 1, 2),
    r AS (
      SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank, b.phrase, a, l, r, n, score
      FROM b JOIN words USING (lang) LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase
      WHERE most IS NULL OR 100 * most < 50 * a)
    SELECT * FROM r WHERE rank <= 2000
    """,
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    from cartolex.llm.collocations import collocations

    return collocations(table(spark, folder, "documents"), longest=3, least=10, covered=50, top=2000)


@query("op11_whitening")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    from cartolex.llm.whitening import whiten

    return whiten(table(spark, folder, "embeddings"), components=32, scale=64)
