"""Token counts of texts, kept by content: what was counted once is never encoded again.

The cache is a Parquet table (content, tokenizer, n_tokens): digests of the normalised text and of the tokenizer's file,
kind and library version. A count joins the digests of all texts to it, encodes one text of each digest that misses, and
appends those. Normalising only makes null an empty text: any further change could change a count.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolex.llm.bpe import read_file
from cartolex.llm.common import pieces, shared_folder, ship

CACHE = "content binary, tokenizer string, n_tokens long"
CHUNK = 1 << 20

_loaded: dict[str, object] = {}


def version_of(path: str, content: bytes) -> str:
    """Digest of a tokenizer: another file, kind or library release has other counts."""
    import sentencepiece
    import tokenizers

    kind = "sentencepiece" if path.endswith(".model") else "tokenizers"
    release = sentencepiece.__version__ if kind == "sentencepiece" else tokenizers.__version__
    return hashlib.sha256(b"\0".join([kind.encode(), release.encode(), content])).hexdigest()


def counter(version: str, kind: str, content: bytes):
    """A function from texts to counts, built once in each worker."""
    if version not in _loaded:
        if kind == "model":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=content)
            _loaded[version] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_str(content.decode())
            own.no_truncation()
            own.no_padding()
            _loaded[version] = lambda texts: [len(x.ids) for x in own.encode_batch(texts, add_special_tokens=False)]
    return _loaded[version]


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer; a cache that does not exist yet is empty."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "content binary, n_tokens long")
    known = spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == version)
    # Two runs at a time may have appended one content twice.
    return known.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(documents: DataFrame, path: str, cache: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of each row's whole text, as the tokenizer's library counts.

    No begin, end or added special tokens, no truncation. Null text is empty; rows that share an id are counted by their
    own texts, repeated rows come back as often as they are there, and a null id is kept, also beside others. An empty table
    gives no rows. Other columns are not read, whatever their names. ``cache`` is a folder that all executors reach; without
    one, the counts are kept for this run only. Building the result appends the misses, so a later call with the same cache
    encodes only new texts.
    """
    spark = documents.sparkSession
    ship(spark)
    content = read_file(path)
    version, kind = version_of(path, content), "model" if path.endswith(".model") else "json"
    held = spark.sparkContext.broadcast(content)
    cache = cache or shared_folder(spark, "token-counts")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    docs = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), body.alias("text"))
    # Without an id, rows are told apart by content alone.
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("row"), "text", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("content"))
    slim = docs.select("doc_id", "row", "content", F.octet_length("text").cast("long").alias("n_bytes"))

    def task(batches):
        count = counter(version, kind, held.value)
        for part in pieces(batches, "text", CHUNK):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count(part.column(1).to_pylist()), pa.int64())], ["content", "n_tokens"])

    chosen = slim.groupBy("content").agg(F.min("row").alias("row"))
    chosen = chosen.join(read_cache(spark, cache, version), "content", "left_anti")
    misses = docs.select("row", "content", "text").join(chosen.hint("shuffle_hash"), ["row", "content"], "left_semi").select("content", "text")
    counted = misses.mapInArrow(task, "content binary, n_tokens long").groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    counted.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    return slim.join(read_cache(spark, cache, version), "content").select("doc_id", "n_bytes", "n_tokens")
