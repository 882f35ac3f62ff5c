"""Token counts of texts of any length: huge ones are encoded in overlapping chunks, which are spliced where both agree.

A chunk begins within the one before it. Where a word (a match of the tokenizer's pattern, or a special string) begins in
both encodings, what follows is the same in both, as the pattern looks only ahead; so the earlier chunk's tokens count
before that place and the later one's from there on. Ends of a chunk are left out as far as text beyond them could change a
word's end. Where two chunks have no such place in common, as in a word longer than their overlap, the later one's overlap
is widened to all of the earlier chunk, which it replaces.
"""

from __future__ import annotations

import json
import os
import threading
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, as_long, as_text, limit_batches, met, own_dir

#: Characters of a chunk and of its overlap with the one before, bytes from which texts are huge, characters encoded at once.
CHUNK, OVERLAP, HUGE, AT_ONCE = 32_768, 512, 65_536, 1 << 20
#: Tokens of a document over the limit.
LIMIT = 512
#: Characters behind a word's end that decide about it, at most: a contraction of three, or a character behind white space.
AHEAD = 4
#: Digests whose texts are chosen by a broadcast; more by a shuffle.
FEW = 10_000

PLACES = pa.list_(pa.struct([("p", pa.int64()), ("c", pa.int64())]))
CHUNKS = pa.schema([("digest", pa.string()), ("no", pa.int64()), ("span", pa.int64()), ("begin", pa.int64()), ("last", pa.bool_()), ("text", pa.string())])
ENCODED = pa.schema([("digest", pa.string()), ("no", pa.int64()), ("span", pa.int64()), ("total", pa.int64()), ("left", PLACES), ("right", PLACES)])


class Counter:
    """A tokenizer of one worker, from the content of its file."""

    def __init__(self, kind: str, content: bytes):
        self.kind = kind
        if kind == ".model":
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer, processors

        self.model = Tokenizer.from_str(content.decode())
        self.model.no_truncation()
        self.model.no_padding()
        if spliceable(kind, content):
            self.model.post_processor = processors.ByteLevel(trim_offsets=False)

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text."""
        if self.kind == ".model":
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        return [len(x) for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, text: str) -> tuple[int, list[tuple[int, int]]]:
        """Number of tokens, and of each word its first character and the number of tokens before it."""
        e = self.model.encode(text, add_special_tokens=False)
        ids, offsets = e.word_ids, e.offsets
        return len(ids), [(offsets[k][0], k) for k in range(len(ids)) if not k or ids[k] != ids[k - 1]]


_LOCAL = threading.local()


def counter(kind: str, content: bytes) -> Counter:
    """The tokenizer of this Python worker, made once for a file."""
    key = (kind, hash(content))
    if getattr(_LOCAL, "key", None) != key:
        _LOCAL.counter, _LOCAL.key = Counter(kind, content), key
    return _LOCAL.counter


def spliceable(kind: str, content: bytes) -> bool:
    """Whether the tokenizer's words depend on nothing before them: byte-level with its own pattern, nothing normalised, special strings taken as they stand."""
    if kind != ".json":
        return False
    j = json.loads(content)
    pre = j.get("pre_tokenizer") or {}
    plain = not any(t[k] for t in j["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
    return j["model"]["type"] == "BPE" and not j["model"].get("dropout") and not j.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and plain


def margin(content: bytes) -> int:
    """Characters at a chunk's end in which no place counts: longer than any special string."""
    return AHEAD + max((len(t["content"]) for t in json.loads(content)["added_tokens"]), default=0)


def default_path() -> str:
    """The tokenizer that the query uses, in the tokenizers' folder."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Chunks of huge texts (digest, text, plan), equal ones once, dealt to as many tasks as there are.

    plan lists the chunks wanted, each by its first one and how many it spans; null stands for all of one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for digest, raw, plan in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                text = raw.decode("utf-8", "replace")
                for no, span in [(x["no"], x["span"]) for x in plan] if plan is not None else [(k, 1) for k in range(-(-len(text) // chunk))]:
                    begin, end = max(0, no * chunk - overlap), (no + span) * chunk
                    yield pa.RecordBatch.from_pylist([{"digest": digest, "no": no, "span": span, "begin": begin, "last": end >= len(text), "text": text[begin:end]}], schema=CHUNKS)

    rows = texts.mapInArrow(run, "digest string, no long, span long, begin long, last boolean, text string")
    return rows.groupBy("digest", "no", "span").agg(F.first(F.struct("begin", "last", "text")).alias("c")).select("digest", "no", "span", "c.*")


def encoded(chunks: DataFrame, told, chunk: int, overlap: int) -> DataFrame:
    """Of every chunk its number of tokens, and the places where words begin in its overlaps: p by character of the whole text, c tokens before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, content, away = told.value
        t = counter(kind, content)
        for b in batches:
            for r in b.to_pylist():
                total, words = t.words(r["text"])
                own, end = r["no"] * chunk, (r["no"] + r["span"]) * chunk
                places = [{"p": r["begin"] + p, "c": c} for p, c in words]
                left = [x for x in places if x["p"] < own] if r["no"] else []
                right = [x for x in places if end - overlap <= x["p"] <= end - away] if not r["last"] else []
                yield pa.RecordBatch.from_pylist([{"digest": r["digest"], "no": r["no"], "span": r["span"], "total": total, "left": left, "right": right}], schema=ENCODED)

    place = "array<struct<p: long, c: long>>"
    return chunks.mapInArrow(run, f"digest string, no long, span long, total long, left {place}, right {place}")


def spliced(texts: DataFrame, told, chunk: int, overlap: int) -> DataFrame:
    """digest and n_tokens of huge texts (digest, text); equal texts are one row.

    A text's chunks, some numbers each, meet in one task to be spliced; a text is one row, so they are as many as its length allows.
    """
    spark = texts.sparkSession
    path = own_dir(spark, "tokens")

    def written(df: DataFrame, k: int, what: str) -> DataFrame:
        df.write.parquet(f"{path}/{what}-{k}")
        return spark.read.parquet(f"{path}/{what}-{k}")

    none = F.lit(None).cast("array<struct<no: long, span: long>>")
    known = written(encoded(cut(texts.withColumn("plan", none), chunk, overlap), told, chunk, overlap), 0, "chunks")
    k = 0
    while True:
        w = Window.partitionBy("digest").orderBy("no")
        common = F.array_min(F.array_intersect(F.transform("right", lambda x: x["p"]), F.transform(F.lead("left").over(w), lambda x: x["p"])))
        pairs = known.withColumns({"at": common, "apart": common.isNull() & F.lead("no").over(w).isNotNull()})
        pairs = written(pairs, k, "pairs")
        apart = pairs.where("apart").select("digest").distinct()
        n = apart.count()
        if not n:
            break
        # Runs of chunks that don't meet become one each.
        run = F.sum(F.when(F.lag("apart").over(w), 0).otherwise(1)).over(w)
        runs = pairs.join(F.broadcast(apart) if n <= FEW else apart, "digest", "left_semi").withColumn("run", run)
        wide = runs.groupBy("digest", "run").agg(F.min("no").alias("no"), F.sum("span").alias("span"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
        plan = wide.groupBy("digest").agg(F.collect_list(F.struct("no", "span")).alias("plan"))
        chosen = texts.join(F.broadcast(plan) if n <= FEW else plan, "digest")
        old = known.join(runs.join(wide.select("digest", "run"), ["digest", "run"]).select("digest", "no"), ["digest", "no"], "left_anti")
        k += 1
        known = written(old.unionByName(encoded(cut(chosen, chunk, overlap), told, chunk, overlap)), k, "chunks")
    w = Window.partitionBy("digest").orderBy("no")
    tokens = lambda side, at: F.get(F.filter(side, lambda x: x["p"] == at), F.lit(0))["c"]
    own = pairs.withColumn("from", F.lag("at").over(w))
    count = F.coalesce(tokens("right", F.col("at")), F.col("total")) - F.coalesce(tokens("left", F.col("from")), F.lit(0))
    return written(own.groupBy("digest").agg(F.sum(count).alias("n_tokens")), k, "counts")


def counted(docs: DataFrame, path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP, huge: int = HUGE) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row's whole text, as the file's library counts them by default.

    `.json` files are read by tokenizers, `.model` files by sentencepiece; special strings within texts are special tokens,
    none are added. Null and empty texts have 0 tokens, repeated rows a row each, an empty table none; bytes that aren't
    UTF-8 count as U+FFFD. Texts over `huge` bytes are spliced from chunks where that is proven to be right (spliceable),
    else encoded whole. The driver reads the file, of fixed size, and broadcasts it.
    """
    if not 0 < 2 * overlap <= chunk:
        raise ValueError("an overlap is at most half a chunk")
    spark = docs.sparkSession
    path = path or default_path()
    kind = os.path.splitext(path)[1]
    with open(path, "rb") as f:
        content = f.read()
    splice = spliceable(kind, content)
    told = spark.sparkContext.broadcast((kind, content, margin(content) if splice else 0))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, content, _ = told.value
        t = counter(kind, content)
        for b in batches:
            raw, n, i = as_bytes(b.column(1)), [], 0
            texts = [x.decode("utf-8", "replace") for x in raw]
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= AT_ONCE):
                    size += len(texts[j])
                    j += 1
                n += t.count(texts[i:j])
                i = j
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(n, pa.int64())], schema=schema)

    limit_batches(spark)
    own = docs.select(as_long(docs, "doc_id").alias("doc_id"), as_text(docs).alias("text"))
    size = F.octet_length("text")
    small = (own.where(size <= huge) if splice else own).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    out = small
    if splice:
        long = own.where(size > huge).withColumn("digest", F.sha2("text", 256))
        tokens = spliced(long.select("digest", "text"), told, chunk, overlap)
        rows = long.select("doc_id", size.cast("long").alias("n_bytes"), "digest")
        ids = own_dir(spark, "tokens-rows")
        rows.write.parquet(ids)
        rows = spark.read.parquet(ids)
        keys = rows.groupBy("digest").agg(F.count("*").alias("_rows")).join(tokens, "digest")
        out = small.unionByName(met(rows, keys, ["digest"], "_rows", ["doc_id"]).select("doc_id", "n_bytes", "n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
