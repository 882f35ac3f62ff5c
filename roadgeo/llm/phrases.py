"""Phrase mining with position bitmaps: shift, AND and popcount extend phrases depth-first; counts are summed over shards.

A shard is some megabytes of text of one language within a task. Its words stand at consecutive positions, with a free
position between pieces, so that no shift leads from one piece into the next. Each word has a bitmap of its positions,
compressed to the 64-bit blocks that aren't zero. The bitmap of a phrase has the positions of its last words; shifted by
one and ANDed with a word's bitmap it is that of the phrase with this word behind it, and its popcount is the shard's count.

Three passes over the texts keep the counts of all shards small. What may be frequent is told to a pass by a table of
hashed bits of fixed size: of words to the pass over pairs, of pairs to the pass over longer phrases. Such a table lets
some rare phrases through, which the exact counts then drop, and no frequent one is ever left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_text, limit_batches, own_dir

#: Words of a phrase, least count, share of a longer phrase's count that hides a phrase, rows a language.
LONGEST, LEAST, HIDES_PCT, BEST = 4, 30, 80, 2000
#: Bytes of text of a shard, set bits that a bundle of first words begins with, bits of the tables of what may be frequent, bundles of ranked rows.
SHARD, BUNDLE, TABLE_BITS, DEALT = 4 << 20, 60_000, 1 << 26, 64
SPACES, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
PLAIN = bytes.maketrans(bytes(range(65, 91)) + b"\t" + BREAKS, bytes(range(97, 123)) + b" " + b"\n" * len(BREAKS))
FOLLOWING = re.compile(rb" *(?:[^ \n]+ *){0,%d}" % (LONGEST - 1))


def hashed(words: list[bytes], lang: str) -> np.ndarray:
    """64 bits of each word of a language."""
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits of pairs, of those of their words."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Told:
    """A table of hashed bits: what isn't in it is rare."""

    def __init__(self, slots: np.ndarray, values: np.ndarray, bits: int):
        self.words, self.mask = np.zeros(bits >> 6, np.uint64), np.uint64(bits - 1)
        self.words[slots] = values

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def slices(text: bytes) -> Iterator[tuple[bytes, int]]:
    """A text in lower case with single kinds of separators, in slices of a shard's size, each with the number of its own bytes.

    A slice that ends within a piece is followed by the next words of that piece, as far as a phrase may reach.
    """
    text = text.translate(PLAIN)
    a = 0
    while len(text) - a > SHARD:
        b = text.rfind(b"\n", a + SHARD // 2, a + SHARD)
        if b < 0:
            b = next((x for x in (text.rfind(b" ", a + 1, a + SHARD), text.find(b" ", a + SHARD), text.find(b"\n", a + SHARD)) if x > a), len(text))
        yield text[a : FOLLOWING.match(text, b).end()], b - a
        a = b
    if a < len(text):
        yield text[a:], len(text) - a


class Shard:
    """Words of texts of one language, their positions, and their bitmaps."""

    def __init__(self, lang: str, parts: list[tuple[bytes, int]]):
        self.lang = lang
        data = np.frombuffer(b"\n".join(t for t, _ in parts), np.uint8)
        is_break = data == 10
        inside = ~(is_break | (data == 32))
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        piece = np.searchsorted(np.flatnonzero(is_break), starts)
        position = np.arange(len(starts)) + np.cumsum(np.diff(piece, prepend=piece[:1]) > 0)
        own = np.ones(len(starts), bool)  # words of a slice, not those that only follow it
        begin = 0
        for t, n in parts:
            if n < len(t):
                own[np.searchsorted(starts, begin + n) : np.searchsorted(starts, begin + len(t))] = False
            begin += len(t) + 1
        offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
        self.words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        self.code, self.position, self.own = code, position, own
        self.hashes: np.ndarray | None = None

    def keep(self, told: Told) -> None:
        """Leave out the words that are rare."""
        self.hashes = hashed(self.words.to_pylist(), self.lang)
        kept = told.has(self.hashes)[self.code]
        self.code, self.position, self.own = self.code[kept], self.position[kept], self.own[kept]

    def bitmaps(self, rows: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, block and bits of every block that isn't zero, by word and block."""
        code, position = self.code[rows], self.position[rows]
        order = np.argsort(code, kind="stable")
        return blocks(code[order].astype(np.int64), position[order] >> 6, np.uint64(1) << (position[order] & 63).astype(np.uint64))

    def counts(self) -> tuple[pa.Array, np.ndarray]:
        """Every word and its popcount."""
        code, _, bits = self.bitmaps(self.own)
        n = np.zeros(len(self.words), np.int64)
        if len(code):
            at = heads(code)
            n[code[at]] = np.add.reduceat(np.bitwise_count(bits).astype(np.int64), at)
        return self.words.filter(pa.array(n > 0)), n[n > 0]

    def phrases(self, longest: int, told: Told | None = None) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Phrases of 2 to `longest` words with their counts; with a table, the pairs themselves are left out, and all that holds a pair not told."""
        if not len(self.code):
            return
        word, block, bits = self.bitmaps()
        self.keys, self.bits = (word << 32) | block, bits
        self.at = np.full((int(self.position.max()) >> 6 << 6) + 129, -1, np.int64)
        self.at[self.position] = self.code
        word, block, bits = self.bitmaps(self.own)
        if not len(word):
            return
        at = heads(word)
        total = np.cumsum(np.add.reduceat(np.bitwise_count(bits).astype(np.int64), at))
        first = [0, *np.flatnonzero(np.diff(total // BUNDLE) > 0) + 1, len(at)]
        for a, b in zip(first, first[1:], strict=False):  # the subtree of some first words, then the next
            lo, hi = at[a], at[b] if b < len(at) else len(word)
            yield from self.below(word[at[a:b]][:, None], word[lo:hi], block[lo:hi], bits[lo:hi], longest, told)

    def below(self, phrase: np.ndarray, owner: np.ndarray, block: np.ndarray, bits: np.ndarray, longest: int, told: Told | None) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """All that extends the phrases (rows of word codes), which have the given blocks, in their order."""
        owner = np.repeat(np.arange(len(phrase)), np.diff([*heads(owner), len(owner)]))
        deep = phrase.shape[1] + 1
        over = np.flatnonzero(bits >> np.uint64(63))  # shift by one, with what goes over into the next block
        who, where, what = np.concatenate((owner, owner[over])), np.concatenate((block, block[over] + 1)), np.concatenate((bits << np.uint64(1), np.ones(len(over), np.uint64)))
        order = np.argsort((who << 32) | where, kind="stable")  # two rising runs
        who, where, what = blocks(who[order], where[order], what[order])
        row, bit = np.nonzero(np.unpackbits(what.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        word = self.at[where[row] * 64 + bit]
        some = word >= 0
        if told is not None:
            last = phrase[:, -1][who[row]]
            some &= told.has(mixed(self.hashes[last], self.hashes[word]))
        row, word = row[some], word[some]
        if not len(row):
            return
        order = np.argsort((who[row] << 32) | word, kind="stable")  # by phrase, which rows rise with, then next word, then block
        row, word = row[order], word[order]
        new = np.flatnonzero(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(word) != 0))))
        row, word = row[new], word[new]
        both = what[row] & self.bits[np.searchsorted(self.keys, (word << 32) | where[row])]
        child = (who[row] << 32) | word
        at = heads(child)
        count = np.add.reduceat(np.bitwise_count(both).astype(np.int64), at)
        longer = np.hstack((phrase[who[row[at]]], word[at][:, None]))
        if told is None or deep > 2:
            yield pc.binary_join_element_wise(*[self.words.take(pa.array(longer[:, k])) for k in range(deep)], b" "), count
        if deep < longest:
            yield from self.below(longer, child, where[row], both, longest, told)


def heads(sorted_keys: np.ndarray) -> np.ndarray:
    """Where equal keys begin."""
    return np.flatnonzero(np.concatenate(([True], np.diff(sorted_keys) != 0))) if len(sorted_keys) else np.zeros(0, np.int64)


def blocks(owner: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of the same owner and number, which stand side by side, as one."""
    if not len(owner):
        return owner, block, bits
    at = np.flatnonzero(np.concatenate(([True], (np.diff(owner) != 0) | (np.diff(block) != 0))))
    return owner[at], block[at], np.bitwise_or.reduceat(bits, at)


def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """Shards of a task's rows (lang, text): all texts of a language once they have a shard's size together, and what is left."""
    held: dict[str, list[tuple[bytes, int]]] = {}
    size: dict[str, int] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            for part in slices(text.as_py()):
                held.setdefault(lang, []).append(part)
                size[lang] = size.get(lang, 0) + len(part[0])
                if size[lang] >= SHARD:
                    yield Shard(lang, held.pop(lang))
                    del size[lang]
                while sum(size.values()) > 2 * SHARD:  # many languages: the largest goes
                    most = max(size, key=size.get)
                    yield Shard(most, held.pop(most))
                    del size[most]
    for lang, parts in held.items():
        yield Shard(lang, parts)


def _summed(texts: DataFrame, mine) -> DataFrame:
    """Counts by language and phrase of what `mine` gives of each shard."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("a", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrase = n = lang = None
        for shard in sharded(batches):
            for phrase, n in mine(shard):
                lang = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(n), np.int8)), [shard.lang]).cast(pa.string())
                yield from pa.table([lang, phrase.cast(pa.binary()), pa.array(n)], schema=schema).to_batches(max_chunksize=20_000)
            shard = phrase = n = lang = None
            pa.default_memory_pool().release_unused()

    return texts.mapInArrow(run, "lang string, phrase binary, a long").groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("a").alias("a"))


def _told(frequent: DataFrame, bits: int) -> Told:
    """The table of a DataFrame's words or pairs; made on the executors, at most bits / 64 numbers come to the driver."""
    schema = pa.schema([("slot", pa.int64()), ("bit", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang in pc.unique(b.column(0)).to_pylist():
                words = [w.as_py().split(b" ") for w in b.column(1).filter(pc.equal(b.column(0), lang))]
                h = hashed([w[0] for w in words], lang)
                if len(words[0]) > 1:
                    h = mixed(h, hashed([w[1] for w in words], lang))
                at = h & np.uint64(bits - 1)
                yield pa.record_batch([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], schema=schema)

    slots = frequent.select("lang", F.col("phrase").cast("binary").alias("phrase")).mapInArrow(run, "slot long, bit long").groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    return Told(slots.column("slot").to_numpy(), slots.column("bits").to_numpy().view(np.uint64), bits)


def counted(docs: DataFrame, least: int = LEAST, bits: int = TABLE_BITS) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, a of all phrases of 1 to LONGEST words that stand `least` times or more in their language, and lang, n: all its words.

    Null languages are `und`, null texts are empty, repeated rows count each. Without any word both tables are empty.
    """
    spark = docs.sparkSession
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")) if "lang" in docs.columns else F.lit("und")
    texts = docs.select(lang.alias("lang"), as_text(docs).cast("binary").alias("text"))
    limit_batches(spark)
    path = own_dir(spark, "phrases")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    words = _summed(texts, lambda s: [s.counts()])
    # Words of any count are written once, so that totals need no pass of their own.
    words = written(words, "words")
    total = words.groupBy("lang").agg(F.sum("a").alias("n"))
    words = words.where(F.col("a") >= least)
    known = spark.sparkContext.broadcast(_told(words, bits))

    def pairs(s: Shard):
        s.keep(known.value)
        return s.phrases(2)

    two = written(_summed(texts, pairs).where(F.col("a") >= least), "pairs")
    near = spark.sparkContext.broadcast(_told(two, bits))

    def longer(s: Shard):
        s.keep(known.value)
        return s.phrases(LONGEST, near.value)

    many = written(_summed(texts, longer).where(F.col("a") >= least), "longer")
    return words.unionByName(two).unionByName(many), total


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST, bits: int = TABLE_BITS) -> DataFrame:
    """The best phrases of 2 to LONGEST words of each language: lang, rank, phrase, a, l, r, n, score.

    Of a phrase's cuts the one with the lowest floor(2000000 * a / (l + r)) counts, ties to the first. A phrase whose words
    lie in a longer one of HIDES_PCT of its count or more is left out. Numbers are decimals of 38 digits where products may
    pass 64 bits. A language without such phrases has no row; an empty table gives an empty one.
    """
    known, total = counted(docs, least, bits)
    split = F.split("phrase", " ", -1)
    rows = known.withColumn("w", split).where("size(w) > 1")
    join = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1))).withColumns({"left": join(1, F.col("k")), "right": join(F.col("k") + 1, F.size("w") - F.col("k"))})
    part = lambda side, n: known.select("lang", F.col("phrase").alias(side), F.col("a").alias(n))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    cuts = cuts.withColumn("_a", whole("a").cast("decimal(30,0)") * F.lit(2_000_000)).withColumn("_b", whole("l").cast("decimal(30,0)") + F.col("r")).withColumn("score", F.expr("_a div _b"))
    cut = F.min(F.struct("score", "k", "l", "r"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(cut.alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    spans = F.expr("filter(flatten(transform(sequence(1, size(w) - 1), i -> transform(sequence(2, size(w) - 1), n -> if(i + n <= size(w) + 1, array_join(slice(w, i, n), ' '), null)))), x -> x is not null)")
    hiding = rows.where("size(w) > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), F.col("a").alias("_longer")).groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    seen = scored.join(hiding, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (whole("_longer").cast("decimal(30,0)") * 100 < whole("a").cast("decimal(30,0)") * HIDES_PCT)).drop("_longer")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each bundle of a language first, so that no task ranks all its phrases.
    deal = F.pmod(F.xxhash64("phrase"), F.lit(DEALT))
    some = seen.withColumn("_d", deal).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_d").orderBy(*order))).where(F.col("rank") <= best)
    top = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return top.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle_sql() -> str:
    """The same in DuckDB, over all n-grams."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
        WITH doc AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM doc),
        grams AS (SELECT lang, len, unnest(list_transform(range(1, len(w) - len + 2), lambda i: w[i:i + len - 1])) AS p FROM words, (SELECT unnest([1, 2, 3, 4]) AS len) lens WHERE len(w) >= len),
        f AS MATERIALIZED (SELECT lang, len, p, count(*) AS a FROM grams GROUP BY ALL),
        total AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE len = 1 GROUP BY lang),
        cand AS MATERIALIZED (SELECT * FROM f WHERE len > 1 AND a >= {LEAST}),
        cuts AS (SELECT c.lang, c.len, c.p, c.a, k, x.a AS l, y.a AS r, ((2000000::HUGEINT * c.a) // (x.a + y.a))::BIGINT AS score
            FROM (SELECT *, unnest(range(1, len)) AS k FROM cand) c JOIN f x ON x.lang = c.lang AND x.p = c.p[:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1:]),
        cut AS (SELECT lang, len, p, a, arg_min({{'l': l, 'r': r, 's': score}}, score * 10 + k) AS c FROM cuts GROUP BY ALL),
        hiding AS (SELECT lang, sub, max(a) AS m FROM (SELECT c.lang, c.a, c.p[i:i + n - 1] AS sub FROM cand c, (SELECT unnest([1, 2, 3]) AS i) s, (SELECT unnest([2, 3]) AS n) t WHERE n < len AND i + n - 1 <= len) GROUP BY ALL),
        kept AS (SELECT cut.lang, array_to_string(p, ' ') AS phrase, a, c.l AS l, c.r AS r, c.s AS score FROM cut LEFT JOIN hiding ON hiding.lang = cut.lang AND hiding.sub = cut.p WHERE m IS NULL OR 100 * m < {HIDES_PCT} * a),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= {BEST}"""
