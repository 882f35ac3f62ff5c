"""Byte-level BPE: recursive DuckDB queries in each partition contract words to tokens, ordered aggregation decodes them."""

from __future__ import annotations

import base64
import gc
import hashlib
import threading
from collections.abc import Iterator

import duckdb
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, as_long, as_text, batch, limit_batches

#: Entries of a generation of kept pieces and of kept words, words that one recursive query contracts, characters encoded at once.
KEPT, WORDS_A_QUERY, AT_ONCE = 200_000, 60_000, 8 << 20
#: Memory of a worker's DuckDB, which runs on one thread, and while it has a very long word.
MEMORY, MORE_MEMORY = "128MB", "512MB"

#: A step lays the places of each word's tokens out as rows, joins neighbours with the merge table, takes each word's pair
#: of least rank, the leftmost of equals, and contracts it; words without a pair leave the recursion. A word's last step
#: has its tokens. Pairs are one key, l << 32 | r; rank and place are one number, rank << 32 | place.
_STEP = """
        SELECT {i} w, s[:(best & 4294967295) - 1] || [(best >> 32)::INT] || s[(best & 4294967295) + 2:]
        FROM (
            SELECT w AS w_best, min((m.t::BIGINT << 32) | p) AS best
            FROM (SELECT w, (unnest(s[:-2])::BIGINT << 32) | unnest(s[2:]) AS k, unnest(range(1, len(s))) AS p FROM step) place
            JOIN merge m ON m.k = place.k GROUP BY w
        ) JOIN step ON w = w_best
"""
CONTRACT = f"""
    CREATE OR REPLACE TABLE coded AS
    WITH RECURSIVE step(i, w, s) AS (SELECT 0, w, s FROM word UNION ALL {_STEP.format(i="i + 1,")})
    SELECT w, arg_max(s, i) AS s FROM step GROUP BY w
"""
#: Long words keep only their last step, by key, so that memory doesn't grow with their square; that costs short ones more
#: than it spares.
CONTRACT_LONG = f"""
    CREATE OR REPLACE TABLE coded AS
    WITH RECURSIVE step(w, s) USING KEY (w) AS (SELECT w, s FROM word UNION {_STEP.format(i="")})
    SELECT w, s FROM step
"""
#: A very long word goes alone, and its step contracts all pairs of the least rank that don't overlap, from the left, as
#: far as that is what one at a time would do: up to the first whose new neighbours make a pair of a rank lower still. So a
#: run of one letter halves at each step.
CONTRACT_RUN = """
    CREATE OR REPLACE TABLE coded AS
    WITH RECURSIVE step(w, s) USING KEY (w) AS (
        SELECT w, s FROM word
        UNION
        SELECT any_value(w), list(CASE WHEN done THEN t ELSE a END ORDER BY p) FROM (
            SELECT *, lag(done, 1, false) OVER (ORDER BY p) AS gone FROM (
                SELECT *, take AND coalesce(sum(stop) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS done FROM (
                    SELECT n.w, n.p, n.a, n.t, n.take, (n.take AND least(coalesce(x.t, n.t), coalesce(y.t, n.t)) < n.t)::INT AS stop FROM (
                        SELECT *, (CASE WHEN lag(take, 2, false) OVER o THEN t ELSE lag(a) OVER o END::BIGINT << 32) | t AS before, (t::BIGINT << 32) | lead(a, 2) OVER o AS after FROM (
                            SELECT *, hit AND (p - last_value(CASE WHEN hit THEN NULL ELSE p END IGNORE NULLS) OVER (ORDER BY p)) % 2 = 1 AS take FROM (
                                SELECT w, p, a, t, coalesce(t = min(t) OVER (), false) AS hit FROM (
                                    SELECT 0 AS w, 0 AS p, NULL AS a, NULL AS t
                                    UNION ALL
                                    SELECT place.w, p, a, m.t FROM (
                                        SELECT w, unnest(s) AS a, unnest(range(1, len(s) + 1)) AS p, unnest(list_append(s[2:], -1)) AS b FROM step
                                    ) place LEFT JOIN merge m ON m.k = ((a::BIGINT << 32) | b) AND b >= 0
                                )
                            )
                        ) WINDOW o AS (ORDER BY p)
                    ) n LEFT JOIN merge x ON n.take AND x.k = n.before LEFT JOIN merge y ON n.take AND y.k = n.after
                )
            )
        ) WHERE NOT gone AND p > 0 HAVING bool_or(done)
    )
    SELECT w, s FROM step
"""
#: Bytes from which words are long, and very long.
LONG, RUN = 64, 2048
#: Tokens with their places, joined with their bytes and aggregated in order.
DECODE = """
    SELECT w, array_to_string(s, ' '), plain FROM coded JOIN (
        SELECT w, string_agg(h, '' ORDER BY p) AS plain FROM (SELECT w, unnest(s) AS t, unnest(range(1, len(s) + 1)) AS p FROM coded) place JOIN token USING (t) GROUP BY w
    ) USING (w)
"""


class Tokenizer:
    """A worker's encoder over one rank file: the merge table in DuckDB, and what it has encoded so far, bounded in size."""

    def __init__(self, ranks: list[tuple[bytes, int]], pattern: str, by_space: bool = False):
        self.pattern, self.by_space = regex.compile(pattern), by_space
        self.ranks = dict(ranks)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
        self.db.execute("SET preserve_insertion_order = false")
        merges = [(self.ranks[t[:i]], self.ranks[t[i:]], k) for t, k in ranks for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        keys, made = [a << 32 | b for a, b, _ in merges], [k for _, _, k in merges]
        self._load("merge", k=pa.array(keys, pa.int64()), t=pa.array(made, pa.int32()))
        self._load("token", t=pa.array([k for _, k in ranks], pa.int32()), h=pa.array([t.hex() for t, _ in ranks], pa.string()))
        self.pairs = {t[i : i + 2] for t, _ in ranks for i in range(len(t) - 1)}
        self.byte = [self.ranks.get(bytes([k]), -1) for k in range(256)]
        self.words, self.heads, self.tails = Recent(KEPT), Recent(KEPT // 8), Recent(KEPT)

    def forget(self) -> None:
        """Let go of all but the rank file's tables: the worker may serve other stages next."""
        self.words, self.heads, self.tails = Recent(KEPT), Recent(KEPT // 8), Recent(KEPT)
        self.db.execute("DROP TABLE IF EXISTS word; DROP TABLE IF EXISTS coded")

    def _load(self, name: str, **columns: pa.Array) -> None:
        self.db.register("loaded", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM loaded")
        self.db.unregister("loaded")

    def contract(self, words: list[bytes]) -> list[tuple[str, bytes]]:
        """Ids, joined by spaces, and the bytes that they decode to, of words that aren't empty; a word that is a token begins, and ends, as that."""
        places = pa.array([[k] if (k := self.ranks.get(w)) is not None else [self.byte[c] for c in w] for w in words], pa.list_(pa.int32()))
        self._load("word", w=pa.array(range(len(words)), pa.int32()), s=places)
        longest = max(map(len, words))
        if longest > RUN:
            self.db.execute(f"SET memory_limit = '{MORE_MEMORY}'")
        self.db.execute(CONTRACT if longest <= LONG else CONTRACT_LONG if longest <= RUN else CONTRACT_RUN)
        out = [("", b"")] * len(words)
        for k, ids, h in self.db.execute(DECODE).fetchall():
            out[k] = ids, bytes.fromhex(h)
        if longest > RUN:
            self.db.execute("DROP TABLE word; DROP TABLE coded")
            self.db.execute(f"SET memory_limit = '{MEMORY}'")
        return out

    def learn(self, words: set[str]) -> None:
        """Contract and decode the words not yet known."""
        cut = {x: [b] if len(b) <= LONG or b in self.ranks else self.cut(b) for x, b in ((x, x.encode()) for x in self.words.keep(words))}
        many = sorted({b for parts in cut.values() for b in parts}, key=len)  # words of a query leave the recursion at about the same step
        done: dict[bytes, tuple[str, bytes]] = {}
        i = 0
        while i < len(many):
            j, size = i, 0
            while j < len(many) and (j == i or (j - i < WORDS_A_QUERY and size < 20 * WORDS_A_QUERY and len(many[j]) <= RUN and (len(many[i]) > LONG) == (len(many[j]) > LONG))):
                size += len(many[j])
                j += 1
            done.update(zip(many[i:j], self.contract(many[i:j]), strict=True))
            i = j
        for x, parts in cut.items():
            self.words.young[x] = done[parts[0]] if len(parts) == 1 else (" ".join([done[b][0] for b in parts]), b"".join([done[b][1] for b in parts]))

    def cut(self, word: bytes) -> list[bytes]:
        """A long word in parts: where two bytes stand side by side in no token, no contraction ever spans them."""
        at = [0, *[i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.pairs], len(word)]
        return [word[a:b] for a, b in zip(at, at[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """Ids, joined by spaces, and decoded bytes of each text.

        A text is cut at its single spaces first. Where no piece is empty or begins or ends with white space, the
        pattern never matches across such a cut, so a piece with its space before it is matched and kept by itself;
        any other text is matched whole. That holds for the default pattern; with another every text is matched whole.
        """
        if not self.by_space:
            matched = [self.pattern.findall(t) for t in texts]
            self.learn({w for m in matched for w in m})
            known = self.words.young
            return [(" ".join([known[w][0] for w in m]), b"".join([known[w][1] for w in m])) for m in matched]
        cut = [t.split(" ") for t in texts]
        heads, tails = {c[0] for c in cut}, set()
        for c in cut:
            tails.update(c[1:])
        new_heads, new_tails = self.heads.keep(heads), self.tails.keep(tails)
        odd = {x for x in new_heads | new_tails if not x or x[0].isspace() or x[-1].isspace()}
        whole = {k: self.pattern.findall(texts[k]) for k, c in enumerate(cut) if not odd.isdisjoint(c)} if odd else {}
        matched = [(self.heads.young, {x: self.pattern.findall(x) for x in new_heads - odd}), (self.tails.young, {x: self.pattern.findall(" " + x) for x in new_tails - odd})]
        words = {w for _, new in matched for m in new.values() for w in m}
        for m in whole.values():
            words.update(m)
        self.learn(words)
        known = self.words.young
        for kept, new in matched:
            for x, m in new.items():
                if len(m) == 1:
                    kept[x] = known[m[0]]
                else:
                    got = [known[w] for w in m]
                    kept[x] = " ".join([g[0] for g in got]), b"".join([g[1] for g in got])
        out, head, tail = [], self.heads.young, self.tails.young
        for k, c in enumerate(cut):
            if k in whole:
                ids, plain = zip(*[known[w] for w in whole[k]], strict=True) if whole[k] else ((), ())
            elif len(c) == 1:
                out.append(head[c[0]])
                continue
            else:
                got = [head[c[0]], *map(tail.__getitem__, c[1:])]
                ids, plain = [g[0] for g in got], [g[1] for g in got]
            out.append((" ".join(ids), b"".join(plain)))
        return out


class Recent(dict):
    """Two generations of entries: those used of late, and those before them, which move up when used again.

    Of two generations of `most` entries at most, so bounded; what is used again and again is never computed anew.
    """

    def __init__(self, most: int):
        super().__init__()
        self.most, self.young = most, {}

    def keep(self, keys: set[str]) -> set[str]:
        """Have all known entries of the keys in the young generation, which begins anew if it would grow too large; returns the keys not known."""
        missing = keys - self.young.keys()
        if self.young and len(self.young) + len(missing) > self.most:
            self.clear()
            self.update(self.young)
            self.young, missing = {}, keys
        if self:
            found = missing & self.keys()
            for k in found:
                self.young[k] = self[k]
            missing = missing - found
        return missing


_LOCAL = threading.local()


def worker_tokenizer(ranks: list[tuple[bytes, int]], pattern: str, by_space: bool) -> Tokenizer:
    """The tokenizer of this Python worker, made once for a rank file; over tasks it keeps the merge table alone."""
    key = (len(ranks), hash(tuple(ranks[-3:])), pattern, by_space)
    if getattr(_LOCAL, "key", None) != key:
        _LOCAL.tokenizer, _LOCAL.key = Tokenizer(ranks, pattern, by_space), key
    return _LOCAL.tokenizer


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """Token bytes and rank of each line of a rank file."""
    with open(path, "rb") as f:
        return sorted(((base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)), key=lambda x: x[1])


def default_ranks() -> tuple[str, str]:
    """Path of the rank file and the pattern that the queries use, from the tokenizers' folder."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row's whole text, and the ids themselves on demand.

    The ids are those of the rank file without special tokens; null and empty texts have none; repeated rows keep a row
    each; an empty table gives none. A very long word, even of one letter, takes steps by the logarithm of its runs or so
    (a long word without repeats, one for each token). The driver reads the rank
    file (a fixed size) and broadcasts it. Memory is bounded by a batch of texts and the KEPT pieces, whatever the input.
    """
    own = default_ranks()
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path or own[0]))
    splits = pattern or own[1]
    by_space = splits == own[1]
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *([("ids", pa.list_(pa.int32()))] if with_ids else [])])

    def coded(tokenizer: Tokenizer, b: pa.RecordBatch) -> pa.RecordBatch | None:
        got, texts = [], [t.decode() for t in as_bytes(b.column(1))]
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) < AT_ONCE):
                size += len(texts[j])
                j += 1
            got += [(s.count(" ") + 1 if s else 0, hashlib.sha256(s.encode()).hexdigest(), hashlib.sha256(d).hexdigest(), *([[int(x) for x in s.split()]] if with_ids else [])) for s, d in tokenizer.encode(texts[i:j])]
            i = j
        return batch(schema, b.column(0), *zip(*got, strict=True)) if got else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(ranks.value, splits, by_space)
        gc.disable()  # hundreds of thousands of kept tuples without cycles would be walked again and again
        try:
            yield from (made for b in batches if (made := coded(tokenizer, b)) is not None)
        finally:
            tokenizer.forget()
            gc.enable()

    limit_batches(docs.sparkSession)
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select(as_long(docs, "doc_id").alias("doc_id"), as_text(docs).alias("text")).mapInArrow(run, kinds)
