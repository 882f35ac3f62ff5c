"""Vector codes by broadcast integer codebooks: distances by norm expansion, exact products of 64-bit integers, sums by a grouped shuffle.

Components are integers, floor(SCALE * x); a vector is cut into PARTS consecutive parts, each coded by its nearest entry of
that part's codebook. Codebooks have PARTS x ENTRIES entries, whatever the number of rows, so they are broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_long, limit_batches, met, own_dir

#: Units of a component, parts of a vector, entries of a codebook, rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows whose distances to a codebook are held at once.
AT_ONCE = 4096


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector isn't null or empty and holds neither null nor non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad)


def integers(column: pa.Array, wide: int, exact: bool) -> np.ndarray:
    """Vectors as rows of integers, filled up with zeros to `wide`; Python's integers where 64 bits don't do."""
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    flat = flat.astype(np.int64) if exact else np.array([int(x) for x in flat], object)
    flat = flat.reshape(len(column), -1)
    return flat if flat.shape[1] == wide else np.hstack((flat, np.zeros((len(flat), wide - flat.shape[1]), flat.dtype)))


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of the smallest squared distance, the first of equals, and that distance, of each row: |x|^2 - 2 x.c + |c|^2."""
    found = [_nearest(part[k : k + AT_ONCE], book) for k in range(0, len(part), AT_ONCE)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    far = (book * book).sum(axis=1)[None, :] - 2 * part.dot(book.T)
    code = far.argmin(axis=1)
    return code, far[np.arange(len(part)), code] + (part * part).sum(axis=1)


class Books:
    """The codebooks, (PARTS, entries, components of a part), with how vectors become integers."""

    def __init__(self, books: np.ndarray, length: int):
        self.books, self.length = books, length

    @property
    def exact(self) -> bool:
        return self.books.dtype != object

    def parts(self, column: pa.Array) -> np.ndarray:
        """(PARTS, rows, components) of vectors."""
        n, wide = self.books.shape[0], self.books.shape[2]
        return integers(column, n * wide, self.exact).reshape(len(column), n, wide).transpose(1, 0, 2)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


def smallest(rows: DataFrame, many: int = ENTRIES) -> list[int]:
    """The smallest ids of rows, ascending, each once: a task hands on no more than that many, so neither vectors nor all ids are shuffled."""
    schema = pa.schema([("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.zeros(0, np.int64)
        for b in batches:
            least = np.unique(np.concatenate((least, b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))))[:many]
        yield pa.record_batch([pa.array(least)], schema=schema)

    return [r.id for r in rows.where("id is not null").select("id").mapInArrow(run, "id long").distinct().orderBy("id").limit(many).collect()]


def initial(rows: DataFrame, vector: str = "embedding") -> Books:
    """Codebooks of the vectors with the ENTRIES smallest ids, one of each id (of a repeated id, the smallest vector).

    Rows have `id` and the vector. The length is that of most of these vectors, the longer of equals; a length that PARTS
    doesn't divide is filled up with zeros. If a squared distance may pass 64 bits, integers are Python's.
    """
    drawn = sorted(rows.where(F.col("id").isin(smallest(rows))).groupBy("id").agg(F.min(vector).alias("v")).collect(), key=lambda r: r.id)  # ENTRIES rows
    sizes = [len(r.v) for r in drawn]
    length = max(set(sizes), key=lambda n: (sizes.count(n), n), default=0)
    wide = -(-length // PARTS)
    most = rows.where(F.size(vector) == length).agg(F.max(F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double")))))).first()[0] or 0.0
    exact = 4 * PARTS * max(wide, 1) * (most * SCALE + 1) ** 2 < 2**62
    vectors = [r.v for r in drawn if len(r.v) == length]
    whole = integers(pa.array(vectors, pa.list_(pa.float64())), PARTS * wide, exact) if vectors else np.zeros((0, PARTS * wide), np.int64)
    return Books(whole.reshape(len(vectors), PARTS, wide).transpose(1, 0, 2).copy(), length)


def refined(rows: DataFrame, books: Books, vector: str = "embedding") -> Books:
    """Every entry replaced by the mean of its parts, rounded down; unused ones stay. A task sums what it assigns; a row an entry and task is shuffled."""
    known = rows.sparkSession.sparkContext.broadcast(books)
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = known.value
        n = np.zeros(b.books.shape[:2], np.int64)
        sums = np.zeros(b.books.shape, object)
        for rows in batches:
            for p, part in enumerate(b.parts(rows.column(0))):
                code, _ = nearest(part, b.books[p])
                order = np.argsort(code, kind="stable")
                at = np.flatnonzero(np.diff(code[order], prepend=-1))
                used = code[order][at]
                n[p, used] += np.diff([*at, len(order)])
                sums[p, used] += np.add.reduceat(part[order], at, axis=0).astype(object)
        p, e = np.nonzero(n)
        yield pa.record_batch([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array([[Decimal(int(x)) for x in s] for s in sums[p, e]], schema.field("sums").type)], schema=schema)

    wide = books.books.shape[2]
    kinds = "part int, entry int, n long, sums array<decimal(38,0)>"
    partial = rows.select(vector).mapInArrow(run, kinds)
    summed = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(wide)])
    new = books.books.copy()
    for r in summed.collect():  # PARTS x ENTRIES rows at most
        new[r.part, r.entry] = [int(r[f"s{k}"]) // r.n for k in range(wide)]
    return Books(new, books.length)


def compressed(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable vector.

    Vectors null, empty, of another length than most of the first ones, or with null or non-finite components take no part.
    Rows with equal or null ids are rows of their own (a null one never begins a codebook). Fewer ids than ENTRIES make
    codebooks as short; if there is none, or the table is empty, so is the result. Without a label column all labels are
    null. An error that a long can't hold is null.
    """
    spark = rows.sparkSession
    limit_batches(spark)
    named = F.col(label).cast("string") if label in rows.columns else F.lit(None).cast("string")
    own = usable(rows.select(as_long(rows, key).alias("id"), F.col(vector), named.alias("label")), vector)
    books = initial(own, vector)
    own = own.where((F.size(vector) == books.length) & F.lit(books.books.shape[1] > 0))
    for _ in range(ROUNDS if books.books.shape[1] else 0):
        books = refined(own, books, vector)
    known = spark.sparkContext.broadcast(books)
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = known.value
        for rows in batches:
            if not rows.num_rows:
                continue
            codes, far = zip(*[nearest(part, b.books[p]) for p, part in enumerate(b.parts(rows.column(1)))], strict=True)
            text = [c.tobytes().hex() for c in np.stack(codes, axis=1).astype(np.uint8)]
            error = [int(x) if x < 2**63 else None for x in sum(far)]
            yield pa.record_batch([rows.column(0), rows.column(2).cast(pa.string()), pa.array(text), pa.array(error, pa.int64())], schema=schema)

    path = own_dir(spark, "codes")
    own.select("id", vector, "label").mapInArrow(run, "vec_id long, label string, code string, error long").write.parquet(path)
    coded = spark.read.parquet(path).withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce("label", F.lit(""))})
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    whole = F.when(total < F.lit(Decimal(2**63)), total.cast("long"))
    by_label = coded.groupBy("_none", "_label").agg(F.count("*").alias("_rows"), whole.alias("label_error"))
    out = met(coded, by_label, ["_none", "_label"], "_rows", ["vec_id", "code"])  # a label may be that of a third of all rows
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def oracle_sql() -> str:
    """The same in DuckDB: every round a table of the codebooks, assignments by a join with all entries."""
    far = "list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    assign = lambda book: f"SELECT v.vec_id, v.part, arg_min(c.entry, {far} * 1000 + c.entry) AS entry, min({far}) AS far FROM v JOIN {book} c ON c.part = v.part GROUP BY ALL"
    rounds = ", ".join(
        f"""a{k} AS MATERIALIZED ({assign(f"b{k}")}),
        m{k} AS (SELECT part, entry, list(m ORDER BY i) AS x FROM (
            SELECT a.part, a.entry, i, floor_div(sum(v.x[i])::BIGINT, count(*)) AS m FROM a{k} a JOIN v ON v.vec_id = a.vec_id AND v.part = a.part, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM v))) AS i) GROUP BY ALL) GROUP BY ALL),
        b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (part, entry))"""
        for k in range(ROUNDS)
    ).replace("floor_div(sum(v.x[i])::BIGINT, count(*))", "((sum(v.x[i])::BIGINT - ((sum(v.x[i])::BIGINT % count(*)) + count(*)) % count(*)) // count(*))")
    return f"""
        WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        v AS MATERIALIZED (SELECT vec_id, part, x[part * len(x) // {PARTS} + 1:(part + 1) * len(x) // {PARTS}] AS x FROM kept, (SELECT unnest(range({PARTS})) AS part)),
        b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM v QUALIFY entry < {ENTRIES}),
        {rounds},
        final AS MATERIALIZED ({assign(f"b{ROUNDS}")}),
        coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM final GROUP BY vec_id),
        book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS s FROM b{ROUNDS})
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM coded JOIN kept USING (vec_id), book"""
