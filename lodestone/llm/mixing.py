"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's target over its size is the number of copies each of its documents should get. The whole part
is taken; the fractions are rounded together. Two fractions at a time exchange words, at random and without
bias, until one of them is 0 or 1; the other goes on. Words are only exchanged within a source, so what a source takes
differs from its target by less than one document. Blocks of documents are rounded on their own and hand on one residual
each; the residuals are rounded in blocks in turn, up a tree with one root for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, free, table

#: Fractions rounded in one block; the height of the tree is the logarithm of the documents to this base.
BLOCK = 128
#: The decisions (some 60 bytes each) are broadcast to the documents up to this number of rows; more are joined by a shuffle.
BROADCAST_ROWS = 300_000
_EPS = 1e-9

#: One step of the fold: ``acc.cur`` carries the open fraction; ``x`` is the next. Words move until one of both is settled.
_FOLD = f"""
aggregate(items,
  named_struct('f', CAST(0 AS DOUBLE), 's', CAST(0 AS LONG), 'i', -1, 'done', CAST(array() AS ARRAY<STRUCT<i: INT, up: INT>>)),
  (acc, x) -> CASE
    WHEN acc.i < 0 THEN named_struct('f', x.f, 's', x.size, 'i', x.i, 'done', acc.done)
    ELSE transform(array(named_struct(
        'a', least((1 - acc.f) * acc.s, x.f * x.size),
        'b', least(acc.f * acc.s, (1 - x.f) * x.size),
        'u', (pmod(xxhash64(x.h, x.size, acc.i, {{seed}}), 1073741824) + 0.5D) / 1073741824)),
      d -> transform(array(IF(d.u * (d.a + d.b) < d.b,
          named_struct('fi', IF((1 - acc.f) * acc.s <= x.f * x.size, 1D, acc.f + d.a / acc.s), 'fj', IF(x.f * x.size <= (1 - acc.f) * acc.s, 0D, x.f - d.a / x.size)),
          named_struct('fi', IF(acc.f * acc.s <= (1 - x.f) * x.size, 0D, acc.f - d.b / acc.s), 'fj', IF((1 - x.f) * x.size <= acc.f * acc.s, 1D, x.f + d.b / x.size)))),
        g -> CASE
          WHEN g.fi <= {_EPS} OR g.fi >= 1 - {_EPS} THEN named_struct('f', g.fj, 's', x.size, 'i', x.i, 'done', concat(acc.done, array(named_struct('i', acc.i, 'up', CAST(round(g.fi) AS INT)))))
          ELSE named_struct('f', g.fi, 's', acc.s, 'i', acc.i, 'done', concat(acc.done, array(named_struct('i', x.i, 'up', CAST(round(g.fj) AS INT)))))
        END)[0])[0]
  END)
"""


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): by weight, none above ``cap`` times its size.

    With sources in the order in which they reach their caps, the level is the largest that any prefix of
    capped sources implies. The input has one row for each source, so one task orders them.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("c", cap * F.col("source_size"))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("c") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("c").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", level)
    return rows.withColumn("level", F.max("level").over(every)).select("source", "source_size", F.least("c", F.col("level") * F.col("w")).alias("target"))


def _round_level(items: DataFrame, seed: int) -> DataFrame:
    """items: source, block, h, key (a struct), size, f. Adds the decisions and the residual of each block."""
    fields = F.struct("h", "size", "f", "key")
    blocks = items.groupBy("source", "block").agg(F.sort_array(F.collect_list(fields)).alias("items"))
    blocks = blocks.withColumn("items", F.expr("transform(items, (x, i) -> struct(i AS i, x.h AS h, x.size AS size, x.f AS f, x.key AS key))"))
    return cut(blocks.withColumn("r", F.expr(_FOLD.format(seed=seed))), "mix")


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 0) -> DataFrame:
    """How many rows of a document the mix takes: doc_id, source, size, n_rows, n_copies, source_size, target.

    A null text has size 0; a null source is a source of its own, in the last place; a null id is an id. Repeated rows
    (equal id, size and source) are decided together: ``n_copies`` is for all ``n_rows`` of them. Documents of size
    0 take part in no exchange and are kept as they are (their copies hold no words). Reruns agree: chance comes from hashes, and ties of
    hashes go by size. However long texts are their words are all counted; an empty table gives an empty table; other columns are not read.
    """
    size = F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"))
    rows = cut(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n_rows")), "sizes")
    sums = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"), F.count("*").alias("n"))
    stats = cut(targets(sums.select("source", "source_size"), weights, share, cap).join(sums.select(F.col("source").alias("s2"), "n"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2"), "targets")
    s = stats.select(F.col("source").alias("s2"), "source_size", "target", F.ceil(F.col("n") / BLOCK).alias("n_blocks"))
    whole = F.col("n_rows") * F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0)
    x = rows.join(s, F.col("source").eqNullSafe(F.col("s2"))).drop("s2").withColumn("whole", whole)
    x = x.withColumn("base", F.floor(F.col("whole") + _EPS)).withColumn("f", F.col("whole") - F.col("base"))
    x = x.withColumn("open", (F.col("f") > _EPS) & (F.col("size") > 0)).withColumn("base", F.when(F.col("size") == 0, F.col("n_rows")).otherwise(F.col("base")))
    h = F.xxhash64(F.lit(seed), "doc_id", "size")
    key = F.struct("doc_id", "n_rows", "base")
    items = x.where("open").select("source", F.pmod(h, F.col("n_blocks")).alias("block"), h.alias("h"), key.alias("key"), "size", "f")
    most = (stats.agg(F.max("n")).first()[0] or 0) // BLOCK + 1
    done, level = [x.where("NOT open").select("source", "doc_id", "size", "n_rows", F.col("base").alias("n_copies"))], 0
    while True:
        r = _round_level(items, seed + 7919 * level)
        settled = r.select("source", F.explode("r.done").alias("d"), "items").select("source", F.expr("element_at(items, d.i + 1)").alias("x"), "d.up")
        rest = r.where("r.i >= 0").select("source", "block", F.expr("element_at(items, r.i + 1)").alias("x"), F.col("r.f").alias("f"))
        last = most <= 1
        if last:  # the root of each source: its fraction becomes 1 with that probability
            u = (F.pmod(F.xxhash64(F.lit(seed + 1), "x.h", "x.size"), F.lit(1 << 30)) + 0.5) / (1 << 30)
            settled = settled.unionByName(rest.select("source", "x", (u < F.col("f")).cast("int").alias("up")))
        done.append(settled.select("source", "x.key.doc_id", "x.size", "x.key.n_rows", (F.col("x.key.base") + F.col("up")).alias("n_copies")))
        if last:
            break
        most, level = (most - 1) // BLOCK + 1, level + 1
        items = rest.select("source", F.floor(F.col("block") / BLOCK).alias("block"), "x.h", "x.key", "x.size", "f")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.join(stats.select(F.col("source").alias("s2"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")


def _share(n_copies: str, n_rows: str, i: str) -> Column:
    """Copies of the i-th of n_rows equal rows: an even share of n_copies."""
    return F.expr(f"CAST({n_copies} DIV {n_rows} + IF({i} <= {n_copies} % {n_rows}, 1, 0) AS LONG)")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (0, 1 or more times), with their own columns only.

    Nulls, repeated rows and ties are treated as in ``copies``; of repeated rows that do not all have the same number of copies, which
    one has more goes by the hash of its text. However long texts are they are taken whole; an empty table gives an empty table.
    """
    id2, source2, size2, n_rows, n_copies, n, i, each = free(docs, "id", "source", "size", "n_rows", "n_copies", "n", "i", "copies")
    got = cut(copies(docs, doc_id, text, source, **how).select(F.col("doc_id").alias(id2), F.col("source").alias(source2), F.col("size").alias(size2), F.col("n_rows").alias(n_rows), F.col("n_copies").alias(n_copies)), "copies")
    count, most = got.agg(F.count("*"), F.max(n_rows)).first()
    size = F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    row = docs.withColumn(n, size)
    if (most or 0) > 1:
        row = row.withColumn(i, F.row_number().over(Window.partitionBy(doc_id, source, n).orderBy(F.xxhash64(text))))
    else:
        row = row.withColumn(i, F.lit(1))
    got = F.broadcast(got) if count <= BROADCAST_ROWS else got
    row = row.join(got, F.col(doc_id).eqNullSafe(F.col(id2)) & F.col(source).eqNullSafe(F.col(source2)) & (F.col(n) == F.col(size2)))
    row = row.withColumn(each, _share(n_copies, n_rows, i)).where(F.col(each) > 0).withColumn(each, F.explode(F.expr(f"sequence(1, CAST({each} AS INT))")))
    return row.select(*[row[f"`{c}`"] for c in docs.columns])


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = copies(table(spark, sf_dir, "documents")).withColumn("i", F.explode(F.expr("sequence(1, CAST(n_rows AS INT))"))).withColumn("copies", _share("n_copies", "n_rows", "i"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
