"""Audit of how far the sources of a language differ in their terms, exactly, by one-hot level products.

1. Terms are counted once per document in the tasks (Arrow batches), merged there, and summed by (lang, source, term) and
   (lang, term), so a source with a third of all rows is pre-aggregated before anything moves.
2. Each kept term is a row with its count in every source of its language, zeros included. The counts of a block of terms
   become a 0/1 matrix: one column for each (source, count level) that occurs in the block. The matrix, transposed, times
   itself has at ((a, i), (b, j)) the number of terms with level i in source a and level j in source b: the joint tables of all
   pairs of sources at once. It is computed tile by tile; all entries are whole numbers up to the rows of a block, which
   32-bit floats hold exactly. Joint tables of blocks add up.
3. A divergence of two sources is a sum over terms of a price that depends on the two levels alone, so each cell of a joint
   table is priced once and multiplied by its number of terms, in 64-bit integers.

Shares and prices are whole numbers: p = 1 + floor(10^9 (count + 2) / (N + 2 V)), f = floor((p - q)^2 / (p + q)). Shares are
computed in decimals, as 10^9 times a count can pass 64 bits; (p - q)^2 stays below 2^60.

Defined cases: null text, lang and source count as ''; a source without kept terms has count zero for each; a language without
kept terms has pairs of value 0 and no terms; a language with one source has no pairs; texts of any length are read whole;
repeated rows count as documents of their own; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievewatch.llm.common import lean, stage, text_batches, text_of

#: A term is kept in a language if so many of its documents hold it.
LEAST_DOCUMENTS = 10
#: Ranks of differing terms that are reported.
TOP = 10
#: Terms of a block, and columns of a tile.
BLOCK_TERMS = 256
TILE = 1024
#: Counts held in a task before they are handed on.
HELD_TERMS = 200_000

_COUNTS = "lang string, source string, term string, n long, documents long"
_VALUES = "lang string, a int, b int, value decimal(38, 0)"
_JOINT = "lang string, a int, a_count long, b int, b_count long, terms long"
#: A-Z in lower case; the other ASCII characters part terms.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Stretches of letters and of characters beyond ASCII, whose bytes in UTF-8 are all above 127."""
    return text.translate(_LETTERS).split(b" ")


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def handed_on(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, documents) in held.items():
            terms = list(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array([documents[t] for t in terms], pa.int64())],
                names=["lang", "source", "term", "n", "documents"],
            )

    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            found = Counter(terms_of(text.as_buffer().to_pybytes()))
            del found[b""]
            counts, documents = held.setdefault((lang, source), (Counter(), Counter()))
            counts.update(found)
            documents.update(found.keys())
        if sum(len(c) for c, _ in held.values()) >= HELD_TERMS:
            yield from handed_on(held)
            held = {}
    yield from handed_on(held)


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, documents) of every term of every source."""
    text_batches(docs.sparkSession)
    slim = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), text_of(text_col).cast("binary").alias("text"))
    found = slim.mapInArrow(lean(_counted), _COUNTS)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kinds)), exactly."""
    part = F.lit(10**9).cast("decimal(10, 0)") * (count.cast("decimal(20, 0)") + 2)
    return F.call_function("div", part, (total + 2 * kinds).cast("decimal(20, 0)")) + 1


def price(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


class Levels(NamedTuple):
    """Counts of kept terms: one row per language (lang, kinds, sources, totals), and one per term with lists in the order of ``sources``."""

    langs: DataFrame
    terms: DataFrame


def count_levels(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS) -> Levels:
    counted = term_counts(docs, text_col, lang_col, source_col)
    by_term = counted.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by_source"))
    kept = stage(by_term.where(F.col("documents") >= least).select("lang", "term", "by_source"), "kept-terms")
    groups = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source")).distinct()
    totals = kept.select("lang", F.explode("by_source").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    kinds = kept.groupBy("lang").agg(F.count("*").alias("kinds"))
    groups = groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    langs = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("held"))
    langs = langs.join(kinds, "lang", "left").select("lang", F.coalesce("kinds", F.lit(0)).alias("kinds"), F.col("held.source").alias("sources"), F.col("held.n").alias("totals"))
    langs = stage(langs, "languages")
    counts = F.expr("transform(sources, s -> coalesce(by_source[s], 0L))").alias("counts")
    shares = F.transform("counts", lambda count, i: share(count, F.get("totals", i), F.col("kinds"))).alias("shares")
    wide = kept.join(langs, "lang").select("lang", "term", "kinds", "sources", "totals", counts)
    return Levels(langs, stage(wide.select("*", shares), "term-levels"))


def _columns(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source, first row with the level, column of each cell) of the one-hot matrix of ``counts`` (terms x sources)."""
    n, wide = counts.shape
    order = np.lexsort((counts.T.ravel(), np.repeat(np.arange(wide), n)))
    level, source = counts.T.ravel()[order], order // n
    new = np.ones(n * wide, bool)
    new[1:] = (level[1:] != level[:-1]) | (source[1:] != source[:-1])
    cell = np.empty(n * wide, np.int64)
    cell[order] = np.cumsum(new) - 1
    first = order[new]
    return first // n, first % n, cell.reshape(wide, n).T


def _hot(cell: np.ndarray, low: int, high: int) -> np.ndarray:
    """Columns ``low`` to ``high`` of the one-hot matrix."""
    out = np.zeros((len(cell), high - low), np.float32)
    row, at = np.nonzero((cell >= low) & (cell < high))
    out[row, cell[row, at] - low] = 1
    return out


def joint_cells(counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row-column, row-column, terms) of all cells that hold terms, over pairs of columns of different sources, each pair once.

    ``counts`` is a block of terms x sources; cells come as column numbers of ``_columns``.
    """
    source, _, cell = _columns(counts)
    size = len(source)
    for low in range(0, size, TILE):
        left = _hot(cell, low, min(low + TILE, size)).T
        for at in range(low, size, TILE):
            if source[min(at + TILE, size) - 1] == source[low]:  # one source's own levels never meet
                continue
            product = left @ _hot(cell, at, min(at + TILE, size))
            i, j = np.nonzero(product)
            terms = product[i, j].astype(np.int64)
            i, j = i + low, j + at
            apart = source[i] < source[j]
            yield i[apart], j[apart], terms[apart]


def _blocks(batches: Iterable[pa.RecordBatch], columns: list[int]) -> Iterator[tuple[str, list[np.ndarray]]]:
    """Blocks of at most BLOCK_TERMS terms of one language: (lang, matrices of the list columns)."""
    for batch in batches:
        lang = np.array(batch.column(0).to_pylist(), object)
        for name in dict.fromkeys(lang.tolist()):
            rows = np.nonzero(lang == name)[0]
            for at in range(0, len(rows), BLOCK_TERMS):
                part = rows[at: at + BLOCK_TERMS]
                lists = [batch.column(c).take(pa.array(part)) for c in columns]
                yield name, [v.flatten().to_numpy().reshape(len(part), -1) for v in lists]


def _priced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    values: dict[str, np.ndarray] = {}
    for lang, (counts, shares) in _blocks(batches, [1, 2]):
        source, row, _ = _columns(counts)
        share_at = shares[row, source]
        total = values.setdefault(lang, np.zeros((counts.shape[1],) * 2, np.int64))
        for i, j, terms in joint_cells(counts):
            p, q = share_at[i], share_at[j]
            # a price is at most p + q, so all prices of a pair sum to 2 * 10^9 and a little per term
            np.add.at(total, (source[i], source[j]), terms * ((p - q) ** 2 // (p + q)))
    for lang, total in values.items():
        a, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(total[a, b].tolist(), pa.decimal128(38, 0))], names=["lang", "a", "b", "value"])


def _tabled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, (counts,) in _blocks(batches, [1]):
        source, row, _ = _columns(counts)
        level = counts[row, source]
        for i, j, terms in joint_cells(counts):
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(i), pa.string()), pa.array(source[i], pa.int32()), pa.array(level[i]), pa.array(source[j], pa.int32()), pa.array(level[j]), pa.array(terms)],
                names=["lang", "a", "a_count", "b", "b_count", "terms"],
            )


def joint_tables(levels: Levels) -> DataFrame:
    """(lang, source, count, other, other_count, terms): how many kept terms have both counts, for each pair of sources once."""
    found = levels.terms.select("lang", "counts").mapInArrow(lean(_tabled), _JOINT)
    summed = found.groupBy("lang", "a", "a_count", "b", "b_count").agg(F.sum("terms").alias("terms")).join(levels.langs, "lang")
    return summed.select("lang", F.get("sources", "a").alias("source"), F.col("a_count").alias("count"), F.get("sources", "b").alias("other"), F.col("b_count").alias("other_count"), "terms")


def pair_values(levels: Levels) -> DataFrame:
    """(lang, source, item: each other source, value), both ways round; 0 where the shares never differ."""
    priced = levels.terms.select("lang", "counts", "shares").mapInArrow(lean(_priced), _VALUES)
    once = priced.groupBy("lang", "a", "b").agg(F.sum("value").cast("long").alias("value"))
    both = once.unionAll(once.selectExpr("lang", "b", "a", "value"))
    every = levels.langs.select("lang", "sources", F.posexplode("sources").alias("a", "source"))
    every = every.select("lang", "a", "source", F.posexplode("sources").alias("b", "item")).where("a <> b")
    return every.join(both, ["lang", "a", "b"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))


def term_values(levels: Levels) -> DataFrame:
    """(lang, source, item: each term the source uses more than its language, value)."""
    summed = [F.aggregate(c, F.lit(0).cast("long"), lambda s, n: s + n) for c in ("counts", "totals")]
    lang_share = share(*summed, F.col("kinds"))
    rows = levels.terms.select("lang", F.col("term").alias("item"), lang_share.alias("q"), F.explode(F.arrays_zip("sources", "counts", "shares")).alias("g"))
    rows = rows.where("g.counts > 0 AND g.shares > q").select("lang", F.col("g.sources").alias("source"), "item", F.col("g.shares").alias("p"), "q")
    return rows.select("lang", "source", "item", price("p", "q").alias("value"))


def source_divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP,
) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has every other source, part `term` the ``top`` terms of the source."""
    levels = count_levels(docs, text_col, lang_col, source_col, least)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_values(levels).withColumn("rank", rank).withColumn("part", F.lit("pair"))
    terms = term_values(levels).withColumn("rank", rank).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


#: The same by SQL, a sum over all terms of all pairs of sources.
DIVERGENCE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), t AS (
  SELECT row_no, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row_no) >= {LEAST_DOCUMENTS}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT g.lang, count(k.term)::HUGEINT AS v, coalesce(sum(k.n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang FROM g) g LEFT JOIN k USING (lang) GROUP BY g.lang),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (s.n + 2 * v.v) AS p, 1 + (1000000000 * (k.n + 2)) // (v.n + 2 * v.v) AS q
  FROM g JOIN k USING (lang) JOIN s USING (lang, source) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source
), term AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= {TOP}
"""
