"""Mixing sources to target weights, by Poisson replication.

A source with weight w and c characters shall give w of all characters, so each
of its documents is wanted w * total / c times on average. How often a document
comes is that Poisson distribution, inverted at a number that a seeded hash of
its id gives; the copies are then shuffled by hash. All of it is in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import DOCUMENT_COLUMNS, checkpoint, pick

SEED = "mix-1"
#: Without explicit weights, a source weighs its characters to this power.
POWER = 0.5
#: Above this rate a document's count is the sum of several draws, as exp(-rate) would vanish.
PART = 500.0
#: A table of the sources' distributions of so many bytes at most is broadcast; a larger one is joined by salted keys.
BROADCAST, SALTS = 16_000_000, 16
_NONE = "(none)"


def uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) from the MD5 of the parts."""
    return (_bits(*parts) + F.lit(0.5)) / F.lit(float(1 << 52))


def _bits(*parts: Column | str) -> Column:
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def _name(column: str = "source") -> Column:
    return F.coalesce(F.col(column), F.lit(_NONE))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = POWER) -> DataFrame:
    """``(source, rate, parts, cdf)``: how often a source's documents are wanted, and the distribution of each of their draws.

    ``weights`` needs no unit; sources that it lacks weigh nothing. The total
    of characters stays what it is, over the sources that weigh something.
    """
    sizes = pick(docs, "text", "source").groupBy(_name().alias("source")).agg(F.sum(F.length(F.coalesce("text", F.lit("")))).cast("double").alias("size"))
    if weights is None:
        weight = F.pow("size", F.lit(power))
    elif weights:
        given = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
        weight = F.coalesce(given[F.col("source")], F.lit(0.0))
    else:
        weight = F.lit(0.0)
    sizes = checkpoint(sizes.withColumn("weight", weight))
    all_size, all_weight = (x or 0.0 for x in sizes.agg(F.sum("size"), F.sum("weight")).first())
    rate = F.when((F.col("size") > 0) & F.lit(all_weight > 0), F.col("weight") / F.lit(all_weight or 1.0) * F.lit(all_size) / F.col("size")).otherwise(0.0)
    out = sizes.withColumn("rate", rate)
    out = out.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART).cast("int"))).withColumn("r", F.col("rate") / F.col("parts"))
    start = F.struct(F.exp(-F.col("r")).alias("p"), F.array(F.exp(-F.col("r"))).alias("c"))
    steps = F.sequence(F.lit(1), F.ceil(F.col("r") + 12 * F.sqrt("r") + 30).cast("int"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("r") / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return out.select("source", "rate", "parts", F.aggregate(steps, start, step)["c"].alias("cdf"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, power: float = POWER, seed: str = SEED, broadcast: int = BROADCAST) -> DataFrame:
    """``documents`` -> its five columns, ``copy``, ``rate`` and ``shuffle_key``, a row for each copy, in shuffled order.

    A null source is a source of its own. Rows that share a ``doc_id`` (null
    too) come equally often, as the hash is of the id. Sources without weight
    or characters give nothing; an empty table gives no rows. The order is by
    ``shuffle_key`` within partitions that are chosen by its hash. Null and empty texts have no characters but come as often as others
    of their source; texts of any length are whole; further columns are left out. The rows don't depend on ``broadcast``.
    """
    table = checkpoint(rates(docs, weights, power).withColumnsRenamed({"source": "m_source", "rate": "m_rate", "parts": "m_parts", "cdf": "m_cdf"}))
    rows = pick(docs, *DOCUMENT_COLUMNS)
    if (table.agg(F.sum(8 * F.size("m_cdf") + F.octet_length("m_source") + 100)).first()[0] or 0) <= broadcast:
        rows = rows.join(F.broadcast(table), _name() == F.col("m_source"))
    else:
        table = table.withColumn("m_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        rows = rows.join(table, (_name() == F.col("m_source")) & (salt == F.col("m_salt")))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    draws = F.transform(F.sequence(F.lit(1), F.col("m_parts")), lambda j: uniform(seed, key, j.cast("string")))
    count = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter("m_cdf", lambda c: u >= c)))
    rows = rows.withColumn("m_count", count).filter("m_count > 0")
    rows = rows.select(*DOCUMENT_COLUMNS, F.round("m_rate", 6).alias("rate"), F.explode(F.sequence(F.lit(1), F.col("m_count"))).alias("copy"))
    rows = rows.withColumn("shuffle_key", _bits(seed, "order", key, F.col("copy").cast("string")))
    return rows.repartition("shuffle_key").sortWithinPartitions("shuffle_key", "doc_id", "copy")


def mixed_documents(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The copies that ``mix`` gives, with the five columns of ``documents``; nulls, empty and long texts, repeated rows, empty tables and further columns are as there."""
    return mix(docs, weights).select(*DOCUMENT_COLUMNS)


#: The default mix in DuckDB, over a relation ``documents``.
SQL = f"""
WITH d AS (SELECT doc_id, text, lang, source, n_chars, coalesce(source, '{_NONE}') AS m_source, coalesce(doc_id::VARCHAR, 'null') AS k FROM documents),
sizes AS (SELECT m_source, sum(length(coalesce(text, '')))::DOUBLE AS size FROM d GROUP BY 1),
weighed AS (SELECT *, pow(size, {POWER}) AS weight FROM sizes),
r0 AS (SELECT m_source, CASE WHEN size > 0 THEN weight / (SELECT sum(weight) FROM weighed) * (SELECT sum(size) FROM weighed) / size ELSE 0.0 END AS rate FROM weighed),
r1 AS (SELECT *, greatest(1, ceil(rate / {PART})::INT) AS parts FROM r0),
r2 AS (SELECT *, rate / parts AS r FROM r1),
pmf AS (SELECT m_source, i, CASE WHEN r = 0 THEN (CASE WHEN i = 0 THEN 1.0 ELSE 0.0 END) ELSE exp(-r + i * ln(r) - lgamma(i + 1)) END AS p
        FROM r2, LATERAL (SELECT unnest(generate_series(0, ceil(r + 12 * sqrt(r) + 30)::BIGINT)) AS i)),
cdf AS (SELECT m_source, sum(p) OVER (PARTITION BY m_source ORDER BY i) AS c FROM pmf),
tables AS (SELECT m_source, list(c) AS cs FROM cdf GROUP BY 1),
draws AS (SELECT d.*, rate, list_sum(list_transform(range(1, parts + 1), lambda j: len(list_filter(cs,
        lambda c: (('0x' || substr(md5('{SEED}:' || k || ':' || j), 1, 13))::BIGINT + 0.5) / {1 << 52}.0 >= c)))) AS n
        FROM d JOIN r2 USING (m_source) JOIN tables USING (m_source)),
copies AS (SELECT *, unnest(generate_series(1, n::BIGINT))::INT AS copy FROM draws WHERE n > 0)
SELECT doc_id, text, lang, source, n_chars, round(rate, 6) AS rate, copy,
       ('0x' || substr(md5('{SEED}:order:' || k || ':' || copy), 1, 13))::BIGINT AS shuffle_key FROM copies
"""
