"""URL filter: a weighted vocabulary of strict and soft terms.

One Aho-Corasick pass over the whole URL in lower case finds the
terms; one counts only where no letter or digit stands beside it. A URL is
rejected on one strict term, or when the weights of its distinct soft terms
reach a limit that several of them are needed for. The vocabulary is a table of terms: the file
beside this module, another one, or a DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import pick

#: The vocabulary in use if no other is given: general terms, with the weights of soft ones.
TERMS = Path(__file__).with_name("url_terms.tsv")
#: A vocabulary has so many terms at most, as every task has all of them.
MOST_TERMS = 1_000_000
#: Distinct soft terms, two at least, reject once their weights reach it.
LIMIT = 1.0
Vocabulary = tuple[frozenset[str], dict[str, float]]


def _vocabulary(rows) -> Vocabulary:
    """Strict terms, and soft ones with their weights, from rows ``(term, kind, weight)``; in lower case, empty terms left out, of repeated ones the greatest weight."""
    strict, soft = set(), {}
    for term, kind, weight in rows:
        term = (term or "").strip().lower()
        if kind not in ("strict", "soft"):
            raise ValueError(f"a term is strict or soft, not {kind!r}")
        if term and kind == "strict":
            strict.add(term)
        elif term:
            soft[term] = max(soft.get(term, 0.0), float(weight))
    return frozenset(strict), soft


def read_terms(path: str | Path = TERMS) -> Vocabulary:
    """A vocabulary from a file of tab-separated lines "term, kind, weight" below one of their names; strict terms need no weight."""
    with open(path, encoding="utf-8") as f:
        next(f)
        return _vocabulary(line.rstrip("\n").split("\t") for line in f if line.strip())


def terms_of(table: DataFrame, most: int = MOST_TERMS) -> Vocabulary:
    """A vocabulary from a table ``(term, kind, weight)`` of ``most`` rows at most; a larger one is an error."""
    rows = pick(table, "term", "kind", "weight").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms")
    return _vocabulary(rows)


_BESIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


@lru_cache(maxsize=8)
def _automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    table = ahocorasick.Automaton()
    for w in words:
        table.add_word(w, w)
    if words:
        table.make_automaton()
    return table


def terms(url: str, words: tuple[str, ...]) -> dict[str, int]:
    """How often each of ``words`` (lower case) stands in ``url`` with neither letter nor digit beside it."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url) if not url.islower() else url
    counts: dict[str, int] = {}
    if not words:
        return counts
    for end, w in _automaton(words).iter(low):
        a, b = end + 1 - len(w), end + 1
        if (a == 0 or low[a - 1] not in _BESIDE) and (b == len(low) or low[b] not in _BESIDE):
            counts[w] = counts.get(w, 0) + 1
    return counts


def _judge(strict: frozenset[str], soft: dict[str, float], limit: float):
    words = tuple(sorted({*strict, *soft}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hard, mild, weight, found, bad = [], [], [], [], []
            for url in batch.column(1).to_pylist():
                counts = terms(url or "", words)
                own = [w for w in sorted(counts) if w in soft]
                hard.append(sum(n for w, n in counts.items() if w in strict))
                mild.append(len(own))
                weight.append(round(sum(soft[w] for w in own), 6))
                found.append(",".join(sorted(counts)))
                bad.append(hard[-1] > 0 or len(own) > 1 and weight[-1] >= limit)
            columns = [pa.array(hard, pa.int64()), pa.array(mild, pa.int64()), pa.array(weight, pa.float64()), pa.array(found, pa.string()), pa.array(bad, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "strict_hits", "soft_terms", "soft_weight", "terms", "is_rejected"])

    return run


def judge(pages: DataFrame, vocabulary: Vocabulary | None = None, limit: float = LIMIT) -> DataFrame:
    """``pages`` -> ``(page_id, url, strict_hits, soft_terms, soft_weight, terms, is_rejected)`` for each row.

    ``strict_hits`` counts every place, ``soft_terms`` and ``soft_weight`` distinct
    soft terms, each once. Null and empty URLs have no hits and are kept. A term of both
    kinds counts in both. Repeated rows are judged alike; very long URLs are read whole; an empty table gives no rows; only
    the two columns are read, whatever others there are.
    """
    rows = pick(pages, "page_id", "url")
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_judge(*(vocabulary or read_terms()), limit), f"page_id {kind}, url string, strict_hits long, soft_terms long, soft_weight double, terms string, is_rejected boolean")


def keep(pages: DataFrame, **how) -> DataFrame:
    """The rows of ``judge`` that are not rejected."""
    return judge(pages, **how).filter(~F.col("is_rejected"))


def _sql() -> str:
    hard, mild = read_terms()
    rows = [(w, w in hard, mild.get(w)) for w in sorted({*hard, *mild})]
    values = ", ".join(f"('{w}', {str(s).lower()}, {'NULL' if x is None else x}::DOUBLE)" for w, s, x in rows)
    # Beside a term there may be one character that two hits share, so the text's such characters are doubled before hits are counted.
    return f"""
WITH vocabulary(term, strict, weight) AS (VALUES {values}),
p AS (SELECT row_number() OVER () AS r, page_id, url, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM pages),
q AS (SELECT r, regexp_replace(low, '([^a-z0-9])', '\\1\\1', 'g') AS wide, low FROM p),
hits AS (SELECT r, term, strict, weight, len(regexp_extract_all(wide, '(^|[^a-z0-9])' || regexp_replace(term, '([^a-z0-9])', '\\1\\1', 'g') || '($|[^a-z0-9])')) AS n FROM q JOIN vocabulary ON contains(low, term)),
sums AS (SELECT r, sum(CASE WHEN strict THEN n ELSE 0 END)::BIGINT AS hard, count(weight) AS mild, round(coalesce(sum(weight), 0), 6) AS w, string_agg(term, ',' ORDER BY term) AS t FROM hits WHERE n > 0 GROUP BY r)
SELECT page_id, url, coalesce(hard, 0) AS strict_hits, coalesce(mild, 0) AS soft_terms, coalesce(w, 0.0) AS soft_weight, coalesce(t, '') AS terms,
       coalesce(hard > 0 OR (mild > 1 AND w >= {LIMIT}), false) AS is_rejected
FROM p LEFT JOIN sums USING (r)
"""


SQL = _sql()
