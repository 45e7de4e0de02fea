"""Keyword tags of function bodies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Tag and its literal, case-sensitive keywords; "~" parts them, as spaces count. Tags come out in this order.
_TABLE = """
retry: BackOff~MaxRetries~Retry~backoff~maxRetries~retry~retryCount
http_call: HttpClient~axios~fetch(~http.Do~http.Get~http.NewRequest~http.Post~requests.get~requests.post~urllib
db_access: .FindAll~.findById~DELETE ~INSERT ~SELECT ~UPDATE ~cursor.execute~db.Exec~db.Query~sql.DB~sql.Open
validation: ErrInvalid~IsValid~Must(~Validate~assert(~isValid~required~validate
mapping: Convert~FromDTO~ToDTO~Transform~convert~json.Marshal~json.Unmarshal~toMap~transform
transaction: .Begin(~.Commit(~.Rollback(~BEGIN TRANSACTION~COMMIT~ROLLBACK~Transaction(~tx.
caching: .TTL~Cache{~Expire~Redis(~cache.~expire~memcache~redis.~sync.Map
concurrency: .Lock()~<-chan~Promise.~Thread(~WaitGroup~async ~atomic.~await ~chan ~go func~select {~sync.Mutex
error_wrapping: %w"~WithMessage(~WithStack(~Wrapf(~errors.As~errors.Is~errors.Wrap~fmt.Errorf
"""
RULES: tuple[tuple[str, tuple[str, ...]], ...] = tuple((tag, tuple(words.split("~"))) for tag, words in (line.split(": ", 1) for line in _TABLE.strip("\n").split("\n")))


def tags(body: Column | str, rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES) -> Column:
    """The tags whose rule has a keyword in ``body``, each once, in the order of the rules; none for a null."""
    text = F.coalesce(F.col(body) if isinstance(body, str) else body, F.lit(""))
    hits = [F.when(reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words]), F.lit(tag)) for tag, words in rules if words]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
