"""The engine's own queries over the driver's tables, and the SQL they are held against.

Scores are rounded to six places, as sums in another order differ in the last bit; lists
are joined to texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..analysis import analyse
from ..config import Settings
from ..functions import compare, tags as tagging, text
from ..operators import callgraph, embed as embedding, evidence, explain, similarity
from ..session import written
from ..sinks import report
from ..sources import tree
from .units import DOCS_SQL, GRAPH_SQL, UNITS_SQL, tags_sql, table, units

#: The vectors' greatest cosine is below the usual threshold.
THRESHOLD, TOP, CONTEXT = 0.3, 20, 0
LISTS = ("callers", "callees", "patterns", "caller_patterns", "callee_patterns", "caller_packages", "callee_packages")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _joined(*columns: str) -> list[Column]:
    return [F.array_join(c, ",").alias(c) for c in columns]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), "embedding")


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units as a table, as graphs read them more than once."""
    return written(units(spark, sf_dir))


_COSINES = f"""SELECT a.vec_id AS a_ord, b.vec_id AS b_ord, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {THRESHOLD}"""
_BEST = f"(SELECT * FROM ({_COSINES}) ORDER BY score DESC, a_ord, b_ord LIMIT {TOP})"


@query(f"SELECT row_number() OVER (ORDER BY score DESC, a_ord, b_ord)::INT AS rank, a_ord, b_ord, round(score, 6) AS score FROM {_BEST}")
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top pairs of vectors, by block products."""
    return similarity.find_similar(vectors(spark, sf_dir), THRESHOLD, TOP).withColumn("score", F.round("score", 6))


@query(f"SELECT a_ord, b_ord, round(score, 6) AS score FROM ({_COSINES})")
def all_similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair at the threshold or above."""
    return similarity.block_pairs(vectors(spark, sf_dir), THRESHOLD).select("a_ord", "b_ord", F.round("score", 6).alias("score"))


@query(f"SELECT a_ord, b_ord, round(score, 6) AS score FROM {_BEST}")
def similar_pairs_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top pairs without ranks, by block products too: expressions (``similarity.plain_pairs``) take microseconds a pair, so they are what tests hold this against."""
    found = similarity.best(similarity.block_pairs(vectors(spark, sf_dir), THRESHOLD, TOP), THRESHOLD, TOP)
    return found.select("a_ord", "b_ord", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id, array_to_string({tags_sql('text', tagging.RULES)}, ',') AS tags FROM documents")
def tag_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in keyword rules over documents."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tagging.tags("text"), ",").alias("tags"))


@query(UNITS_SQL + "SELECT ord, name, array_to_string(patterns, ',') AS patterns, array_to_string(callees, ',') AS callees FROM units")
def tag_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of units by rules of the caller's own."""
    return units(spark, sf_dir).select("ord", "name", *_joined("patterns", "callees"))


def _cut(n: int) -> str:
    tries = ", ".join(f"try(decode(encode(text)[1:{n - k}]))" for k in range(4))
    return f"CASE WHEN octet_length(encode(text)) <= {n} THEN text ELSE coalesce({tries}) END"


@query(f"SELECT doc_id, {_cut(256)} AS short, {_cut(8192)} AS long FROM documents")
def truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut to bytes without a broken character."""
    cut = {c: text.truncate_bytes("text", n, "rune_safe").cast("string").alias(c) for c, n in (("short", 256), ("long", 8192))}
    return table(spark, sf_dir, "documents").select("doc_id", *cut.values())


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 256 THEN hex(encode(text)) ELSE regexp_replace(hex(encode(text)[1:256]), '(?:[89AB][0-9A-F])+$', '') END AS cut FROM documents")
def truncate_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut to bytes as the embedder gets them."""
    return table(spark, sf_dir, "documents").select("doc_id", F.hex(text.truncate_bytes("text", 256)).alias("cut"))


@query(f"SELECT doc_id, sha256('nomic-embed-text' || chr(0) || '{CONTEXT}' || chr(0) || text) AS cache_key FROM documents")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.cache_key(F.lit("nomic-embed-text"), CONTEXT, "text").alias("cache_key"))


@query(UNITS_SQL + "," + GRAPH_SQL + " SELECT name, array_to_string(callers, ',') AS callers FROM graph")
def call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callgraph.call_graph(_units(spark, sf_dir)).select("name", *_joined("callers"))


@query(UNITS_SQL + "," + GRAPH_SQL + " SELECT * FROM exact")
def exact_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callgraph.exact_edges(units(spark, sf_dir))


@query(UNITS_SQL + "," + GRAPH_SQL + " SELECT * FROM scanned")
def text_scan_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callgraph.text_edges(_units(spark, sf_dir))


@query(UNITS_SQL + "," + DOCS_SQL + " SELECT role, count(*) AS units FROM docs GROUP BY 1")
def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callgraph.concept_docs(_units(spark, sf_dir)).groupBy("role").agg(F.count("*").alias("units"))


@query(UNITS_SQL + "," + DOCS_SQL + " SELECT ord, name, package, doc_comment, exported, receiver_type, role, " + ", ".join(f"array_to_string({c}, ',') AS {c}" for c in LISTS) + " FROM docs")
def concept_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = callgraph.concept_docs(_units(spark, sf_dir))
    return docs.select("ord", "name", "package", "doc_comment", "exported", "receiver_type", "role", *_joined(*LISTS))


_TEXT_SQL = "'Name: ' || name || chr(10) " + "".join(
    f"|| CASE WHEN coalesce({c}, '') <> '' THEN '{h}: ' || {c} || chr(10) ELSE '' END "
    if kind == "line"
    else f"|| CASE WHEN {c} THEN 'Exported: true' || chr(10) ELSE '' END "
    if kind == "flag"
    else f"|| CASE WHEN len({c}) > 0 THEN '{h}:' || chr(10) || '- ' || array_to_string({c}, chr(10) || '- ') || chr(10) ELSE '' END "
    for h, c, kind in (
        ("Doc", "doc_comment", "line"), ("Package", "package", "line"), ("", "exported", "flag"), ("Receiver", "receiver_type", "line"), ("Callers", "callers", "list"), ("Callees", "callees", "list"),
        ("Patterns", "patterns", "list"), ("Role", "role", "line"), ("CallerPatterns", "caller_patterns", "list"), ("CalleePatterns", "callee_patterns", "list"),
        ("CallerPackages", "caller_packages", "list"), ("CalleePackages", "callee_packages", "list"),
    )
)


@query(UNITS_SQL + "," + DOCS_SQL + f" SELECT ord, {_TEXT_SQL} AS text FROM docs")
def concept_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callgraph.concept_docs(_units(spark, sf_dir)).select("ord", text.concept_text().alias("text"))


@query("SELECT p_brand AS package, arg_max(p_name, p_partkey) AS body, max(p_partkey) AS ord FROM part GROUP BY 1")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the units of one key the last."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("package"), F.col("p_name").alias("body"), F.col("p_partkey").alias("ord"))
    return callgraph.last_wins(rows, "package", "body", "ord")


def _shared(c: str) -> str:
    return f"list_sort(list_distinct(list_intersect(a.{c}, b.{c})))"


def _ratio(c: str) -> str:
    return f"CASE WHEN greatest(len(a.{c}), len(b.{c})) > 0 THEN len({_shared(c)}) / greatest(len(a.{c}), len(b.{c})) ELSE 0.0::DOUBLE END"


def _reason(c: str, head: str) -> str:
    return f"CASE WHEN len({_shared(c)}) > 0 THEN {head} || '[' || array_to_string({_shared(c)}, ', ') || ']' END"


_SAME = {"role": "a.role = b.role", "package": "a.package = b.package AND a.package <> ''", "visibility": "a.exported = b.exported", "receiver": "a.receiver_type = b.receiver_type"}
_SCORE = " + ".join(
    [f"{w} * ({_ratio(c)})" for c, w in (("callees", 0.25), ("callers", 0.15), ("patterns", 0.20))] + [f"{w} * ({_SAME[c]})::INT" for c, w in (("role", 0.15), ("package", 0.10), ("visibility", 0.05), ("receiver", 0.05))] + [f"0.025 * ({_ratio(c)})" for c in ("caller_packages", "callee_packages")]
)
_SIGNALS = " + ".join([f"(len({_shared(c)}) > 0)::INT" for c in ("callees", "callers", "patterns")] + [f"({_SAME[c]})::INT" for c in ("role", "package")])
_REASONS = "array_to_string(list_filter([" + ", ".join(
    [_reason(c, f"'share ' || len({_shared(c)}) || ' {c}: '") for c in ("callees", "callers")] + [_reason("patterns", "'share patterns: '"), f"CASE WHEN {_SAME['role']} THEN 'both are ' || a.role || ' functions' END",
    f"CASE WHEN {_SAME['package']} THEN 'same package' END", f"CASE WHEN {_SAME['visibility']} THEN 'same visibility' END", f"CASE WHEN {_SAME['receiver']} THEN 'same receiver type: ' || CASE WHEN a.receiver_type = '' THEN 'plain functions' ELSE a.receiver_type END END",
    _reason("caller_packages", "'called from same packages: '"), _reason("callee_packages", "'call into same packages: '")]
) + "], lambda x: x IS NOT NULL), '; ')"
_EVIDENCE = f"""SELECT a_ord, b_ord, score, least(1.0, {_SCORE}) AS overlap, least(1.0, {_SCORE}) >= 0.4 AND {_SIGNALS} >= 2 AS merge_worthy, {_REASONS} AS reasons
FROM best JOIN docs a ON a.ord = a_ord JOIN docs b ON b.ord = b_ord"""
_COMPARED = f"{UNITS_SQL}, {DOCS_SQL}, best AS (SELECT * FROM ({_COSINES})), compared AS ({_EVIDENCE})"
#: The pairs that are left of the first by score.
_TOP_COMPARED = f"{UNITS_SQL}, {DOCS_SQL}, best AS (SELECT * FROM {_BEST} q WHERE a_ord IN (SELECT ord FROM units) AND b_ord IN (SELECT ord FROM units)), compared AS ({_EVIDENCE})"


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All similar pairs of vectors that have units, with evidence."""
    return evidence.all_with_evidence(vectors(spark, sf_dir), written(callgraph.concept_docs(_units(spark, sf_dir))), THRESHOLD)


@query(_COMPARED + " SELECT a_ord, b_ord, round(score, 6) AS score, round(overlap, 6) AS overlap, merge_worthy, reasons FROM compared")
def compare_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("evidence")
    return _compared(spark, sf_dir).select("a_ord", "b_ord", F.round("score", 6).alias("score"), F.round(e["overlap_score"], 6).alias("overlap"), e["merge_worthy"].alias("merge_worthy"), F.array_join(e["reasons"], "; ").alias("reasons"))


@query(_COMPARED + " SELECT a_ord, b_ord, round(overlap, 6) AS overlap FROM compared WHERE overlap >= 0.35")
def struct_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.struct_min(_compared(spark, sf_dir), 0.35).select("a_ord", "b_ord", F.round("evidence.overlap_score", 6).alias("overlap"))


@query(_TOP_COMPARED + " SELECT a_ord, b_ord, round(overlap, 6) AS overlap FROM compared WHERE overlap >= 0.35")
def struct_min_of_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the top pairs those of enough overlap: fewer than asked for, as the filter comes after the top-N."""
    own = _units(spark, sf_dir)
    pairs = written(evidence.with_units(similarity.find_similar(vectors(spark, sf_dir), THRESHOLD, TOP), own))
    found = evidence.struct_min(evidence.with_evidence(pairs, evidence.docs_of(pairs, callgraph.concept_docs(own))), 0.35)
    return found.select("a_ord", "b_ord", F.round("evidence.overlap_score", 6).alias("overlap"))


@query(UNITS_SQL + "," + DOCS_SQL + ", r AS (SELECT name, len(callers) AS i, len(callees) AS o, role FROM docs) SELECT name, i AS callers, o AS callees, role FROM r")
def fan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fan-in, fan-out and the role they give."""
    own = _units(spark, sf_dir)
    met = own.join(callgraph.call_graph(own), "name").select("name", F.size("callers").alias("callers"), F.size("callees").alias("callees"))
    return met.withColumn("role", compare.role(F.col("callers"), F.col("callees")))


@query(UNITS_SQL + " SELECT ord, CASE WHEN coalesce(package, '') <> '' THEN package || '.' || name ELSE name END AS label, file || ':' || start_line AS place, replace(signature, '|', '\\|') AS signature FROM units")
def unit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, sf_dir).select("ord", text.qualified("package", "name").alias("label"), text.location("file", "start_line").alias("place"), text.escape_markdown("signature").alias("signature"))


@query("SELECT doc_id, array_to_string(list_transform(string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10)), lambda x: '> ' || x), chr(10)) AS quoted FROM documents")
def quote_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.quoted("text"), "\n").alias("quoted"))


@query("SELECT url AS path, row_number() OVER (ORDER BY string_split(url, '/')) - 1 AS file_ord FROM (SELECT DISTINCT url FROM pages)")
def walk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in the order of a walk of folders."""
    found = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.lit(None).cast("binary").alias("content"))
    return tree.numbered(found).select("path", "file_ord").distinct()


_GO_SQL = """SELECT p_partkey AS k, p_partkey || '.go' AS path, 'package ' || lower(p_type) || chr(10) || chr(10) || '// ' || p_name || chr(10) || '//go:noinline' || chr(10)
|| 'func (r *Part) Price' || p_size || '(n int, s []string) (float64, error) {' || chr(10) || chr(9) || 'for i := range s { // ignored(1)' || chr(10) || chr(9) || chr(9) || 'check' || p_size || '(s[i], "quoted(2)")' || chr(10)
|| chr(9) || '}' || chr(10) || chr(9) || 'return r.store.Load(n), fmt.Errorf("%w", []byte(s[0]))' || chr(10) || '}' || chr(10) || chr(10) || 'var x = call(1)' || chr(10) || chr(10) || 'func check' || p_size || '(a, b string) {}' || chr(10) AS source FROM part"""
_PARSED_SQL = f"""WITH g AS (SELECT *, regexp_extract(source, 'Price([0-9]+)', 1) AS z FROM ({_GO_SQL}) s), q AS (SELECT p_partkey, p_name, p_type FROM part)
SELECT path AS file, '*Part.Price' || z AS name, 5 AS start_line, '*Part' AS receiver_type, true AS exported, lower(p_type) AS package, p_name AS doc_comment, '(n int, s []string) (float64, error)' AS signature,
substr(source, position('func (r' IN source), position(chr(10) || '}}' || chr(10) || chr(10) || 'var' IN source) + 2 - position('func (r' IN source)) AS body, 'Load,check' || z || ',fmt.Errorf' AS callees FROM g JOIN q ON p_partkey = k
UNION ALL SELECT path, 'check' || z, 14, '', false, lower(p_type), '', '(a, b string)', 'func check' || z || '(a, b string) {{}}', '' FROM g JOIN q ON p_partkey = k"""


def go_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Go file for each part."""
    p = table(spark, sf_dir, "part")
    p = p.repartition(-(-p.count() // tree.FILES_PER_TASK // 4) or 1)  # a table of narrow rows may be read by one task, and a file's text takes long to parse
    size = F.col("p_size").cast("string")
    source = F.concat(
        F.lit("package "), F.lower("p_type"), F.lit("\n\n// "), F.col("p_name"), F.lit("\n//go:noinline\nfunc (r *Part) Price"), size, F.lit("(n int, s []string) (float64, error) {\n\tfor i := range s { // ignored(1)\n\t\tcheck"), size,
        F.lit('(s[i], "quoted(2)")\n\t}\n\treturn r.store.Load(n), fmt.Errorf("%w", []byte(s[0]))\n}\n\nvar x = call(1)\n\nfunc check'), size, F.lit("(a, b string) {}\n"),
    )
    return p.select(F.col("p_partkey").alias("file_ord"), F.concat(F.col("p_partkey").cast("string"), F.lit(".go")).alias("path"), source.cast("binary").alias("content"))


@query(_PARSED_SQL)
def parse_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of Go files, with all that the scanner tells of them."""
    return tree.parse(go_files(spark, sf_dir)).select("file", "name", "start_line", "receiver_type", "exported", "package", "doc_comment", "signature", "body", *_joined("callees"))


_RAW = "encode(text)"
_SENT = f"CASE WHEN octet_length({_RAW}) <= {embedding.MOST_BYTES} THEN {_RAW} ELSE unhex(regexp_replace(hex({_RAW}[1:{embedding.MOST_BYTES}]), '(?:[89AB][0-9A-F])+$', '')) END"


@query(UNITS_SQL + "," + DOCS_SQL + ", d AS (SELECT " + _TEXT_SQL + f" AS text FROM docs) SELECT DISTINCT sha256(encode('hash' || chr(0) || '0' || chr(0)) || {_SENT}) AS cache_key FROM d")
def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of what is in the cache once all units are embedded."""
    texts = callgraph.concept_docs(_units(spark, sf_dir)).select("ord", text.concept_text().alias("text"))
    return embedding.embed(texts, embedding.HashEmbedder())[1].select("cache_key")


#: Texts' words counted by their hashes, as ``HashEmbedder`` does. All texts of the units are ASCII.
_EMBEDDED = f"""d AS (SELECT ord, {_TEXT_SQL} AS text FROM docs),
words AS (SELECT text, unnest(regexp_extract_all(lower(substr(text, 1, {embedding.MOST_BYTES})), '[a-z0-9_]+')) AS w FROM (SELECT DISTINCT text FROM d)),
signed AS (SELECT text, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS k, sum(CASE WHEN substr(md5(w), 9, 1) >= '8' THEN 1 ELSE -1 END) AS n FROM words GROUP BY 1, 2),
grid AS (SELECT text, unnest(range(64)) AS k FROM (SELECT DISTINCT text FROM d)),
vectors AS (SELECT text, list(coalesce(n, 0)::DOUBLE ORDER BY k) AS v FROM grid LEFT JOIN signed USING (text, k) GROUP BY 1),
embedded AS (SELECT ord, v, sqrt(list_dot_product(v, v)) AS norm FROM d JOIN vectors USING (text))"""


@query(UNITS_SQL + "," + DOCS_SQL + "," + _EMBEDDED + " SELECT ord, CASE WHEN ord % 2 = 0 THEN 'cached' ELSE array_to_string(list_transform(v, lambda x: x::INT), ',') END AS vector FROM embedded")
def warm_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all units where the cache has those of even ``ord``, which it marks: hits come from it, all else is embedded."""
    model = embedding.HashEmbedder()
    texts = embedding.keyed(callgraph.concept_docs(_units(spark, sf_dir)).select("ord", text.concept_text().alias("text")), model)
    cache = texts.filter("ord % 2 = 0").select("cache_key", F.array(F.lit(7.5)).alias("embedding")).distinct()
    found = embedding.embed_keyed(texts, model, cache)[0]
    shown = F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",")
    return found.select("ord", F.when(F.col("embedding")[0] == 7.5, F.lit("cached")).otherwise(shown).alias("vector"))


class _Echo:
    """Stands in for a chat service: the prompt's first line."""

    def generate(self, prompt: str) -> str:
        return prompt.split("\n", 1)[0]


def _analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = Settings(threshold=0.85, top=TOP)
    return analyse(units(spark, sf_dir), settings, embedding.HashEmbedder(), chat=_Echo()).pairs


_ANALYSED = f"""{UNITS_SQL}, {DOCS_SQL}, {_EMBEDDED},
scores AS (SELECT a.ord AS a_ord, b.ord AS b_ord, list_dot_product(a.v, b.v) / (a.norm * b.norm) AS score FROM embedded a JOIN embedded b ON a.ord < b.ord AND a.norm > 0 AND b.norm > 0),
best AS (SELECT * FROM scores WHERE score >= 0.85 ORDER BY score DESC, a_ord, b_ord LIMIT {TOP}), compared AS ({_EVIDENCE}),
pairs AS (SELECT row_number() OVER (ORDER BY score DESC, a_ord, b_ord)::INT AS rank, *, printf('You review code. An embedding finds these two functions similar (score %.4f).', score) AS explanation FROM compared)"""


@query(_ANALYSED + " SELECT rank, a_ord, b_ord, round(score, 6) AS score, round(overlap, 6) AS overlap, explanation, NULL::VARCHAR AS warning FROM pairs")
def explained_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole analysis of the units, embedded by hashing and explained by an echo."""
    return _analysed(spark, sf_dir).select("rank", "a_ord", "b_ord", F.round("score", 6).alias("score"), F.round("evidence.overlap_score", 6).alias("overlap"), "explanation", "warning")


def _unit_text(u: str) -> str:
    """The lines of a unit in the text report."""
    label = f"CASE WHEN coalesce({u}.package, '') <> '' THEN {u}.package || '.' || {u}.name ELSE {u}.name END"
    return f"""['  {u.upper()}  ' || rpad({u}.file || ':' || {u}.start_line, 60, ' ') || '  ' || {label}, '       sig: ' || {u}.signature]
    || CASE WHEN len({u}.patterns) > 0 THEN ['      tags: ' || array_to_string({u}.patterns, ', ')] ELSE [] END"""


def _unit_row(u: str) -> str:
    label = f"CASE WHEN coalesce({u}.package, '') <> '' THEN {u}.package || '.' || {u}.name ELSE {u}.name END"
    tags_ = f"CASE WHEN len({u}.patterns) > 0 THEN array_to_string({u}.patterns, ', ') ELSE '—' END"
    return f"'| **{u.upper()}** | `' || {u}.file || ':' || {u}.start_line || '` | `' || replace({label}, '|', '\\|') || '` | `' || replace({u}.signature, '|', '\\|') || '` | ' || {tags_} || ' |'"


_REASON_LIST = "CASE WHEN reasons = '' THEN [] ELSE string_split(reasons, '; ') END"
_REPORTS = f"""{_ANALYSED}, met AS (SELECT rank, score, overlap, merge_worthy, {_REASON_LIST} AS rs, explanation, a, b FROM pairs JOIN units a ON a.ord = a_ord JOIN units b ON b.ord = b_ord), n AS (SELECT count(*) AS functions FROM units), p AS (SELECT count(*) AS found FROM pairs),
blocks AS (SELECT 'text' AS kind, 0 AS part, ['', 'Code Similarity Report', repeat('=', 22), 'Functions analyzed: ' || functions || '  |  Threshold: 0.85', ''] AS ls FROM n
UNION ALL SELECT 'text', rank, ['#' || rpad(rank::VARCHAR, 3, ' ') || '  score: ' || printf('%.4f', score)] || {_unit_text("a")} || {_unit_text("b")} || ['  structural overlap: ' || printf('%.2f', overlap) || CASE WHEN merge_worthy THEN ' (merge-worthy)' ELSE '' END]
    || list_transform(rs, lambda x: '    • ' || x) || ['  → ' || explanation, ''] FROM met
UNION ALL SELECT 'text', 1000, ['']
UNION ALL SELECT 'markdown', 0, ['# Code Similarity Report', '', '**Functions analyzed:** ' || functions || ' | **Threshold:** 0.85 | **Pairs found:** ' || found, '', '---', ''] FROM n, p
UNION ALL SELECT 'markdown', rank, ['## Match #' || rank || ' — Score: `' || printf('%.4f', score) || '`', '', '| | Location | Function | Signature | Patterns |', '|---|---|---|---|---|', {_unit_row("a")}, {_unit_row("b")}, '',
    '**Structural overlap:** `' || printf('%.2f', overlap) || '` (' || CASE WHEN merge_worthy THEN '' ELSE 'not ' END || 'merge-worthy)', ''] || list_transform(rs, lambda x: '- ' || x) || CASE WHEN len(rs) > 0 THEN [''] ELSE [] END || ['> ' || explanation, '', '---', ''] FROM met
UNION ALL SELECT 'markdown', 1000, ['']),
lines AS (SELECT kind, part, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM blocks)
SELECT kind, (row_number() OVER (PARTITION BY kind ORDER BY part, i) - 1)::INT AS n, line FROM lines"""


@query(_REPORTS)
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both reports of the analysis, by lines. It is the top-N that is rendered."""
    own = _units(spark, sf_dir)
    found = analyse(own, Settings(threshold=0.85, top=TOP), embedding.HashEmbedder(), chat=_Echo()).pairs
    pairs = [r.asDict(recursive=True) for r in found.orderBy("rank").collect()]
    lines = [(kind, n, line) for kind, f in (("text", report.text), ("markdown", report.markdown)) for n, line in enumerate(f(pairs, 0.85, own.count()).split("\n"))]
    return spark.createDataFrame(lines, "kind string, n int, line string")


_NAME = "CASE WHEN coalesce({0}.package, '') <> '' THEN {0}.package || '.' || {0}.name ELSE {0}.name END"


@query(
    _TOP_COMPARED
    + f""", ranked AS (SELECT row_number() OVER (ORDER BY score DESC, a_ord, b_ord)::INT AS rank, a_ord, b_ord FROM {_BEST} q)
SELECT rank, {_NAME.format("a")} || ' ~ ' || {_NAME.format("b")} || ':' || array_to_string(list_transform({_REASON_LIST}, lambda x: ' [' || x || ']'), '') AS explanation, NULL::VARCHAR AS warning
FROM ranked JOIN compared USING (a_ord, b_ord) JOIN units a ON a.ord = a_ord JOIN units b ON b.ord = b_ord"""
)
def rendered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's template filled in for each pair of the top-N."""
    template = "{{.A.Name}} ~ {{.B.Name}}{{if .Evidence}}:{{range .Evidence.Reasons}} [{{.}}]{{end}}{{end}}"

    class Whole:
        def generate(self, prompt: str) -> str:
            return prompt

    pairs = written(evidence.with_units(similarity.find_similar(vectors(spark, sf_dir), THRESHOLD, TOP), own := _units(spark, sf_dir)))
    pairs = evidence.with_evidence(pairs, evidence.docs_of(pairs, callgraph.concept_docs(own)))
    return explain.explain(pairs, Whole(), template).select("rank", "explanation", "warning")
